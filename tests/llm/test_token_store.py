import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from durata.llm import shared, token_store
from tests.conftest import SF_SMALL

PATH = P.path("word_bpe_49k.json")
END = 1


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "Don't STOP  now\n", "naïve Ünïcode İK", "a\x1cb c\x85d", "x" * 3000,
                                  "é ́e", "ΑΣ ΑΣ.", "<|endoftext|> <|startoftext|>", "12 345", "日本 語", "a. b, c.. d., e.,. 3. é. it's. x.'s"])
def test_word_by_word_equals_whole_text(library, encoder, text):
    texts = ("x.", text, "", "y")
    for got, want in zip(encoder([t.encode() for t in texts]), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library(want)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sAbté.,!<|>0Kİ"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(library, encoder, text):
    assert np.frombuffer(encoder([text.encode()])[0], "<u4").tolist() == library(text)


@pytest.fixture(scope="module")
def encoder():
    return token_store.WordEncoder(PATH)


def check(spark, rows, path, library):
    want, start = [], 0
    for key, text in rows:
        ids = np.array(library(text or "") + [END], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_store.read(spark, path, with_ids=False).collect()), key=lambda r: r[1])
    assert got == want


def test_whole_small_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    path = shared.fresh_path(spark, "t")
    token_store.write(docs, path, PATH, END)
    check(spark, sorted((r.doc_id, r.text) for r in docs.collect()), path, library)
    assert len(spark.read.parquet(f"{path}/dictionary").first().bytes) > 1000
    some = token_store.read(spark, path, doc_ids=[3, 5, 10 ** 9]).collect()
    assert sorted(r.doc_id for r in some) == [3, 5]
    texts = {r.doc_id: r.text for r in docs.filter("doc_id in (3, 5)").collect()}
    assert all(list(r.ids) == library(texts[r.doc_id]) + [END] for r in some)


def test_nulls_empty_texts_and_repeats(spark, library):
    rows = [(5, "one two"), (2, None), (None, "lost"), (7, ""), (5, "one two"), (9, "z " * 30_000)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, start string")
    path = shared.fresh_path(spark, "t")
    token_store.write(docs.repartition(3), path, PATH, END)
    check(spark, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), path, library)


def test_empty_table(spark, docs_of):
    path = shared.fresh_path(spark, "t")
    token_store.write(docs_of(["a"]).filter("false"), path, PATH, END)
    assert token_store.read(spark, path).count() == 0
    assert token_store.read(spark, path, doc_ids=[]).count() == 0


def test_width_follows_the_tokenizer(spark, tmp_path):
    """Ids above 65,535 are kept whole, whether the tokenizer's or the end id."""
    big = json.loads(open(P.path("word_bpe_49k.json")).read())
    big["model"]["vocab"] = {t: i if i < 15_000 else i + 60_000 for t, i in big["model"]["vocab"].items()}
    big["added_tokens"] = []
    where = str(tmp_path / "big.json")
    with open(where, "w") as f:
        json.dump(big, f)
    assert token_store.id_width(P.path("word_bpe_49k.json"), 1) == 2 and token_store.id_width(where, 1) == 4
    assert token_store.id_width(P.path("word_bpe_49k.json"), 70_000) == 4
    docs = spark.createDataFrame([(i, "extraordinary zebra stories and rarities " * (i + 1)) for i in range(5)], "doc_id long, text string")
    for name, tokenizer, end in (("a", where, 1), ("b", P.path("word_bpe_49k.json"), 70_000)):
        token_store.write(docs, str(tmp_path / name), tokenizer, end)
        lib = Tokenizer.from_file(tokenizer)
        got = {r.doc_id: list(r.ids) for r in token_store.read(spark, str(tmp_path / name)).collect()}
        want = {r.doc_id: [*lib.encode(r.text, add_special_tokens=False).ids, end] for r in docs.collect()}
        assert got == want and max(map(max, got.values())) > 65_535
