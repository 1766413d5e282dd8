import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from durata.llm import bpe, hashing

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.Encoder(bpe.Vocabulary(ranks, P.PATTERN)), tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, text):
    mine, lib = both
    texts = ["x y", text, "z"]
    ids, ends = mine.encode(texts)
    lists = [x.tolist() for x in np.split(ids, ends)[:3]]
    assert lists == [lib.encode_ordinary(t) for t in texts]
    assert list(mine.digests(ids, ends)) == [
        (hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        for x, t in zip(lists, texts, strict=True)]
    assert mine.v.decode(np.array(lists[1], np.int32)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabtheL1é汉🙂."), st.characters(codec="utf-8")), max_size=60))
def test_same_ids_as_the_library(both, text):
    same(both, text)


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a  b", "a \n b", "\n\n x", "don't we'll", "x" * 5000, "ab" * 3000, "the" * 2000,
    "abcdefghijklmnopqrstuvwxyz" * 60, "é" * 700, "汉字" * 400, "1234567890" * 200, "a  b", "a \x1cb", "\x85 x"])
def test_edges(both, text):
    same(both, text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abehnorst", min_size=100, max_size=400))
def test_long_pieces(both, text):
    same(both, text)


def test_operator(spark, docs_of, both):
    texts = ["Hello world", None, "", "Hello world", "naïve  words\n" * 50]
    got = {r.doc_id: r for r in bpe.encode(docs_of(texts), PATH, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = both[1].encode_ordinary(t or "")
        assert list(got[i].ids) == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table_and_clashing_columns(spark, docs_of):
    d = docs_of(["a b"]).selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS ids")
    assert bpe.encode(d, PATH, P.PATTERN).collect()[0].n_tokens == 2
    assert bpe.encode(d.filter("false"), PATH, P.PATTERN).count() == 0


def test_worker_keeps_only_pieces_that_come_up_again(spark):
    """What a task met in one block alone does not stay in its worker."""
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, work, _):
            return work

    enc = bpe.encoder(PATH, P.PATTERN)
    enc._forget()
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, i: "zq" + letters[k] + letters[i // 676] + letters[i // 26 % 26] + letters[i % 26]
    often, size = " common words here ", 12_000
    texts = [often * 40_000 + " ".join(word(k, i) for i in range(size)) for k in range(3)] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1, 2, 3], "text": texts})
    work = bpe.encode(Docs(), PATH, P.PATTERN)
    first = [x.column(2).to_pylist() for x in work(iter([batch]))]
    assert " common" in enc.place and len(enc.place) < size
    assert len(enc.place) == len(enc.lengths) == len(enc.used) and enc.lengths.sum() == len(enc.ids)
    # the second time with what stayed: same ids
    assert [x.column(2).to_pylist() for x in work(iter([batch]))] == first


def test_text_blocks_hold_one_block_of_texts():
    texts = [None, "a" * 10, "é" * 3, "", "b" * 30]
    column = pa.array(texts)
    whole = hashing.utf8(column)
    found = list(hashing.text_blocks(column, 12))
    assert [(lo, hi) for lo, hi, _ in found] == list(hashing.blocks(whole, 12))
    assert [t for _, _, part in found for t in part] == whole
    assert all(len(part) == hi - lo for lo, hi, part in found)
