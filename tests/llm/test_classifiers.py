import zlib

import numpy as np
import pytest

from durata.llm import quality_mil, queries, toxicity
from tests.conftest import SF_ORACLE


@pytest.mark.parametrize("query,label,fold,least", [
    (queries.op2_toxicity, "toxic", (5, 0), 0.93), (queries.op6_quality_mil, "quality", (3, 1), 0.9)])
def test_held_out_accuracy(spark, query, label, fold, least):
    rows = query(spark, SF_ORACLE).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= least


@pytest.mark.parametrize("module", [toxicity, quality_mil])
def test_defined_results(spark, module):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a b c", 0.5), (3, "a b c", 0.5), (4, "z " * 50_000, 0.5)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, label int")
    for labels, want in ((none, 0.5), (spark.createDataFrame([(3, 1), (2, None)], "doc_id long, label int"), 1.0)):
        got = module.score(docs, module.learn(docs, labels)).collect()
        assert len(got) == 5 and all(r.score == want for r in got)
    both = spark.createDataFrame([(3, 1), (4, 0), (1, 0)], "doc_id long, label int")
    got = module.score(docs, module.learn(docs, both)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert module.score(docs.filter("false"), module.learn(docs, both)).count() == 0


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    x, first = r.normal(size=(9, quality_mil.N_FEATURES)), np.array([0, 2, 3, 9])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    m = quality_mil.Attention()

    def loss():
        p = m.forward(x, first)["y"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()
    g = m._gradients(m.forward(x, first), y, w)
    for k in m.NAMES:
        at = tuple(0 for _ in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up = loss()
        m.p[k][at] = old - 1e-5
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_attention_sums_to_one():
    x, first = quality_mil.encode_passages([b"", b"one two", b"word " * 1000])
    assert np.diff(first).tolist() == [1, 1, 16]
    f = quality_mil.Attention().forward(x, first)
    assert np.allclose(np.add.reduceat(f["a"], f["lo"]), 1)


def test_windows_cover_the_text():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        t = bytes(range(256))[:n] if n < 256 else b"ab" * (n // 2)
        ws = toxicity.windows(t)
        covered = set()
        for i, w in enumerate(ws):
            covered |= set(range(i * toxicity.STEP, i * toxicity.STEP + len(w)))
        assert covered == set(range(n))


def test_plain_marks_the_beginnings_of_words():
    assert toxicity.plain("Über der\tMORGENSTERN, x9y".encode()) == "ÜBER DER MORGENstern, X9Y".encode()
    assert toxicity.plain(b"") == b"" and toxicity.plain(toxicity.plain(b"Morgenstern")) == b"MORGENstern"


def _varied(n, toxic, seed):
    """Texts of 150 words; toxic ones hold one of 60 words three times."""
    r = np.random.default_rng(seed)
    words = np.random.default_rng(77)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    common = ["".join(words.choice(letters, words.integers(3, 10))) for _ in range(2000)]
    bad = ["".join(words.choice(letters, words.integers(6, 11))) for _ in range(60)]
    share = 1 / np.arange(1, 2001)
    out = []
    for _ in range(n):
        text = list(r.choice(common, 150, p=share / share.sum()))
        for _ in range(3 if toxic else 0):
            text.insert(r.integers(len(text)), bad[len(out) % 60])
        out.append(" ".join(text))
    return out


def test_varied_wording_is_learned_at_two_sizes(spark):
    for n in (480, 960):
        texts = [(i, t, i % 2) for i, t in enumerate(
            t for pair in zip(_varied(n, False, n), _varied(n, True, n + 1), strict=True) for t in pair)]
        docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, label int")
        model = toxicity.learn(docs, labels)
        caught = np.mean([model.score(t.encode())[0] >= 0.5 for t in _varied(120, True, 3)])
        false = np.mean([model.score(t.encode())[0] >= 0.5 for t in _varied(120, False, 4)])
        assert caught >= 0.8 and false <= 0.05


def test_a_text_that_does_not_fit_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 1000)
    rows = spark.createDataFrame([(1, "a" * 400), (2, "b" * 5000), (3, "c" * 500), (4, "d" * 300), (5, None)], "h long, text string")
    assert toxicity._texts(rows) == [toxicity.plain(t) for t in (b"a" * 400, b"c" * 500, b"")]


def test_toxic_segments_stay_out_of_the_ordinary_dictionary():
    toxic = [b"ALPHA GRUMBLexx%d BETA" % (i % 9) for i in range(40)]
    ordinary = [b"ALPHA BETA GAMMA %d DELTA" % i for i in range(400)] + [b"X GRUMBLexx Y"]
    segments = toxicity.toxic_segments(toxic, ordinary)
    assert any(b"GRUMBL" in s for s in segments) and not any(b"ALPHA" in s for s in segments)
    pieces = toxicity.without_segments(ordinary, segments)
    assert not any(b"GRUMBL" in p for p in pieces) and len(pieces) == 400
