import random
import re

import numpy as np
import pytest

from durata.llm import ngram_join
from durata.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        t = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def near_copies(seed, n_bases=6, copies=7, words=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    hot = [r.choice(vocab) for _ in range(25)]
    texts = []
    for _ in range(n_bases):
        base = [r.choice(vocab) for _ in range(words)]
        if r.random() < 0.7:
            base[10:10] = hot
        for _ in range(r.randint(1, copies)):
            c = list(base)
            for _ in range(r.randint(0, 3)):
                c[r.randrange(len(c))] = r.choice(vocab)
            texts.append(r.choice([" ", "\n", "  "]).join(c))
    return texts


def run(spark, rows, columns="doc_id long, text string"):
    df = spark.createDataFrame(rows, columns).repartition(3)
    return sorted((tuple(r) for r in ngram_join.similar(df).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    texts = near_copies(seed) + [None, "", " \n", "one", "one", "ONE", "a b c d", "a b c d", "a b c", "x " * 3000]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    assert run(spark, rows) == brute(rows)


def test_small_chunks_give_the_same(spark, monkeypatch):
    rows = list(enumerate(near_copies(11, n_bases=4, copies=12)))
    want = brute(rows)
    monkeypatch.setattr(ngram_join, "CHUNK", 300)
    assert run(spark, rows) == want


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "q r s t u v"), (3, None), (None, "solo x")]
    got = run(spark, rows)
    assert got.count((7, 2, 7)) == 3 and (None, 2, 7) in got and (3, 0, 3) in got and (None, 1, None) in got


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, cls string, component_id string")
    assert [tuple(r) for r in ngram_join.similar(df).collect()] == [(1, 1, 1)]
    assert ngram_join.similar(df.filter("false")).count() == 0


def test_filters_keep_all_links():
    r = np.random.default_rng(3)
    for _ in range(40):
        base = r.integers(0, 2 ** 56, 40, dtype=np.uint64)
        sets = [np.unique(np.where(r.random(40) < 0.06, r.integers(0, 2 ** 56, 40, dtype=np.uint64), base)) for _ in range(8)]
        every, df = np.unique(np.concatenate(sets), return_counts=True)
        f = dict(zip(every.tolist(), df.tolist(), strict=True))
        shared = [np.array(sorted((h for h in s.tolist() if f[h] > 1), key=lambda h: (f[h], h)), np.uint64) for s in sets]
        g = ngram_join._Group([len(s) for s in sets], [len(s) - len(x) for s, x in zip(sets, shared, strict=True)], shared)
        g.links(np.zeros(8, int))
        root = list(range(8))
        for i in range(8):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = root[i], root[j]
                    root = [b if x == a else x for x in root]
        assert [[x == y for y in g.label] for x in g.label] == [[x == y for y in root] for x in root]


def test_pack_round_trip():
    a, b = np.array([1, 2 ** 60, 5], "<u8"), np.array([7, 0, 2 ** 31], "<u4")
    x, y = ngram_join.unpack(ngram_join.pack(a, b), "<u8", "<u4")
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
