import hashlib
import re

import numpy as np
import pytest

from durata.llm import quality_rules as qr
from durata.llm import sharding as sh


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(7)]
    a = sh.fill_table(names, 1009)
    n = np.bincount(a)
    assert n.max() - n.min() <= 1 and n.sum() == 1009
    b = sh.fill_table(names[:-1], 1009)
    moved = (a != b) & (a != 6)
    assert moved.mean() < 0.15
    assert (np.bincount(sh.fill_table(["a", "b"], 101, [3, 1])) >= [74, 24]).all()


def test_turns_by_hand():
    """The claim order, replayed with plain lists."""
    names, size = ["a", "b", "c"], 13
    prefs = []
    for s in names:
        start, step = sh._number(s, "start") % size, sh._number(s, "step") % (size - 1) + 1
        prefs.append([(start + k * step) % size for k in range(size)])
        assert sorted(prefs[-1]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for i, p in enumerate(prefs):
            free = [s for s in p if s not in owner]
            if free:
                owner[free[0]] = i
    assert sh.fill_table(names, size).tolist() == [owner[i] for i in range(size)]


def test_place_against_brute_force(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, None), (None, None), (10 ** 12, "é" * 3000)]
    df = spark.createDataFrame(rows, "k long, v string")
    names = ["x", "y", "z"]
    table = sh.fill_table(names, 101)

    def slot(parts):
        s = "".join(f"{-1 if p is None else len(str(p))}:{'' if p is None else p}" for p in parts)
        return int(hashlib.md5(s.encode()).hexdigest()[:15], 16) % 101
    got = sorted(((r.k, r.v, r.slot, r.shard) for r in sh.place(df, names, ["k", "v"], 101).collect()), key=str)
    assert got == sorted(((k, v, slot((k, v)), names[table[slot((k, v))]]) for k, v in rows), key=str)
    assert sh.place(df.filter("false"), names, ["k"]).count() == 0
    with pytest.raises(ValueError):
        sh.place(df.withColumnRenamed("v", "Shard"), names, ["k"])
    for bad in (([], 101), (["a", "a"], 101), (["a"], 100)):
        with pytest.raises(ValueError):
            sh.fill_table(*bad)


def test_write_shards(spark, tmp_path):
    df = sh.place(spark.range(500), ["x", "y"], ["id"], 101)
    sh.write_shards(df, str(tmp_path / "out"), files_per_shard=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500


def counts(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    cover = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


TEXTS = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 4000, "a b c d e f " * 3 + "q", "l\nl\n l\nl\n\n\n",
         "# $ | <b> %&*", "é漢🙂 ñ x\x0by", "one two three four five six\n" * 40, "\x85 a\x1cb"]


def test_counts_against_brute_force(spark, docs_of):
    voted = qr.with_votes(qr.measures(docs_of(TEXTS))).collect()
    assert len(voted) == len(TEXTS)
    for r in voted:
        want = counts(TEXTS[r.doc_id])
        assert tuple(r[c] for c in qr.BASE_COLUMNS) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_em_finds_the_bad_cluster(spark):
    good, bad = (1,) * len(qr.RULES), (-1, -1, -1) + (1,) * (len(qr.RULES) - 3)
    m = qr.fit([(good, 900), (bad, 100)])
    p = lambda v: qr.posterior(v, m["prior"], m["acc_good"], m["acc_bad"])
    assert p(good) > 0.9 > 0.1 > p(bad) and 0.85 < m["prior"] < 0.95
    assert qr.fit([])["prior"] == qr.PRIOR_GOOD


def test_judge_matches_posterior_and_empty_table(spark, docs_of):
    voted = qr.with_votes(qr.measures(docs_of(TEXTS)))
    model = qr.learn(voted)
    for r in qr.judge(voted, model).collect():
        assert abs(r.posterior - qr.posterior(r.votes, model["prior"], model["acc_good"], model["acc_bad"])) < 1e-9
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    none = qr.with_votes(qr.measures(docs_of(TEXTS).filter("false")))
    assert qr.judge(none, qr.learn(none)).count() == 0
