"""Fuzzy harmonisation equals a brute-force scan; split policies; ID lists."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from durata.operators import blocks, harmonise, split
from durata.plans.catalogue import _q34_inputs
from durata.sources import idlists
from tests.conftest import SF_SMALL


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_fuzzy_matches_brute_force(spark):
    canon = ["num patients", "site n", "country n", "masking", "phase", "age min", "age max",
             "metastatic colorectal carcinoma", "country num"]
    values = ["num patiens", "site_n", "contry n", "maskin", "phaze", "agemin", "zzz", "# patients", "age mx",
              "metastatic colorectal carcinomas x", "country numm ab", "a", "age", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    d = spark.createDataFrame([(c,) for c in canon], "canonical string")
    got = {r.v: (r.match, r.reason) for r in harmonise.harmonise(df, "v", d, threshold=0.7, measure="edits").collect()}
    nv = {r[0]: r[1] for r in df.select("v", harmonise.normalise_name("v")).collect()}
    nc = {r[0]: r[1] for r in d.select("canonical", harmonise.normalise_name("canonical")).collect()}
    for v in values:
        best = None
        for c in sorted(canon):
            if nv[v] == nc[c]:
                cand = (-1.0, 0, 0, c, "exact")
            else:
                k = lev(nv[v], nc[c])
                sim = 1 - k / max(len(nv[v]), len(nc[c]), 1)
                if sim < 0.7:
                    continue
                cand = (-sim, 2, k, c, "fuzzy")
            best = cand if best is None or cand < best else best
        assert got[v] == ((best[3], best[4]) if best else (None, None)), v


def test_block_ratio(spark):
    """Against the standard library, over texts with many ties."""
    rng = random.Random(3)
    pairs = [("", ""), ("a", ""), ("", "b"), ("abcd", "bcde"), ("private thread", "private volatile currentthread"), ("ééé", "é")]
    pairs += [tuple("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(2))
              for alphabet in ("ab", "abc ", "abcdefghij") for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", blocks.ratio("a", "b").alias("r")).collect():
        assert abs(r.r - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12, (r.a, r.b)


@pytest.mark.parametrize("threshold", [0.4, 0.7, 1.0])
def test_near_finds_every_pair(spark, threshold):
    rng = random.Random(8)
    words = ["site", "n", "num", "age", "min", "country", "xx", "outcomes"]
    left, right = ([" ".join(rng.sample(words, rng.randint(1, 3)))[rng.randint(0, 2):] for _ in range(60)] for _ in range(2))
    left, right = [*left, "", None, left[0]], [*right, "", None, "zzz"]
    got = blocks.near(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"),
                      "l", "r", threshold).collect()
    want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in left for b in right if a and b}
    want = {k: v for k, v in want.items() if v >= threshold}
    assert {(x.l, x.r) for x in got} == set(want) and len(got) == len(want)
    assert all(abs(x.ratio - want[x.l, x.r]) < 1e-12 for x in got)


def test_harmonise_by_blocks(spark):
    """Every part name of the small tables against a plain scan."""
    vals, canon, syn = _q34_inputs(spark, SF_SMALL)
    got = {r.value: r for r in harmonise.harmonise(vals, "value", canon, syn).collect()}
    norm = {r[0]: r[1] for r in vals.select("value", harmonise.normalise_name("value")).distinct().collect()}
    names = {r[0]: (r[1], r[2]) for r in canon.join(syn, "canonical").select(
        "canonical", harmonise.normalise_name("canonical"), harmonise.normalise_name("synonym")).collect()}
    fuzzy = 0
    for v, nv in norm.items():
        cands = []
        for c, (nc, ns) in names.items():
            r = SequenceMatcher(None, nc, nv).ratio()
            cands += [(-1.0, 0, c)] if nc == nv else []
            cands += [(-0.95, 1, c)] if nv in ns or ns in nv else []
            cands += [(-r, 2, c)] if r >= 0.7 else []
        best = min(cands, default=(None, None, None))
        assert got[v].match == best[2], (v, best, got[v])
        assert best[0] is None or abs(got[v].confidence + best[0]) < 1e-12
        fuzzy += best[1] == 2
    assert fuzzy > 3


def test_split_policies(spark):
    tr = spark.createDataFrame([("A",), ("B",)], "id string")
    te = spark.createDataFrame([("B",), ("C",)], "id string")
    t = {r.id: r.split for r in split.split_table(tr, te, overlap="test").collect()}
    assert t == {"A": "train", "B": "test", "C": "test"}
    t = {r.id: r.split for r in split.split_table(tr, te, overlap="train").collect()}
    assert t == {"A": "train", "B": "train", "C": "test"}


def test_id_list_parsers(spark, tmp_path):
    p = tmp_path / "ids.txt"
    p.write_text(" nct00000001 \n\nNCT00000002 extra\nNCT00000001\nNCT123, nct0000000003 NCT00000004\n")
    ln = idlists.read_lines(spark, str(p), ordered=True)
    s4 = sorted(r.id for r in idlists.ids_one_per_line(ln).collect())
    assert s4 == ["NCT00000001", "NCT00000002 EXTRA", "NCT123, NCT0000000003 NCT00000004"]
    s5 = sorted(r.id for r in idlists.ids_first_column(ln).collect())
    assert s5 == ["NCT00000001", "NCT00000002", "NCT123,"]
    s6 = {r.id: r.pos for r in idlists.ids_ordered(ln).collect()}
    assert s6["NCT00000001"] < s6["NCT00000002 EXTRA"]
    s7 = sorted(r.id for r in idlists.ids_tokens(ln).collect())
    assert s7 == ["NCT0000000003", "NCT00000001", "NCT00000002", "NCT00000004"]


def test_synonym_containment_matches_brute_force(spark):
    canon = ["num patients", "site n", "masking"]
    syns = [("num patients", "enrollment"), ("site n", "site count"), ("masking", "blinded flag")]
    values = ["total enrollment n", "count", "blinded", "enrollment", "unrelated"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    d = spark.createDataFrame([(c,) for c in canon], "canonical string")
    sy = spark.createDataFrame(syns, "canonical string, synonym string")
    got = {r.v: (r.match, r.reason) for r in harmonise.harmonise(df, "v", d, sy, fuzzy=False).collect()}
    norm = {x: r[0] for x in values + [s for _, s in syns] + canon
            for r in [spark.createDataFrame([(x,)], "x string").select(harmonise.normalise_name("x")).first()]}
    for v in values:
        hits = sorted((c, f"synonym:{s}") for c, s in syns
                      if norm[v] and norm[s] and (norm[s] in norm[v] or norm[v] in norm[s]))
        exact = [c for c in canon if norm[c] == norm[v]]
        want = (exact[0], "exact") if exact else (hits[0] if hits else (None, None))
        assert got[v] == want, v
