"""The manifest against a tree built level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from durata.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lowered=False):
    values = list(row)
    if lowered and values[4] is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[4])
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels(digests):
    """All levels of a tree, and the parent of place i is i // 8."""
    out = [list(digests)]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree, i):
    for level in tree[:-1]:
        lo = i // 8 * 8
        yield level[lo:i], level[i + 1:lo + 8]
        i //= 8


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            path = [*steps(trees[g], i), *steps(top, k)]
            d = leaf(r, tampered)
            for left, right in path:
                d = h([*left, d, *right])
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, h(x for a, b in path for x in (*a, *b)), d, d == root))
    return sorted(out, key=repr)


def made(n, langs, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "lower only", "Some Äpfel And Words " * rng.randint(1, 4)])
        rows.append((i, rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 5]), text))
    return rows


def found(spark, rows, tmp_path, partitions=5):
    where = str(tmp_path / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(partitions).write.parquet(f"{where}/documents.parquet")
    got = queries.op11_merkle(spark, where)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (73, ["en", None, "", "de"]),
                                     (700, ["en", "en", "en", "en", None, "z", "é"])])
def test_equals_plain_tree(spark, tmp_path, n, langs):
    rows = made(n, langs)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_many_passes_and_groups(spark, tmp_path, monkeypatch):
    """Subtrees of 8 leaves: several passes up and down, also over groups."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SUBTREE", 8)
    rows = made(600, ["hot"] * 80 + [f"l{i}" for i in range(70)], seed=3)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = made(40, ["en", "de"]) + [(3, "a", "en", 1, "Twice")] * 30 + [(None, None, None, None, None)] * 20 + [
        (None, "s", "en", 2, f"no id {i % 4}") for i in range(20)]
    got, want = found(spark, rows, tmp_path), brute(rows)
    assert len(got) == len(want) == len(rows)
    assert got == want


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path, 1) == []


def test_extra_columns_and_paths(spark):
    """Clashing names pass through; every path folds to the root; a very long
    text travels as its digest only."""
    rows = [(i, "g" if i % 3 else None, "x" * (2_000_000 if i == 7 else i), i) for i in range(100)]
    df = spark.createDataFrame(rows, "at long, subtree string, digest string, `a.b` long")
    df = df.withColumn("leaf", merkle.leaf_digest(F.col("digest")))
    out = merkle.manifest(df, "subtree", "at", keep=["a.b"])
    assert out.columns == ["subtree", "at", "a.b", "leaf", "subroot", "root", "path"]
    got = out.withColumn("f", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == 100 and len({r.root for r in got}) == 1 and all(r.f == r.root and r["a.b"] == r["at"] for r in got)


def test_labels_are_swept_in_order():
    """Children come before parents, so a queue ordered by label never waits."""
    for n in (1, 7, 8, 9, 64, 65, 200):
        height = merkle._height(n)
        digests = [h([str(i)]) for i in range(n)]
        root, heard = merkle._forward(digests, height)
        tree = levels(digests)
        assert root == tree[-1][0] and len(tree) == height + 1
        order = [i for i, _ in merkle._backward(n, height, heard, ())]
        assert order == list(range(n - 1, -1, -1))
