import random

from durata.llm import line_dedup
from pyspark.sql import functions as F


def chunk_table(spark, rows):
    """Chunks as the operator cuts them: list per document of line ranges."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.coalesce("text", F.lit("")))
    out = {}
    for r in line_dedup.with_chunks(df).collect():
        out[(r.doc_id, r.text)] = [(c["from"], c["to"]) for c in r["__chunks"]]
    return out


def brute(rows, cuts):
    seen, first = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        for a, b in cuts[d, t]:
            k = "\n".join(lines[a:b])
            if b - a > 1 and k.strip(" \t\n\r\x0b\x0c"):
                seen[k] = seen.get(k, 0) + 1
                first.setdefault(k, (d, a))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        lines, kept = t.split("\n"), []
        for a, b in cuts[d, t]:
            k = "\n".join(lines[a:b])
            if seen.get(k, 0) < 2 or first[k] == (d, a) or b - a < 2:
                kept += lines[a:b]
        out.append((d, "\n".join(kept)))
    return sorted(out, key=str)


def sample(seed):
    r = random.Random(seed)
    shared = [[f"shared {k} line {i}" for i in range(8)] for k in range(3)]
    rows = []
    for d in range(30):
        lines = [f"own {d} {i}" for i in range(r.randint(0, 6))]
        for s in r.sample(shared, r.randint(0, 2)):
            at = r.randint(0, len(lines))
            lines[at:at] = s
        rows.append((d, "\n".join(lines)))
    return rows


def test_against_brute_force(spark):
    rows = sample(1) + [(50, None), (51, ""), (52, "\n\n\n"), (53, "\n\n\n"), (54, "x\n" * 2000), (55, "x\n" * 2000)]
    cuts = chunk_table(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in line_dedup.dedup(df).collect()), key=str)
    assert got == brute(rows, cuts)
    assert sum(len(t or "") for _, t in got) < sum(len(t or "") for _, t in rows)


def test_boundaries_survive_shifts(spark):
    lines = [f"line {i}" for i in range(60)]
    cuts = chunk_table(spark, [(1, "\n".join(lines)), (2, "\n".join(["new"] + lines))])
    a = {x for x in cuts[1, "\n".join(lines)]}
    b = {(x - 1, y - 1) for x, y in cuts[2, "\n".join(["new"] + lines)]}
    assert len(a & b) >= len(a) - 2
    assert [x for x, _ in sorted(a)][1:] == [y for _, y in sorted(a)][:-1]


def test_repeated_rows_share_their_fate_and_columns_pass(spark):
    text = "\n".join(f"l{i}" for i in range(20))
    df = spark.createDataFrame([(1, text, "a", 9), (1, text, "b", 9), (2, text, "c", 9)],
                               "doc_id long, text string, hash string, `from` int")
    got = sorted((r.doc_id, r.hash, r["from"], r.text) for r in line_dedup.dedup(df).collect())
    assert [g[:3] for g in got] == [(1, "a", 9), (1, "b", 9), (2, "c", 9)]
    assert got[0][3] == got[1][3] == text and len(got[2][3]) < len(text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup(df, counts=True).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(sample(2), "doc_id long, text string")
    plan = line_dedup.dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_planted_passages_go_whole(spark):
    r = random.Random(7)
    passages = [[" ".join(f"p{k}w{i}x{r.randint(0, 999)}" for _ in range(12)) for i in range(r.randint(2, 9))] for k in range(40)]
    rows = []
    for d in range(120):
        own = [f"document {d} has line {i} of its own" for i in range(4)]
        rows.append((d, "\n".join([*own[:1 + d % 3], *passages[d % 40], *own[1 + d % 3:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.text.split("\n") for x in line_dedup.dedup(df).collect()}
    whole = sum(not set(passages[d % 40]) & set(got[d]) for d in range(40, 120))
    assert whole == 80
    assert all("\n".join(got[d]) == t for d, t in rows[:40])
    assert all(f"document {d} has line {i} of its own" in got[d] for d in got for i in range(4))


def test_many_lines_of_one_document(spark):
    """Two of every three lines shared: 8,000 chunks go from the second document, in order, at their places."""
    docs = [(d, "\n".join(f"own {d} {i}" if i % 3 == 2 else f"shared {i}" for i in range(24_000))) for d in (1, 2)]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), counts=True).collect()}
    assert got[1].text == docs[0][1] and got[1].n_removed == 0
    assert got[2].text.split("\n") == [f"own 2 {i}" for i in range(2, 24_000, 3)]
    assert (got[2].n_lines, got[2].n_removed) == (24_000, 16_000)


def test_names_that_the_operator_needs_raise(spark):
    import pytest

    for name in ("__lines", "__GONE", "__id"):
        with pytest.raises(ValueError, match="in the input already"):
            line_dedup.dedup(spark.createDataFrame([(1, "a", 2)], f"doc_id long, text string, `{name}` int"))
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_lines int")
    assert line_dedup.dedup(df).first().n_lines == 2
