"""Longest-matching-block similarity of short texts.

The ratio of two texts is 2 M / (their lengths): M is the length of their
longest common block plus, recursively, those of the parts before it and
after it (the earliest block of the first text, then of the second, among
equally long ones).  ``ratio`` is one native expression: regions still to be
matched wait on a stack, and each is searched row by row with the lengths of
the runs that end at every character.

``near`` finds all pairs that reach a threshold without comparing all: M is at
most the number of characters (counted with repetition) that both hold, so a
pair needs a share of common characters, and ordered rare ones first, the
first few characters of both must have one in common (prefix filter).  Length
and overlap are checked before the exact ratio is worked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import _c, _let

_REGION = "array<struct<al:int,ah:int,bl:int,bh:int>>"


def _longest(a: Column, b: Column, r: Column) -> Column:
    """(k, i, j): the longest block of region ``r`` of two character arrays."""
    start = F.struct(F.array_repeat(F.lit(0), r["bh"] - r["bl"]).alias("row"), F.lit(0).alias("k"), F.lit(0).alias("i"),
                     F.lit(0).alias("j"))

    def line(best, i):
        runs = F.transform(F.slice(b, r["bl"] + 1, r["bh"] - r["bl"]), lambda ch, x: F.when(
            ch == F.get(a, i), F.coalesce(F.get(best["row"], x - 1), F.lit(0)) + 1).otherwise(0))
        return _let(runs, lambda row: _let(F.array_max(row), lambda k: F.when(k > best["k"], F.struct(
            row.alias("row"), k.alias("k"), (i - k + 1).alias("i"),
            (r["bl"] + F.array_position(row, k).cast("int") - k).alias("j"))).otherwise(F.struct(
                row.alias("row"), best["k"].alias("k"), best["i"].alias("i"), best["j"].alias("j")))))
    return F.aggregate(F.sequence(r["al"], r["ah"] - 1), start, line)


def _region(al, ah, bl, bh) -> Column:
    one = F.struct(al.alias("al"), ah.alias("ah"), bl.alias("bl"), bh.alias("bh"))
    return F.when((al < ah) & (bl < bh), F.array(one)).otherwise(F.array().cast(_REGION))


def _matched(a: Column, b: Column) -> Column:
    """M of two character arrays."""
    zero = F.lit(0)
    start = F.struct(_region(zero, F.size(a), zero, F.size(b)).alias("todo"), F.lit(0).alias("m"))

    def step(state, _):
        def search(r):
            return _let(_longest(a, b, r), lambda hit: F.when(hit["k"] > 0, F.struct(
                F.concat(F.slice(state["todo"], F.lit(1), F.size(state["todo"]) - 1),
                         _region(r["al"], hit["i"], r["bl"], hit["j"]),
                         _region(hit["i"] + hit["k"], r["ah"], hit["j"] + hit["k"], r["bh"])).alias("todo"),
                (state["m"] + hit["k"]).alias("m"))).otherwise(F.struct(
                    F.slice(state["todo"], F.lit(1), F.size(state["todo"]) - 1).alias("todo"), state["m"].alias("m"))))
        return F.when(F.size(state["todo"]) > 0, _let(F.element_at(state["todo"], -1), search)).otherwise(state)
    # a block splits its region in two at most, and a region without one is the last of its branch
    steps = F.sequence(F.lit(1), 2 * F.least(F.size(a), F.size(b)) + 1)
    return F.aggregate(steps, start, step)["m"]


def ratio(a, b) -> Column:
    """Block similarity of two texts, 0 to 1; two empty texts are equal."""
    a, b = _c(a), _c(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(
        2.0 * _let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda s: _matched(s["a"], s["b"])) / total)


def _tokens(s: Column) -> Column:
    """The characters of a text, each with how many equal ones stand before it."""
    return _let(F.split(s, ""), lambda chars: F.transform(chars, lambda ch, i: F.concat(
        ch, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == ch)).cast("string"))))


def near(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """(a, b, ratio) of all pairs of a text of ``left[a]`` and one of
    ``right[b]`` whose ratio reaches ``threshold`` (above 0).  Empty and null
    texts are left out; texts that repeat are compared once."""
    sides = {k: d.select(F.col(c).alias("s")).where(F.length(c) > 0).distinct() for k, d, c in ((0, left, a), (1, right, b))}
    each = {k: d.select("s", F.explode(_tokens(F.col("s"))).alias("t")) for k, d in sides.items()}
    often = each[0].unionAll(each[1]).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(k):
        rare = each[k].join(often, "t").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("ts"))
        size = F.length("s")
        # whatever the partner, so many characters must be common
        common = F.ceil(threshold * size / (2 - threshold) - 1e-9).cast("int")
        return rare.select("s", F.explode(F.slice("ts", F.lit(1), size - common + 1)).alias("p")).select("s", "p.t")
    pairs = prefixes(0).withColumnRenamed("s", a).join(prefixes(1).withColumnRenamed("s", b), "t")
    la, lb = F.length(a), F.length(b)
    least = threshold * (la + lb) / 2 - 1e-9
    pairs = pairs.where(F.least(la, lb) >= least).select(a, b).distinct()
    pairs = pairs.where(F.size(F.array_intersect(_tokens(F.col(a)), _tokens(F.col(b)))) >= least)
    return pairs.withColumn("ratio", ratio(a, b)).where(F.col("ratio") >= threshold - 1e-12)
