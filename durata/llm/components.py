"""Connected components of an edge table by alternating star contractions.

Large stars hang every larger neighbour of a node on its least neighbour,
small stars every smaller one; both together end in one star per component
after a number of rounds that grows with the logarithm of the graph.  Every
round is written to the shared folder, nothing but two check numbers reaches
the driver, and a node's neighbours are never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.shared import written


def _least(e: DataFrame) -> DataFrame:
    """Least neighbour of every node, written: joined with it as a table of
    its own, the edges of a hot node need not stay in one task."""
    return written(e.groupBy("u").agg(F.min("v").alias("m")), "cc-least")


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"))
    return (both.join(least, "u").filter("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(e: DataFrame) -> DataFrame:
    least = _least(e)
    down = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges``; root is the component's least
    node.  Loops and nulls are left out, an empty table gives an empty one."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = written(e, "cc")
    last = None
    for _ in range(rounds):
        e = written(_small(_large(e)), "cc")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
