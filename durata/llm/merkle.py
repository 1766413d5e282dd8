"""Merkle manifest of a dataset: a tree of digests per group of rows, a tree
over the groups' roots, and for every row the path that proves it.

Time-forward processing.  A node's label is (last leaf below it, level), so
children come before parents in label order.  The forward sweep reads leaves in
order; every node's digest goes as a message to its parent through a priority
queue ordered by label, and a node is computed when the queue reaches it.  The
reversed sweep starts at the root and sends every child the digests beside it
together with its parent's path, in descending order of label, until the
leaves are reached.

Between tasks Spark's sorted shuffle is the external part of the queue: leaves
are dealt by subtrees of ``FAN ** LEVELS`` leaves, each swept with a queue of
its own; the digest of a subtree is a message to the next pass, whose leaves
these digests are, and in the way back the path of a subtree's root is a
message that is sorted in front of its leaves.  The number of passes grows
with the logarithm of the largest group, and no task holds more than one
subtree.

Defined results: null values count as ``-`` in a leaf; the null group comes
first; rows with equal order values are ordered by their digests (equal
digests are interchangeable); an empty table gives an empty manifest; a text
may be of any length, only its digest travels; columns that are not named
play no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.ordered import ranked
from durata.llm.shared import written

FAN = 8
#: Levels of a subtree that one sweep holds: 4,096 leaves.
LEVELS = 4
SUBTREE = FAN ** LEVELS
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*columns: F.Column) -> F.Column:
    """sha256 over ``-`` for null, else UTF-8 byte count, ``:``, value."""
    def field(c):
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(digest: F.Column, path: F.Column) -> F.Column:
    """The root that ``digest`` leads to along ``path``."""
    return F.aggregate(path, digest, lambda d, step: F.sha2(F.concat(step["left"], d, step["right"]), 256))


def proof(path: F.Column) -> F.Column:
    """All digests of a path end to end, from the leaf's siblings upwards."""
    return F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"])))


def _height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def _label(level: int, i: int, n: int) -> tuple[int, int]:
    """Label of node ``i`` of a level, over ``n`` leaves."""
    return min((i + 1) * FAN ** level, n) - 1, level


def _forward(leaves: Sequence[str], height: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """Digest of the root over ``leaves`` and, by (level, number), what the
    children of each node sent."""
    n, queue, heard = len(leaves), [], {}
    root = leaves[0]

    def send(level, i, digest):
        if level < height:
            heapq.heappush(queue, (*_label(level + 1, i // FAN, n), i, digest))

    for at, digest in enumerate(leaves):
        send(0, at, digest)
        while queue and queue[0][0] <= at:
            end, level, first, _ = queue[0]
            children = []
            while queue and queue[0][:2] == (end, level):
                children.append(heapq.heappop(queue)[3])
            heard[level, first // FAN] = children
            root = hashlib.sha256("".join(children).encode()).hexdigest()
            send(level, first // FAN, root)
    return root, heard


def _backward(n: int, height: int, heard: dict, path: tuple) -> Iterator[tuple[int, tuple]]:
    """(leaf, its path) in descending order of leaves; ``path`` is the root's."""
    def entry(level, i, path):
        end, _ = _label(level, i, n)
        return -end, -level, i, path
    queue = [entry(height, 0, path)]
    while queue:
        _, level, i, path = heapq.heappop(queue)
        level = -level
        if not level:
            yield i, path
            continue
        children = heard[level, i]
        for j in range(len(children)):
            beside = ("".join(children[:j]), "".join(children[j + 1:]))
            heapq.heappush(queue, entry(level - 1, i * FAN + j, (beside, *path)))


def _subtrees(batches, keys: int) -> Iterator[list]:
    """Rows of sorted Arrow batches as runs of equal leading ``keys`` columns."""
    run, current = [], None
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[:keys] != current and run:
                yield run
                run = []
            current = row[:keys]
            run.append(row)
    if run:
        yield run


def _by_subtree(rows: DataFrame, *then) -> DataFrame:
    return (rows.repartition("g", "subtree").sortWithinPartitions("g", "subtree", *then))


def _climb_once(rows: DataFrame) -> DataFrame:
    """One pass up: (g, at, n, digest, done) of every subtree's root."""
    def work(batches):
        import pyarrow as pa

        out = []

        def flush():
            cols = zip(*out, strict=True)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                              names=["g", "at", "n", "digest", "done"])
        for run in _subtrees(batches, 2):
            g, subtree, _, n, _ = run[0]
            done = n <= SUBTREE
            root, _ = _forward([r[4] for r in run], _height(n) if done else LEVELS)
            out.append((g, subtree, -(-n // SUBTREE), root, done))
            if len(out) == 4096:
                yield flush()
                out.clear()
        if out:
            yield flush()

    dealt = _by_subtree(rows.select("g", F.expr(f"at div {SUBTREE}").alias("subtree"), "at", "n", "digest"), "at")
    return dealt.mapInArrow(work, "g string, at long, n long, digest string, done boolean")


def _climb(rows: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The passes' leaves (``rows`` first) and (g, digest) of every root."""
    spark, passes, roots = rows.sparkSession, [], None
    while True:
        passes.append(rows)
        up = written(_climb_once(rows), name)
        ready = up.filter("done").select("g", "digest")
        roots = ready if roots is None else roots.unionAll(ready)
        rows = up.filter("NOT done").drop("done")
        if rows.isEmpty():
            return passes, roots


def _descend_once(rows: DataFrame, messages: DataFrame, kept: str) -> DataFrame:
    """One pass down: every leaf of ``rows`` with its path and the roots that
    its subtree's message names."""
    spark = rows.sparkSession
    tops = "subroot string, root string"
    nodes = rows.select("g", F.expr(f"at div {SUBTREE}").alias("subtree"), "at", "n", "digest", "kept",
                        *[F.lit(None).cast(t).alias(c) for c, t in (("path", PATH), ("subroot", "string"), ("root", "string"))])
    sent = messages.select("g", F.col("at").alias("subtree"), F.lit(None).cast("long").alias("at"),
                           F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"),
                           F.lit(None).cast(kept).alias("kept"), "path", "subroot", "root")
    dealt = _by_subtree(nodes.unionByName(sent), F.col("at").asc_nulls_first())

    def work(batches):
        import pyarrow as pa

        tables, key = [], None

        def sweep():
            run = pa.Table.from_batches(tables).combine_chunks()
            _, _, _, _, _, _, path, subroot, root = (c[0].as_py() for c in run.columns)
            run = run.slice(1)
            n = run.column("n")[0].as_py()
            height = _height(n) if n <= SUBTREE else LEVELS
            _, heard = _forward(run.column("digest").to_pylist(), height)
            order, paths = zip(*_backward(len(run), height, heard, tuple((s["left"], s["right"]) for s in path)),
                               strict=True)
            steps = [s for p in paths for s in p]
            ends = [0]
            for p in paths:
                ends.append(ends[-1] + len(p))
            step = pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)],
                                              names=["left", "right"])
            run = run.take(pa.array(order, pa.int64()))
            cols = [run.column(c).combine_chunks() for c in ("g", "at", "kept", "digest")]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            cols += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), step),
                     pa.array([subroot] * len(run), pa.string()), pa.array([root] * len(run), pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=["g", "at", "kept", "digest", "path", "subroot", "root"])

        for b in batches:
            gs, subtrees = b.column("g").to_pylist(), b.column("subtree").to_pylist()
            lo = 0
            for hi in range(1, len(gs) + 1):
                if hi < len(gs) and gs[hi] == gs[lo] and subtrees[hi] == subtrees[lo]:
                    continue
                if tables and key != (gs[lo], subtrees[lo]):
                    yield sweep()
                    tables = []
                key = gs[lo], subtrees[lo]
                tables.append(b.slice(lo, hi - lo))
                lo = hi
        if tables:
            yield sweep()

    return dealt.mapInArrow(work, f"g string, at long, kept {kept}, digest string, path {PATH}, {tops}")


def _descend(passes: list[DataFrame], heads: DataFrame, kept: str, name: str) -> DataFrame:
    """Paths of the first pass's leaves; ``heads`` (g, path, subroot, root)
    holds what each group's root is told."""
    below = None
    for p in range(len(passes) - 1, -1, -1):
        rows = passes[p] if p == 0 else passes[p].withColumn("kept", F.lit(None).cast(kept))
        ends = rows.filter(f"n <= {SUBTREE} AND at = 0").select("g")
        messages = ends.join(heads, "g").select("g", F.lit(0).cast("long").alias("at"), "path", "subroot", "root")
        if below is not None:
            messages = messages.unionByName(below.select("g", "at", "path", "subroot", "root"))
        below = _descend_once(rows, messages, kept)
        if p:
            below = written(below, name)
    return below


def manifest(rows: DataFrame, group: str, order: str, digest: str = "leaf", keep: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the columns ``group``, ``order``, ``digest`` and ``keep``,
    and ``subroot``, ``root`` and ``path`` (the digests left and right of the
    row's ancestors, from the row upwards; levels of a group's tree first,
    then those of the tree over the groups in order).

    ``digest`` must not be null.  Every group's rows ascend by ``order``.
    """
    names = [group, order, *keep]
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))  # null first
    flat = rows.select(key.alias("g"), F.col(f"`{order}`").alias("o"), F.col(f"`{digest}`").alias("digest"),
                       kept.alias("kept"))
    kind = flat.schema["kept"].dataType.simpleString()
    leaves = written(ranked(flat, ["g"], ["o", "digest"], "merkle-sorted").select("g", "at", "n", "digest", "kept"),
                     "merkle-leaves")
    passes, subroots = _climb(leaves, "merkle-up")
    # the tree over the groups' roots: one group, whose rows are kept by name
    tops = ranked(subroots.select(F.lit("").alias("all"), "g", "digest"), ["all"], ["g"], "merkle-groups")
    tops = written(tops.select(F.col("all").alias("g"), "at", "n", "digest", F.struct(F.col("g").alias("c0")).alias("kept")),
                   "merkle-subroots")
    top_passes, top = _climb(tops, "merkle-up")
    start = top.select("g", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"),
                       F.col("digest").alias("root"))
    heads = written(_descend(top_passes, start, "struct<c0:string>", "merkle-down").select(
        F.col("kept.c0").alias("g"), "path", F.col("digest").alias("subroot"), "root"), "merkle-heads")
    found = _descend(passes, heads, kind, "merkle-down")
    return found.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)], F.col("digest").alias(digest),
                        "subroot", "root", "path")
