"""Similarity join on word 5-grams: Jaccard of 0.8 or more, exactly.

1. Every block of documents becomes sets of 56-bit shingle hashes.  Blocks
   send each distinct hash once, with its number of documents in the block,
   to the hash range it falls in; there the document frequencies are summed,
   and hashes in two documents or more go back to the blocks, with their
   frequency.  Hashes of one document need no reply: they are the rarest.
2. Shingles are ordered by (frequency, hash).  A document whose prefix (the
   rarest n - ceil(0.8 n) + 1) holds only shingles of its own has no partner
   and leaves.  Documents with the same set become one class.
3. Classes that share a prefix shingle form clusters (connected components);
   a cluster is dealt to tasks as pairs of chunks of bounded size.  A task
   probes a prefix index with length, positional and suffix filters, and
   verifies each remaining pair once, unless its two classes are linked
   through others already.  It returns a spanning forest, never all pairs.

Defined results: null, empty and word-less texts have an empty set and link
with nothing; repeated rows are copies; a null doc_id takes part, and a
component of nothing but nulls has a null id; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.components import components
from durata.llm.hashing import Words, gram_hashes, mix, text_blocks
from durata.llm.shared import written

K = 5
NUM, DEN = 80, 100
BITS = 56
BLOCK_BYTES = 8 << 20
#: Shingles of a chunk, and of the chunk pairs and small clusters dealt to one task.
CHUNK = 2_000_000
#: A cluster's classes are spread over so many keys where they meet its size.
SALTS = 64
_U = np.uint64


def pack(*columns: np.ndarray) -> bytes:
    """Equally long integer columns as bytes: byte planes, zstandard."""
    import zstandard

    parts = [np.array([len(columns[0])], "<u8").tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c)
        parts.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, "<u8", 1)[0]), 8, []
    for t in types:
        size = np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * size
    return out


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document index) pairs of a block, sorted by both.

    A text of fewer than K words has its whole sequence as its one shingle.
    """
    w = Words(texts)
    g = gram_hashes(w.hash, K)
    inside = w.doc[:len(g)] == w.doc[K - 1:] if len(g) else np.zeros(0, bool)
    h, d = [g[inside]], [w.doc[:len(g)][inside]]
    for k in range(1, K):
        short = np.flatnonzero(w.count == k)
        if len(short):
            h.append(gram_hashes(w.hash, k)[w.first[short]])
            d.append(short)
    del w, g, inside
    h, d = np.concatenate(h) >> _U(64 - BITS), np.concatenate(d)
    order = np.argsort(h)
    h, d = h[order], d[order]
    same = h[1:] == h[:-1]
    tied = np.append(same, False) | np.append(False, same)
    if tied.any():
        at = np.flatnonzero(tied)
        sub = np.lexsort((d[at], h[at]))
        d[at] = d[at][sub]
    keep = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    return h[keep], d[keep]


def set_prints(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit fingerprint (two sums of mixed hashes) of each set."""
    n = np.bincount(d, minlength=n_docs).astype(np.int64)
    order = np.argsort(d, kind="stable")
    ends = np.cumsum(n)
    prints = []
    for salt in (0x51ED270B, 0xA24BAED4963EE407):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h[order] ^ _U(salt)), out=total[1:])
        prints.append(total[ends] - total[ends - n])
    return n, *prints


_BLOCK_SCHEMA = "bucket int, block long, kind int, payload binary"


def _send(n_buckets: int):
    """Documents -> for each block one header (kind 0: ids, sizes, prints and
    the hashes that several of its documents share) and, for each hash range,
    its hashes (kind 1: hash, documents in the block, index of the only one)."""
    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            keys = b.column(0)
            for lo, hi, texts in text_blocks(b.column(1), BLOCK_BYTES):
                block = (part << 24) | seq
                seq += 1
                h, d = shingles(texts)
                n, p1, p2 = set_prints(h, d, hi - lo)
                ids = keys.slice(lo, hi - lo)
                null = np.asarray(ids.is_null()).astype(np.uint8)
                ids = np.asarray(ids.fill_null(0)).astype(np.int64)
                new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                count = np.diff(np.append(new, len(h)))
                shared = np.repeat(count > 1, count)
                header = [pack(ids, null, n, p1, p2), pack(h[shared], d[shared].astype(np.uint32))]
                size = len(header[0]).to_bytes(8, "little")
                rows = [(block % n_buckets, block, 0, size + header[0] + header[1])]
                u, only = h[new], np.where(count > 1, 0, d[new]).astype(np.uint32)
                bucket = ((u >> _U(BITS - 32)) * _U(n_buckets)) >> _U(32)
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
                for k in range(n_buckets):
                    s = slice(cuts[k], cuts[k + 1])
                    if cuts[k] < cuts[k + 1]:
                        rows.append((k, block, 1, pack(np.diff(u[s], prepend=_U(0)), count[s].astype(np.uint32),
                                                       only[s])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                        (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "block", "kind", "payload"])
    return work


def _count(key, table):
    """One hash range: frequencies of hashes in two documents or more, sent
    back to the blocks that hold them; headers pass through."""
    import pyarrow as pa

    block, kind, payload = (table.column(c).to_pylist() for c in ("block", "kind", "payload"))
    out = [(b, 0, p) for b, k, p in zip(block, kind, payload, strict=True) if k == 0]
    sent = [(b, unpack(p, "<u8", "<u4", "<u4")) for b, k, p in zip(block, kind, payload, strict=True) if k == 1]
    if sent:
        h = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for _, x in sent])
        c = np.concatenate([x[1] for _, x in sent]).astype(np.int64)
        only = np.concatenate([x[2] for _, x in sent])
        origin = np.repeat(np.arange(len(sent)), [len(x[0]) for _, x in sent])
        order = np.argsort(h)
        hs = h[order]
        new = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
        df = np.repeat(np.add.reduceat(c[order], new), np.diff(np.append(new, len(hs))))
        keep = df > 1
        at = order[keep]
        df = df[keep]
        back = np.lexsort((h[at], origin[at]))
        at, df = at[back], df[back]
        cuts = np.searchsorted(origin[at], np.arange(len(sent) + 1))
        for i, (b, _) in enumerate(sent):
            s = at[cuts[i]:cuts[i + 1]]
            if len(s):
                out.append((b, 1, pack(np.diff(h[s], prepend=_U(0)), df[cuts[i]:cuts[i + 1]].astype(np.uint64),
                                       c[s].astype(np.uint32), only[s])))
    return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()),
                     "payload": pa.array([r[2] for r in out], pa.binary())})


_SET_SCHEMA = "doc_id long, n long, own long, cls binary, shared binary"


def _sets(key, table):
    """One block: per document its size, and if its prefix holds a shared
    shingle, its class, the number of shingles of its own (``own``) and its
    shared ones, rarest first."""
    import pyarrow as pa

    kind, payload = table.column("kind").to_pylist(), table.column("payload").to_pylist()
    head = payload[kind.index(0)]
    size = int.from_bytes(head[:8], "little")
    ids, null, n, p1, p2 = unpack(head[8:8 + size], "<i8", "u1", "<i8", "<u8", "<u8")
    lh, ld = unpack(head[8 + size:], "<u8", "<u4")
    h, df, d = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, p in zip(kind, payload, strict=True):
        if k == 1:
            delta, f, c, only = unpack(p, "<u8", "<u8", "<u4", "<u4")
            x = np.cumsum(delta, dtype=np.uint64)
            one = c == 1
            h.append(x[one])
            df.append(f[one])
            d.append(only[one].astype(np.int64))
            many = ~one
            if many.any():
                lo, hi = np.searchsorted(lh, x[many], "left"), np.searchsorted(lh, x[many], "right")
                reps = hi - lo
                at = np.repeat(hi - np.cumsum(reps), reps) + np.arange(reps.sum())
                h.append(lh[at])
                df.append(np.repeat(f[many], reps))
                d.append(ld[at].astype(np.int64))
    h, df, d = np.concatenate(h), np.concatenate(df), np.concatenate(d)
    m = np.bincount(d, minlength=len(ids))
    live = (n > 0) & (DEN * m >= NUM * n)
    pick = live[d]
    h, df, d = h[pick], df[pick], d[pick]
    order = np.lexsort((h, df, d))
    h, d = h[order], d[order]
    cuts = np.searchsorted(d, np.arange(len(ids) + 1))
    cls = [n[i].tobytes()[:4] + p1[i].tobytes() + p2[i].tobytes() if live[i] else None for i in range(len(ids))]
    sets = [h[cuts[i]:cuts[i + 1]].tobytes() if live[i] else None for i in range(len(ids))]
    return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n": pa.array(n), "own": pa.array(n - m),
                     "cls": pa.array(cls, pa.binary()), "shared": pa.array(sets, pa.binary())})


def prefix_size(n):
    """Rarest shingles of a set of n, of which linked sets share one."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def _prefixes(batches):
    import pyarrow as pa

    for b in batches:
        cls, n, own, sets = (b.column(i).to_pylist() for i in range(4))
        take = [max(0, prefix_size(x) - o) for x, o in zip(n, own, strict=True)]
        h = [np.frombuffer(s, "<i8")[:t] for s, t in zip(sets, take, strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in h])]).astype(np.int32)
        flat = np.concatenate(h) if h else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))], names=["cls", "h"])


class _Group:
    """Classes of one cluster (or two chunks of it) and their links."""

    RANGES = 16

    def __init__(self, n, own, sets):
        self.n, self.own = np.array(n, np.int64), np.array(own, np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        self.off = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        _, tok = np.unique(flat, return_inverse=True)
        self.tok = tok
        self.flag = np.zeros(int(tok.max()) + 1 if len(tok) else 1, bool)
        owner = np.repeat(np.arange(len(sets)), sizes)
        pos = np.arange(len(flat)) - np.repeat(self.off[:-1], sizes) + self.own[owner]
        # tokens per range of the hash: fixed pivots of the suffix filter
        cell = owner * self.RANGES + (flat >> _U(BITS - 4)).astype(np.int64)
        self.cells = np.bincount(cell, minlength=len(sets) * self.RANGES).reshape(-1, self.RANGES)
        pre = pos < prefix_size(self.n)[owner]
        order = np.lexsort((owner[pre], tok[pre]))
        self.p_tok, self.p_doc, self.p_pos = tok[pre][order], owner[pre][order], pos[pre][order]
        self.label = np.arange(len(sets))

    def candidates(self, x: int, other: np.ndarray) -> np.ndarray:
        """Classes of ``other`` (a mask) that the filters leave for ``x``."""
        t = self.tok[self.off[x]:self.off[x] + max(0, int(prefix_size(self.n[x]) - self.own[x]))]
        lo, hi = np.searchsorted(self.p_tok, t, "left"), np.searchsorted(self.p_tok, t, "right")
        reps = hi - lo
        at = np.repeat(hi - np.cumsum(reps), reps) + np.arange(reps.sum())
        y, y_pos = self.p_doc[at], self.p_pos[at]
        x_pos = np.repeat(np.arange(len(t)) + self.own[x], reps)
        ok = other[y] & (self.label[y] != self.label[x])
        y, first = np.unique(y[ok], return_index=True)
        x_pos, y_pos = x_pos[ok][first], y_pos[ok][first]
        nx, ny = self.n[x], self.n[y]
        need = -(-NUM * (nx + ny) // (NUM + DEN))
        length = DEN * np.minimum(nx, ny) >= NUM * np.maximum(nx, ny)
        room = np.minimum(nx - x_pos, ny - y_pos) >= need
        shared = np.minimum(nx - self.own[x], ny - self.own[y]) >= need
        # suffix: shared tokens apart from those that one of both has too many of in a range
        most = np.minimum(self.cells[x], self.cells[y]).sum(axis=1) >= need
        return y[length & room & shared & most]

    def common(self, x: int, ys: np.ndarray) -> np.ndarray:
        self.flag[self.tok[self.off[x]:self.off[x + 1]]] = True
        out = np.array([np.count_nonzero(self.flag[self.tok[self.off[y]:self.off[y + 1]]]) for y in ys], np.int64)
        self.flag[self.tok[self.off[x]:self.off[x + 1]]] = False
        return out

    def links(self, side: np.ndarray) -> list[tuple[int, int]]:
        """A spanning forest of the links between sides 0 and 1, or of all
        links if every class is on side 0.  Classes with the smallest share of
        shingles of their own probe first: a common ancestor of many copies
        ties them together early."""
        out = []
        rank = np.argsort(self.own / np.maximum(self.n, 1), kind="stable")
        two = side.any()
        other = side == 1 if two else np.ones(len(side), bool)
        for x in rank:
            if two and side[x]:
                continue
            if not two:
                other[x] = False
            ys = self.candidates(x, other)
            if not len(ys):
                continue
            inter = self.common(x, ys)
            for y in ys[DEN * inter >= NUM * (self.n[x] + self.n[ys] - inter)]:
                if self.label[x] != self.label[y]:
                    self.label[self.label == self.label[y]] = self.label[x]
                    out.append((int(x), int(y)))
        return out


def _join(key, table):
    """Links among the classes dealt to one task."""
    import pyarrow as pa

    t = table.sort_by([("cluster", "ascending"), ("i", "ascending"), ("j", "ascending"), ("cls", "ascending")])
    names = ("cluster", "i", "j", "side", "cls", "n", "own", "shared")
    cluster, i, j, side, cls, n, own, shared = (t.column(c).to_pylist() for c in names)
    a, b = [], []
    lo = 0
    while lo < len(cls):
        hi = lo
        while hi < len(cls) and (cluster[hi], i[hi], j[hi]) == (cluster[lo], i[lo], j[lo]):
            hi += 1
        group = _Group(n[lo:hi], own[lo:hi], [np.frombuffer(s, "<u8") for s in shared[lo:hi]])
        for x, y in group.links(np.array(side[lo:hi])):
            a.append(cls[lo + x])
            b.append(cls[lo + y])
        lo = hi
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """Steps 1 and 2, written: doc_id, n, own, cls, shared (cls and shared are
    null for documents that cannot have a partner)."""
    spark = docs.sparkSession
    n_buckets = n_buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(_send(n_buckets), _BLOCK_SCHEMA)
    back = sent.groupBy("bucket").applyInArrow(_count, "block long, kind int, payload binary")
    return written(back.groupBy("block").applyInArrow(_sets, _SET_SCHEMA), "op7-sets", "lz4")


def class_links(sets: DataFrame) -> DataFrame:
    """Step 3: (a, b), a spanning forest of the links between classes."""
    live = sets.filter("cls IS NOT NULL")
    classes = live.groupBy("cls").agg(F.first("n").alias("n"), F.first("own").alias("own"),
                                      F.first("shared").alias("shared"))
    classes = written(classes, "op7-classes", "lz4")
    rows = classes.select("cls", "n", "own", "shared").mapInArrow(_prefixes, "cls binary, h array<long>").select(
        "cls", F.explode("h").alias("h"))
    rows = written(rows, "op7-prefixes")
    least = rows.groupBy("h").agg(F.min("cls").alias("m"), F.max("cls").alias("top")).filter("m <> top")
    near = rows.join(least, "h").filter("cls <> m").select("cls", "m").distinct()
    cluster = written(components(near, "cls", "m"), "op7-clusters")
    weighed = cluster.join(classes.select(F.col("cls").alias("node"), (F.octet_length("shared") / 8).alias("w")), "node")
    sizes = weighed.groupBy("root").agg(F.ceil(F.sum("w") / CHUNK).cast("int").alias("chunks"), F.sum("w").alias("w"))
    total = sizes.agg(F.sum(F.col("w") * F.col("chunks"))).first()[0] or 0
    bins = max(1, int(total // CHUNK) * 2, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    c, k = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"), F.col("chunks")
    pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(
        F.least(F.col("c"), o).alias("i"), F.greatest(F.col("c"), o).alias("j"),
        (F.col("c") > o).cast("int").alias("side")))
    salted = sizes.select(F.col("root").alias("cluster"), "chunks",
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = (cluster.select(F.col("node").alias("cls"), F.col("root").alias("cluster"),
                            F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
             .join(salted, ["cluster", "salt"])
             .withColumn("c", c).select("cls", "cluster", F.explode(pairs).alias("p"))
             .select("cls", "cluster", "p.i", "p.j", "p.side")
             .withColumn("bin", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(bins))))
    return dealt.join(classes, "cls").groupBy("bin").applyInArrow(_join, "a binary, b binary")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by
    links, its own included) of every document."""
    sets = document_sets(docs, id_col, text_col)
    root = components(class_links(sets), "a", "b")
    lows = sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("low"))
    lows = lows.join(root.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "low", F.coalesce("root", "cls").alias("root"))
    lows = written(lows, "op7-lows")
    best = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = lows.join(best, "root").select("cls", "component_id")
    n = F.col("n").alias("n_shingles")
    linked = sets.filter("cls IS NOT NULL").select("doc_id", "cls", n).join(of_class, "cls").select(
        "doc_id", "n_shingles", "component_id")
    alone = sets.filter("cls IS NULL").select("doc_id", n, F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone)
