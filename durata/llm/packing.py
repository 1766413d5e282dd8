"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits a sequence.  The
linear program asks for the least number of sequences whose configurations
cover the histogram of lengths.  It is solved by multiplicative weights: every
length starts at a weight near its volume, a knapsack dynamic
programme over the capacity finds the configuration of greatest value at the
present prices, and lengths that are covered ahead of the others get cheaper.
The programme covers lengths of a ``SMALL``-th of the capacity and more; it is
rounded to whole sequences, most used configurations first, and what is left,
and the small pieces, go best-fit into the gaps (the rounding that ends with
the fewest sequences is taken).  Each step works on counts per length: its
cost depends on the capacity, never on the number of documents.

Pieces are matched to slots without a join of large tables: a piece has its
exact rank among the pieces of its length, and the plan assigns intervals of
ranks to configurations.

Defined results: null text counts as empty; a document without any id (empty
text, no end id) has no piece; rows that repeat an id or a text are documents
of their own; a document longer than the capacity is cut, its last piece may
be shorter; an empty table gives an empty plan.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from durata.llm.shared import written
from durata.llm.token_store import _chunks, _encoder, _with_end

#: Configurations asked for, and how sharply prices follow coverage.
ROUNDS = 192
RATE = 8.0
#: Long pieces start dearer than their volume, so that what is left is easy.
HARD = 1.05
#: Lengths below this part of the capacity only fill gaps.
SMALL = 32
#: Shares of the linear program's solution that the rounding tries.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.1)
_RANK_BITS = 44


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = None, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """The pieces of every document, written once: doc_id, piece, start (ids
    of the document before it), length, ids (little-endian unsigned 32-bit
    numbers), and its place: ``nth`` among the pieces of its length in part
    ``part``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), _encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            at = 0
            for keys, texts in _chunks(b):
                owner, piece, ids = [], [], []
                for i, x in enumerate(enc(texts)):
                    x = _with_end(x, end_id)
                    for j in range(0, len(x), 4 * capacity):
                        owner.append(at + i)
                        piece.append(j // (4 * capacity))
                        ids.append(x[j:j + 4 * capacity])
                at += len(keys)
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                order = np.argsort(length, kind="stable")
                new = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(ids), np.int64)
                nth[order] = np.arange(len(ids)) - np.repeat(np.cumsum(new) - new, new) + np.repeat(seen, new)
                seen += new
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity),
                     pa.array(length), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return written(rows.mapInArrow(
        work, f"doc_id {id_type}, piece int, start long, length long, ids binary, part int, nth long"), "pieces")


def _items(lengths: list[int], most: list[int], capacity: int) -> list[tuple[int, int]]:
    """(length, copies): copies of a length split into powers of two."""
    out = []
    for length, top in zip(lengths, most, strict=True):
        left, k = min(top, capacity // length), 1
        while left > 0:
            out.append((length, min(k, left)))
            left -= k
            k *= 2
    return out


def _dearest(items: list[tuple[int, int]], values: np.ndarray, capacity: int) -> tuple[float, tuple]:
    """Value and configuration of the best knapsack over ``items``."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for j, (length, copies) in enumerate(items):
        w = length * copies
        with_it = best[:capacity + 1 - w] + values[j]
        np.greater(with_it, best[w:], out=taken[j, w:])
        np.maximum(with_it, best[w:], out=best[w:])
    room, config = capacity, {}
    for j in range(len(items) - 1, -1, -1):
        if taken[j, room]:
            length, copies = items[j]
            config[length] = config.get(length, 0) + copies
            room -= length * copies
    return float(best[capacity]), tuple(sorted(config.items()))


def solve(histogram: np.ndarray, capacity: int) -> tuple[dict[tuple, float], float]:
    """Fractional numbers of sequences per configuration, and the greatest
    lower bound that the prices proved for the linear program."""
    lengths = np.flatnonzero(histogram)
    lengths = lengths[(lengths >= max(1, capacity // SMALL)) & (lengths < capacity)]
    if not len(lengths):
        return {}, 0.0
    n = histogram[lengths].astype(float)
    sequences = max(1.0, float((lengths * n).sum()) / capacity)
    # no configuration holds far more of a length than its share
    most = np.minimum(np.maximum(1, np.ceil(2 * n / sequences)), n).astype(int)
    items = _items(lengths.tolist(), most.tolist(), capacity)
    number = {length: i for i, length in enumerate(lengths.tolist())}
    which = np.array([number[length] for length, _ in items])
    copies = np.array([c for _, c in items], float)
    covered, found, bound, step = np.zeros(len(lengths)), {}, 0.0, sequences / ROUNDS
    for t in range(ROUNDS):
        price = (lengths / capacity) ** HARD * np.exp(-RATE * (covered - t / ROUNDS))
        value, config = _dearest(items, price[which] * copies, capacity)
        bound = max(bound, float(price @ n) / value)
        found[config] = found.get(config, 0.0) + step
        for length, c in config:
            covered[number[length]] += c * step / n[number[length]]
    return found, bound


def best_fit(histogram: np.ndarray, capacity: int, started: list[tuple[tuple, int]]) -> list[tuple[tuple, int]]:
    """Packs ``histogram`` best-fit, longest first, into the gaps of the
    ``started`` (configuration, sequences) and into new sequences; equal
    sequences are handled together."""
    room: dict[int, list] = {}
    rooms: list[int] = []

    def add(r, config, count):
        if r not in room:
            room[r] = []
            bisect.insort(rooms, r)
        room[r].append((config, count))

    for config, count in started:
        add(capacity - sum(length * c for length, c in config), config, count)
    for length in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[length])
        while n:
            j = bisect.bisect_left(rooms, length)
            if j == len(rooms):
                r, config, count = capacity, (), -(-n // (capacity // length))
            else:
                r = rooms[j]
                config, count = room[r].pop()
                if not room[r]:
                    del room[r], rooms[j]
            each = r // length
            full = min(count, n // each)
            if full:
                add(r - each * length, (*config, (length, each)), full)
                n, count = n - full * each, count - full
            elif n:
                add(r - n * length, (*config, (length, n)), 1)
                n, count = 0, count - 1
            if count and config:
                add(r, config, count)
    return [e for r in rooms for e in room[r]]


@dataclass
class Plan:
    """``configs``: (configuration, sequences); a configuration lists
    (length, copies) in the order they stand in a sequence.  ``bound``: no
    packing has fewer sequences."""

    capacity: int
    configs: list[tuple[tuple, int]]
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configs)


def plan(histogram: np.ndarray, capacity: int) -> Plan:
    """A packing of ``histogram[length]`` pieces of each length."""
    whole = int(histogram[capacity])
    rest = histogram.astype(np.int64).copy()
    rest[capacity] = 0
    found, bound = solve(rest, capacity)
    order = sorted(found.items(), key=lambda e: (-e[1], e[0]))
    best = None
    for share in SHARES:
        left, started = rest.copy(), []
        for config, x in order:
            n = min(int(np.ceil(x * share)), *(int(left[length]) // c for length, c in config))
            if n:
                started.append((config, n))
                for length, c in config:
                    left[length] -= c * n
        packed = best_fit(left, capacity, started)
        if best is None or sum(n for _, n in packed) < sum(n for _, n in best):
            best = packed
    volume = int((np.arange(capacity + 1) * rest).sum())
    least = max(-(-volume // capacity), int(np.ceil(bound - 1e-6)))
    return Plan(capacity, [(((capacity, 1),), whole)] * (whole > 0) + best, whole + least)


def histogram(pieces: DataFrame, capacity: int) -> np.ndarray:
    """Pieces of each length, 0 to ``capacity``."""
    h = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # one row per length at most
        h[r["length"]] = r["count"]
    return h


def _slots(p: Plan) -> np.ndarray:
    """Rows (key, first sequence, copies, offset) by ascending key, the
    length and the first rank of an interval."""
    given, rows, base = {}, [], 0
    for config, n in p.configs:
        offset = 0
        for length, copies in config:
            rank = given.get(length, 0)
            rows.append((length << _RANK_BITS | rank, base, copies, offset))
            given[length] = rank + copies * n
            offset += length * copies
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(pieces: DataFrame, p: Plan) -> DataFrame:
    """``pieces`` (with length, part, nth and any other columns) and the
    sequence_id and offset of each.

    The slots travel to every task; their number follows the capacity: some
    configurations for each round of the program and each length."""
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("length").orderBy("part")
    starts = counts.select("part", "length", (F.sum("rows").over(upto) - F.col("rows")).alias("before"))
    ranked = pieces.join(starts, ["part", "length"])
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = ranked.select(*kept, (F.col("nth") + F.col("before")).alias("__rank"))
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(p))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])

    def work(batches):
        import pyarrow as pa

        key, first, copies, offset = slots.value.T
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            at = np.searchsorted(key, length << _RANK_BITS | rank, side="right") - 1
            rank = rank - (key[at] & ((1 << _RANK_BITS) - 1))
            cols = [pa.array(first[at] + rank // copies[at]), pa.array(offset[at] + rank % copies[at] * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(work, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (end to end, as in the pieces) and members
    (offset, doc_id, piece, length) of every sequence; a group is one
    sequence."""
    member = F.struct("offset", "doc_id", "piece", "length", "ids")
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    ids = F.aggregate("m", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return whole.select("sequence_id", F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
                        ids.alias("ids"), F.transform("m", lambda x: x.dropFields("ids")).alias("members"))
