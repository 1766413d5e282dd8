"""Benchmark decontamination by canonical templates.

Benchmark items and documents are brought to two forms.  In the first, numbers,
names and units become typed placeholders (a run of capitalised words, or a
number with inner points and commas, is one of them), so an item with other
values gives the same windows.  In the second, words are case-folded and
names stay words, so an item in capitals or small letters does.  Items that
have no window in either (too few literal words) are looked for word by word.

Windows of WINDOW words are hash-joined.  Matches of one document and one
template on neighbouring diagonals (document place less template place, up to
SHIFT apart) are put together, so a word put in or left out does not part
them; the template's words under matched windows are counted, and the slots
are checked: each filler of the template must stand for one filler of the
document wherever it occurs.  Templates of which at least COVER of the words
are found with consistent slots count as leaked.

Items with the same canonical words and equal fillers in the same slots are one
template, so a benchmark of many re-parameterised questions does not multiply
matches; ``exact`` compares the fillers of each item.  A bitmap of
2 ** BITMAP_BITS bits (1 MB whatever the benchmark's size) of the template
windows keeps windows that cannot join from becoming rows.

Defined results: null and empty texts hold nothing; a text may be of any
length; items of fewer than LEAST words are never matched (``unmatchable``
lists them); an item of LEAST to WINDOW - 1 words is matched as one window of
its own length; rows that repeat a document are found each on its own, also
without an id; of several places in a document the one that covers most
counts, the first of equal ones; other columns play no part; empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.hashing import ALNUM, Words, gram_hashes, mix, text_blocks, word_hashes
from durata.llm.shared import written

WINDOW = 5
LEAST = 4
#: Literal words that a window of the first two forms needs.
LITERALS = 2
#: Share of a template's words that must be found.
COVER = 0.5
#: Diagonals so far apart are put together.
SHIFT = 8
#: Share of a template's slots whose filler must be consistent.
CONSISTENT = 0.8
BITMAP_BITS = 23
#: Forms of a text: names as slots, names as words, everything as words.
SLOTTED, FOLDED, LITERAL = 0, 1, 2
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres g kg mg lb lbs "
         "oz ton tons gram grams kilogram kilograms pound pounds ounce ounces l ml liter liters litre litres gallon "
         "gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month "
         "months year years mph kmh km2 m2 percent dollar dollars usd euro euros eur cent cents degree degrees").split()
_U = np.uint64
NUMBER, NAME, UNIT = _U(0x6E756D62657200), _U(0x6E616D6500), _U(0x756E697400)


def _unit_hashes() -> np.ndarray:
    return np.sort(word_hashes((" ".join(UNITS) + " ").encode(), ALNUM)[2])


_UNITS = _unit_hashes()


class Form:
    """A block of texts in one form: ``canon`` (hash of each word or of its
    placeholder), ``slot`` (whether it is one), ``fill`` (hash of what stands
    there), ``doc`` and ``place`` (its first word's number in the text), and
    ``first`` as in ``Words``."""

    def __init__(self, w: Words, form: int):
        a = np.frombuffer(w.buf, np.uint8)
        n = len(w.hash)
        digits = np.zeros(len(a) + 1, np.int32)
        np.cumsum((a >= 0x30) & (a <= 0x39), out=digits[1:])
        number = digits[w.end] - digits[w.start] == w.end - w.start
        head = a[w.start]
        name = (head >= 0x41) & (head <= 0x5A)
        if form != SLOTTED:
            name[:] = False
        if form == LITERAL:
            number[:] = False
        # what stands between a word and the one before it, in the same text
        near = np.zeros(n, bool)
        near[1:] = (w.doc[1:] == w.doc[:-1]) & (w.start[1:] - w.end[:-1] == 1)
        between = np.where(near, a[w.start - 1], 0)
        joined = np.zeros(n, bool)
        joined[1:] = (name[1:] & name[:-1] & (between[1:] == 0x20)) | (
            number[1:] & number[:-1] & np.isin(between[1:], [0x2C, 0x2E]))
        keep = np.flatnonzero(~joined)
        self.doc = w.doc[keep]
        self.first = np.searchsorted(keep, w.first)
        self.place = keep - w.first[self.doc] if n else keep
        rank = np.arange(n) - np.repeat(keep, np.diff(np.append(keep, n)))
        self.fill = np.add.reduceat(mix(w.hash + rank.astype(np.uint64) * NUMBER), keep) if n else w.hash
        number, name, single = number[keep], name[keep], w.hash[keep]
        after = np.zeros(len(keep), bool)
        if form != LITERAL:
            after[1:] = number[:-1] & (self.doc[1:] == self.doc[:-1])
        unit = after & np.isin(single, _UNITS)
        kind = np.select([number, unit, name], [1, 3, 2], 0)
        self.slot = kind > 0
        self.canon = np.where(self.slot, np.array([0, NUMBER, NAME, UNIT], np.uint64)[kind], single) + _U(form) * UNIT
        self.count = np.diff(self.first)
        self.literals = LITERALS if form != LITERAL else 0

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of windows of ``k`` words within one text and
        with enough literal words."""
        g = gram_hashes(self.canon, k)
        if not len(g):
            return np.zeros(0, np.int64), g
        lit = np.concatenate([[0], np.cumsum(~self.slot)])
        ok = (self.doc[:len(g)] == self.doc[k - 1:]) & (lit[k:] - lit[:-k] >= min(k, self.literals))
        at = np.flatnonzero(ok)
        return at, g[at]

    def print(self, i: int) -> str:
        """Digest of a text's canonical words and of which slots hold equal
        fillers."""
        mine = slice(self.first[i], self.first[i + 1])
        _, at, same = np.unique(self.fill[mine][self.slot[mine]], return_index=True, return_inverse=True)
        return hash_bytes(np.concatenate([self.canon[mine], at[same].astype(np.uint64)]))


def _lower(text: bytes) -> bytes:
    return text if text.isascii() else text.decode().lower().encode()


_WINDOW = "array<struct<pos:int,size:int,hash:long,place:int,slots:array<long>>>"


def _scan(bitmap, forms: list[tuple[int, int]], whole: bool):
    """Texts -> a row (key, form, words in it, print, windows) for each form.
    Benchmark items (``whole``) give all windows of their size, documents
    those that the bitmap lets through."""
    def work(batches):
        import pyarrow as pa

        bits = None if whole else np.frombuffer(bitmap.value, np.uint64)
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("place", pa.int32()),
                                   ("slots", pa.list_(pa.int64()))]))
        for b in batches:
            for lo, hi, texts in text_blocks(b.column(1)):
                words = Words(texts, ALNUM)
                # word hashes fold ASCII letters; others are lowered where there are any
                lowered = words if all(t.isascii() for t in texts) else Words([_lower(t) for t in texts], ALNUM)
                for form in sorted({f for f, _ in forms}):
                    w = Form(words if form == SLOTTED else lowered, form)
                    rows: list[list] = [[] for _ in range(hi - lo)]
                    for k in [k for f, k in forms if f == form]:
                        at, h = w.windows(k)
                        if whole:
                            mine = w.count[w.doc[at]]
                            ok = (mine >= WINDOW) if k == WINDOW else (mine == k)
                        else:
                            cell = h >> _U(64 - BITMAP_BITS)
                            ok = (bits[(cell >> _U(6)).astype(np.int64)] >> (cell & _U(63))) & _U(1) == 1
                        for p, x in zip(at[ok].tolist(), h[ok].astype(np.int64).tolist(), strict=True):
                            slots = np.where(w.slot[p:p + k], w.fill[p:p + k], _U(0)).astype(np.int64)
                            rows[w.doc[p]].append({"pos": p - int(w.first[w.doc[p]]), "size": k, "hash": x,
                                                   "place": int(w.place[p]), "slots": slots.tolist()})
                    prints = [f"{form}{w.print(i)}" for i in range(hi - lo)] if whole else [None] * (hi - lo)
                    some = np.arange(hi - lo) if whole else np.array([i for i, r in enumerate(rows) if r], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, hi - lo).take(pa.array(some)), b.column(2).slice(lo, hi - lo).take(pa.array(some)),
                         pa.array(np.full(len(some), form, np.int32)), pa.array(w.count[some].astype(np.int32)),
                         pa.array([prints[i] for i in some], pa.string()), pa.array([rows[i] for i in some], kind)],
                        names=["key", "uid", "form", "n_words", "print", "windows"])
    return work


_SCANNED = f"key long, uid long, form int, n_words int, print string, windows {_WINDOW}"


def hash_bytes(a: np.ndarray) -> str:
    import hashlib

    return hashlib.md5(a.tobytes()).hexdigest()


def _rows(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key, text and a number of its own for each row: repeated rows stay apart."""
    return table.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"),
                        F.monotonically_increasing_id().alias("uid"))


def templates(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(template, item_id, form, n_words, pos, size, hash, slots), one row per
    window; ``template`` is the print of the item's form and of the pattern of
    its equal fillers.  The literal form is for items without windows in the
    other two."""
    forms = [(f, k) for f in (SLOTTED, FOLDED, LITERAL) for k in range(LEAST, WINDOW + 1)]
    scanned = _rows(benchmark, id_col, text_col).mapInArrow(_scan(None, forms, True), _SCANNED)
    scanned = scanned.filter(F.size("windows") > 0)
    other = scanned.filter(F.col("form") < LITERAL).select("uid").distinct()
    literal = scanned.filter(F.col("form") == LITERAL).join(other, "uid", "left_anti")
    kept = scanned.filter(F.col("form") < LITERAL).unionByName(literal)
    return kept.select(F.col("print").alias("template"), F.col("key").alias("item_id"), "form", "n_words",
                       F.explode("windows").alias("w")).select(
        "template", "item_id", "form", "n_words", "w.pos", "w.size", "w.hash", "w.slots")


def unmatchable(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Items too short to be looked for."""
    found = templates(benchmark, id_col, text_col).select("item_id").distinct()
    return benchmark.select(F.col(id_col).cast("long").alias("item_id")).join(found, "item_id", "left_anti")


def _bitmap(windows: DataFrame) -> bytes:
    """Bitmap over the leading bits of the window hashes, summed up in Spark:
    at most 2 ** (BITMAP_BITS - 6) words reach the driver."""
    cell = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    words = windows.groupBy(F.shiftright(cell, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63 AS INT))")).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for r in words.toLocalIterator():
        out[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out.tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, first_word, exact): one row per document
    row and leaked item; coverage is the share of the item's words found.
    ``exact`` says that every window is there and all slots hold the item's
    own values."""
    spark = docs.sparkSession
    items = written(templates(benchmark, item_col, item_text_col), "op8-templates")
    one = items.groupBy("template").agg(F.min_by("item_id", F.coalesce("item_id", F.lit(-(1 << 63)))).alias("item_id"))
    same = (items["template"] == one["template"]) & items["item_id"].eqNullSafe(one["item_id"])
    windows = items.join(one, same, "left_semi").drop("item_id", "form").dropDuplicates(["template", "pos", "size"])
    forms = sorted((r["form"], r["size"]) for r in items.select("form", "size").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    scanned = _rows(docs, id_col, text_col).mapInArrow(_scan(bitmap, forms, False), _SCANNED)
    found = written(scanned.select("uid", F.col("key").alias("doc_id"), F.explode("windows").alias("w")).select(
        "uid", "doc_id", F.col("w.pos").alias("at"), F.col("w.place").alias("place"), F.col("w.hash").alias("hash"),
        F.col("w.size").alias("size"), F.col("w.slots").alias("fill")), "op8-windows")
    hits = found.join(windows, ["hash", "size"]).withColumn("diagonal", F.col("at") - F.col("pos"))
    # two rows of bands, half a band apart: diagonals up to SHIFT apart share one
    bands = F.array(F.floor(F.col("diagonal") / (2 * SHIFT)) * 2, F.floor((F.col("diagonal") + SHIFT) / (2 * SHIFT)) * 2 + 1)
    banded = hits.withColumn("band", F.explode(bands))
    group = ["uid", "template", "band"]
    # a template's places in one band: no more than it has words
    votes = banded.groupBy(*group).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("size").alias("size"),
        F.array_sort(F.collect_set("pos")).alias("places"), F.min("place").alias("first_word"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    words = F.aggregate("places", start, lambda done, p: F.struct(
        (done["n"] + p + F.col("size") - F.greatest(p, done["end"])).alias("n"), (p + F.col("size")).alias("end")))["n"]
    votes = votes.select(*group, "doc_id", "n_words", "first_word", words.alias("words"))
    # slot fillers seen by all matched windows of a band: one document filler each?
    pairs = banded.select(*group, F.explode(F.arrays_zip("slots", "fill")).alias("s")).filter("s.slots <> 0").select(
        *group, F.col("s.slots").alias("theirs"), F.col("s.fill").alias("mine"))
    slots = pairs.groupBy(*group, "theirs").agg(F.min("mine").alias("lo"), F.max("mine").alias("hi")).groupBy(*group).agg(
        F.count("*").alias("slots"), F.count_if(F.col("lo") == F.col("hi")).alias("steady"))
    judged = votes.join(slots, group, "left").filter(
        (F.col("words") >= COVER * F.col("n_words"))
        & (F.col("slots").isNull() | (F.col("steady") >= CONSISTENT * F.col("slots"))))
    best = written(judged.groupBy("uid", "template").agg(F.max_by(
        F.struct("doc_id", (F.col("words") / F.col("n_words")).alias("coverage"), "first_word"),
        F.struct("words", -F.col("first_word"), -F.col("band"))).alias("b")), "op8-best")
    # fillers in order of the item's windows: one digest for each item, and one for each diagonal of a document
    order = F.sort_array(F.collect_set(F.struct("pos", "size", "slots")))
    print_ = lambda windows: F.md5(F.to_json(windows).cast("binary"))
    members = written(items.groupBy("template", "item_id").agg(print_(order).alias("fillers")), "op8-members")
    # the document's filler stands where the template has a slot
    held = F.zip_with("slots", "fill", lambda x, y: F.when(x == 0, x).otherwise(y)).alias("slots")
    held = hits.join(best.select("uid", "template"), ["uid", "template"], "left_semi").select(
        "uid", "template", "diagonal", "pos", "size", held).groupBy("uid", "template", "diagonal").agg(print_(order).alias("fillers"))
    whole = held.join(members, ["template", "fillers"]).select(
        "uid", "template", F.col("item_id").alias("own"), F.lit(True).alias("whole")).distinct()
    leaked = best.join(members.select("template", "item_id"), "template")
    match = (leaked["uid"] == whole["uid"]) & (leaked["template"] == whole["template"]) & leaked["item_id"].eqNullSafe(whole["own"])
    leaked = leaked.join(whole.select(whole["uid"], whole["template"], "own", "whole"), match, "left").select(
        leaked["uid"], "item_id", "b", F.coalesce("whole", F.lit(False)).alias("exact"))
    return leaked.groupBy("uid", "item_id").agg(
        F.max_by("b", F.struct("b.coverage", -F.col("b.first_word"))).alias("b"), F.max("exact").alias("exact")).select(
        "b.doc_id", "item_id", "b.coverage", "b.first_word", "exact")
