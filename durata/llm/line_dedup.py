"""Line de-duplication by content-defined chunks (native functions only).

A joint is a line with the next one.  Their hashes are counted over the
corpus; a chunk ends where a joint is rarer than one beside it, so at both
ends of a passage that several documents share, whatever stands around it.
Longer passages are cut further where a joint's hash is less than both beside
it: such cuts depend on nearby lines alone, survive shifts and leave no chunk of
one line.  Chunks of several lines that occur
more than once in the corpus are removed except for their first occurrence
(least doc_id, then place), after their bytes were compared: equal chunk
hashes count as repeats only if the texts behind them are equal.

Defined results: null text counts as the empty text and stays null; chunks of
one line and chunks without a word are never removed; rows that repeat both
doc_id and text are one document and share its fate; a null doc_id sorts
last; texts of any number of lines are cut whole, in time linear in their
lines; an empty table gives an empty table.  Other columns pass through; those
with a name that the operator needs (``__id``, ``__mark``, ``__text``,
``__lines``, ``__chunks``, ``__gone``, with counts ``n_lines`` and
``n_removed``) raise a ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from durata.llm.shared import written

#: A null doc_id comes after all others.
LAST = 2 ** 63 - 1


def _joints(text: str) -> Column:
    """Hashes of each line with the next one: joint ``b`` - 1 lies between lines ``b`` - 1 and ``b``."""
    h = F.transform(F.split(text, "\n"), lambda x: F.xxhash64(x))
    return F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda x, y: F.xxhash64(x, y))


def _counted(keyed: DataFrame) -> DataFrame:
    """(__id, __mark, __found): the joints of each document that the corpus
    holds more than once, as (place, count) in order."""
    joints = keyed.select("__id", "__mark", F.posexplode(_joints("__text")).alias("at", "joint"))
    again = written(joints.groupBy("joint").agg(F.count("*").alias("n")).filter("n > 1"), "op4-joints")
    # written, so that Spark can split a hot joint's rows in a plain join
    places = written(joints.join(again, "joint").select("__id", "__mark", "at", "n"), "op4-places")
    return places.groupBy("__id", "__mark").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("__found"))


def with_chunks(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Add ``__lines`` and ``__chunks``: (from, to, hash), lines ``from`` to
    ``to`` - 1, in order.  Cuts look at all of ``docs``."""
    own = "__id" not in docs.columns
    d = docs.withColumns({"__id": F.lit(0).cast("long"), "__mark": F.xxhash64(text)}) if own else docs
    counted = written(_counted(d.select("__id", "__mark", F.col(text).alias("__text"))), "op4-counted")
    d = d.join(counted.hint("merge"), ["__id", "__mark"], "left")
    d = d.withColumn("__lines", F.split(text, "\n")).withColumn("__h", F.transform("__lines", lambda x: F.xxhash64(x)))
    d = d.withColumn("__p", _joints(text))
    found, p, n = F.col("__found"), F.col("__p"), F.size("__lines")
    ones = lambda k: F.array_repeat(F.lit(1).cast("long"), k)
    before = lambda k: F.when(k > 0, F.get(found, k - 1)["at"]).otherwise(-1)
    d = d.withColumn("__n", F.when(found.isNull(), ones(n - 1)).otherwise(F.concat(
        F.flatten(F.transform(found, lambda x, k: F.concat(ones(x["at"] - before(k) - 1), F.array(x["n"])))),
        ones(n - 2 - F.element_at(found, -1)["at"]))))
    counts = F.col("__n")
    at = lambda b: F.coalesce(F.when(b > 0, F.get(counts, b - 1)), F.lit(0))
    end = lambda b: at(b) < F.greatest(at(b - 1), at(b + 1))
    # least of three joints: never next to another such cut, and two lines off the end of a repeat
    least = lambda b: ((at(b - 1) == at(b)) & (at(b) == at(b + 1)) & ~end(b - 1) & ~end(b + 1)
                       & (F.get(p, b - 1) < F.get(p, b - 2)) & (F.get(p, b - 1) < F.get(p, b)))
    d = d.withColumn("__ends", F.filter(F.sequence(F.lit(1), n), lambda b: (b == n) | end(b) | ((b > 1) & least(b))))
    ends, h = F.col("__ends"), F.col("__h")
    start = lambda k: F.when(k > 0, F.get(ends, k - 1)).otherwise(0)
    d = d.withColumn("__chunks", F.transform("__ends", lambda e, k: F.struct(
        start(k).alias("from"), e.alias("to"), F.xxhash64(F.slice(h, start(k) + 1, e - start(k))).alias("hash"),
        (F.get(counts, start(k)) > 1).alias("again"))))
    return d.drop("__h", "__p", "__n", "__ends", "__found", *(("__id", "__mark") if own else ()))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key columns ``__id``, ``__mark`` (hash of the text) and ``__text``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)), "__text": text,
                             "__mark": F.xxhash64(text)})


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """Hashes of multi-line chunks with a word that occur at least twice, all
    with the same bytes."""
    by_bytes = chunks.groupBy("hash", "text").agg(F.count("*").alias("n"))
    return (by_bytes.groupBy("hash").agg(F.count("*").alias("texts"), F.sum("n").alias("n"),
                                         F.bool_or(F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("wordy"))
            .filter("texts = 1 AND n > 1 AND wordy").select("hash"))


def removals(keyed: DataFrame) -> DataFrame:
    """(__id, __mark, __gone): per document the chunks to remove, as (from,
    to) pairs in order."""
    lines = F.col("__lines")
    # the joints of a repeated chunk are repeated, so no other chunk needs its text
    some = F.filter("__chunks", lambda c: (c["to"] - c["from"] > 1) & c["again"])
    chunks = with_chunks(keyed.select("__id", "__mark", "__text")).select("__id", "__mark", F.explode(
        F.transform(some, lambda c: F.struct(c["from"].alias("from"), c["to"].alias("to"), c["hash"].alias("hash"),
                                             F.array_join(F.slice(lines, c["from"] + 1, c["to"] - c["from"]), "\n")
                                             .alias("text")))).alias("c")).select(
        "__id", "__mark", "c.from", "c.to", "c.hash", "c.text")
    chunks = written(chunks, "op4-chunks")
    # both small sides are written, so that a join reads plain shuffles and Spark can split a hot chunk's rows
    again = written(chunks.drop("text").join(written(repeated_chunks(chunks), "op4-hashes"), "hash"), "op4-repeats")
    place = F.struct("__id", "__mark", "from")
    first = written(again.groupBy("hash").agg(F.min(place).alias("first")), "op4-first")
    return (again.join(first, "hash").filter(place != F.col("first"))
            .groupBy("__id", "__mark").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("__gone")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text_col``.  With
    ``counts`` also ``n_lines`` and ``n_removed``."""
    names = docs.columns
    taken = {c.lower() for c in names} & {"__id", "__mark", "__text", "__lines", "__chunks", "__gone",
                                          *(("n_lines", "n_removed") if counts else ())}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the input already")
    keyed = _keyed(docs, id_col, text_col)
    gone = written(removals(keyed), "op4-removals")
    # a merge join at every size: the removals grow with the corpus
    d = keyed.join(gone.hint("merge"), ["__id", "__mark"], "left").withColumn("__lines", F.split("__text", "\n"))
    g = F.col("__gone")
    # the removed chunks part the lines into stretches that stay: from each one's end to the next one's start
    froms = F.concat(F.array(F.lit(0)), F.transform(g, lambda c: c["to"]))
    tos = F.concat(F.transform(g, lambda c: c["from"]), F.array(F.size("__lines")))
    kept = F.flatten(F.zip_with(froms, tos, lambda a, b: F.slice(F.col("__lines"), a + 1, b - a)))
    text = F.when(g.isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    if counts:
        size = F.aggregate(g, F.lit(0), lambda a, c: a + c["to"] - c["from"])
        out += [F.size("__lines").cast("long").alias("n_lines"), F.coalesce(size, F.lit(0)).cast("long").alias("n_removed")]
    return d.select(*out)
