"""Name normalisation, label prettifying and dictionary harmonisation.

``harmonise`` maps free-text values onto a canonical dictionary with three
tiers, best tier wins:

1. exact: the normalised value equals a normalised canonical name (1.0);
2. synonym: the normalised value equals, contains or is contained in a
   normalised synonym (0.95);
3. fuzzy: similarity >= ``threshold``, by default the longest-matching-block
   ratio (``blocks``), with ``measure="edits"`` ``1 - levenshtein / max(len)``.

All tiers are equi-joins.  Containment joins on substrings: substrings of
each value at the lengths that synonyms have (synonym inside value), and
all substrings of the synonyms, the bounded dictionary side (value inside
synonym).  Edit candidates come from pieces: a canonical name of length L
can reach the threshold with at most ``k = floor((1 - threshold) L /
threshold)`` edits (its partner is at most L / threshold long), so of its
``k + 1`` pieces one stands unchanged in the partner, at most ``k`` places
away.  Joining on pieces and their places therefore finds every pair above
the threshold, whatever the number of edits, and nothing needs a cross
product.
Values are de-duplicated first, so a value repeated in a third of the rows
is matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import _c, py_strip
from . import blocks

# Name normalisation (fixed rules): lower/strip, "#" -> "num ", "number" -> "num",
# runs of _ - / -> space, "count" -> "n", "randomised" -> "randomized",
# "trial" removed, blanks collapsed.


def normalise_name(c) -> Column:
    s = F.lower(py_strip(_c(c)))
    s = F.replace(s, F.lit("#"), F.lit("num "))
    s = F.replace(s, F.lit("number"), F.lit("num"))
    s = F.regexp_replace(s, r"[_\-/]+", " ")
    s = F.replace(s, F.lit("count"), F.lit("n"))
    s = F.replace(s, F.lit("randomised"), F.lit("randomized"))
    s = F.replace(s, F.lit("trial"), F.lit(""))
    return F.regexp_replace(s, r"\s+", " ")


def tidy_label(c) -> Column:
    """Fallback label: ``_``/blank runs to one space, drop " ts", capitalise."""
    s = F.trim(F.regexp_replace(_c(c), r"[_\s]+", " "))
    s = F.replace(s, F.lit(" ts"), F.lit(""))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def pretty_labels(df: DataFrame, col: str, labels: DataFrame, out: str = "label",
                  key: str = "name", value: str = "label") -> DataFrame:
    """Display labels from a label dictionary (join), else the tidy fallback."""
    lab = labels.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    j = df.join(lab, F.col(col) == F.col("__k"), "left")
    return j.withColumn(out, F.coalesce("__v", tidy_label(col))).drop("__k", "__v")


def label_tail(c) -> Column:
    """What follows the first `` | `` of a label; the label itself without one."""
    s = _c(c)
    return F.when(F.contains(s, F.lit(" | ")), F.substring(s, F.instr(s, " | ") + 3, 1 << 30)).otherwise(s)


def relabel_baseline(c, flag, label: str) -> Column:
    """``label`` on baseline rows, the tail of the label elsewhere."""
    return F.when(_c(flag) == 1, F.lit(label)).otherwise(label_tail(c))


def _near(vals: DataFrame, canon: DataFrame, threshold: float) -> DataFrame:
    """(value, nv, canonical, nc) of all pairs that share a piece of the
    canonical name at nearly the same place; it holds every pair whose
    similarity reaches ``threshold``."""
    n = F.length("nc")
    edits = F.floor((1.0 - threshold) * n / threshold + 1e-9).cast("int")
    c = canon.select("canonical", "nc", edits.alias("k"), n.alias("n")).where("n > 0")
    # pieces 1 .. k + 1, the first ones a character longer if the length does not divide
    cut = lambda i: (i * F.col("n") / (F.col("k") + 1)).cast("int")
    pieces = c.select("canonical", "nc", "k", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(
            (cut(i) + 1).alias("at"), F.expr("nc").substr(cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"))))
        .alias("p")).select("canonical", "nc", "k", "p.at", "p.piece")
    sizes = [r[0] for r in pieces.select(F.length("piece")).distinct().collect()]
    if 0 in sizes:
        raise ValueError("a threshold below 0.5 leaves pieces without characters")
    if not sizes:
        return vals.select("value", "nv", F.lit("").alias("canonical"), F.lit("").alias("nc")).where("false")
    m = F.length("nv")
    subs = F.flatten(F.transform(F.array(*[F.lit(k) for k in sorted(sizes)]), lambda k: F.transform(
        F.when(k <= m, F.sequence(F.lit(1), m - k + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("spot"), F.substring("nv", i, k).alias("piece")))))
    spots = vals.where(m > 0).select("value", "nv", F.explode(subs).alias("s")).select("value", "nv", "s.spot", "s.piece")
    return (spots.join(pieces, "piece").where("abs(spot - at) <= k").where(
        F.least(F.length("nv"), F.length("nc")) >= F.lit(threshold) * F.greatest(F.length("nv"), F.length("nc")) - 1e-9)
        .select("value", "nv", "canonical", "nc").distinct())


def _substrings(c: Column, lengths: Column) -> Column:
    """All substrings of ``c`` whose length is in the array ``lengths``."""
    ks = F.filter(lengths, lambda k: (k >= 1) & (k <= F.length(c)))
    return F.array_distinct(F.flatten(F.transform(
        ks, lambda k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1),
                                  lambda i: F.substring(c, i, k)))))


def harmonise(df: DataFrame, col: str, dictionary: DataFrame, synonyms: DataFrame | None = None,
              threshold: float = 0.70, fuzzy: bool = True, canon_col: str = "canonical",
              syn_col: str = "synonym", measure: str = "blocks") -> DataFrame:
    """Add ``match``, ``confidence``, ``reason`` to every row of ``df``."""
    if measure not in ("blocks", "edits"):
        raise ValueError(f"measure: blocks or edits, not {measure}")
    vals = (df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
            .withColumn("nv", normalise_name("value")))
    canon = (dictionary.select(F.col(canon_col).alias("canonical")).distinct()
             .withColumn("nc", normalise_name("canonical")))

    exact = (vals.join(canon, vals.nv == canon.nc)
             .select("value", "canonical", F.lit(1.0).alias("confidence"), F.lit("exact").alias("reason"),
                     F.lit(0).alias("dist"), F.lit(0).alias("tier")))
    tiers = [exact]
    if synonyms is not None:
        syn = (synonyms.select(F.col(canon_col).alias("canonical"), F.col(syn_col).alias("syn"))
               .withColumn("ns", normalise_name("syn")).where(F.col("ns") != ""))
        lengths = sorted({r[0] for r in syn.select(F.length("ns")).distinct().collect()})
        vq = vals.where(F.col("nv") != "")
        # synonym inside the value (equality included)
        v_sub = vq.select("value", F.explode(_substrings(F.col("nv"), F.array(*[F.lit(k) for k in lengths])))
                          .alias("piece"))
        inside = v_sub.join(syn.select("canonical", "syn", F.col("ns").alias("piece")), "piece")
        # value inside the synonym
        s_sub = syn.select("canonical", "syn", F.explode(_substrings(F.col("ns"), F.sequence(
            F.lit(1), F.length("ns")))).alias("piece"))
        around = vq.select("value", F.col("nv").alias("piece")).join(s_sub, "piece")
        tiers.append(inside.unionByName(around).select("value", "canonical", "syn").distinct()
                     .select("value", "canonical", F.lit(0.95).alias("confidence"),
                             F.concat(F.lit("synonym:"), "syn").alias("reason"), F.lit(0).alias("dist"),
                             F.lit(1).alias("tier")))
    if fuzzy and measure == "blocks":
        # a pair of names is compared once, whatever values and canonical names have them
        alike = blocks.near(canon, vals, "nc", "nv", threshold)
        tiers.append(vals.join(alike, "nv").join(canon, "nc").select(
            "value", "canonical", F.col("ratio").alias("confidence"), F.lit("fuzzy").alias("reason"), F.lit(0).alias("dist"),
            F.lit(2).alias("tier")))
    elif fuzzy:
        d = F.levenshtein("nv", "nc")
        sim = F.lit(1.0) - d / F.greatest(F.length("nv"), F.length("nc"), F.lit(1))
        tiers.append(_near(vals, canon, threshold)
                     .select("value", "canonical", sim.alias("confidence"), F.lit("fuzzy").alias("reason"),
                             d.alias("dist"), F.lit(2).alias("tier"))
                     .where(F.col("confidence") >= threshold))
    cand = tiers[0]
    for t in tiers[1:]:
        cand = cand.unionByName(t)
    # the best candidate is found on both sides of the shuffle, however many a value has
    rank = F.struct(-F.col("confidence"), "tier", "dist", "canonical", "reason")
    best = cand.groupBy("value").agg(F.min_by(F.struct("canonical", "confidence", "reason"), rank).alias("b")).select(
        F.col("value").alias(col), F.col("b.canonical").alias("match"), "b.confidence", "b.reason")
    return df.join(best, on=col, how="left")
