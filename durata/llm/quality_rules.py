"""Quality rules as weak supervision (native DataFrame and SQL functions).

Each rule votes good (+1), bad (-1) or abstains (0).  Expectation-maximisation
over the table of vote patterns (at most 3 ** len(RULES) rows, whatever the
corpus size) estimates each rule's accuracy on good and on bad documents, and
the posterior probability of "good" replaces an all-must-pass filter.

Defined results: null text counts as the empty text; an empty text has zero
words and fails the base rule; repeated rows are scored each on its own; an
empty table gives an empty table.  Clashing column names are no matter: only
``id_col`` and ``text_col`` are read, and the result has fixed columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Neither a letter, a digit, white space nor ordinary punctuation.
ODD = r"[^\p{L}\p{N}\x20\x09-\x0D.,;:()@/+=_-]"
WINDOW = 5
EM_ROUNDS = 25
PRIOR_GOOD = 0.8
#: Pseudo-counts as a share of the documents, so that growth leaves them alike.
SMOOTH = 0.002
#: A rule seldom condemns good documents, but each sees only some kinds of bad ones.
START_GOOD, START_BAD = 0.99, 0.2
LOW_GOOD, LOW_BAD, CEIL = 0.8, 0.01, 0.999

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: name, value (SQL over the measures), good when, bad when
RULES = [
    ("length", "n_words", "{v} >= 20", "{v} < 10"),
    ("word_size", "word_chars / greatest(n_words, 1)", "{v} BETWEEN 3 AND 9", "{v} < 2 OR {v} > 14"),
    ("symbols", "n_symbols / greatest(n_words, 1)", "{v} <= 0.02", "{v} > 0.10"),
    ("marks", "n_marks / greatest(n_words, 1)", "{v} <= 0.02", "{v} > 0.10"),
    ("odd_chars", "n_odd / greatest(word_chars, 1)", "{v} <= 0.04", "{v} > 0.08"),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", "{v} <= 0.10", "{v} > 0.30"),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", "{v} <= 0.05", "{v} > 0.20"),
    ("capitals", "n_capitals / greatest(word_chars, 1)", "{v} <= 0.15", "{v} > 0.30"),
    ("shouting", "n_shouts / greatest(n_words, 1)", "{v} <= 0.05", "{v} > 0.15"),
    ("stops", "n_stops / greatest(n_words, 1)", "{v} BETWEEN 0.01 AND 0.35", "{v} > 0.60"),
]


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def _covered(grams: Column) -> Column:
    """Words lying in windows whose hash occurs at least twice.

    Sort (hash, place) pairs; a pair equal to a neighbour marks its place; the
    marked places, sorted, cover min(WINDOW, gap to the next) words each.
    """
    def marked(pairs: Column) -> Column:
        n = F.size(pairs)
        return F.array_compact(F.transform(pairs, lambda p, k: F.when(
            (F.when(k > 0, F.get(pairs, k - 1)["h"] == p["h"]).otherwise(False))
            | (F.when(k + 1 < n, F.get(pairs, k + 1)["h"] == p["h"]).otherwise(False)), p["i"])))

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.sort_array(_let(pairs, marked))
    return _let(places, lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(
        F.lit(WINDOW) + F.aggregate(
            F.sequence(F.lit(1), F.size(s)), F.lit(0),
            lambda acc, k: acc + F.when(k < F.size(s), F.least(F.lit(WINDOW), F.get(s, k) - F.get(s, k - 1)))
            .otherwise(0))))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the counts the rules look at, all from the whole text.

    ``keep`` names input columns to carry along (for a filter that returns
    the documents); they come back in a struct ``row``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [F.col(id_col).alias("doc_id"), text.alias("t")]
    if keep:
        cols.append(F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("row"))
    d = docs.select(*cols)
    d = d.withColumn("words", F.array_remove(F.split("t", SPACE), ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    w = F.col("words")
    d = d.withColumn("grams", F.when(n >= WINDOW + 1, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))))
    distinct = F.size(F.array_distinct("grams"))
    repeat = F.when(distinct < F.size("grams"), _covered(F.col("grams"))).otherwise(0)
    out = [
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]+")).cast("long").alias("n_marks"),
        F.regexp_count("t", F.lit(ODD)).cast("long").alias("n_odd"),
        F.regexp_count("t", F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit(r"[!?]")).cast("long").alias("n_shouts"),
        F.regexp_count("t", F.lit(r"[.]")).cast("long").alias("n_stops"),
    ]
    # the generator keeps a filter on the measures from being pushed into (and repeating) their expressions
    return d.select("doc_id", *(["row"] if keep else []), F.inline(F.array(F.struct(*out))))


def _value(rule) -> str:
    return f"({rule[1]})"


def with_votes(measured: DataFrame) -> DataFrame:
    """Add ``votes``, one of -1, 0, +1 per rule, and ``base_failed``."""
    votes = []
    for rule in RULES:
        v = _value(rule)
        votes.append(F.expr(f"CASE WHEN {rule[3].format(v=v)} THEN -1 WHEN {rule[2].format(v=v)} THEN 1 ELSE 0 END"))
    return (measured.withColumn("votes", F.array(*votes))
            .withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> dict:
    """EM over (vote pattern, documents) pairs: the prior of "good" and, per
    rule, how often it votes rightly on good and on bad documents, abstentions
    left out.  The lower bound on good documents keeps the two classes from
    trading places."""
    r = len(RULES)
    prior, acc_good, acc_bad = PRIOR_GOOD, [START_GOOD] * r, [START_BAD] * r
    total = float(sum(n for _, n in patterns))
    s = SMOOTH * total
    for _ in range(rounds if total else 0):
        good = 0.0
        hit_g, all_g, hit_b, all_b = [0.0] * r, [0.0] * r, [0.0] * r, [0.0] * r
        for votes, n in patterns:
            q = posterior(votes, prior, acc_good, acc_bad)
            good += n * q
            for j, v in enumerate(votes):
                if v:
                    all_g[j] += n * q
                    all_b[j] += n * (1 - q)
                    if v > 0:
                        hit_g[j] += n * q
                    else:
                        hit_b[j] += n * (1 - q)
        prior = min(0.99, max(0.01, good / total))
        acc_good = [min(CEIL, max(LOW_GOOD, (hit_g[j] + START_GOOD * s) / (all_g[j] + s))) for j in range(r)]
        acc_bad = [min(CEIL, max(LOW_BAD, (hit_b[j] + START_BAD * s) / (all_b[j] + s))) for j in range(r)]
    return {"prior": prior, "acc_good": acc_good, "acc_bad": acc_bad}


def posterior(votes, prior: float, acc_good: list[float], acc_bad: list[float]) -> float:
    z = math.log(prior) - math.log(1 - prior)
    for j, v in enumerate(votes):
        if v > 0:
            z += math.log(acc_good[j]) - math.log(1 - acc_bad[j])
        elif v < 0:
            z += math.log(1 - acc_good[j]) - math.log(acc_bad[j])
    return 1 / (1 + math.exp(-z))


def _log_odds(model: dict) -> Column:
    z = F.lit(math.log(model["prior"]) - math.log(1 - model["prior"]))
    for j in range(len(RULES)):
        g, b, v = model["acc_good"][j], model["acc_bad"][j], F.col("votes")[j]
        z = z + F.when(v > 0, math.log(g) - math.log(1 - b)).when(v < 0, math.log(1 - g) - math.log(b)).otherwise(0.0)
    return z


def learn(voted: DataFrame) -> dict:
    """The model of all documents in ``voted``.  What reaches the driver is
    the pattern table, at most 3 ** len(RULES) rows."""
    rows = voted.groupBy("votes").count().collect()
    return fit(sorted((tuple(r["votes"]), r["count"]) for r in rows))


def judge(voted: DataFrame, model: dict) -> DataFrame:
    """Add ``posterior`` (of "good") and ``kept``."""
    p = 1 / (1 + F.exp(-_log_odds(model)))
    return voted.withColumn("posterior", p).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
