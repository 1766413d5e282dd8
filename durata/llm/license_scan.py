"""License scans by diagonal voting.

Templates are short license phrases and notices.  Rolling word K-grams of
every document are joined to the templates' K-grams on hash and words; a match
votes for its diagonal (document place less template place).  Full diagonals
are places where a template stands word for word.  Templates whose votes can
make a span have their diagonals within SLACK words of each other put
together: the cheapest path through matching words, in the order of both text
and template, is the span.  A path costs one edit for every template word that
is left out or changed and for every place where up to SLACK words are put in;
a notice may have one edit for every EDIT_WORDS words, and at least one.
Words that name a license (third field of a notice) must stand as they are, so
that no notice is taken for its neighbour.

A bitmap of the templates' hashes (fixed size) keeps K-grams that cannot join
from becoming rows, as a runtime filter does; the join on the words decides.

Defined results: null and empty texts have no words and no labels; a text of
any length is scanned whole, in one task; labels are distinct, sorted and
joined by commas (empty string for none); of overlapping spans of a template
the cheapest stays, of equal ones the first; repeated rows are scanned each on
its own; other columns take no part, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.hashing import ALNUM, Words, blocks, gram_hashes, utf8
from durata.llm.shared import written

K = 2
SLACK = 3
#: So many words of a notice allow one edit; every notice allows one.
EDIT_WORDS = 5
#: Template words up to so many places off a matching K-gram go with it, for words that stand between two edits.
NEAR = SLACK + 2
BITMAP_BITS = 16
#: phrase, label: the base; every word-for-word place counts
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: notices of other licenses, label, words that must stand as they are; matched with edits
NOTICES = [
    ("licensed under cc by nc", "cc-by-nc", "nc"),
    ("licensed under cc by sa", "cc-by-sa", "sa"),
    ("licensed under cc by nd", "cc-by-nd", "nd"),
    ("apache license version 2 0", "apache-2.0", "apache"),
    ("general public license version 2", "gpl-2", "2"),
    ("general public license version 3", "gpl-3", "3"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl", ""),
    ("under the terms of the gnu lesser general public license", "lgpl", "lesser"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ""),
    ("released under the mit license", "mit", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ""),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla"),
    ("this work is dedicated to the public domain", "public-domain", "domain"),
    ("no part of this publication may be reproduced without written permission", "reserved", ""),
]
_U = np.uint64


def _parts(template) -> tuple[list[str], str, set[int]]:
    """Words, label, and places of the words that must stand."""
    phrase, label, *keys = template
    words = phrase.split()
    if len(words) < K:
        raise ValueError(f"template {phrase!r} has fewer than {K} words")
    named = set(" ".join(keys).split())
    return words, label, {i for i, w in enumerate(words) if w in named}


def allowed(n_words: int) -> int:
    return max(1, n_words // EDIT_WORDS)


def template_grams(base=BASE, notices=NOTICES) -> list[tuple]:
    """(template, is_base, label, n_grams, least, pos, hash, gram) of all
    templates: ``least`` grams must be found for a span to be possible."""
    out = []
    for t, template in enumerate([*base, *notices]):
        words, label, _ = _parts(template)
        n = len(words) - K + 1
        w = Words([" ".join(words).encode()], ALNUM)
        for pos, h in enumerate(gram_hashes(w.hash, K).astype(np.int64).tolist()):
            out.append((t, t < len(base), label, n, max(1, n - K * allowed(len(words))), pos, h,
                        " ".join(words[pos:pos + K])))
    return out


def spans_of(matches, n: int, keys: set[int]) -> list[tuple[int, int, int]]:
    """(first, last, edits) of a template of ``n`` words in the sorted
    (place, template place) pairs of equal words: paths that rise in both, of
    at most ``allowed(n)`` edits, overlapping ones reduced to the cheapest."""
    most = allowed(n)
    reach = most + SLACK + 1
    stands = [0] * (n + 1)
    for i in range(n):
        stands[i + 1] = stands[i] + (i in keys)
    recent: list[tuple[int, int, int, int]] = []
    found = []
    for p, q in matches:
        recent = [r for r in recent if p - r[0] <= reach]
        best = (q, p) if q <= most and not stands[q] else None
        for p0, q0, cost, start in recent:
            if q0 >= q or p0 >= p or stands[q] - stands[q0 + 1]:
                continue
            left_out, between = q - q0 - 1, p - p0 - 1
            if between - left_out > SLACK:
                continue
            step = (cost + max(left_out, int(between > left_out)), start)
            if step[0] <= most and (best is None or step < best):
                best = step
        if best is None:
            continue
        recent.append((p, q, *best))
        rest = n - 1 - q
        if best[0] + rest <= most and not stands[n] - stands[q + 1]:
            found.append((best[1], p, best[0] + rest))
    out: list[tuple[int, int, int]] = []
    for lo, hi, cost in sorted(found):
        if out and lo <= out[-1][1]:
            a, b, c = out[-1]
            out[-1] = min((cost, lo, -hi), (c, a, -b))
            cost, lo, hi = out[-1]
            out[-1] = (lo, -hi, cost)
        else:
            out.append((lo, hi, cost))
    return out


def _verify(templates):
    parts = [_parts(t) for t in templates]
    places: list[dict[str, list[int]]] = [{} for _ in parts]
    for known, (words, _, _) in zip(places, parts):
        for q, word in enumerate(words):
            known.setdefault(word, []).append(q)

    def work(batches):
        import pyarrow as pa

        span = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("label", pa.string()), ("share", pa.float64())])
        for b in batches:
            rows = []
            for t, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, label, keys = parts[t]
                pairs = set()
                for h in hits:
                    pairs.update((h["at"] + k, h["pos"] + k) for k in range(K))
                    pairs.update((x["at"], q) for x in h["near"] for q in places[t].get(x["word"], ()))
                rows.append([{"lo": lo, "hi": hi, "label": label, "share": 1 - cost / len(words)}
                             for lo, hi, cost in spans_of(sorted(pairs), len(words), keys)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(span))], names=["uid", "spans"])
    return work


def _scan(hashes: np.ndarray, vocabulary: list[str]):
    listed = np.sort(Words([" ".join(vocabulary).encode()], ALNUM).hash)
    bits = np.zeros(1 << BITMAP_BITS, bool)
    bits[(hashes.astype(np.uint64) >> _U(64 - BITMAP_BITS)).astype(np.int64)] = True

    def work(batches):
        import pyarrow as pa

        gram = pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("gram", pa.string()),
                          ("near", pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())])))])
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in blocks(texts):
                w = Words(texts[lo:hi], ALNUM)
                h = gram_hashes(w.hash, K)
                n = len(h)
                keep = np.flatnonzero((w.doc[:n] == w.doc[K - 1:]) & bits[(h >> _U(64 - BITMAP_BITS)).astype(np.int64)]
                                      ) if n else np.zeros(0, np.int64)
                rows: list[list] = [[] for _ in range(hi - lo)]
                known = listed[np.minimum(np.searchsorted(listed, w.hash), len(listed) - 1)] == w.hash

                def words(lo, hi):
                    return b" ".join(w.buf[w.start[i]:w.end[i]] for i in range(lo, hi)).lower().decode("utf-8", "replace")

                for p in keep.tolist():
                    doc, first = w.doc[p], int(w.first[w.doc[p]])
                    near = [i for i in (*range(max(first, p - NEAR), p), *range(p + K, min(len(known), p + K + NEAR)))
                            if known[i] and w.doc[i] == doc]
                    rows[doc].append({"at": p - first, "hash": int(h[p].astype(np.int64)), "gram": words(p, p + K),
                                      "near": [{"at": i - first, "word": words(i, i + 1)} for i in near]})
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), pa.array(rows, pa.list_(gram))],
                    names=["doc_id", "n_words", "grams"])
    return work


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (best share of a template found: its words in a
    span, or else its K-grams on a diagonal) and spans (first and last word,
    label, share of words) of the method's findings."""
    spark = docs.sparkSession
    grams = template_grams(base, notices)
    hashes = np.array([g[6] for g in grams], np.int64)
    table = spark.createDataFrame(grams, "template int, is_base boolean, label string, n_grams int, least int, pos int, "
                                         "hash long, gram string")
    vocabulary = sorted({word for template in [*base, *notices] for word in template[0].split()})
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    scanned = rows.mapInArrow(_scan(hashes, vocabulary), "doc_id long, n_words long, "
                              "grams array<struct<at:int,hash:long,gram:string,near:array<struct<at:int,word:string>>>>")
    scanned = written(scanned.withColumn("uid", F.monotonically_increasing_id()), "op5-grams")
    # the template table is a fixed list of a few hundred rows at most
    hits = (scanned.select("uid", F.explode("grams").alias("g")).select("uid", "g.*")
            .join(F.broadcast(table), ["hash", "gram"])
            .select("uid", "template", "is_base", "label", "n_grams", "least", "at", "pos", "near"))
    by = ["uid", "template", "is_base", "label", "n_grams", "least"]
    lines = hits.groupBy(*by, (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.collect_list(F.struct("at", "pos", "near")).alias("hits"))
    voted = lines.groupBy(*by).agg(
        F.count(F.when(F.col("votes") == F.col("n_grams"), 1)).alias("places"),
        F.min(F.when(F.col("votes") == F.col("n_grams"), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("votes") == F.col("n_grams"), F.col("diagonal"))).alias("last"),
        F.max(F.col("votes") / F.col("n_grams")).alias("share"), F.flatten(F.collect_list("hits")).alias("hits"))
    voted = voted.withColumn("possible", F.size(F.array_distinct("hits.pos")) >= F.col("least"))
    voted = written(voted.withColumn("hits", F.when(F.col("possible") & ~F.col("is_base"), F.col("hits"))), "op5-votes")
    exact = voted.groupBy("uid").agg(
        F.sum(F.when(F.col("is_base"), F.col("places"))).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("last"))).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(F.col("is_base") & (F.col("places") > 0), F.col("label")))).alias("base_set"),
        F.max("share").alias("share"))
    spans = (voted.filter("hits IS NOT NULL").select("uid", "template", "hits")
             .mapInArrow(_verify([*base, *notices]), "uid long, spans array<struct<lo:int,hi:int,label:string,share:double>>"))
    found = spans.groupBy("uid").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    out = scanned.select("uid", "doc_id", "n_words").join(exact, "uid", "left").join(found, "uid", "left")
    base_set = F.coalesce("base_set", F.array().cast("array<string>"))
    spans = F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int,label:string,share:double>>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(base_set, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_set, F.transform(spans, lambda x: x["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.coalesce(F.array_max(F.transform(spans, lambda x: x["share"])), F.lit(0.0))
                   ).cast("double").alias("score"), spans.alias("spans"))
