import re

from durata.llm import license_scan as ls


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def places(w):
    out = []
    for phrase, label in ls.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return out


TEXTS = ["All rights reserved. CC BY-SA 4.0", None, "", "cc by cc by cc by", "general public license " * 3,
         "The GNU General-Public\nLicense, version 3", "all rights all rights reserved", "cc", "ALL RIGHTS ReSeRvEd é ñ",
         "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "cc\x00by",
         "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software",
         "general public public license", "word " * 20_000 + "cc by", "Cc ßy cc by"]


def test_base_against_brute_force(spark, docs_of):
    got = {r.doc_id: r for r in ls.scan(docs_of(TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w = words(t)
        p = places(w)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(p)), t
        assert (r.first_word, r.last_word) == ((min(p)[0], max(p)[0]) if p else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in p}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_labels_of_the_method(spark, docs_of):
    got = {r.doc_id: r for r in ls.scan(docs_of(TEXTS)).collect()}
    assert got[5].labels == "gpl,gpl-3"
    assert got[9].labels == "apache-2.0"
    assert got[10].labels == "cc-by,cc-by-nc"
    assert got[12].labels == "mit", "one word put in"
    assert got[2].labels == got[1].labels == ""


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "cc by", "x"), (1, "cc by", "y"), (None, "cc by", "z")],
                               "doc_id long, text string, labels string")
    assert sorted((r.doc_id or 0, r.n_base, r.labels) for r in ls.scan(df).collect()) == [
        (0, 1, "cc-by"), (1, 1, "cc-by"), (1, 1, "cc-by")]
    assert ls.scan(df.filter("false")).count() == 0


def one_edit(words, keys):
    """Every text that one word put in, left out or changed makes of a notice, key words apart."""
    for i in range(len(words) + 1):
        if 0 < i < len(words):
            yield words[:i] + ["zebra"] + words[i:]
        if i < len(words) and words[i] not in keys:
            yield words[:i] + words[i + 1:]
            yield words[:i] + ["zebra"] + words[i + 1:]


def test_one_edit_in_every_notice(spark, docs_of):
    cases = [(label, w) for phrase, label, keys in ls.NOTICES for w in one_edit(phrase.split(), keys.split())]
    got = {r.doc_id: r for r in ls.scan(docs_of(["before it " + " ".join(w) + " and after" for _, w in cases])).collect()}
    missed = [" ".join(w) for i, (label, w) in enumerate(cases) if label not in got[i].labels.split(",")]
    assert not missed


def test_neighbours_of_a_notice_and_loose_words_are_no_notice(spark, docs_of):
    texts = ["licensed under cc by sa", "licensed under cc by 4 0", "general public license version 4",
             "released under the bsd license", "license the under released mit", "nc by cc under licensed",
             "under the terms of the mozilla agreement", "licensed zebra cc zebra nc", "version of the license 2 0 apache",
             "by nc " * 500, "released " + "zebra " * 5 + "under the mit license"]
    got = {r.doc_id: r.labels for r in ls.scan(docs_of(texts)).collect()}
    assert got == {0: "cc-by,cc-by-sa", 1: "cc-by", 2: "gpl", 3: "", 4: "", 5: "", 6: "", 7: "", 8: "", 9: "", 10: "mit"}


def test_spans_against_brute_force():
    """Random texts over a notice's words: a span is found if and only if some
    stretch of the text is within the edits, counted by a plain recursion."""
    import random
    from functools import lru_cache

    r = random.Random(5)
    for _ in range(400):
        n = r.randint(3, 7)
        t = [r.choice("abcd") for _ in range(n)]
        text = [r.choice("abcdxy") for _ in range(r.randint(1, 14))]
        keys = {r.randrange(n)}

        @lru_cache(None)
        def cost(p, q):
            """Least edits of paths that end with text word p on template word q."""
            best = q if not any(k < q for k in keys) else 99
            for p0 in range(p):
                for q0 in range(q):
                    if text[p0] == t[q0] and not any(q0 < k < q for k in keys):
                        out, put = q - q0 - 1, p - p0 - 1
                        if put - out <= ls.SLACK:
                            best = min(best, cost(p0, q0) + max(out, int(put > out)))
            return best

        pairs = [(p, q) for p in range(len(text)) for q in range(n) if text[p] == t[q]]
        want = min((cost(p, q) + n - 1 - q for p, q in pairs if not any(k > q for k in keys)), default=99)
        got = min((c for _, _, c in ls.spans_of(pairs, n, keys)), default=99)
        assert got == (want if want <= ls.allowed(n) else 99)


def test_clashing_columns_and_dots(spark):
    df = spark.createDataFrame([(1, "all rights reserved", "a", "b")], "`d.id` long, `t.x` string, uid string, hits string")
    assert ls.scan(df, "d.id", "t.x").first().labels == "reserved"
