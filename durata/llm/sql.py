"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from durata.llm import quality_rules as qr


def _quality_rules() -> str:
    votes = ", ".join(
        f"CASE WHEN {r[3].format(v=f'({r[1]})')} THEN -1 WHEN {r[2].format(v=f'({r[1]})')} THEN 1 ELSE 0 END AS v{j}"
        for j, r in enumerate(qr.RULES))
    k = range(len(qr.RULES))
    names = ", ".join(f"v{j}" for j in k)

    def odds(m: str) -> str:
        return f"ln({m}.prior) - ln(1 - {m}.prior) + " + " + ".join(
            f"CASE WHEN v{j} > 0 THEN ln({m}.g{j}) - ln(1 - {m}.b{j}) "
            f"WHEN v{j} < 0 THEN ln(1 - {m}.g{j}) - ln({m}.b{j}) ELSE 0 END" for j in k)

    def share(hit: str, seen: str, low: float, start: float) -> str:
        return (f"least({qr.CEIL}, greatest({low}, (sum(CASE WHEN {hit} ELSE 0 END) + {start} * {qr.SMOOTH} * sum(n))"
                f" / (sum(CASE WHEN {seen} ELSE 0 END) + {qr.SMOOTH} * sum(n))))")

    rounds = ["m0 AS MATERIALIZED (SELECT CAST(%s AS DOUBLE) AS prior, %s)" % (
        qr.PRIOR_GOOD, ", ".join(f"CAST({qr.START_GOOD} AS DOUBLE) AS g{j}, CAST({qr.START_BAD} AS DOUBLE) AS b{j}" for j in k))]
    for i in range(qr.EM_ROUNDS):
        fitted = ", ".join(
            share(f"v{j} > 0 THEN n * q", f"v{j} <> 0 THEN n * q", qr.LOW_GOOD, qr.START_GOOD) + f" AS g{j}, "
            + share(f"v{j} < 0 THEN n * (1 - q)", f"v{j} <> 0 THEN n * (1 - q)", qr.LOW_BAD, qr.START_BAD)
            + f" AS b{j}" for j in k)
        rounds.append(f"e{i} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-({odds(f'm{i}')}))) AS q FROM patterns p, m{i})")
        rounds.append(f"m{i + 1} AS MATERIALIZED (SELECT least(0.99, greatest(0.01, sum(n * q) / sum(n))) AS prior, "
                      f"{fitted} FROM e{i})")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, list_aggregate(words[i:i+{qr.WINDOW - 1}], 'string_agg', ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - {qr.WINDOW - 2})) AS i FROM w
            WHERE len(words) > {qr.WINDOW})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + {qr.WINDOW})) AS j FROM twice)
          GROUP BY rid),
m AS MATERIALIZED (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    len(regexp_extract_all(t, '[#*$%&|<>]+')) AS n_marks,
    length(t) - length(regexp_replace(t, '{qr.ODD}', '', 'g')) AS n_odd,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_shouts,
    length(t) - length(regexp_replace(t, '[.]', '', 'g')) AS n_stops FROM w LEFT JOIN cover USING (rid)),
v AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {votes} FROM m),
patterns AS MATERIALIZED (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY {names}),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds("z")}))) >= 0.5 AS kept
FROM v, m{qr.EM_ROUNDS} AS z
"""


def _ngram_join() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
    WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents
    UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.c AS component_id
FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) AS d LEFT JOIN n USING (doc_id)
"""


def _merkle(levels: int = 7, top: int = 3) -> str:
    """Trees of up to 8 ** ``levels`` rows a group and 8 ** ``top`` groups."""
    def field(c, value=None):
        v = value or f"CAST({c} AS VARCHAR)"
        return f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')"

    def leaf(text):
        return "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field("text", text)]) + ")"

    def tree(n, s, height):
        """Nodes of every level and, of each node, the digests beside it."""
        out = []
        for k in range(height):
            out.append(f"{n}{k + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN max(c) = 1 THEN max(d) "
                       f"ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM "
                       f"(SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {n}{k}) GROUP BY g, i // 8)")
            out.append(f"{s}{k} AS MATERIALIZED (SELECT a.g, a.i, a.c > 1 AS up, "
                       "coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, "
                       "coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r "
                       f"FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {n}{k}) a LEFT JOIN {n}{k} b "
                       "ON a.g = b.g AND a.i // 8 = b.i // 8 AND a.i <> b.i GROUP BY a.g, a.i, a.c)")
        return out

    steps = [f"f{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.i // 8 AS i, f.proof || s.l || s.r AS proof, "
             f"CASE WHEN s.up THEN sha256(s.l || f.fold || s.r) ELSE f.fold END AS fold) "
             f"FROM f{k} f JOIN s{k} s ON s.g = f.g AND s.i = f.i)" for k in range(levels)]
    steps += [f"h{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.i // 8 AS i, f.proof || s.l || s.r AS proof, "
              f"CASE WHEN s.up THEN sha256(s.l || f.fold || s.r) ELSE f.fold END AS fold) "
              f"FROM h{k} f JOIN u{k} s ON s.i = f.i)" for k in range(top)]
    ctes = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf("text")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(
        list_prepend(xor(a, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 3 = 0
    THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
    ELSE {leaf("text")} END AS claimed FROM documents)""",
        "e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "n0 AS (SELECT g, i, leaf AS d FROM e)", *tree("n", "s", levels),
        f"t0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS lang FROM n{levels})",
        *tree("t", "u", top),
        "f0 AS (SELECT doc_id, leaf, g, i, '' AS proof, claimed AS fold FROM e)", *steps[:levels],
        f"h0 AS (SELECT f.* REPLACE (t.i AS i), t.d AS subroot FROM f{levels} f JOIN t0 t ON t.lang = f.g)", *steps[levels:]]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified
FROM h{top}, (SELECT d FROM t{top})"""


def _centroids(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding,
    lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"xs AS MATERIALIZED (SELECT rid, unnest(range({dims})) AS j, unnest(v) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS j, unnest(v) AS y FROM (SELECT row_number() OVER (
    ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept) WHERE c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT rid, c, sum((x - y) * (x - y)) AS d
    FROM xs JOIN c{r} USING (j) GROUP BY rid, c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, j, coalesce(m.y, o.y) AS y FROM c{r} o LEFT JOIN (
    SELECT c, j, (s - ((s % n) + n) % n) // n AS y FROM (SELECT c, j, sum(x) AS s, count(*) AS n
    FROM a{r} JOIN xs USING (rid) GROUP BY c, j)) m USING (c, j))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
    CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid)
JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c) USING (c)"""


ORACLE: dict[str, str] = {"op7_ngram_join": _ngram_join(), "op10_quality_rules": _quality_rules(),
                          "op11_merkle": _merkle(), "op13_centroids": _centroids()}
