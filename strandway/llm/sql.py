"""DuckDB twins of the corpus queries."""

from strandway.llm import quality, secrets

_Q = {k: v.replace("'", "''") for k, v in secrets.KINDS.items()}
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rank, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS hit,"
    f" unnest(regexp_split_to_array(text, '{p}')[:len(regexp_extract_all(text, '{p}'))]) AS gap,"
    f" unnest(range(len(regexp_extract_all(text, '{p}')))) AS i FROM d"
    for i, (k, p) in enumerate(_Q.items())
)
_WORD = r"[^\x20\x09-\x0D]+"
_PARTS = (("n_symbols", "word_chars"), ("n_upper", "word_chars"), ("n_marks", "word_chars"), ("word_chars", "n_words * 20"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))
_SHARES = ", ".join(f"CASE WHEN {whole} > 0 THEN CAST(least(floor({part} * {quality.STEPS} / ({whole})), {quality.STEPS}) AS INT) ELSE 0 END" for part, whole in _PARTS)
_RULE_NAMES, _N_RULES = ", ".join(f"'{r}'" for r in quality.RULES), len(quality.RULES)

_ROUND = """
    a{i} AS MATERIALIZED (
        SELECT nth, arg_min(c, d * 16 + c) AS c, min(d) AS d FROM (
            SELECT v.nth, m.c, list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN m{i} m)
        GROUP BY nth),"""
_MOVE = """
    m{j} AS MATERIALIZED (
        SELECT m.c, CASE WHEN n.e IS NULL THEN m.e ELSE n.e END AS e FROM m{i} m LEFT JOIN (
            SELECT c, list(CAST(s // k - CASE WHEN s % k < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS e FROM (
                SELECT a.c, p.i, sum(v.e[p.i]) AS s, count(*) AS k FROM a{i} a JOIN v USING (nth), (SELECT unnest(range(1, 65)) AS i) p GROUP BY a.c, p.i)
            GROUP BY c) n USING (c)),"""
_CENTROIDS = "".join(_ROUND.format(i=i) + (_MOVE.format(i=i, j=i + 1) if i < 3 else "") for i in range(4))
#: crc32 of x's digits, bit by bit
_CRC = """
    crc AS (SELECT x, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(x, ''), lambda b: list_prepend(CAST(ascii(b) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
                lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
            FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS x FROM documents WHERE doc_id IS NOT NULL)),"""
_CELL = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_CELL(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
_TAMPERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op11_centroid_clustering": f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS c, e FROM v QUALIFY c < 16),
    {_CENTROIDS}
    own AS (SELECT c, sum(d) AS d FROM a3 GROUP BY c)
    SELECT v.vec_id, CAST(a3.c AS INT) AS cluster, CAST(a3.d AS BIGINT) AS distance, CAST(own.d AS BIGINT) AS cluster_inertia,
           CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia, sha256(array_to_string(m3.e, ',')) AS centroid_sha256
    FROM v JOIN a3 USING (nth) JOIN own ON own.c = a3.c JOIN m3 ON m3.c = a3.c
    """,
    "op12_merkle_manifest": f"""
    WITH RECURSIVE {_CRC}
    docs AS MATERIALIZED (
        SELECT row_number() OVER () AS nth, doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF("text")} AS leaf, coalesce(xor(c, 4294967295) % 3 = 0, false) AS drawn, {_LEAF(_TAMPERED)} AS tampered
        FROM documents LEFT JOIN crc ON x = CAST(doc_id AS VARCHAR)),
    low AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, nth) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM docs),
    level AS (
        SELECT tree, 0 AS depth, idx, n, leaf AS h FROM low
        UNION ALL
        SELECT tree, depth + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM level WHERE n > 1 GROUP BY tree, depth, idx // 8, n),
    sub AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY tree COLLATE "C") - 1 AS idx, count(*) OVER () AS n FROM level WHERE n = 1),
    top AS (
        SELECT 0 AS depth, idx, n, h FROM sub
        UNION ALL
        SELECT depth + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY depth, idx // 8, n),
    runs AS MATERIALIZED (
        SELECT tree, depth, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM level WHERE n > 1 GROUP BY ALL
        UNION ALL
        SELECT '' AS tree, depth, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY ALL),
    walk AS (
        SELECT nth, tree, 0 AS depth, idx, n, '' AS proof, CASE WHEN drawn THEN tampered ELSE leaf END AS got FROM low
        UNION ALL
        SELECT w.nth, CASE WHEN w.n > 1 THEN w.tree ELSE '' END, CASE WHEN w.n > 1 THEN w.depth + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.idx // 8 ELSE s.idx END, CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE s.n END,
               CASE WHEN w.n > 1 THEN proof || array_to_string(hs[:w.idx % 8], '') || array_to_string(hs[w.idx % 8 + 2:], '') ELSE proof END,
               CASE WHEN w.n > 1 THEN sha256(array_to_string(hs[:w.idx % 8], '') || got || array_to_string(hs[w.idx % 8 + 2:], '')) ELSE got END
        FROM walk w LEFT JOIN runs r ON w.n > 1 AND r.tree = w.tree AND r.depth = w.depth AND r.run = w.idx // 8 LEFT JOIN sub s ON w.n = 1 AND s.tree = w.tree
        WHERE w.n > 1 OR w.tree <> '')
    SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, got AS folded_root, got = top.h AS verified
    FROM walk JOIN low USING (nth) JOIN sub ON sub.tree = low.tree CROSS JOIN (SELECT h FROM top WHERE n = 1) top
    WHERE walk.tree = '' AND walk.n = 1
    """,
    "op1_secret_scan": f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({_FOUND}),
    p AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM m),
    s AS (SELECT doc_id, rank, kind, stop - length(hit) AS start, stop FROM p
          WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '{_Q["assign"]}', 2)) >= 8
                          WHEN 'access' THEN length(hit) >= 16
                          WHEN 'blob' THEN regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]')
                          ELSE true END),
    n AS (SELECT s.doc_id, s.rank, s.kind, s.start, s.stop,
                 bool_or(t.kind IN ('assign', 'hex', 'blob')) AS secret, bool_or(t.kind IN ('access', 'ident')) AS ident
          FROM s JOIN s t ON s.doc_id = t.doc_id AND t.start <= s.stop + {secrets.SCOPE} AND s.start <= t.stop + {secrets.SCOPE}
          GROUP BY ALL),
    k AS (SELECT * FROM n WHERE rank < 3 OR (kind = 'ident' AND secret) OR (kind = 'blob' AND ident) OR (kind = 'endpoint' AND secret AND ident)),
    a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
          FROM k GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (doc_id)
    """,
    "op10_exact_topk": """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
    """,
    "op3_quality_rules": f"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
    windows AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id),
    counts AS (SELECT d.doc_id, coalesce(lang, '') AS stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks
        FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{_SHARES}] AS bins FROM counts),
    marks AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    held AS (SELECT stratum, good, bins, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) % 3 = 0 AS fitting
        FROM base JOIN marks USING (doc_id) WHERE NOT base_failed),
    fit AS (SELECT stratum, good, unnest(bins) AS bin, unnest(range({_N_RULES})) AS rule FROM held WHERE fitting),
    binned AS (SELECT stratum, rule, bin, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM fit GROUP BY ALL),
    gains AS (SELECT stratum, rule, coalesce(CAST(floor((bin + lead(bin) OVER v - 1) / 2) AS INT), bin) AS cutoff,
        coalesce(sum(bad) OVER u, 0) - 20 * coalesce(sum(good) OVER u, 0) AS gain FROM binned
        WINDOW v AS (PARTITION BY stratum, rule ORDER BY bin), u AS (PARTITION BY stratum, rule ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    best AS (SELECT * FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1),
    path0 AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS step FROM best),
    first0 AS (SELECT h.stratum, good, (SELECT min(step) FROM path0 p WHERE p.stratum = h.stratum AND h.bins[p.rule + 1] > p.cutoff) AS step FROM held h WHERE fitting),
    more AS (SELECT stratum, step FROM first0 GROUP BY ALL HAVING count(*) FILTER (NOT good) > 20 * count(*) FILTER (good)),
    path AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY step) AS step FROM path0 SEMI JOIN more USING (stratum, step)),
    first AS (SELECT h.stratum, good, (SELECT min(step) FROM path p WHERE p.stratum = h.stratum AND h.bins[p.rule + 1] > p.cutoff) AS step FROM held h
        WHERE NOT fitting AND stratum IN (SELECT stratum FROM path)),
    n AS (SELECT stratum, count(*) FILTER (good) AS n FROM first GROUP BY stratum),
    steps AS (SELECT p.stratum, p.step, p.rule, p.cutoff, coalesce(n, 0) AS n,
        (SELECT count(*) FROM first f WHERE f.stratum = p.stratum AND f.good AND f.step <= p.step) AS k,
        (SELECT count(DISTINCT stratum) FROM held) AS strata FROM path p LEFT JOIN n USING (stratum)),
    bounds AS (SELECT *, k < n * 0.05 AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95))) FROM range(k + 1) t(i)) <= 0.05 / strata AS allowed FROM steps),
    used AS (SELECT * FROM (SELECT *, bool_and(allowed) OVER (PARTITION BY stratum ORDER BY step) AS used FROM bounds) WHERE used),
    r AS (SELECT stratum, count(*) AS n_rules FROM used GROUP BY stratum)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit IS NULL AS kept, coalesce(n_rules, 0) AS n_rules, [{_RULE_NAMES}][hit + 1] AS rejected_by
    FROM (SELECT *, (SELECT min(rule) FROM used u WHERE u.stratum = base.stratum AND base.bins[u.rule + 1] > u.cutoff) AS hit FROM base) LEFT JOIN r USING (stratum)
    """,
    "op7_substring_dedup": f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    windows AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS g, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) > 19),
    later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) t(k)),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op9_minhash_near_dedup": f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 4 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
    """,
}
