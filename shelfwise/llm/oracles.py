"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from shelfwise.llm import licenses, mixing

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{UPPER.lower()}')"


def crc32_sql(strings: str) -> str:
    """CTEs up to ``crc32s(s, crc)``: the unsigned crc32 of the distinct texts ``s`` of a CTE.

    The last of them recurses, so a query with them begins WITH RECURSIVE.
    """
    return f"""
crc_bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8
), crc_table AS (
  SELECT i, c AS t FROM crc_bits WHERE k = 8
), crc_bytes(s, h, k, c) AS (
  SELECT s, hex(encode(s)), 0, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT s FROM {strings})
  UNION ALL
  SELECT s, h, k + 1, xor(c >> 8, t) FROM crc_bytes
  JOIN crc_table ON i = xor(c, CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)) & 255
  WHERE 2 * k < length(h)
), crc32s AS (
  SELECT s, xor(c, 4294967295) AS crc FROM crc_bytes WHERE 2 * k = length(h)
)"""


def near_duplicates_sql(documents: str = "documents") -> str:
    """CTEs up to ``near_dups(doc_id, n_shingles, component_id, kept)``."""
    return rf"""
spaced AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '[^\x20\x09-\x0D]+') AS w FROM {documents}
), shingle_sets AS (
  SELECT doc_id, CASE
      WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
      WHEN len(w) = 1 THEN w
      ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s
  FROM spaced
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingle_sets
), shared_grams AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM shared_grams WHERE 100 * common >= 80 * (na + nb - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM {documents}
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), lowest AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
), near_dups AS (
  SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
  FROM shingle_sets s JOIN lowest l ON s.doc_id = l.doc_id
)"""


def op3() -> str:
    return f"WITH RECURSIVE {near_duplicates_sql()} SELECT doc_id, n_shingles, component_id, kept FROM near_dups"


def op6() -> str:
    return """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM scored
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5"""


def op8() -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '{pattern}') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all({_lower('text')}, '{pattern}') AS w FROM benchmark
), lengths AS (
  SELECT DISTINCT least(len(w), 13) AS n FROM item_words WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, g FROM (
    SELECT item_id, least(len(w), 13) AS n,
      unnest([array_to_string(w[i : i + least(len(w), 13) - 1], ' ') for i in range(1, len(w) - least(len(w), 13) + 2)]) AS g
    FROM item_words WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
    unnest([array_to_string(w[i : i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS g
  FROM doc_words, lengths WHERE len(w) >= n
), found AS (
  SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.g = b.g
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM doc_words w LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def op10() -> str:
    """Templates by the positions of their shingles, without windows, bands or a gate."""
    rows = []
    for name, text in licenses.TEMPLATES.items():
        words = licenses.plain_words(text)
        size, window, step = licenses.shape(len(words))
        shingles = dict.fromkeys(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
        rows += [f"('{name}', {size}, {window + step}, {len(shingles)}, '{g}')" for g in shingles]
    return f"""
WITH templates(license, size, reach, total, g) AS (VALUES {', '.join(rows)}
), doc_words AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '[a-z0-9]+') AS w FROM documents
), sizes AS (
  SELECT DISTINCT size FROM templates
), grams AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i,
    unnest([array_to_string(w[i : i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) AS g
  FROM doc_words, sizes WHERE len(w) >= size
), hits AS (
  SELECT doc_id, license, reach, total, i, grams.g FROM grams JOIN templates USING (size, g)
), stretches AS (
  SELECT a.doc_id, a.license, a.i, any_value(a.total) AS total, count(DISTINCT b.g) AS n
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.license = b.license AND b.i >= a.i AND b.i < a.i + a.reach
  GROUP BY a.doc_id, a.license, a.i
), held AS (
  SELECT DISTINCT doc_id, license FROM stretches WHERE 100 * n >= {licenses.PERCENT} * total
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS l FROM held GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(l, '') AS licenses
FROM doc_words w LEFT JOIN listed USING (doc_id)"""


def op11() -> str:
    """All pairs that share a shingle, without prefixes or filters."""
    size, percent = 4, 85
    return rf"""
WITH RECURSIVE spaced AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle_sets AS (
  SELECT doc_id, CASE
      WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
      WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
      ELSE list_distinct([array_to_string(w[i : i + {size - 1}], ' ') for i in range(1, len(w) - {size} + 2)]) END AS s
  FROM spaced
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingle_sets
), shared_grams AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM shared_grams WHERE 100 * common >= {percent} * (na + nb - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), lowest AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
), classes AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CASE WHEN len(s) = 0 THEN CAST(doc_id AS VARCHAR) ELSE
    array_to_string(list_sort(s), '|') END AS same FROM shingle_sets
), named AS (
  SELECT *, min(doc_id) OVER (PARTITION BY n_shingles, same) AS class_id FROM classes
), class_links AS (
  SELECT x.class_id, count(DISTINCT y.class_id) AS n FROM both_ways l
  JOIN named x ON x.doc_id = l.a JOIN named y ON y.doc_id = l.b WHERE x.class_id <> y.class_id GROUP BY x.class_id
)
SELECT d.doc_id, d.n_shingles, l.component_id, d.class_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links
FROM named d JOIN lowest l USING (doc_id) LEFT JOIN class_links c USING (class_id)"""


def op12() -> str:
    """The cheapest edits by a plain recursion over the rows.

    A state of the recursion is a text that sorts by cost and then by audit, with the repaired
    lines behind it; z is nothing so far, s, u and a are the last role's initial.
    """
    white = r"[^\x20\x09-\x0D]"
    far = "'500000000|'"

    def after(state: str, cost: str, letter: str, line: str) -> str:
        return (
            f"printf('%09d', CAST(substr({state}, 1, 9) AS INTEGER) + {cost}) || '|' || split_part({state}, '|', 2) || '{letter}' || '|'"
            f" || substr({state}, length(split_part({state}, '|', 2)) + 12) || {line}"
        )

    def inserted(role: str, *before: str) -> str:
        return ", ".join(after(b, "3", "I", f"'{role}:' || chr(10)") for b in before)

    return f"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations
), {crc32_sql("plain").strip()}, fated AS (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
    CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM plain JOIN crc32s USING (s)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM fated
), marked AS (
  SELECT *, regexp_extract_all(text, '{white}') AS seen,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS nth FROM placed
), faults AS (
  SELECT conv_id, turn, role, text, p, substr(role, 1, 1) AS r,
    CASE WHEN len(seen) = 0 THEN 'b' WHEN nth > 1 THEN 'd' WHEN seen[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f
  FROM marked
), steps(conv_id, p, z, s, u, a, zi, ui, ai, si) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000000||', {far} || '|', {far} || '|', {far} || '|',
    '000000000||', '000000003|I|user:' || chr(10), '000000006|II|user:' || chr(10) || 'assistant:' || chr(10), {far} || '|'
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, p, z, s, u, a, z, least(u, {inserted("user", "z", "s", "a")}),
    least(a, {inserted("assistant", "u", f"least({inserted('user', 'z', 's')})")}), s
  FROM (
    SELECT t.conv_id, f.p, {after("zi", "4", "D", "''")} AS z,
      least({after("si", "4", "D", "''")}, CASE WHEN f IN ('', 't') AND r = 's'
        THEN {after("zi", "CASE f WHEN 't' THEN 3 ELSE 0 END", "K", "role || ':' || text || chr(10)")} ELSE {far} END) AS s,
      least({after("ui", "4", "D", "''")}, CASE WHEN f IN ('', 't') THEN least(
        {", ".join(after(b, "CASE f WHEN 't' THEN 6 ELSE 3 END", "R", "'user:' || text || chr(10)") for b in ("zi", "si", "ai"))}) ELSE {far} END,
        CASE WHEN f IN ('', 't') AND r = 'u' THEN least(
        {", ".join(after(b, "CASE f WHEN 't' THEN 3 ELSE 0 END", "K", "role || ':' || text || chr(10)") for b in ("zi", "si", "ai"))}) ELSE {far} END) AS u,
      least({after("ai", "4", "D", "''")}, CASE WHEN f IN ('', 't') THEN
        {after("ui", "CASE f WHEN 't' THEN 6 ELSE 3 END", "R", "'assistant:' || text || chr(10)")} ELSE {far} END,
        CASE WHEN f IN ('', 't') AND r = 'a' THEN
        {after("ui", "CASE f WHEN 't' THEN 3 ELSE 0 END", "K", "role || ':' || text || chr(10)")} ELSE {far} END) AS a
    FROM steps t JOIN faults f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND f.p = t.p + 1
  )
), ends AS (
  SELECT conv_id, best, substr(best, length(split_part(best, '|', 2)) + 12) AS lines FROM (
    SELECT conv_id, least(zi, ai) AS best FROM steps QUALIFY p = max(p) OVER (PARTITION BY conv_id))
), counted AS (
  SELECT conv_id, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM faults GROUP BY conv_id
), neighbours AS (
  SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (
    SELECT conv_id, lag(r) OVER (PARTITION BY conv_id ORDER BY p) || r AS pair FROM faults) WHERE pair IS NOT NULL GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(substr(best, 1, 9) AS BIGINT) AS cost, split_part(best, '|', 2) AS audit,
  sha256(CASE lines WHEN '' THEN '' ELSE substr(lines, 1, length(lines) - 1) END) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN neighbours n ON e.conv_id IS NOT DISTINCT FROM n.conv_id"""


def op13() -> str:
    """Near words by the texts that are left when one letter goes."""
    pattern = r"[A-Za-z\x{00C0}-\x{00FF}]+"
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_lower('text')}, '{pattern}')) AS w FROM documents
), keyed AS (
  SELECT w, concat(doc_id, ':', w) AS s, count(*) AS n FROM runs GROUP BY ALL
), {crc32_sql("keyed").strip()}, damaged AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(w, 1, CAST(crc % length(w) AS BIGINT)) || substr(w, CAST(crc % length(w) AS BIGINT) + 2)
    ELSE w END AS word, n FROM keyed JOIN crc32s USING (s)
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), gone AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, y.word AS other FROM gone x JOIN gone y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
  UNION SELECT g.word, w.word FROM gone g JOIN words w ON g.d = w.word
  UNION SELECT w.word, g.word FROM gone g JOIN words w ON g.d = w.word
), ranked AS (
  SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS k FROM near JOIN words w ON w.word = other
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN other END AS form,
    CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1
), chain(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT chain.word, form FROM chain JOIN forms ON chain.root = forms.word WHERE form IS NOT NULL
), roots AS (
  SELECT chain.word, chain.root FROM chain JOIN forms ON chain.root = forms.word WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


#: Rounds of fitting that the SQL spells out; the test tables settle in far fewer.
RAKING_ROUNDS = 40


def op1() -> str:
    dimensions, power = mixing.DIMENSIONS, 48
    uniform = "CAST(CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) AS DOUBLE) / " + f"CAST({2**power} AS DOUBLE)"
    word = r"[^\x20\x09-\x0D]+"
    same = "c.{0} IS NOT DISTINCT FROM f.value"
    parts = [
        f"""facts AS (
  SELECT doc_id, source, lang, CASE
      WHEN contains(coalesce(text, ''), 'icense') OR contains(coalesce(text, ''), 'ights reserved') THEN 'legal'
      WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
      WHEN length(coalesce(text, '')) < 300 THEN 'note' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{word}')) AS BIGINT) AS n_tokens FROM documents
)""",
        "w0 AS (SELECT source, lang, topic, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS weight"
        " FROM facts GROUP BY source, lang, topic)",
    ]
    for name in dimensions:
        parts.append(
            f"goal_{name} AS (SELECT value, p / sum(p) OVER () AS share FROM (SELECT {name} AS value,"
            f" pow(CAST(sum(tokens) AS DOUBLE), {mixing.TEMPER}) AS p FROM w0 GROUP BY {name} HAVING sum(tokens) > 0))"
        )
    k = 0
    for _ in range(RAKING_ROUNDS):
        for name in dimensions:
            parts.append(
                f"w{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * coalesce(f.factor, 0) AS weight FROM w{k} c"
                f" LEFT JOIN (SELECT s.value, g.share / s.held AS factor FROM (SELECT {name} AS value, sum(weight) AS held FROM w{k}"
                f" GROUP BY {name} HAVING sum(weight) > 0) s JOIN goal_{name} g ON s.value IS NOT DISTINCT FROM g.value) f"
                f" ON {same.format(name)})"
            )
            k += 1
    parts.append(
        f"live AS MATERIALIZED (SELECT source, lang, topic, CAST(tokens AS DOUBLE) AS tokens, weight, weight / tokens AS rate FROM w{k}"
        " WHERE tokens > 0 AND weight > 0)"
    )
    parts.append("f0 AS MATERIALIZED (SELECT CAST(0 AS DOUBLE) AS factor)")
    for r in range(12):
        parts.append(
            f"f{r + 1} AS MATERIALIZED (SELECT greatest(f{r}.factor, coalesce(({mixing.KEEP_SHARE} * (SELECT sum(tokens) FROM w0)"
            f" - coalesce(sum(l.tokens) FILTER (l.rate * f{r}.factor >= 1), 0))"
            f" / sum(l.weight) FILTER (l.rate * f{r}.factor < 1), 0)) AS factor FROM live l, f{r} GROUP BY f{r}.factor)"
        )
    parts.append("chances AS (SELECT l.*, least(1.0, l.rate * f12.factor) AS p FROM live l, f12)")
    return f"""
WITH {', '.join(parts)}
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(c.p, 0), 9) AS probability,
  {uniform.format("coalesce(CAST(d.doc_id AS VARCHAR), 'null')")} < coalesce(c.p, 0) AS kept
FROM facts d LEFT JOIN chances c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang
  AND d.topic IS NOT DISTINCT FROM c.topic"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": op1(),
        "op3_near_duplicates": op3(),
        "op6_exact_top_k": op6(),
        "op8_decontamination": op8(),
        "op10_licenses": op10(),
        "op11_jaccard_join": op11(),
        "op12_conversations": op12(),
        "op13_spelling": op13(),
    }
