"""DuckDB SQL for each registered query, written apart from the Spark code.

Only fixed texts and tables come from ``fixed_values``; joins, windows and rules
are spelled out here in another form than the library's.
"""

from __future__ import annotations

from shelfwise import fixed_values as fixed
from checks import derived


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(column: str, entries: dict) -> str:
    arms = " ".join(f"WHEN {quoted(k) if isinstance(k, str) else k} THEN {quoted(v)}" for k, v in entries.items())
    return f"CASE {column} {arms} END"


BASE = derived.CATALOG_SQL.format(part="part", lineitem="lineitem")
REQUESTS = derived.REQUESTS_SQL.format(part="part", pages="pages")
REPLIES = derived.REPLIES_SQL.format(base=f"({derived.REPLY_BASE_SQL.format(part='part')}) b")
VIEWS = derived.VIEWS_SQL

STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def strip(column: str) -> str:
    return STRIP.format(column)


def has_word(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


FACTS = f"""
base AS ({BASE}),
listed AS (
  SELECT *, coalesce(string_split(categories, '|'), []) AS cats,
         coalesce(string_split(labels, '|'), []) AS labs,
         coalesce(string_split(additives, '|'), []) AS adds,
         coalesce(string_split(allergens, '|'), []) AS alls
  FROM base
),
facts AS (
  SELECT barcode, product_name, url, image_url, unique_scans_n, nutriscore_grade, nova_group,
    cats, labs, adds, alls,
    lower(trim(product_name)) AS name_key,
    nullif(trim(lower(nutriscore_grade)), '') AS grade,
    CASE WHEN trim(lower(nutriscore_grade)) IN ('a','b','c','d','e')
         THEN ascii(trim(lower(nutriscore_grade))) - 97 ELSE 99 END AS rnk,
    CASE WHEN regexp_full_match(nova_group, '[0-9]+') THEN cast(nova_group AS INTEGER) ELSE 0 END AS nova,
    coalesce(fat_100g, 0e0) AS fat,
    CASE WHEN coalesce(sugars_100g, 0e0) <> 0 THEN sugars_100g ELSE coalesce(sugars, 0e0) END AS sugar,
    coalesce(salt_100g, 0e0) AS salt,
    saturated_fat_100g AS satfat,
    coalesce(proteins_100g, 0e0) AS protein,
    coalesce(fiber_100g, 0e0) AS fiber,
    coalesce(energy_kcal_100g, 0e0) AS energy,
    (sugars_100g IS NOT NULL OR sugars IS NOT NULL) AS h_sugar,
    fat_100g IS NOT NULL AS h_fat,
    salt_100g IS NOT NULL AS h_salt,
    proteins_100g IS NOT NULL AS h_protein,
    fiber_100g IS NOT NULL AS h_fiber,
    energy_kcal_100g AS energy_raw, proteins_100g AS protein_raw, fat_100g AS fat_raw, fiber_100g AS fiber_raw,
    list_transform(cats, lambda t: lower(regexp_replace(t, '^[^:]*:', ''))) AS all_slugs,
    list_filter(list_transform(list_reverse(cats)[1:3], lambda t: lower(regexp_replace(t, '^[^:]*:', ''))),
                lambda s: s <> '') AS path,
    {has_word("lower(array_to_string(cats, ' '))", fixed.CANDY_WORDS)} AS candy
  FROM listed
)
"""

GRADE_TEXT = _case("grade", fixed.GRADE_DESCRIPTIONS)
NOVA_TEXT = _case("nova", fixed.NOVA_DESCRIPTIONS)

INDICATORS = f"""
rules AS (
  SELECT *,
    list_filter([
      CASE WHEN fat > 20 THEN 'High fat' END, CASE WHEN sugar > 15 THEN 'High sugar' END,
      CASE WHEN salt > 1.5 THEN 'High salt' END, CASE WHEN satfat > 5 THEN 'High saturated fat' END,
      CASE WHEN energy > 400 THEN 'High calorie density' END,
      CASE WHEN nova >= 4 THEN 'Ultra-processed food (NOVA 4)' END,
      CASE WHEN len(adds) > 5 THEN 'Many additives (' || len(adds) || ' found)' END
    ], lambda x: x IS NOT NULL) AS risks,
    list_filter([
      CASE WHEN protein > 10 THEN 'High protein' END, CASE WHEN sugar <= 5 THEN 'Low sugar content' END,
      CASE WHEN fiber > 6 THEN 'High fiber' END,
      CASE WHEN len(list_filter(labs, lambda t: lower(t) LIKE '%organic%' OR lower(t) LIKE '%bio%')) > 0 THEN 'Organic label' END,
      CASE WHEN len(list_filter(labs, lambda t: lower(t) LIKE '%fair-trade%' OR lower(t) LIKE '%fairtrade%')) > 0 THEN 'Fair trade certified' END,
      CASE WHEN fat <= 20 AND sugar <= 15 AND salt <= 1.5 THEN 'Balanced fat, sugar, and salt levels' END,
      CASE WHEN nova = 1 THEN 'Minimally processed (NOVA 1)' END,
      CASE WHEN nova = 2 THEN 'Processed culinary ingredient (NOVA 2)' END,
      CASE WHEN grade IN ('a', 'b') THEN 'Good NutriScore (' || upper(grade) || ')' END
    ], lambda x: x IS NOT NULL) AS positives
  FROM facts
)
"""

_DETAILS = """concat_ws(', ', CASE WHEN fat > 20 THEN 'high fat content' END,
  CASE WHEN satfat > 5 THEN 'high saturated fat' END, CASE WHEN sugar > 15 THEN 'high sugar content' END,
  CASE WHEN fiber > 6 THEN 'good dietary fiber' END, CASE WHEN protein > 10 THEN 'good protein content' END)"""
_HIGHLIGHTS = """concat_ws(', ', CASE WHEN fat > 20 THEN 'high levels of fat' END,
  CASE WHEN sugar > 15 THEN 'high sugar content' END, CASE WHEN protein > 10 THEN 'a good source of protein' END)"""

TEXTS = f"""
texts AS (
  SELECT barcode,
    CASE WHEN {GRADE_TEXT} IS NULL THEN {quoted(fixed.NUTRISCORE_MISSING)}
         ELSE 'NutriScore ' || upper(grade) || ' means ' || {GRADE_TEXT} || '.' ||
              CASE WHEN {_DETAILS} = '' THEN '' ELSE ' This product has ' || {_DETAILS} || '.' END
    END AS nutriscore,
    CASE WHEN {NOVA_TEXT} IS NULL THEN {quoted(fixed.NOVA_MISSING)}
         ELSE 'NOVA Group ' || nova || ': This product is classified as a ' || {NOVA_TEXT} || '. ' ||
              {_case("nova", fixed.NOVA_SENTENCES)} END AS nova_text,
    CASE WHEN energy <= 0 THEN {quoted(fixed.DENSITY_MISSING)}
         ELSE printf('Energy: %.0f kcal per 100 g.', energy)
              || CASE WHEN protein > 0 THEN printf(' Protein: %.1f g per 100 g.', protein) ELSE '' END
              || CASE WHEN fiber > 0 THEN printf(' Fiber: %.1f g per 100 g.', fiber) ELSE '' END
              || CASE WHEN protein / energy * 100 > 5 THEN ' Good protein-to-calorie ratio.' ELSE '' END
    END AS density,
    concat_ws(' ',
      CASE WHEN {GRADE_TEXT} IS NULL THEN coalesce(nullif(product_name, ''), 'This product') || ' is a food product.'
           ELSE coalesce(nullif(product_name, ''), 'This product') || ' is a product with ' || {GRADE_TEXT}
                || ' (NutriScore ' || upper(grade) || ').' END,
      CASE WHEN nova = 4 THEN 'It is classified as an ' || {NOVA_TEXT} || ', which may contain additives, artificial flavors, and emulsifiers.'
           WHEN nova = 1 THEN 'It is ' || {NOVA_TEXT} || ' with little to no industrial processing.'
           WHEN nova IN (2, 3) THEN 'It is a ' || {NOVA_TEXT} || '.' END,
      CASE WHEN {_HIGHLIGHTS} <> '' THEN 'It contains ' || {_HIGHLIGHTS} || '.' END,
      CASE WHEN len(alls) > 0 THEN 'Contains allergens: ' || array_to_string(
        list_transform(alls, lambda t: replace(regexp_replace(t, '^[^:]*:', ''), '-', ' ')), ', ') || '.' END
    ) AS summary
  FROM facts
)
"""

_KEYS = ",\n".join(
    f"({i}, {quoted(key)}, {quoted(', '.join(items))})"
    for i, (key, items) in enumerate(fixed.CATEGORY_PAIRINGS.items())
)
_DEFAULT = quoted(", ".join(fixed.DEFAULT_PAIRINGS))

RULE_PAIRINGS = f"""
keys AS (
  SELECT key, items, row_number() OVER (ORDER BY length(key) DESC, n) AS ord
  FROM (VALUES {_KEYS}) t(n, key, items)
),
rule_pairings AS (
  SELECT barcode, coalesce(arg_min(items, ord), {_DEFAULT}) AS pairings
  FROM (SELECT barcode, unnest(CASE WHEN len(all_slugs) = 0 THEN [''] ELSE all_slugs END) AS slug FROM facts) s
  LEFT JOIN keys ON contains(slug, key)
  GROUP BY barcode
)
"""

ALTERNATIVES = """
members AS (
  SELECT DISTINCT barcode, unnest(all_slugs) AS slug FROM facts
),
top50 AS (
  SELECT * FROM (
    SELECT m.slug, f.*,
           row_number() OVER (PARTITION BY m.slug ORDER BY f.unique_scans_n DESC NULLS LAST, f.barcode) AS pos
    FROM members m JOIN facts f USING (barcode) WHERE m.slug <> ''
  ) WHERE pos <= 50
),
wanted AS (
  SELECT barcode, unnest(path) AS slug, generate_subscripts(path, 1) - 1 AS lvl FROM facts
),
met AS (
  SELECT w.barcode AS cur_barcode, w.lvl, t.*,
         row_number() OVER (PARTITION BY w.barcode, t.name_key, lower(trim(t.url)) ORDER BY w.lvl, t.pos) AS nth
  FROM wanted w JOIN top50 t ON t.slug = w.slug
),
pairs AS (
  SELECT c.barcode AS cur_barcode, m.lvl, m.pos, trim(m.product_name) AS name, m.url, m.grade,
    m.rnk, c.rnk AS cur_rnk, m.nova, c.nova AS cur_nova,
    c.sugar AS cs, m.sugar AS s, c.fat AS cf, m.fat AS f, c.salt AS cl, m.salt AS l,
    c.protein AS cp, m.protein AS p, c.fiber AS cb, m.fiber AS b,
    cast(c.h_sugar AND m.h_sugar AS INTEGER) AS w_s, cast(c.h_fat AND m.h_fat AS INTEGER) AS w_f,
    cast(c.h_salt AND m.h_salt AS INTEGER) AS w_l, cast(c.h_protein AND m.h_protein AS INTEGER) AS w_p,
    cast(c.h_fiber AND m.h_fiber AS INTEGER) AS w_b,
    c.h_sugar::int + c.h_fat::int + c.h_salt::int + c.h_protein::int + c.h_fiber::int AS cur_known,
    m.h_sugar::int + m.h_fat::int + m.h_salt::int + m.h_protein::int + m.h_fiber::int AS known
  FROM met m JOIN facts c ON c.barcode = m.cur_barcode
  WHERE m.nth = 1 AND trim(m.product_name) <> '' AND m.name_key <> c.name_key
),
kinds AS (
  SELECT *, rnk < cur_rnk AS is_better,
    CASE WHEN rnk >= cur_rnk THEN 'discovery'
         WHEN known >= 2 AND cur_known >= 2 AND w_s + w_f + w_l + w_p + w_b >= 1 THEN 'detailed'
         ELSE 'simple' END AS kind
  FROM pairs
),
scored AS (
  SELECT *,
    CASE kind
      WHEN 'simple' THEN (cur_rnk - rnk) * 0.25e0
      WHEN 'discovery' THEN -0.05e0
        + CASE WHEN rnk < 99 THEN greatest(-0.2e0, (cur_rnk - rnk) * 0.05e0) ELSE 0e0 END
        + CASE WHEN nova > 0 AND cur_nova > 0 THEN greatest(-0.1e0, least(0.1e0, (cur_nova - nova) * 0.03e0)) ELSE 0e0 END
      ELSE 0.30e0 * w_s * greatest(-1e0, least(1e0, (cs - s) / greatest(abs(cs), 1e0)))
         + 0.20e0 * w_f * greatest(-1e0, least(1e0, (cf - f) / greatest(abs(cf), 1e0)))
         + 0.15e0 * w_l * greatest(-1e0, least(1e0, (cl - l) / greatest(abs(cl), 1e0)))
         + 0.20e0 * w_p * greatest(-1e0, least(1e0, (p - cp) / greatest(abs(cp), 1e0)))
         + 0.15e0 * w_b * greatest(-1e0, least(1e0, (b - cb) / greatest(abs(cb), 1e0)))
         + CASE WHEN rnk < 99 AND cur_rnk < 99 THEN 0.25e0 * greatest(-1e0, least(1e0, (cur_rnk - rnk) / 4e0)) ELSE 0e0 END
         + CASE WHEN nova > 0 AND cur_nova > 0 THEN 0.15e0 * greatest(-1e0, least(1e0, (cur_nova - nova) / 3e0)) ELSE 0e0 END
    END AS score
  FROM kinds
),
reasoned AS (
  SELECT *,
    CASE kind WHEN 'simple' THEN 75 WHEN 'discovery' THEN 60
         ELSE greatest(50, least(98, cast(trunc(50 + score * 35) AS INTEGER))) END AS confidence,
    CASE WHEN nova > 0 AND cur_nova > 0 AND nova < cur_nova THEN true ELSE false END AS less_processed,
    CASE kind
      WHEN 'detailed' THEN concat_ws('; ', 'NutriScore ' || upper(grade),
        CASE WHEN s < cs THEN printf('Sugar: %.1fg → %.1fg', cs, s) END,
        CASE WHEN f < cf THEN printf('Fat: %.1fg → %.1fg', cf, f) END,
        CASE WHEN l < cl THEN printf('Salt: %.2fg → %.2fg', cl, l) END,
        CASE WHEN b > cb THEN printf('Fiber: %.1fg → %.1fg', cb, b) END,
        CASE WHEN p > cp THEN printf('Protein: %.1fg → %.1fg', cp, p) END,
        CASE WHEN less_processed THEN 'NOVA: ' || cur_nova || ' → ' || nova END
      ) || ' (confidence: ' || confidence || '%)'
      WHEN 'simple' THEN concat_ws('; ', 'Better NutriScore (' || upper(grade) || ')',
        CASE WHEN cur_rnk - rnk >= 2 THEN 'significantly better nutritional quality'
             WHEN cur_rnk - rnk = 1 THEN 'better nutritional quality' END,
        CASE WHEN less_processed THEN 'lower processing (NOVA ' || cur_nova || ' -> ' || nova || ')' END)
      ELSE concat_ws('; ', 'Category discovery option',
        CASE WHEN rnk = cur_rnk THEN 'same NutriScore (' || upper(grade) || ')' END,
        CASE WHEN less_processed THEN 'lower processing (NOVA ' || cur_nova || ' -> ' || nova || ')'
             WHEN nova > 0 AND nova = cur_nova THEN 'similar processing (NOVA ' || nova || ')' END)
    END AS reason
  FROM scored
),
chosen AS (
  SELECT * FROM (
    SELECT *, cast(row_number() OVER (PARTITION BY cur_barcode ORDER BY score DESC, lvl, pos) AS INTEGER) AS place
    FROM (SELECT *, bool_or(is_better) OVER (PARTITION BY cur_barcode) AS any_better FROM reasoned) r
    WHERE is_better = any_better
  ) WHERE place <= 5
)
"""

_JSON = r"regexp_extract(reply, '\{.*\}', 0, 's')"


def _items(field: str) -> str:
    return (
        f"CASE WHEN json_type(j, '$.{field}') = 'ARRAY' THEN list_transform(list_filter("
        f"json_extract(j, '$.{field}[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') ELSE [] END"
    )


def _void(field: str) -> str:
    return f"coalesce(json_type(j, '$.{field}') IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN'), false)"


_FILLERS = "[" + ", ".join(quoted(w) for w in fixed.CANDY_FILLERS) + "]"

REPLIES_BY_PRODUCT = f"""
replies AS ({REPLIES}),
parsed AS (SELECT *, CASE WHEN json_valid({_JSON}) THEN {_JSON} END AS j FROM replies),
asked AS (
  SELECT barcode, bool_or(task = 'pairings') AS asked_pairings,
    max(CASE WHEN task = 'summary' THEN nullif({strip("reply")}, '') END) AS r_summary,
    max(CASE WHEN task = 'nutriscore' THEN nullif({strip("reply")}, '') END) AS r_nutriscore,
    max(CASE WHEN task = 'nova' THEN nullif({strip("reply")}, '') END) AS r_nova
  FROM replies GROUP BY barcode
),
pairing_items AS (
  SELECT barcode, arg_min(items, attempt) AS items FROM (
    SELECT barcode, attempt, list_filter(list_transform({_items("pairings")}, lambda x: trim(lower(x))), lambda x: x <> '') AS items
    FROM parsed WHERE task = 'pairings'
  ) WHERE len(items) > 0 GROUP BY barcode
),
distinct_items AS (
  SELECT barcode, list_filter(items, lambda x, i: list_position(items, x) = i) AS items FROM pairing_items
),
candy_items AS (
  SELECT barcode, items, list_filter(items, lambda x: {has_word("x", fixed.CANDY_PAIRING_WORDS)} AND NOT contains(x, 'tea')) AS kept
  FROM distinct_items
),
reply_pairings AS (
  SELECT f.barcode,
    CASE WHEN NOT coalesce(asked_pairings, false) OR f.all_slugs[-1] = '' THEN NULL
         WHEN candy THEN (list_concat(coalesce(kept, []),
           list_filter({_FILLERS}, lambda x: NOT list_contains(coalesce(kept, []), x))))[1:5]
         ELSE coalesce(items, [])[1:5] END AS items
  FROM facts f LEFT JOIN asked USING (barcode) LEFT JOIN candy_items USING (barcode)
),
insight_items AS (
  SELECT barcode,
    CASE WHEN void THEN [] ELSE list_filter(risks, lambda x: x <> '')[1:1] END AS more_risks,
    CASE WHEN void THEN [] ELSE list_transform(list_filter(positives, lambda x: x <> '')[1:2], lambda x: trim(x)) END AS more_positives
  FROM (SELECT barcode, {_items("enhanced_risks")} AS risks, {_items("enhanced_positives")} AS positives,
          {_void("enhanced_risks")} OR {_void("enhanced_positives")} AS void
        FROM parsed WHERE task = 'insights')
)
"""

MERGED = """
guarded AS (
  SELECT r.*, coalesce(more_risks, []) AS more_risks,
    list_filter(coalesce(more_positives, []), lambda x: x <> ''
      AND NOT (contains(lower(x), 'protein') AND (protein <= 10 OR candy))
      AND NOT (contains(lower(x), 'fiber') AND fiber <= 6)
      AND NOT (contains(lower(x), 'low sugar') AND sugar > 5)
      AND NOT list_contains(list_transform(positives, lambda y: lower(y)), lower(x))) AS more
  FROM rules r LEFT JOIN insight_items USING (barcode)
),
merged AS (
  SELECT barcode, list_concat(risks, more_risks) AS all_risks,
    list_concat(positives, list_filter(more, lambda x, i: i = 1 OR lower(x) <> lower(more[1]))) AS all_positives
  FROM guarded
)
"""


def _template(template: str, **values: str) -> str:
    """A SQL text expression for a prompt template."""
    import re

    parts, end = [], 0
    for mark in re.finditer(r"\$\{?(\w+)\}?", template):
        parts += [quoted(template[end : mark.start()]), values[mark[1]]]
        end = mark.end()
    return "concat(" + ", ".join([*parts, quoted(template[end:])]) + ")"


def _name(default: str) -> str:
    return f"coalesce(nullif(product_name, ''), {quoted(default)})"


def _last(default: str) -> str:
    return f"CASE WHEN len(cats) = 0 THEN {quoted(default)} ELSE regexp_replace(cats[-1], '^[^:]*:', '') END"


_LINES = "concat_ws(chr(10), " + ", ".join(
    f"CASE WHEN {column} > 0 THEN printf('  - {label}: %.1fg/100g', {column}) END"
    for label, column in (("Energy", "energy_raw"), ("Protein", "protein_raw"), ("Fat", "fat_raw"), ("Fiber", "fiber_raw"))
) + ")"
_DICT = "concat('{''fat'': ', fat, ', ''sugar'': ', sugar, ', ''salt'': ', salt, ', ''protein'': ', protein, ', ''fiber'': ', fiber, ', ''saturated_fat'': ', satfat, '}')"


def _pylist(column: str) -> str:
    return f"CASE WHEN len({column}) = 0 THEN 'None detected' ELSE concat('[''', array_to_string({column}, ''', '''), ''']') END"


_PROMPT_SELECTS = [
    (
        "pairings",
        _template(
            fixed.PAIRINGS_PROMPT,
            name=_name("Unknown product"),
            category="all_slugs[-1]",
            nutrients=f"CASE WHEN {_LINES} = '' THEN '' ELSE concat(chr(10), 'Nutrients:', chr(10), {_LINES}) END",
        ),
        "len(cats) > 0 AND all_slugs[-1] <> ''",
    ),
    (
        "summary",
        _template(
            fixed.SUMMARY_PROMPT,
            name=_name("This product"),
            category=_last("food product"),
            grade="coalesce(upper(grade), 'Unknown')",
            nova="CASE WHEN nova > 0 THEN cast(nova AS VARCHAR) ELSE 'Unknown' END",
        ),
        "true",
    ),
    (
        "nutriscore",
        _template(
            fixed.NUTRISCORE_PROMPT,
            name="product_name",
            grade="upper(grade)",
            fat="printf('%.1f', fat)",
            saturated_fat="printf('%.1f', satfat)",
            sugars="printf('%.1f', sugar)",
            proteins="printf('%.1f', protein)",
            fiber="printf('%.1f', fiber)",
        ),
        "rnk < 99",
    ),
    (
        "nova",
        _template(
            fixed.NOVA_PROMPT,
            name="product_name",
            category=_last(""),
            nova="nova",
            description=NOVA_TEXT,
            additives="len(adds)",
        ),
        "nova BETWEEN 1 AND 4",
    ),
    (
        "insights",
        _template(
            fixed.INSIGHTS_PROMPT,
            name=_name("product"),
            category=_last("food"),
            nutrients=_DICT,
            risks=_pylist("risks"),
            positives=_pylist("positives"),
        ),
        "true",
    ),
]


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _unavailable(reply: str, text: str) -> str:
    return f"coalesce({reply}, {quoted(text)})"


FIRST_NUMBER = "list_filter(string_split({0}, '/'), lambda x: regexp_full_match(x, '[0-9]+'))[1]"
ASKED_BARCODE = (
    f"CASE WHEN starts_with(barcode_or_url, 'http') THEN {FIRST_NUMBER.format('barcode_or_url')} "
    "ELSE trim(barcode_or_url) END"
)
REQUESTED = f"requested AS (SELECT request_id, barcode_or_url, {ASKED_BARCODE} AS barcode FROM ({REQUESTS}) q)"

PAGE_URLS = f"""
urls AS (SELECT 'view' AS kind, event_id AS id, url FROM ({VIEWS}) v
         UNION ALL SELECT 'page' AS kind, page_id AS id, url FROM pages)
"""

CONVERSIONS = """
SELECT p_partkey, CASE p_partkey%8 WHEN 0 THEN cast(p_retailprice AS string)
       WHEN 1 THEN concat(' ', cast(p_size AS string), ' ') WHEN 2 THEN p_name
       WHEN 3 THEN concat(cast(p_size AS string), '.0') WHEN 4 THEN concat(cast(p_size AS string), 'd')
       WHEN 5 THEN concat('-', cast(p_size AS string), 'e2') WHEN 6 THEN '' END AS v
FROM {part}
"""

SIMILAR = (
    "array_to_string(array_agg(concat_ws('|', name, coalesce(upper(grade), 'N/A'), reason, "
    "cast(round(score * 1e6) AS BIGINT), confidence, url) ORDER BY place), ' / ')"
)


def _report(cur: str, with_replies: bool) -> str:
    """The report flattened to text columns, for the products in ``cur``."""
    rule_text = "coalesce({0}, {1})" if with_replies else "{1}"
    return (
        _with(
            FACTS, INDICATORS, TEXTS, RULE_PAIRINGS, ALTERNATIVES, REPLIES_BY_PRODUCT, MERGED, REQUESTED,
            f"similar_products AS (SELECT cur_barcode AS barcode, {SIMILAR} AS similar_products FROM chosen GROUP BY cur_barcode)",
        )
        + f"""
SELECT f.barcode, coalesce(nullif(product_name, ''), 'Unknown product') AS name, image_url,
  nutriscore_grade AS nutriscore, try_cast(nova_group AS INTEGER) AS nova,
  {rule_text.format("r_summary", "summary")} AS summary,
  array_to_string({"all_risks" if with_replies else "risks"}, '; ') AS risk_indicators,
  array_to_string({"all_positives" if with_replies else "positives"}, '; ') AS positive_indicators,
  {rule_text.format("CASE WHEN f.rnk < 99 THEN r_nutriscore END", "t.nutriscore")} AS explain_nutriscore,
  {rule_text.format("CASE WHEN f.nova BETWEEN 1 AND 4 THEN r_nova END", "t.nova_text")} AS explain_nova,
  density AS nutrient_density,
  coalesce(s.similar_products, '') AS similar_products,
  {'''CASE WHEN len(cats) = 0 OR rp.items IS NULL OR len(rp.items) = 0 THEN p.pairings
       ELSE array_to_string(rp.items, ', ') END''' if with_replies else "p.pairings"} AS pairings
FROM rules f JOIN texts t USING (barcode) JOIN rule_pairings p USING (barcode)
JOIN merged USING (barcode) JOIN reply_pairings rp USING (barcode)
LEFT JOIN asked USING (barcode) LEFT JOIN similar_products s USING (barcode)
WHERE f.barcode IN ({cur})
"""
    )


def _many_paths(sql: str) -> str:
    """A query over the catalog in which every product with categories has one of its own."""
    own = "CASE WHEN categories IS NOT NULL THEN concat(categories, '|en:own-', barcode) END"
    return sql.replace(f"base AS ({BASE})", f"base AS (SELECT * REPLACE ({own} AS categories) FROM ({BASE}) given)")


def _hashed_replies(prompts: str) -> str:
    """CTEs: prompts with their hash, and the derived replies to them."""
    replies = derived.HASHED_REPLIES_SQL.format(prompts="prompted p").replace("lower(sha2(", "sha256(").replace(", 256)) AS", ") AS")
    return f"WITH prompted AS ({prompts}), asked AS (SELECT *, sha256(prompt) AS prompt_hash FROM prompted), hashed_replies AS ({replies})\n"


CATALOG_REJECTS = f"""
WITH judged AS (
  SELECT line, CASE WHEN NOT json_valid(line) THEN 'not valid JSON' WHEN json_type(line) <> 'OBJECT' THEN 'not an object'
    WHEN json_type(line, '$.categories_tags') = 'UBIGINT' THEN 'a field of another type'
    WHEN coalesce(trim(json_extract_string(line, '$.barcode')), '') = '' THEN 'no barcode' END AS reason
  FROM ({derived.LINES_SQL.format(part="part")}) l
)
SELECT CASE WHEN reason IS NULL THEN json_extract_string(line, '$.barcode') END AS barcode,
  CASE WHEN reason IS NULL THEN json_extract_string(line, '$.product_name') END AS product_name,
  CASE WHEN reason IS NOT NULL THEN line END AS line, reason FROM judged"""

NUTRIMENTS_TYPED = f"""
WITH held AS (
  SELECT json_extract_string(line, '$.barcode') AS barcode, json_type(line, '$.nutriments.fat_100g') AS kind,
    json_extract_string(line, '$.nutriments.fat_100g') AS v, json_extract_string(line, '$.nutriments.fat') AS plain
  FROM ({derived.AMOUNT_LINES_SQL.format(part="part")}) l
)
SELECT barcode, CASE WHEN kind IS NULL OR kind IN ('NULL', 'BOOLEAN') OR v = '' OR (kind <> 'VARCHAR' AND cast(v AS DOUBLE) = 0)
  THEN cast(plain AS DOUBLE) ELSE coalesce(try_cast(v AS DOUBLE), 0e0) END AS fat FROM held"""

CATALOG_LATEST = f"""
SELECT barcode, product_name, last_modified_t, unique_scans_n FROM ({derived.VERSIONS_SQL.format(part="part")}) v
QUALIFY row_number() OVER (PARTITION BY barcode ORDER BY last_modified_t DESC NULLS LAST) = 1"""


def oracle_sql() -> dict[str, str]:
    sql = _oracle_sql()
    return sql | {
        "alternatives_many_paths": _many_paths(sql["alternatives_topn"]),
        "candidates_many_paths": _many_paths(sql["candidates_dedup"]),
        "catalog_read": sql["catalog_scan"],
        "requests_read": sql["barcode_from_url"],
        "replies_read": f"SELECT barcode, task, attempt, reply FROM ({REPLIES}) r",
        "report_written": sql["report"],
        "category_top50_maintained": sql["category_top50"],
        "pairings_rules_table": sql["pairings_rules"],
        "replies_current": _hashed_replies(sql["prompts"])
        + "SELECT barcode, task, attempt, reply FROM asked JOIN hashed_replies USING (task, prompt_hash)",
        "prompts_unanswered": _hashed_replies(sql["prompts"])
        + """SELECT DISTINCT a.task, a.prompt_hash, a.prompt, cast(coalesce(t.tried, 0) + 1 AS INTEGER) AS attempt FROM asked a LEFT JOIN (
  SELECT task, prompt_hash, max(attempt) AS tried, bool_or(CASE task WHEN 'pairings' THEN contains(reply, 'Rice') ELSE reply IS NOT NULL END) AS done
  FROM hashed_replies GROUP BY task, prompt_hash) t USING (task, prompt_hash)
WHERE NOT coalesce(t.done, FALSE) AND coalesce(t.tried, 0) < 2""",
        "catalog_rejects": CATALOG_REJECTS,
        "nutriments_typed": NUTRIMENTS_TYPED,
        "catalog_latest": CATALOG_LATEST,
        "requests_resolved": f"""SELECT request_id, barcode, product_name, nutriscore_grade, 'found' AS outcome, NULL AS error
FROM ({sql["resolve_requests"]}) f
UNION ALL SELECT request_id, barcode, NULL, NULL, CASE WHEN barcode IS NULL THEN 'unreadable' ELSE 'unknown' END, error
FROM ({sql["requests_not_found"]}) n""",
    }


def _oracle_sql() -> dict[str, str]:
    facts = _with(FACTS)
    alts = _with(FACTS, ALTERNATIVES)
    chosen = "SELECT cur_barcode AS barcode, place, "
    return {
        "catalog_scan": _with(f"base AS ({BASE})")
        + """SELECT barcode, product_name, nutriscore_grade, nova_group, fat_100g, sugars_100g, sugars, salt_100g,
  saturated_fat_100g, proteins_100g, fiber_100g, energy_kcal_100g, categories, labels, additives, allergens,
  image_url, url, unique_scans_n FROM base""",
        "safe_conversions": f"""SELECT p_partkey,
  CASE WHEN regexp_full_match(v, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN cast(trim(v) AS DOUBLE) ELSE -1e0 END AS as_double,
  CASE WHEN regexp_full_match(v, '\\s*[+-]?[0-9]+\\s*') THEN cast(trim(v) AS INTEGER) ELSE -1 END AS as_int
FROM ({CONVERSIONS.format(part="part")}) c""",
        "nutrient_extract": facts
        + """SELECT barcode, fat, sugar AS sugars, salt, satfat AS saturated_fat, protein AS proteins, fiber, energy AS energy_kcal,
  h_sugar::int + h_fat::int + h_salt::int + h_protein::int + h_fiber::int AS known_metrics FROM facts""",
        "grade_normalise": facts
        + "SELECT barcode, nutriscore_grade, grade, cast(rnk AS INTEGER) AS grade_rank, nova FROM facts",
        "category_slugs": facts
        + """SELECT barcode, coalesce(list_filter(all_slugs, lambda s: s <> '')[1], '') AS first_slug,
  coalesce(all_slugs[-1], '') AS last_slug, coalesce(array_to_string(path, '>'), '') AS path, candy AS is_candy FROM facts""",
        "allergen_names": facts
        + """SELECT barcode, array_to_string(list_transform(alls, lambda t: replace(regexp_replace(t, '^[^:]*:', ''), '-', ' ')), ', ') AS names FROM facts""",
        "additive_names": facts
        + """SELECT barcode, array_to_string(list_transform(adds, lambda t: upper(replace(regexp_replace(t, '^[^:]*:', ''), '-', ' '))), ', ') AS names FROM facts""",
        "risk_indicators": _with(FACTS, INDICATORS)
        + "SELECT barcode, cast(len(risks) AS INTEGER) AS n, array_to_string(risks, '; ') AS indicators FROM rules",
        "positive_indicators": _with(FACTS, INDICATORS)
        + "SELECT barcode, cast(len(positives) AS INTEGER) AS n, array_to_string(positives, '; ') AS indicators FROM rules",
        "explain_nutriscore": _with(FACTS, TEXTS) + "SELECT barcode, nutriscore FROM texts",
        "explain_nova": _with(FACTS, TEXTS) + "SELECT barcode, nova_text AS nova FROM texts",
        "nutrient_density": _with(FACTS, TEXTS) + "SELECT barcode, density AS nutrient_density FROM texts",
        "summary_text": _with(FACTS, TEXTS) + "SELECT barcode, summary FROM texts",
        "text_precedence": _with(FACTS, REPLIES_BY_PRODUCT)
        + f"""SELECT f.barcode, {_unavailable("r_summary", fixed.SUMMARY_UNAVAILABLE)} AS summary,
  {_unavailable("CASE WHEN f.rnk < 99 THEN r_nutriscore END", fixed.NUTRISCORE_UNAVAILABLE)} AS nutriscore,
  {_unavailable("CASE WHEN f.nova BETWEEN 1 AND 4 THEN r_nova END", fixed.NOVA_UNAVAILABLE)} AS nova
FROM facts f LEFT JOIN asked USING (barcode)""",
        "barcode_from_url": _with(REQUESTED) + "SELECT request_id, barcode_or_url, barcode FROM requested",
        "page_url_barcode": _with(PAGE_URLS)
        + """SELECT kind, id,
  nullif(regexp_extract(url, '^[a-z]+://[^/]+/product/([0-9]+)(/|$)', 1), '') AS by_path,
  nullif(regexp_extract(lower(url), 'food\\.example/product/([0-9]+)', 1), '') AS by_prefix FROM urls""",
        "resolve_requests": _with(FACTS, REQUESTED)
        + "SELECT request_id, r.barcode, product_name, nutriscore_grade FROM requested r JOIN facts f ON f.barcode = r.barcode",
        "requests_not_found": _with(FACTS, REQUESTED)
        + f"""SELECT request_id, barcode_or_url, barcode,
  CASE WHEN barcode IS NULL THEN concat({quoted(fixed.NO_BARCODE_IN_URL)}, barcode_or_url)
       ELSE concat({quoted(fixed.BARCODE_NOT_FOUND)}, barcode) END AS error
FROM requested WHERE barcode IS NULL OR barcode NOT IN (SELECT barcode FROM facts)""",
        "category_top50": alts
        + "SELECT slug, cast(pos AS INTEGER) AS position, barcode, trim(product_name) AS name, unique_scans_n FROM top50",
        "candidates_dedup": alts
        + """SELECT DISTINCT array_to_string(f.path, '>') AS path, cast(lvl AS INTEGER) AS level,
  cast(pos AS INTEGER) AS position, trim(m.product_name) AS name, m.url
FROM met m JOIN facts f ON f.barcode = m.cur_barcode WHERE nth = 1 AND trim(m.product_name) <> ''""",
        "alternative_scores": alts
        + """SELECT cur_barcode AS barcode, name, url, coalesce(upper(grade), 'N/A') AS nutriscore_grade, is_better,
  round(score, 9) AS score, confidence, reason FROM reasoned""",
        "alternatives_topn": alts
        + chosen + "name, coalesce(upper(grade), 'N/A') AS nutriscore_grade, round(score, 9) AS score, confidence, url FROM chosen",
        "alternatives_discovery": alts
        + chosen + "name, round(score, 9) AS score, reason FROM chosen WHERE NOT any_better",
        "alternative_reasons": alts + chosen + "reason FROM chosen",
        "pairings_rules": _with(FACTS, RULE_PAIRINGS) + "SELECT barcode, pairings FROM rule_pairings",
        "pairings_reply": _with(FACTS, REPLIES_BY_PRODUCT)
        + f"""SELECT barcode, CASE WHEN len(cats) = 0 THEN {_DEFAULT} ELSE coalesce(array_to_string(items, ', '), '') END AS pairings
FROM facts JOIN reply_pairings USING (barcode)""",
        "insight_reply_merge": _with(FACTS, INDICATORS, REPLIES_BY_PRODUCT, MERGED)
        + """SELECT barcode, array_to_string(all_risks, '; ') AS risk_indicators,
  array_to_string(all_positives, '; ') AS positive_indicators FROM merged""",
        "prompts": _with(FACTS, INDICATORS)
        + "\nUNION ALL\n".join(
            f"SELECT barcode, '{task}' AS task, {prompt} AS prompt FROM rules WHERE {where}"
            for task, prompt, where in _PROMPT_SELECTS
        ),
        "report": _report("SELECT barcode FROM facts", with_replies=True),
        "report_requested": _report("SELECT barcode FROM requested", with_replies=False),
        "latest_viewed": _latest_viewed(),
        "latest_viewed_stream": _latest_viewed(),
    }


def _latest_viewed() -> str:
    return f"""SELECT user_id, ts, event_id, barcode FROM (
  SELECT user_id, ts, event_id, regexp_extract(url, '/product/([0-9]+)/', 1) AS barcode,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth
  FROM ({VIEWS}) v WHERE contains(url, '/product/')
) WHERE nth = 1"""
