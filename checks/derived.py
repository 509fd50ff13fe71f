"""Food-shaped inputs derived from the given tables.

The SQL texts run unchanged in Spark and in DuckDB, so both sides of a check
start from the same rows. ``{part}`` and the like name the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SQL = """
SELECT k, barcode, product_name, nutriscore_grade, nova_group,
       concat('https://food.example/product/', barcode, '/item') AS url,
       CASE WHEN k%4 = 0 THEN concat('https://food.example/images/', barcode, '.jpg') END AS image_url,
       CASE WHEN k%21 <> 0 AND k%11 <> 0 THEN cast(k*37%601 AS double)/10e0 END AS fat_100g,
       CASE WHEN k%21 <> 0 AND k%13 <> 0 THEN cast(k*53%801 AS double)/10e0 END AS sugars_100g,
       CASE WHEN k%21 <> 0 AND k%13 = 0 THEN cast(k*53%801 AS double)/10e0 END AS sugars,
       CASE WHEN k%23 <> 0 THEN cast(k*29%301 AS double)/100e0 END AS salt_100g,
       cast(k*17%151 AS double)/10e0 AS saturated_fat_100g,
       CASE WHEN k%21 <> 0 AND k%23 <> 0 THEN cast(k*41%301 AS double)/10e0 END AS proteins_100g,
       CASE WHEN k%21 <> 0 AND k%8 <> 0 THEN cast(k*23%151 AS double)/10e0 END AS fiber_100g,
       CASE WHEN k%17 <> 0 THEN cast(k*61%701 AS double) END AS energy_kcal_100g,
       categories, labels, additives, allergens, unique_scans_n
FROM (
  SELECT p_partkey AS k,
         lpad(cast(p_partkey AS string), 13, '0') AS barcode,
         CASE WHEN p_partkey%97 = 0 THEN '' ELSE concat(p_name, ' ', p_brand) END AS product_name,
         CASE p_partkey%9 WHEN 0 THEN 'a' WHEN 1 THEN 'B' WHEN 2 THEN ' c ' WHEN 3 THEN 'd'
              WHEN 4 THEN 'E' WHEN 5 THEN 'unknown' WHEN 6 THEN '' WHEN 7 THEN 'a' END AS nutriscore_grade,
         CASE p_partkey%7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4'
              WHEN 4 THEN 'x' WHEN 5 THEN '4' END AS nova_group,
         CASE p_partkey%10 WHEN 0 THEN 'en:spreads|en:nut-butters|en:peanut-butters'
              WHEN 1 THEN 'en:snacks|en:chocolates|en:milk-chocolates'
              WHEN 2 THEN 'en:dairies|en:yogurts|en:greek-yogurts'
              WHEN 3 THEN 'en:fats|en:vegetable-oils|en:olive-oils'
              WHEN 4 THEN 'en:plant-based-foods|en:legumes|en:pulses|en:red-lentils'
              WHEN 5 THEN 'en:snacks|en:confectioneries|en:gummy-candies'
              WHEN 6 THEN 'en:snacks|en:salty-snacks|en:potato-chips'
              WHEN 7 THEN 'en:uncharted-goods' WHEN 8 THEN 'en:snacks|fr:' END AS categories,
         CASE p_partkey%19 WHEN 0 THEN 'en:organic' WHEN 1 THEN 'en:biodegradable-pack'
              WHEN 2 THEN 'en:fair-trade' WHEN 3 THEN 'en:EU-Bio' END AS labels,
         CASE p_partkey%3 WHEN 1 THEN 'en:e471|en:e322'
              WHEN 2 THEN 'en:e100|en:e101|en:e102|en:e103|en:e104|en:e105|en:e106' END AS additives,
         CASE p_partkey%4 WHEN 1 THEN 'en:peanuts' WHEN 2 THEN 'en:peanuts|en:soybeans'
              WHEN 3 THEN 'en:milk|en:tree-nuts' END AS allergens,
         coalesce(n, 0) AS unique_scans_n
  FROM {part} LEFT JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey) scans
    ON l_partkey = p_partkey
) base
"""

# JSON lines of products, some of them spoilt.
LINES_SQL = """
SELECT CASE WHEN k%31 = 0 THEN concat('{{"barcode":"', barcode, '","product_name":')
            WHEN k%29 = 0 THEN concat('[', line, ']')
            WHEN k%23 = 0 THEN concat('{{"product_name":"no code ', barcode, '"}}')
            WHEN k%19 = 0 THEN concat('{{"barcode":" ","product_name":"', barcode, '"}}')
            WHEN k%17 = 0 THEN concat('{{"barcode":"', barcode, '","categories_tags":7}}')
            WHEN k%13 = 0 THEN concat(line, ' {{"barcode":"1"}}')
            WHEN k%11 = 0 THEN concat('"', barcode, '"')
            WHEN k%7 = 0 THEN concat('  ', line, ' ') ELSE line END AS line
FROM (SELECT k, barcode, concat('{{"barcode":"', barcode, '","product_name":"Food ', cast(k AS string), '"}}') AS line
      FROM (SELECT p_partkey AS k, lpad(cast(p_partkey AS string), 13, '0') AS barcode FROM {part}) base) lines
"""

# JSON lines of products whose amounts are numbers, texts and other values.
AMOUNT_LINES_SQL = """
SELECT concat('{{"barcode":"', lpad(cast(p_partkey AS string), 13, '0'), '","nutriments":{{',
              CASE p_partkey%9 WHEN 0 THEN '"fat_100g":0,' WHEN 1 THEN '"fat_100g":"0",' WHEN 2 THEN '"fat_100g":"",'
                   WHEN 3 THEN '"fat_100g":null,' WHEN 4 THEN '"fat_100g":"x",' WHEN 5 THEN '"fat_100g":false,'
                   WHEN 6 THEN concat('"fat_100g":', cast(p_partkey%50 + 1 AS string), '.5,')
                   WHEN 7 THEN concat('"fat_100g":"', cast(p_partkey%50 + 1 AS string), '.5",') ELSE '' END,
              CASE WHEN p_partkey%2 = 0 THEN '"fat":' ELSE '"fat":"' END, cast(p_partkey%40 AS string),
              CASE WHEN p_partkey%2 = 0 THEN '}}}}' ELSE '"}}}}' END) AS line
FROM {part}
"""

# Versions of products: one to five, the fifth as a repeated row, one without a date.
VERSIONS_SQL = " UNION ALL ".join(
    f"""SELECT lpad(cast(p_partkey AS string), 13, '0') AS barcode, concat(p_name, ' v{min(v, 3)}') AS product_name,
       {f"1700000000 + {min(v, 3)}*1000 + p_partkey%7" if v else "cast(NULL AS bigint)"} AS last_modified_t,
       cast(p_partkey%1000 + {min(v, 3)} AS bigint) AS unique_scans_n
FROM {{part}} WHERE p_partkey%5 >= {v}"""
    for v in range(5)
)

REQUESTS_SQL = """
SELECT k AS request_id,
       CASE WHEN k%5 = 0 THEN concat('https://food.example/product/', barcode, '/item')
            ELSE concat(' ', barcode, ' ') END AS barcode_or_url
FROM (SELECT p_partkey AS k, lpad(cast(p_partkey AS string), 13, '0') AS barcode FROM {part}) base
WHERE k%5 IN (0, 1)
UNION ALL
SELECT 1000000000 + page_id AS request_id, url AS barcode_or_url FROM {pages}
"""

REPLIES_SQL = """
SELECT barcode, task, attempt, reply FROM (
  SELECT k, barcode, 'pairings' AS task, 1 AS attempt,
         CASE k%5
           WHEN 0 THEN concat('{{"pairings": ["Fresh Bread", " fresh bread ", "", "Green Tea", "Fruit Salad ', cast(k%7 AS string), '", "Plain Yogurt", "Soup", "Rice"], "reasoning": "r"}}')
           WHEN 1 THEN concat('Here it is:', chr(10), '{{"pairings": ["Citrus Slices", "Sparkling Water",', chr(10), ' "Rye Crackers ', cast(k%7 AS string), '"]}} Enjoy!')
           WHEN 2 THEN '{{"pairings": ["bread", "che'
           WHEN 3 THEN '{{"pairings": ["Rice", 1, null, true, ["x"], {{"a": 1}}, "Mixed Nuts"]}}'
           WHEN 4 THEN CASE k%4 WHEN 0 THEN '{{"pairings": ["x"]}}], Option B: [{{"pairings": ["y"]}}'
                                WHEN 1 THEN '{{"pairings": ["x"]}}]}}' END
         END AS reply
  FROM {base}
  UNION ALL
  SELECT k, barcode, 'pairings' AS task, 2 AS attempt, '{{"pairings": ["Second Try", "Water"]}}' AS reply
  FROM {base} WHERE k%5 = 2 AND k%2 = 0
  UNION ALL
  SELECT k, barcode, 'insights' AS task, 1 AS attempt,
         CASE k%10
           WHEN 0 THEN '{{"enhanced_risks": ["Watch portion size"], "enhanced_positives": ["Rich in protein", "High fiber", "Third item"]}}'
           WHEN 1 THEN 'Well: {{"enhanced_risks": ["", "Salty for its class", "Extra"], "enhanced_positives": [" low sugar content ", "Heart-healthy fats"]}} .'
           WHEN 2 THEN '{{"enhanced_risks": ["Never shown"]}} and then }}'
           WHEN 3 THEN '{{"enhanced_risks": null, "enhanced_positives": ["Good choice"]}}'
           WHEN 4 THEN '{{"enhanced_positives": [7, "Plant Based", "plant based"]}}'
           WHEN 5 THEN '{{"enhanced_risks": "text", "enhanced_positives": ["Good choice"]}}'
           WHEN 6 THEN 'no object at all'
           WHEN 7 THEN '{{"enhanced_risks": [], "enhanced_positives": ["Low sugar content", " Very low sugar "]}}'
           WHEN 8 THEN '{{"enhanced_risks": [" "], "enhanced_positives": ["  ", "Fine fiber source"]}}'
           WHEN 9 THEN '{{"enhanced_positives": ["Great taste"]}}], or [{{"enhanced_risks": ["Never shown"]}}'
         END AS reply
  FROM {base}
  UNION ALL
  SELECT k, barcode, 'summary' AS task, 1 AS attempt,
         CASE k%4 WHEN 0 THEN concat('  A summary of product ', barcode, '.  ') WHEN 1 THEN '   ' END AS reply
  FROM {base} WHERE k%4 <> 3
  UNION ALL
  SELECT k, barcode, 'summary' AS task, 0 AS attempt, NULL AS reply FROM {base} WHERE k%8 = 0
  UNION ALL
  SELECT k, barcode, 'nutriscore' AS task, 1 AS attempt,
         CASE WHEN k%4 < 2 THEN concat(chr(10), 'The grade of ', barcode, ' explained.') END AS reply
  FROM {base} WHERE k%4 <> 2
  UNION ALL
  SELECT k, barcode, 'nova' AS task, 1 AS attempt,
         CASE WHEN k%4 > 1 THEN concat('The group of ', barcode, ' explained. ') ELSE '' END AS reply
  FROM {base} WHERE k%8 <> 5
) every_task
WHERE k%3 = 0
"""

# Replies by prompt: up to date, stale, none, and of one or two tries; equal prompts have one.
HASHED_REPLIES_SQL = """
SELECT task, lower(sha2(CASE WHEN k%4 = 1 THEN concat(prompt, ' before') ELSE prompt END, 256)) AS prompt_hash, attempt,
       CASE WHEN task <> 'pairings' THEN CASE WHEN k%7 <> 2 THEN concat('Reply to ', cast(length(prompt) AS string)) END
            WHEN attempt = 1 AND k%3 = 0 THEN '{{"pairings": []}}' WHEN k%5 = 0 THEN 'no json'
            ELSE '{{"pairings": ["Rice", "Soup"]}}' END AS reply
FROM (SELECT task, prompt, length(prompt)*7 + ascii(right(prompt, 9)) AS k FROM {prompts} GROUP BY task, prompt) asked
CROSS JOIN (SELECT 1 AS attempt UNION ALL SELECT 2 AS attempt) tries
WHERE k%4 <> 3 AND (attempt = 1 OR k%2 = 0)
"""

REPLY_BASE_SQL = (
    "SELECT p_partkey AS k, lpad(cast(p_partkey AS string), 13, '0') AS barcode FROM {part}"
)

# DuckDB form of ``views``: its regexp_replace needs 'g' to replace every match.
VIEWS_SQL = """
SELECT user_id, event_id, ts,
       CASE WHEN event_id%11 = 3 THEN concat('https://food.example/about/', barcode)
            ELSE concat('https://food.example/product/', barcode, '/item') END AS url
FROM (SELECT user_id, event_id, ts,
             lpad(regexp_replace(props, '[^0-9]', '', 'g'), 13, '0') AS barcode
      FROM events) viewed
"""

# Nutriment key of the catalog -> flat column of the derived rows.
NUTRIMENT_COLUMNS = {
    "fat_100g": "fat_100g",
    "sugars_100g": "sugars_100g",
    "sugars": "sugars",
    "salt_100g": "salt_100g",
    "saturated-fat_100g": "saturated_fat_100g",
    "proteins_100g": "proteins_100g",
    "fiber_100g": "fiber_100g",
    "energy-kcal_100g": "energy_kcal_100g",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product catalog: nutriments as a map of the stated values, tags as arrays."""
    flat = spark.sql(
        CATALOG_SQL,
        part=table(spark, sf_dir, "part"),
        lineitem=table(spark, sf_dir, "lineitem"),
    )
    stated = F.filter(
        F.array(
            *[
                F.struct(F.lit(key).alias("key"), F.col(column).cast("string").alias("value"))
                for key, column in NUTRIMENT_COLUMNS.items()
            ]
        ),
        lambda entry: entry["value"].isNotNull(),
    )
    return flat.select(
        "barcode",
        "product_name",
        "nutriscore_grade",
        "nova_group",
        F.map_from_entries(stated).alias("nutriments"),
        *[
            F.split(column, r"\|").alias(f"{column}_tags")
            for column in ("categories", "labels", "additives", "allergens")
        ],
        "image_url",
        "url",
        "unique_scans_n",
    )


def many_paths_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with a category of its own below those each product has."""
    own = F.array(F.concat(F.lit("en:own-"), F.col("barcode")))
    tags = F.when(F.col("categories_tags").isNotNull(), F.concat("categories_tags", own))
    return catalog(spark, sf_dir).withColumn("categories_tags", tags)


def catalog_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as JSON lines, with processing groups as numbers for every second product.

    These are written as a number with a fraction, as tools do that widen integers.
    """
    line = F.to_json(F.struct("*"))
    number = F.regexp_replace(line, '"nova_group":"([0-9]+)"', '"nova_group":$1.0')
    even = F.col("barcode").cast("long") % 2 == 0
    return catalog(spark, sf_dir).select(F.when(even, number).otherwise(line).alias("value"))


def earlier_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog before the changes below: some products less, some more, some with more scans."""
    now, k = catalog(spark, sf_dir), F.col("barcode").cast("long")
    gone = now.filter(k % 23 == 0).withColumns(
        {"barcode": F.concat(F.lit("x"), "barcode"), "unique_scans_n": F.col("unique_scans_n") + 100}
    )
    scans = F.when(k % 13 == 0, F.col("unique_scans_n") + 50).otherwise(F.col("unique_scans_n"))
    return now.filter(k % 17 != 3).withColumn("unique_scans_n", scans).unionByName(gone)


def catalog_changes(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    """(changed products, deleted barcodes) of two updates that make the catalog of ``earlier_catalog``."""
    now, k = catalog(spark, sf_dir), F.col("barcode").cast("long")
    gone = now.filter(k % 23 == 0).select(F.concat(F.lit("x"), "barcode").alias("barcode"))
    return [(now.filter(k % 13 == 0), gone.limit(0)), (now.filter((k % 17 == 3) & (k % 13 != 0)), gone)]


def _of_part(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, part=table(spark, sf_dir, "part"))


def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_part(spark, sf_dir, LINES_SQL)


def amount_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_part(spark, sf_dir, AMOUNT_LINES_SQL)


def catalog_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_part(spark, sf_dir, VERSIONS_SQL)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        REQUESTS_SQL, part=table(spark, sf_dir, "part"), pages=table(spark, sf_dir, "pages")
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(REPLY_BASE_SQL, part=table(spark, sf_dir, "part"))
    return spark.sql(REPLIES_SQL, base=base)


def views(events: DataFrame) -> DataFrame:
    """Page views; ``events`` may be a stream."""
    barcode = F.lpad(F.regexp_replace("props", "[^0-9]", ""), 13, "0")
    page = F.when(F.col("event_id") % 11 == 3, "about").otherwise("product")
    tail = F.when(F.col("event_id") % 11 == 3, "").otherwise("/item")
    return events.select(
        "user_id",
        "event_id",
        "ts",
        F.concat(F.lit("https://food.example/"), page, F.lit("/"), barcode, tail).alias("url"),
    )
