"""Declared schemas and the typed product frame all jobs work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.config import DEFAULT_CONFIG, InsightConfig
from shelfwise.fixed_values import METRIC_WEIGHTS
from shelfwise.functions import tags as tag_fn
from shelfwise.functions.nutrients import nutriments_of
from shelfwise.functions.scalars import strip, to_int

PRODUCT_SCHEMA = T.StructType(
    [
        T.StructField("barcode", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("nutriscore_grade", T.StringType()),
        T.StructField("nova_group", T.StringType()),
        T.StructField("nutriments", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ingredients_text", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("categories_tags", T.ArrayType(T.StringType())),
        T.StructField("labels", T.StringType()),
        T.StructField("labels_tags", T.ArrayType(T.StringType())),
        T.StructField("additives_tags", T.ArrayType(T.StringType())),
        T.StructField("allergens_tags", T.ArrayType(T.StringType())),
        T.StructField("image_url", T.StringType()),
        T.StructField("brands", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("unique_scans_n", T.LongType()),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("barcode_or_url", T.StringType()),
    ]
)

REPLY_SCHEMA = T.StructType(
    [
        T.StructField("barcode", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("reply", T.StringType()),
    ]
)

# Nutrient column of the typed frame -> name in the nutriments of the catalog.
NUTRIENTS = {
    "fat": "fat",
    "sugars": "sugars",
    "salt": "salt",
    "saturated_fat": "saturated-fat",
    "proteins": "proteins",
    "fiber": "fiber",
    "energy_kcal": "energy-kcal",
}

# Values per 100 g shown in the pairing prompt, in its order.
PROMPT_NUTRIENTS = {
    "energy": "energy-kcal",
    "protein": "proteins",
    "fat": "fat",
    "carbs": "carbohydrates",
    "fiber": "fiber",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as typed nulls."""
    missing = [f for f in schema.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df


def product_facts(catalog: DataFrame, config: InsightConfig = DEFAULT_CONFIG) -> DataFrame:
    """One typed row per product: what the rules, texts and comparisons read.

    ``catalog`` has the columns of ``PRODUCT_SCHEMA``; absent ones count as
    null. ``nutriments`` may be a map (text or number values) or a struct with
    one field per nutrient; of a struct only the fields used are read from
    columnar files. This is a narrow projection, and Catalyst keeps only the
    columns a job asks for.
    """
    df = conform(catalog, PRODUCT_SCHEMA)
    read = list(dict.fromkeys([*NUTRIENTS.values(), *PROMPT_NUTRIENTS.values()]))
    nutriments = nutriments_of(df.schema["nutriments"].dataType, F.col("nutriments"), read)
    tag_columns = ("categories_tags", "labels_tags", "additives_tags", "allergens_tags")

    # Columns of one step are read more than once in the next. Catalyst keeps
    # such steps apart, so that nothing is looked up or parsed twice.
    steps: list[dict[str, Column]] = [
        {name: tag_fn.tags_or_empty(F.col(name)) for name in tag_columns},
        {
            "grade": tag_fn.normalise_grade(F.col("nutriscore_grade")),
            "category_path": tag_fn.category_path(F.col("categories_tags"), config.category_depth),
        },
        *nutriments.steps(),
        {name: nutriments.amount(key) for name, key in NUTRIENTS.items()}
        | {f"has_{name}": nutriments.has(NUTRIENTS[name]) for name in METRIC_WEIGHTS}
        | {f"per_100g_{name}": nutriments.per_100g(key) for name, key in PROMPT_NUTRIENTS.items()}
        | {
            "name_key": F.lower(strip(F.coalesce("product_name", F.lit("")))),
            "grade_rank": tag_fn.grade_rank(F.col("grade")),
            "nova": to_int(F.col("nova_group")),
            "labels_text": tag_fn.joined_tags(F.col("labels_tags")),
            "slugs_text": tag_fn.joined_slugs(F.col("categories_tags")),
        },
    ]
    for step in steps:
        df = df.withColumns(step)
    passed_on = ["barcode", "product_name", "nutriscore_grade", "nova_group", "image_url",
                 "brands", "url", "unique_scans_n", "grade", "category_path"]
    return df.select(*passed_on, *tag_columns, *steps[-1])
