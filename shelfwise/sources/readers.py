"""Reading catalogs, requests and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.replies import one_json
from shelfwise.functions.scalars import strip
from shelfwise.sources.schema import PRODUCT_SCHEMA, REPLY_SCHEMA, REQUEST_SCHEMA


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Columnar files bring their own schema; text formats get the declared one."""
    if fmt in ("parquet", "orc"):
        return spark.read.format(fmt).load(path)
    if fmt == "json":
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    raise ValueError(f"unknown format {fmt!r}")


#: The product as JSON holds it: a processing group or an amount may be a number or a text.
_JSON_TYPES = {"nova_group": T.VariantType(), "nutriments": T.MapType(T.StringType(), T.VariantType())}
_JSON_PRODUCT = T.StructType(
    [T.StructField(f.name, _JSON_TYPES.get(f.name, f.dataType)) for f in PRODUCT_SCHEMA.fields]
)


def _group_text(group: Column) -> Column:
    """A processing group as text; a JSON number loses its fraction, a text stays as it is."""
    kind = F.schema_of_variant(group)
    number = F.try_variant_get(group, "$", "double").cast("long").cast("string")
    is_number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    text = F.when(kind == "STRING", F.try_variant_get(group, "$", "string"))
    return F.when(is_number, number).otherwise(text)


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Products from parquet, ORC or JSON lines, one product per row.

    From JSON the nutriments are a map of variants, which tells the text "0" from the number.
    """
    if fmt == "csv":
        raise ValueError("a catalog has nested columns, which CSV cannot hold")
    if fmt == "json":
        products = _read(spark, path, fmt, _JSON_PRODUCT)
        return products.withColumn("nova_group", _group_text(F.col("nova_group")))
    return _read(spark, path, fmt, PRODUCT_SCHEMA)


#: Why a line of a catalog is not a product.
MALFORMED, NOT_AN_OBJECT, NO_BARCODE, WRONG_TYPE = (
    "not valid JSON",
    "not an object",
    "no barcode",
    "a field of another type",
)


def read_catalog_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as products, with ``line`` and ``reason`` where a line is none.

    Of such a line all product columns are null, so that half-read products reach no job.
    Blank lines are left out. A line may hold one object only: what follows it is an error.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line").filter(strip(F.col("line")) != "")
    schema = T.StructType([*_JSON_PRODUCT.fields, T.StructField("_unread", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"}
    read = lines.withColumns({"_whole": one_json(F.col("line")), "_product": F.from_json("line", schema, options)})
    kind = F.schema_of_variant(F.get(F.col("_whole").cast("array<variant>"), F.lit(0)))
    barcode = F.coalesce(strip(F.col("_product.barcode")), F.lit(""))
    reason = (
        F.when(F.col("_whole").isNull(), MALFORMED)
        .when(~F.coalesce(kind, F.lit("")).startswith("OBJECT"), NOT_AN_OBJECT)
        .when(F.col("_product._unread").isNotNull(), WRONG_TYPE)
        .when(barcode == "", NO_BARCODE)
    )
    good = F.col("reason").isNull()
    fields = [F.when(good, F.col(f"_product.{name}")).alias(name) for name in PRODUCT_SCHEMA.fieldNames()]
    return (
        read.withColumn("reason", reason)
        .select(*fields, F.when(~good, F.col("line")).alias("line"), "reason")
        .withColumn("nova_group", _group_text(F.col("nova_group")))
    )


def accepted(lines: DataFrame) -> DataFrame:
    """The products among the rows of ``read_catalog_lines``."""
    return lines.filter(F.col("reason").isNull()).select(*PRODUCT_SCHEMA.fieldNames())


def rejected(lines: DataFrame) -> DataFrame:
    """(line, reason) of the others."""
    return lines.filter(F.col("reason").isNotNull()).select("line", "reason")


def latest_versions(catalog: DataFrame, version: str = "last_modified_t") -> DataFrame:
    """One row per barcode of a catalog that holds several versions of products: the newest.

    Versions are compared by the column ``version``, nulls being oldest; of equal ones the row
    whose content has the greatest hash stays, the same in every run. Rows without a barcode
    are left out, as nothing can ask for them. Tasks keep one row per barcode before they
    shuffle, so a product with very many versions is no burden to the task it ends up in.
    """
    content = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in catalog.columns))))
    newest = F.max_by(F.struct(*(F.col(f"`{c}`") for c in catalog.columns)), F.struct(F.col(version), content))
    known = catalog.filter(F.col("barcode").isNotNull())
    return known.groupBy(F.col("barcode").alias("_barcode")).agg(newest.alias("_newest")).select("_newest.*")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Products from saved catalog responses, JSON lines ``{code, status, product}``.

    Responses that say the product does not exist are left out.
    """
    envelope = T.StructType(
        [
            T.StructField("code", T.StringType()),
            T.StructField("status", T.IntegerType()),
            T.StructField("status_verbose", T.StringType()),
            T.StructField("product", _JSON_PRODUCT),
        ]
    )
    missing = (F.col("status") == 0) | (F.col("status_verbose") == "product not found")
    found = spark.read.schema(envelope).json(path).filter(~F.coalesce(missing, F.lit(False)))
    fields = [f"product.{name}" for name in PRODUCT_SCHEMA.fieldNames() if name != "barcode"]
    return found.select(F.coalesce("code", "product.barcode").alias("barcode"), *fields).withColumn(
        "nova_group", _group_text(F.col("nova_group"))
    )


def repeated_barcodes(catalog: DataFrame) -> DataFrame:
    """(barcode, count) of barcodes that a catalog holds more than once, which jobs don't expect."""
    return catalog.groupBy("barcode").count().filter(F.col("count") > 1)


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, REQUEST_SCHEMA)


def read_replies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, REPLY_SCHEMA)


def requests_of(catalog: DataFrame) -> DataFrame:
    """A request for every product of a catalog."""
    return catalog.select(
        F.xxhash64("barcode").alias("request_id"), F.col("barcode").alias("barcode_or_url")
    )
