"""Requests, by barcode or product address, against the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed_values import BARCODE_NOT_FOUND, NO_BARCODE_IN_URL
from shelfwise.functions.urls import requested_barcode


def requested(requests: DataFrame) -> DataFrame:
    """Requests with the barcode they ask for; null if an address holds none."""
    return requests.withColumn("barcode", requested_barcode(F.col("barcode_or_url")))


def found(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each request with its product. Barcodes are unique in the catalog."""
    return requested(requests).join(catalog, "barcode")


def not_found(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests without a product, and why.

    Requests without a barcode are split off first: as null keys they would all
    meet in one partition of the join.
    """
    asked = requested(requests)
    unreadable = asked.filter(F.col("barcode").isNull()).withColumn(
        "error", F.concat(F.lit(NO_BARCODE_IN_URL), F.coalesce("barcode_or_url", F.lit("")))
    )
    unknown = (
        asked.filter(F.col("barcode").isNotNull())
        .join(catalog.select("barcode"), "barcode", "left_anti")
        .withColumn("error", F.concat(F.lit(BARCODE_NOT_FOUND), F.col("barcode")))
    )
    return unreadable.unionByName(unknown)


#: Requests without a barcode are spread over this many join keys of their own.
_SPREAD = 4096

FOUND, UNKNOWN, UNREADABLE = "found", "unknown", "unreadable"


def resolved(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every request with its product, or with why it has none, from one join.

    Adds ``barcode``, the columns of the catalog, ``outcome`` (found, unknown or unreadable)
    and ``error``. Barcodes are unique in the catalog. A product that very many requests ask
    for is split by adaptive execution, as its side of the join is one row.
    """
    asked = requested(requests)
    bare = F.concat(F.lit(" "), F.pmod(F.xxhash64(*requests.columns), F.lit(_SPREAD)).cast("string"))
    keyed = asked.withColumn("_key", F.coalesce("barcode", bare))
    others = [c for c in catalog.columns if c != "barcode"]
    products = catalog.filter(F.col("barcode").isNotNull()).select(
        F.col("barcode").alias("_key"), F.lit(True).alias("_there"), *others
    )
    joined = keyed.join(products, "_key", "left").drop("_key")
    outcome = (
        F.when(F.col("_there"), FOUND).when(F.col("barcode").isNotNull(), UNKNOWN).otherwise(UNREADABLE)
    )
    error = F.when(outcome == UNKNOWN, F.concat(F.lit(BARCODE_NOT_FOUND), F.col("barcode"))).when(
        outcome == UNREADABLE, F.concat(F.lit(NO_BARCODE_IN_URL), F.coalesce("barcode_or_url", F.lit("")))
    )
    return joined.withColumns({"outcome": outcome, "error": error}).drop("_there")


def requested_products(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """The requested products, each once however often it is asked for."""
    wanted = requested(requests).select("barcode").filter(F.col("barcode").isNotNull()).distinct()
    return catalog.join(wanted, "barcode", "left_semi")
