"""Run a job from files to files, for ``spark-submit`` or ``python -m shelfwise``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from shelfwise.config import InsightConfig
from shelfwise.plans import jobs
from shelfwise.sources.readers import (
    latest_versions,
    read_catalog,
    read_catalog_lines,
    read_replies,
    read_requests,
    read_responses,
)
from shelfwise.sources.schema import PRODUCT_SCHEMA
from shelfwise.sources.sinks import Staging, write_checked, write_not_found, write_report


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="shelfwise")
    parser.add_argument("job", choices=["report", "alternatives", "prompts", "pools"])
    parser.add_argument("--catalog", required=True)
    parser.add_argument("--out", required=True, help="folder for the result")
    parser.add_argument("--requests", help="products to report on; default: the whole catalog")
    parser.add_argument("--replies", help="model replies to merge in")
    parser.add_argument("--pools", help="stored result of the pools job (parquet)")
    formats = ["parquet", "orc", "json"]
    parser.add_argument("--format", default="parquet", choices=formats, help="of the result")
    parser.add_argument(
        "--catalog-format", choices=[*formats, "responses"], help="default: that of the result"
    )
    parser.add_argument(
        "--checked", help="folder for the products and the rejected lines of a JSON catalog"
    )
    parser.add_argument(
        "--version-column", help="of a catalog with several versions of products: the newest counts"
    )
    parser.add_argument("--requests-format", choices=[*formats, "csv"])
    parser.add_argument("--replies-format", choices=[*formats, "csv"])
    parser.add_argument("--page-size", type=int, default=50, help="candidates per category")
    parser.add_argument("--category-depth", type=int, default=3, help="category levels searched")
    parser.add_argument("--fallback", action="store_true", help="use rules where replies lack")
    parser.add_argument("--max-results", type=int, default=5)
    return parser.parse_args(argv)


def _catalog(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    fmt = options.catalog_format or options.format
    if fmt == "responses":
        catalog = read_responses(spark, options.catalog)
    elif options.checked:
        if fmt != "json":
            raise ValueError("only the lines of a JSON catalog can be checked")
        write_checked(read_catalog_lines(spark, options.catalog), options.checked)
        names = PRODUCT_SCHEMA.fieldNames()
        catalog = spark.read.parquet(options.checked).filter("outcome = 'accepted'").select(*names)
    else:
        catalog = read_catalog(spark, options.catalog, fmt)
    if options.version_column:
        catalog = latest_versions(catalog, options.version_column)
    return catalog


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    config = InsightConfig(
        fallback_to_rules=options.fallback,
        max_results=options.max_results,
        page_size=options.page_size,
        category_depth=options.category_depth,
    )
    fmt = options.format
    catalog = _catalog(spark, options)
    if options.job == "pools":
        write_report(jobs.pools(catalog, config=config), options.out)
        return
    if options.job == "prompts":
        write_report(jobs.prompts(catalog, config=config), options.out, fmt)
        return

    with Staging(spark) as staging:
        asked = catalog
        if options.requests:
            requests = read_requests(spark, options.requests, options.requests_format or fmt)
            missing = jobs.requests_not_found(requests, catalog)
            write_not_found(missing, f"{options.out}/not_found", fmt)
            asked = staging.table(jobs.requested_products(requests, catalog), "requested")
        # A stored table has a known size: Catalyst broadcasts it or not accordingly.
        pools = (
            spark.read.parquet(options.pools)
            if options.pools
            else staging.table(jobs.pools(catalog, asked, config, staging=staging), "pools")
        )
        if options.job == "alternatives":
            result = jobs.alternatives(catalog, asked, pools, config)
        else:
            replies = (
                read_replies(spark, options.replies, options.replies_format or fmt)
                if options.replies
                else None
            )
            result = jobs.report(asked, replies=replies, pools=pools, config=config)
        write_report(result, f"{options.out}/{options.job}", fmt)


if __name__ == "__main__":
    run(SparkSession.builder.appName("shelfwise").getOrCreate(), arguments())
