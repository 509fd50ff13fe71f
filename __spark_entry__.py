
from __future__ import annotations

import importlib
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import shelfwise
from checks import derived, oracles
from shelfwise.functions import scoring, scalars, tags, texts, urls
from shelfwise.functions.indicators import positive_indicators, risk_indicators
from shelfwise.operators import alternatives as alternative_op
from shelfwise.operators import candidates as candidate_op
from shelfwise.operators import shelf_index
from shelfwise.operators.requests import requested
from shelfwise.sources import readers
from shelfwise.sources.schema import product_facts
from shelfwise.sources.sinks import shared_folder, write_checked, write_report, write_resolved
from shelfwise.streaming import views as view_jobs

RULES = shelfwise.InsightConfig(fallback_to_rules=True)
REPLIES_ONLY = shelfwise.InsightConfig(fallback_to_rules=False)

Query = Callable[[SparkSession, str], DataFrame]


def listed(items: str | Column, by: str = "; ") -> Column:
    return F.array_join(items, by)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_facts(derived.catalog(spark, sf_dir), RULES)


def _of_facts(columns: Callable[[], list[Column | str]]) -> Query:
    """A projection of the typed product frame. Columns need a session, so they come late."""
    return lambda spark, sf_dir: _facts(spark, sf_dir).select("barcode", *columns())


def _of_catalog(job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(derived.catalog(spark, sf_dir))


def _with_replies(job: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(
        derived.catalog(spark, sf_dir), derived.replies(spark, sf_dir)
    )


def _with_requests(job: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(
        derived.requests(spark, sf_dir), derived.catalog(spark, sf_dir)
    )


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(derived.catalog(spark, sf_dir))


def catalog_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of JSON lines, with processing groups as numbers and as texts."""
    path = _fresh(spark, "catalog")
    derived.catalog_json(spark, sf_dir).write.text(path)
    return _scanned(shelfwise.read_catalog(spark, path, "json"))


def catalog_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with spoilt ones among them: products and rejects, from one scan and one job."""
    path, checked = _fresh(spark, "lines"), _fresh(spark, "checked")
    derived.catalog_lines(spark, sf_dir).write.text(path)
    write_checked(readers.read_catalog_lines(spark, path), checked)
    return spark.read.parquet(checked).select("barcode", "product_name", "line", "reason")


def nutriments_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as JSON has them: the text "0" is an amount, the number 0 gives way to the plain entry."""
    path = _fresh(spark, "amounts")
    derived.amount_lines(spark, sf_dir).write.text(path)
    return product_facts(shelfwise.read_catalog(spark, path, "json"), RULES).select("barcode", "fat")


def catalog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelfwise.latest_versions(derived.catalog_versions(spark, sf_dir))


def requests_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both sinks hold: requests with and without a product, written by one job."""
    path = _fresh(spark, "resolved")
    write_resolved(shelfwise.resolved(derived.requests(spark, sf_dir), derived.catalog(spark, sf_dir)), path)
    return spark.read.parquet(path).select(
        "request_id", "barcode", "product_name", "nutriscore_grade", "outcome", "error"
    )


def requests_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "requests")
    quoted = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    derived.requests(spark, sf_dir).write.options(**quoted).csv(path)
    return requested(shelfwise.read_requests(spark, path, "csv"))


def replies_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "replies")
    derived.replies(spark, sf_dir).write.json(path)
    return shelfwise.read_replies(spark, path, "json")


def report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "report")
    write_report(_full_report(spark, sf_dir), path)
    return _flat_report(spark.read.parquet(path))


def _scanned(catalog: DataFrame) -> DataFrame:
    amounts = [
        F.try_element_at("nutriments", F.lit(key)).cast("double").alias(name)
        for key, name in derived.NUTRIMENT_COLUMNS.items()
    ]
    joined = [
        listed(f"{name}_tags", "|").alias(name)
        for name in ("categories", "labels", "additives", "allergens")
    ]
    return catalog.select(
        "barcode", "product_name", "nutriscore_grade", "nova_group", *amounts, *joined,
        "image_url", "url", "unique_scans_n",
    )


def safe_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.sql(oracles.CONVERSIONS, part=derived.table(spark, sf_dir, "part"))
    return values.select(
        "p_partkey",
        scalars.to_double(F.col("v"), -1.0).alias("as_double"),
        scalars.to_int(F.col("v"), -1).alias("as_int"),
    )


def page_url_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    viewed = derived.views(derived.table(spark, sf_dir, "events"))
    pages = derived.table(spark, sf_dir, "pages")
    all_urls = viewed.select(F.lit("view").alias("kind"), F.col("event_id").alias("id"), "url").union(
        pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    )
    return all_urls.select(
        "kind",
        "id",
        urls.page_barcode(F.col("url")).alias("by_path"),
        urls.page_barcode(F.col("url"), "prefix", "food.example").alias("by_prefix"),
    )


def category_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_op.category_top(_facts(spark, sf_dir), RULES).select(
        "slug", "position", "barcode", F.col("candidate.name").alias("name"), "unique_scans_n"
    )


def category_top50_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of the index of an earlier catalog, with two updates merged into it."""
    path, facts = _fresh(spark, "index"), _facts(spark, sf_dir)
    shelf_index.build_index(spark, path, product_facts(derived.earlier_catalog(spark, sf_dir), RULES), RULES)
    for changed, deleted in derived.catalog_changes(spark, sf_dir):
        shelf_index.update_index(spark, path, facts, product_facts(changed, RULES), deleted, RULES)
    return shelf_index.indexed_top(spark, path, RULES).select(
        "slug", "position", "barcode", F.col("candidate.name").alias("name"), "unique_scans_n"
    )


def candidates_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_rows(_facts(spark, sf_dir))


def candidates_many_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a catalog with a path of its own for every product."""
    return _candidate_rows(product_facts(derived.many_paths_catalog(spark, sf_dir), RULES))


def _candidate_rows(facts: DataFrame) -> DataFrame:
    shelves = candidate_op.category_shelves(candidate_op.category_top(facts, RULES))
    rows = candidate_op.path_candidates(candidate_op.category_paths(facts), shelves)
    return rows.select(
        listed("category_path", ">").alias("path"),
        "level",
        "position",
        "candidate.name",
        "candidate.url",
    )


def alternative_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    rows = alternative_op.scored_candidates(facts, candidate_op.candidate_pools(facts, facts, RULES))
    return rows.select(
        "barcode", "name", "url", "nutriscore_grade", "is_better",
        F.round("score", 9).alias("score"), "confidence", "reason",
    )


def _alternative_rows(
    spark: SparkSession, sf_dir: str, catalog: DataFrame | None = None
) -> DataFrame:
    catalog = derived.catalog(spark, sf_dir) if catalog is None else catalog
    best = shelfwise.alternatives(catalog, config=RULES, staging=shelfwise.Staging(spark))
    return best.select("barcode", F.posexplode("similar_products").alias("at", "a")).select(
        "barcode", (F.col("at") + 1).alias("place"), "a.*"
    )


def _top_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "barcode", "place", "name", "nutriscore_grade", F.round("score", 9).alias("score"),
        "confidence", "url",
    )


def alternatives_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_rows(_alternative_rows(spark, sf_dir))


def alternatives_many_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = derived.many_paths_catalog(spark, sf_dir)
    return _top_rows(_alternative_rows(spark, sf_dir, catalog))


def alternatives_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alternative_rows(spark, sf_dir)
    return rows.filter(F.col("reason").startswith("Category discovery option")).select(
        "barcode", "place", "name", F.round("score", 9).alias("score"), "reason"
    )


def _flat_report(report: DataFrame) -> DataFrame:
    similar = F.transform(
        "similar_products",
        lambda a: F.concat_ws(
            "|", a["name"], a["nutriscore_grade"], a["reason"],
            F.round(a["score"] * 1e6).cast("bigint").cast("string"),
            a["confidence"].cast("string"), a["url"],
        ),
    )
    return report.select(
        "barcode", "product.name", "product.image_url", "product.nutriscore", "product.nova",
        "summary",
        listed("risk_indicators").alias("risk_indicators"),
        listed("positive_indicators").alias("positive_indicators"),
        F.col("score_explanation.nutriscore").alias("explain_nutriscore"),
        F.col("score_explanation.nova").alias("explain_nova"),
        "score_explanation.nutrient_density",
        listed(similar, " / ").alias("similar_products"),
        listed("pairings", ", ").alias("pairings"),
    )


def _full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelfwise.report(
        derived.catalog(spark, sf_dir),
        replies=derived.replies(spark, sf_dir),
        config=RULES,
        staging=shelfwise.Staging(spark),
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_report(_full_report(spark, sf_dir))


def report_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_report(
        shelfwise.report(
            derived.catalog(spark, sf_dir),
            requests=derived.requests(spark, sf_dir),
            config=RULES,
            staging=shelfwise.Staging(spark),
        )
    )


def text_precedence(catalog: DataFrame, replies: DataFrame) -> DataFrame:
    subjects = shelfwise.plans.jobs.subjects_of(catalog, replies, REPLIES_ONLY)
    full = shelfwise.plans.jobs.with_explanations(
        shelfwise.plans.jobs.with_summary(subjects, REPLIES_ONLY), REPLIES_ONLY
    )
    return full.select(
        "barcode", "summary", "score_explanation.nutriscore", "score_explanation.nova"
    )


def latest_viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_jobs.latest_viewed(derived.views(derived.table(spark, sf_dir, "events")))


def latest_viewed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from file streams: two queries with checkpoints of their own keep one table.

    Each reads the events of one half of the viewers, then stops.
    """
    schema = derived.table(spark, sf_dir, "events").schema
    run = _fresh(spark, "latest-viewed")
    for half in (0, 1):
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
        query = shelfwise.start_latest_viewed(
            derived.views(stream.filter(F.col("user_id") % 2 == half)),
            f"{run}/table",
            f"{run}/checkpoint-{half}",
            availableNow=True,
        )
        query.awaitTermination()
    return shelfwise.read_latest_viewed(spark, f"{run}/table")


def _hashed_replies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prompts = shelfwise.prompts(derived.catalog(spark, sf_dir))
    return prompts, spark.sql(derived.HASHED_REPLIES_SQL, prompts=prompts)


def replies_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to the prompts products have now, out of a table with stale ones."""
    return shelfwise.current_replies(*_hashed_replies(spark, sf_dir))


def prompts_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelfwise.unanswered(*_hashed_replies(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the healthier alternatives of every product."""
    return alternatives_topn(spark, "/root/testdata/sf0.001")


def _slug_columns() -> list[Column | str]:
    category_tags = F.col("categories_tags")
    return [
        tags.first_slug(category_tags).alias("first_slug"),
        tags.last_slug(category_tags).alias("last_slug"),
        listed("category_path", ">").alias("path"),
        tags.is_candy_like(category_tags).alias("is_candy"),
    ]


def _nutrient_columns() -> list[Column | str]:
    nutrients = ["fat", "sugars", "salt", "saturated_fat", "proteins", "fiber", "energy_kcal"]
    return [*nutrients, scoring.known_metrics().alias("known_metrics")]


def _indicator_columns(indicators: Callable[[], Column]) -> list[Column | str]:
    return [F.size(indicators()).alias("n"), listed(indicators()).alias("indicators")]


def library_queries() -> dict[str, Query]:
    """The queries of the library itself."""
    return {
        "catalog_scan": catalog_scan,
        "catalog_read": catalog_read,
        "catalog_rejects": catalog_rejects,
        "catalog_latest": catalog_latest,
        "nutriments_typed": nutriments_typed,
        "requests_read": requests_read,
        "replies_read": replies_read,
        "safe_conversions": safe_conversions,
        "nutrient_extract": _of_facts(_nutrient_columns),
        "grade_normalise": _of_facts(lambda: ["nutriscore_grade", "grade", "grade_rank", "nova"]),
        "category_slugs": _of_facts(_slug_columns),
        "allergen_names": _of_facts(
            lambda: [listed(tags.allergen_names(F.col("allergens_tags")), ", ").alias("names")]
        ),
        "additive_names": _of_facts(
            lambda: [listed(tags.additive_names(F.col("additives_tags")), ", ").alias("names")]
        ),
        "risk_indicators": _of_facts(lambda: _indicator_columns(risk_indicators)),
        "positive_indicators": _of_facts(lambda: _indicator_columns(positive_indicators)),
        "explain_nutriscore": _of_facts(
            lambda: [texts.nutriscore_explanation().alias("nutriscore")]
        ),
        "explain_nova": _of_facts(lambda: [texts.nova_explanation().alias("nova")]),
        "nutrient_density": _of_facts(
            lambda: [texts.nutrient_density().alias("nutrient_density")]
        ),
        "summary_text": _of_catalog(lambda c: shelfwise.summarise(c, config=RULES)),
        "text_precedence": _with_replies(text_precedence),
        "barcode_from_url": lambda spark, sf_dir: requested(derived.requests(spark, sf_dir)),
        "page_url_barcode": page_url_barcode,
        "resolve_requests": _with_requests(
            lambda r, c: shelfwise.resolve_requests(r, c).select(
                "request_id", "barcode", "product_name", "nutriscore_grade"
            )
        ),
        "requests_not_found": _with_requests(shelfwise.requests_not_found),
        "requests_resolved": requests_resolved,
        "category_top50": category_top50,
        "category_top50_maintained": category_top50_maintained,
        "candidates_dedup": candidates_dedup,
        "candidates_many_paths": candidates_many_paths,
        "alternative_scores": alternative_scores,
        "alternatives_topn": alternatives_topn,
        "alternatives_many_paths": alternatives_many_paths,
        "alternatives_discovery": alternatives_discovery,
        "alternative_reasons": lambda spark, sf_dir: _alternative_rows(spark, sf_dir).select(
            "barcode", "place", "reason"
        ),
        "pairings_rules": _of_catalog(
            lambda c: shelfwise.pair(c, config=RULES).select(
                "barcode", listed("pairings", ", ").alias("pairings")
            )
        ),
        "pairings_reply": _with_replies(
            lambda c, r: shelfwise.pair(c, r, REPLIES_ONLY).select(
                "barcode", listed("pairings", ", ").alias("pairings")
            )
        ),
        "insight_reply_merge": _with_replies(
            lambda c, r: shelfwise.analyse(c, r, RULES).select(
                "barcode",
                listed("risk_indicators").alias("risk_indicators"),
                listed("positive_indicators").alias("positive_indicators"),
            )
        ),
        "pairings_rules_table": lambda spark, sf_dir: shelfwise.pair(
            derived.catalog(spark, sf_dir), config=RULES, rules=shelfwise.fixed_rules(spark)
        ).select("barcode", listed("pairings", ", ").alias("pairings")),
        "prompts": _of_catalog(shelfwise.prompts),
        "replies_current": replies_current,
        "prompts_unanswered": prompts_unanswered,
        "report": report,
        "report_requested": report_requested,
        "report_written": report_written,
        "latest_viewed": latest_viewed,
        "latest_viewed_stream": latest_viewed_stream,
    }


def _training_data():
    """The module of the training-data queries, or None where that subpackage is not installed."""
    try:
        return importlib.import_module("shelfwise.llm.queries")
    except ModuleNotFoundError as error:
        if (error.name or "").startswith("shelfwise.llm"):
            return None
        raise


def queries() -> dict[str, Query]:
    more = _training_data()
    return {**library_queries(), **(more.queries() if more else {})}


def oracle_sql() -> dict[str, str]:
    more = _training_data()
    return {**oracles.oracle_sql(), **(more.oracle_sql() if more else {})}
