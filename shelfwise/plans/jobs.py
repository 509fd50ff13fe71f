"""The jobs: each takes catalog-shaped frames and returns a frame.

No job runs anything on its own or brings rows to the driver. All but the
comparison with alternatives are narrow projections over the catalog scan;
replies and requests add a join on the barcode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.config import DEFAULT_CONFIG, InsightConfig
from shelfwise.functions import indicators, prompts as prompt_fn, texts
from shelfwise.functions.pairings import pairings as choose_pairings
from shelfwise.functions.scalars import text_or
from shelfwise.operators import alternatives as alternative_op
from shelfwise.operators import replies as reply_op
from shelfwise.operators import requests as request_op
from shelfwise.operators.candidates import candidate_pools
from shelfwise.operators.rule_tables import table_pairings
from shelfwise.operators.spread import held_parts, spread
from shelfwise.sources.schema import product_facts
from shelfwise.sources.sinks import Staging

resolve_requests = request_op.found
requests_not_found = request_op.not_found
requested_products = request_op.requested_products
resolved = request_op.resolved


def _no_replies(subjects: DataFrame) -> DataFrame:
    """The reply columns, as if nothing had been asked."""
    types = {
        "reply_summary": "string",
        "reply_nutriscore": "string",
        "reply_nova": "string",
        "reply_risks": "array<string>",
        "reply_positives": "array<string>",
        "reply_pairings": "array<string>",
        "asked_pairings": "boolean",
    }
    return subjects.withColumns({n: F.lit(None).cast(t) for n, t in types.items()})


def subjects_of(
    catalog: DataFrame, replies: DataFrame | None, config: InsightConfig
) -> DataFrame:
    """Typed products with their replies."""
    facts = product_facts(catalog, config)
    return _no_replies(facts) if replies is None else reply_op.with_replies(facts, replies)


def with_indicators(subjects: DataFrame, replies: bool) -> DataFrame:
    """Add rule indicators, extended by accepted reply items if there are replies."""
    rules = subjects.withColumns(
        {
            "risk_indicators": indicators.risk_indicators(),
            "positive_indicators": indicators.positive_indicators(),
        }
    )
    return reply_op.with_reply_insights(rules) if replies else rules


def with_explanations(subjects: DataFrame, config: InsightConfig) -> DataFrame:
    """Add the struct of score texts.

    Replies about a grade or group count only where the product has a valid one.
    """
    valid_grade = texts.grade_description().isNotNull()
    valid_nova = texts.nova_description().isNotNull()
    return subjects.withColumn(
        "score_explanation",
        F.struct(
            texts.reply_or_rule(
                F.when(valid_grade, F.col("reply_nutriscore")),
                texts.nutriscore_explanation(),
                fixed.NUTRISCORE_UNAVAILABLE,
                config.fallback_to_rules,
            ).alias("nutriscore"),
            texts.reply_or_rule(
                F.when(valid_nova, F.col("reply_nova")),
                texts.nova_explanation(),
                fixed.NOVA_UNAVAILABLE,
                config.fallback_to_rules,
            ).alias("nova"),
            texts.nutrient_density().alias("nutrient_density"),
        ),
    )


def with_summary(subjects: DataFrame, config: InsightConfig) -> DataFrame:
    return subjects.withColumn(
        "summary",
        texts.reply_or_rule(
            F.col("reply_summary"),
            texts.product_summary(),
            fixed.SUMMARY_UNAVAILABLE,
            config.fallback_to_rules,
        ),
    )


def with_pairings(
    subjects: DataFrame, config: InsightConfig, replies: bool, rules: DataFrame | None = None
) -> DataFrame:
    """Add pairings: from replies if there are any, else from the rules."""
    if replies:
        subjects = subjects.withColumn("reply_pairings", reply_op.reply_pairings())
    from_table = None
    if rules is not None:
        subjects = subjects.join(table_pairings(subjects, rules), "barcode", "left")
        from_table = F.col("rule_items")
    chosen = choose_pairings(F.col("reply_pairings"), config.fallback_to_rules, from_table)
    return subjects.withColumn("pairings", chosen).drop("rule_items")


def analyse(
    catalog: DataFrame, replies: DataFrame | None = None, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Risk and positive indicators: (barcode, risk_indicators, positive_indicators)."""
    subjects = subjects_of(catalog, replies, config)
    return with_indicators(subjects, replies is not None).select(
        "barcode", "risk_indicators", "positive_indicators"
    )


def explain(
    catalog: DataFrame, replies: DataFrame | None = None, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Score explanations: (barcode, nutriscore, nova, nutrient_density)."""
    return with_explanations(subjects_of(catalog, replies, config), config).select(
        "barcode", "score_explanation.*"
    )


def summarise(
    catalog: DataFrame, replies: DataFrame | None = None, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Product summaries: (barcode, summary)."""
    return with_summary(subjects_of(catalog, replies, config), config).select("barcode", "summary")


def pair(
    catalog: DataFrame,
    replies: DataFrame | None = None,
    config: InsightConfig = DEFAULT_CONFIG,
    rules: DataFrame | None = None,
) -> DataFrame:
    """Food pairings: (barcode, pairings).

    ``rules`` is a table (key, position, items) of any size, in place of the built-in rules.
    """
    subjects = subjects_of(catalog, replies, config)
    return with_pairings(subjects, config, replies is not None, rules).select("barcode", "pairings")


def alternatives(
    catalog: DataFrame,
    subjects: DataFrame | None = None,
    pools: DataFrame | None = None,
    config: InsightConfig = DEFAULT_CONFIG,
    staging: Staging | None = None,
) -> DataFrame:
    """Healthier alternatives: (barcode, similar_products), best first.

    ``subjects`` are the products to advise on, the whole catalog by default.
    ``pools`` is a stored result of ``pools``, to search the catalog only once
    for many runs. With ``staging`` the candidate lists are computed and stored at
    once: Catalyst then knows their size, and broadcasts them if they are small
    instead of shuffling the products.
    """
    facts = product_facts(catalog, config)
    asked = facts if subjects is None else product_facts(subjects, config)
    if pools is None:
        pools = _staged(candidate_pools(facts, asked, config, staging), staging)
    return alternative_op.with_alternatives(asked, pools, config).select(
        "barcode", "similar_products"
    )


def _staged(frame: DataFrame, staging: Staging | None) -> DataFrame:
    return frame if staging is None else staging.table(frame, "pools")


def pools(
    catalog: DataFrame,
    subjects: DataFrame | None = None,
    config: InsightConfig = DEFAULT_CONFIG,
    top: DataFrame | None = None,
    staging: Staging | None = None,
) -> DataFrame:
    """Candidates per shared category path and per category, for storing and passing to other jobs.

    ``top`` is what ``indexed_top`` gives, to take the categories from a maintained index
    in place of ranking the catalog.
    """
    facts = product_facts(catalog, config)
    asked = facts if subjects is None else product_facts(subjects, config)
    return candidate_pools(facts, asked, config, staging, top)


def prompts(
    catalog: DataFrame,
    tasks: list[str] | None = None,
    config: InsightConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Prompts to send to a model: (barcode, task, prompt), from one catalog scan.

    Products are dealt out first: prompts are many times as long, and a task that sums them
    up for a whole input split would hold them all. A table held in as many parts stays as it is.
    """
    parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = catalog if held_parts(catalog) >= parts else spread(catalog, "barcode", "product_name", "url")
    rules = product_facts(dealt, config).withColumns(
        {"risks": indicators.risk_indicators(), "positives": indicators.positive_indicators()}
        | prompt_fn.printed_amounts()
    )
    texts_by_task = {
        "pairings": prompt_fn.pairings_prompt(),
        "summary": prompt_fn.summary_prompt(),
        "nutriscore": prompt_fn.nutriscore_prompt(),
        "nova": prompt_fn.nova_prompt(),
        "insights": prompt_fn.insights_prompt(F.col("risks"), F.col("positives")),
    }
    rows = F.array(
        *[
            F.struct(F.lit(task).alias("task"), texts_by_task[task].alias("prompt"))
            for task in (tasks or prompt_fn.TASKS)
        ]
    )
    return rules.select("barcode", F.inline(rows)).filter(F.col("prompt").isNotNull())


def report(
    catalog: DataFrame,
    requests: DataFrame | None = None,
    replies: DataFrame | None = None,
    pools: DataFrame | None = None,
    config: InsightConfig = DEFAULT_CONFIG,
    staging: Staging | None = None,
) -> DataFrame:
    """The full report, one nested row per product.

    Covers the whole catalog, or the products asked for in ``requests``. All
    parts are computed in the product's row, so nothing is joined back. ``staging``
    is that of ``alternatives``.
    """
    asked = catalog if requests is None else request_op.requested_products(requests, catalog)
    subjects = subjects_of(asked, replies, config)
    if pools is None:
        facts, wanted = product_facts(catalog, config), product_facts(asked, config)
        pools = _staged(candidate_pools(facts, wanted, config, staging), staging)
    full = alternative_op.with_alternatives(subjects, pools, config)
    full = with_indicators(full, replies is not None)
    full = with_explanations(with_summary(full, config), config)
    full = with_pairings(full, config, replies is not None)
    header = F.struct(
        text_or(F.col("product_name"), "Unknown product").alias("name"),
        F.col("image_url"),
        F.col("nutriscore_grade").alias("nutriscore"),
        F.col("nova_group").try_cast("int").alias("nova"),
        F.col("brands"),
    )
    return full.select(
        "barcode",
        header.alias("product"),
        "summary",
        "risk_indicators",
        "positive_indicators",
        "score_explanation",
        "similar_products",
        "pairings",
    )
