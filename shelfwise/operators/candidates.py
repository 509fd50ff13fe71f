"""Candidates of categories, and of the category paths products have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.config import DEFAULT_CONFIG, InsightConfig
from shelfwise.functions import tags as tag_fn
from shelfwise.functions.scoring import candidate_struct
from shelfwise.operators.topk import top_k_per_group
from shelfwise.sources.sinks import Staging


def category_members(facts: DataFrame) -> DataFrame:
    """One row per product and category slug it carries."""
    slugs = F.array_distinct(tag_fn.slugs(F.col("categories_tags")))
    return facts.select("*", F.explode(slugs).alias("slug"))


def category_top(
    facts: DataFrame, config: InsightConfig = DEFAULT_CONFIG, slugs: DataFrame | None = None
) -> DataFrame:
    """The most scanned products of every category: (slug, position, barcode, candidate).

    ``slugs`` (one column ``slug``) limits it to categories someone asks for, before
    anything is ranked. What is shown of a candidate is put together for the chosen
    ones only.
    """
    members = category_members(facts)
    if slugs is not None:
        members = members.join(slugs, "slug", "left_semi")
    top = top_k_per_group(
        members,
        ["slug"],
        [F.desc_nulls_last("unique_scans_n"), F.asc("barcode")],
        config.page_size,
        config.shards,
        "position",
    )
    return top.select(
        "slug", "position", "barcode", "unique_scans_n", candidate_struct().alias("candidate")
    )


def _first_of_key(shelf: Column) -> Column:
    """The candidates without those that repeat an earlier one's name and address."""
    keys = F.array(F.transform(shelf, lambda c: c["key"]))
    first = F.transform(keys, lambda k: F.filter(shelf, lambda c, i: F.array_position(k, c["key"]) == i + 1))
    return F.get(first, F.lit(0))


def category_shelves(top: DataFrame) -> DataFrame:
    """One row per category with its candidates in search order.

    A shelf holds at most ``page_size`` candidates, unnamed ones and repeats left out.
    The grouping reuses the partitioning by slug that ranking them needed.
    """
    return (
        top.filter(F.col("candidate.name") != "")
        .groupBy("slug")
        .agg(F.sort_array(F.collect_list("candidate")).alias("shelf"))
        .withColumn("shelf", _first_of_key(F.col("shelf")))
    )


def category_paths(facts: DataFrame) -> DataFrame:
    """The distinct category paths of products that have one."""
    return facts.filter(F.size("category_path") > 0).select("category_path").distinct()


def path_slugs(paths: DataFrame) -> DataFrame:
    """The distinct slugs of the paths."""
    return paths.select(F.explode("category_path").alias("slug")).distinct()


def without_earlier(shelf: Column, earlier: list[Column]) -> Column:
    """A shelf without the candidates that stand on one of the earlier shelves, by key."""
    if not earlier:
        return shelf
    keys = F.concat(*(F.transform(e, lambda c: c["key"]) for e in earlier))
    # bound to a name, so that the keys are put together once and not for every candidate
    rest = F.transform(F.array(keys), lambda k: F.filter(shelf, lambda c: ~F.array_contains(k, c["key"])))
    return F.get(rest, F.lit(0))


def path_shelves(
    paths: DataFrame, shelves: DataFrame, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """(category_path, kept): for every level of a path the candidates it adds.

    What a product may be compared with depends only on its path, so for paths of many
    products this is done per path, not per product. A path brings its shelves together
    as whole arrays, at most ``category_depth`` of them, and repeats of earlier levels are
    dropped in the row, by key; no candidate becomes a row of its own.
    """
    # A broad slug may be part of very many paths. A key built for this join gives
    # it an exchange on both sides, which adaptive execution needs to split it.
    slug_key = F.array("slug").alias("_slug_key")
    found = (
        paths.select("category_path", F.posexplode("category_path").alias("level", "slug"))
        .select("category_path", "level", slug_key)
        .join(shelves.select(slug_key, "shelf"), "_slug_key")
        .groupBy("category_path")
        .agg(F.collect_list(F.struct("level", "shelf")).alias("found"))
    )
    kept: list[str] = []
    for level in range(config.category_depth):
        here = F.filter("found", lambda entry: entry["level"] == level)  # noqa: B023
        shelf = F.get(F.transform(here, lambda entry: entry["shelf"]), F.lit(0))
        shelf = without_earlier(shelf, [F.col(name) for name in kept])
        name = f"_kept_{level}"
        found = found.withColumn(
            name, F.coalesce(shelf, F.array().cast(shelves.schema["shelf"].dataType))
        )
        kept.append(name)
    return found.select("category_path", F.array(*kept).alias("kept"))


def key_digests(shelf: Column) -> Column:
    """The keys of a shelf's candidates as 16 bytes each, in shelf order."""
    return F.transform(shelf, lambda c: F.unhex(F.md5(c["key"])))


def parts_of(count: Column, config: InsightConfig = DEFAULT_CONFIG) -> Column:
    """In how many parts a key of ``count`` rows is dealt out."""
    return F.ceil(count / config.path_rows).cast("int")


def dealt_shelves(shelves: DataFrame, hot: DataFrame) -> DataFrame:
    """Shelves by ``_slug_key``: the slug, and each of the parts that ``hot`` (slug, parts) deals it out in."""
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    dealt = shelves.join(F.broadcast(hot), "slug", "left").select("slug", "shelf", F.explode(parts).alias("part"))
    key = F.array("slug", F.col("part").cast("string"))
    return dealt.select(key.alias("_slug_key"), "shelf", key_digests(F.col("shelf")).alias("digests"))


def path_candidates(
    paths: DataFrame, shelves: DataFrame, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Candidates of each path as rows: (category_path, level, position, candidate).

    Paths may be as many as products, so no path carries its candidates: what its levels
    repeat is told by digests of their keys, and the candidates are unfolded where a level
    meets its shelf, after the last shuffle. Slugs of very many paths are dealt out.
    """
    levels = paths.select("category_path", F.posexplode("category_path").alias("level", "slug")).filter(
        F.col("level") < config.category_depth
    )
    counts = levels.groupBy("slug").count().filter(F.col("count") > config.path_rows)
    hot = counts.select("slug", parts_of(F.col("count"), config).alias("parts"))
    part = F.pmod(F.xxhash64("category_path"), F.coalesce("parts", F.lit(1))).cast("string")
    keyed = levels.join(F.broadcast(hot), "slug", "left").select(
        "category_path", "level", F.array("slug", part).alias("_slug_key")
    )
    shelves = dealt_shelves(shelves, hot)
    found = (
        keyed.join(shelves.select("_slug_key", "digests"), "_slug_key")
        .groupBy("category_path")
        .agg(F.sort_array(F.collect_list(F.struct("level", "_slug_key", "digests"))).alias("found"))
    )

    def unrepeated(entry: Column, i: Column) -> Column:
        before = F.flatten(F.transform(F.slice("found", F.lit(1), i), lambda e: e["digests"]))
        repeats = F.transform(
            F.array(before),
            lambda keys: F.filter(
                F.transform(entry["digests"], lambda k, j: F.when(F.array_contains(keys, k), j)),
                lambda j: j.isNotNull(),
            ),
        )
        return F.struct(
            entry["level"].alias("level"), entry["_slug_key"].alias("_slug_key"), F.get(repeats, F.lit(0)).alias("repeats")
        )

    rows = found.select("category_path", F.inline(F.transform("found", unrepeated)))
    kept = F.filter("shelf", lambda c, i: ~F.array_contains("repeats", i))
    return (
        rows.join(shelves.select("_slug_key", "shelf"), "_slug_key")
        .select("category_path", "level", F.explode(kept).alias("candidate"))
        .select("category_path", "level", "candidate.position", "candidate")
    )


def _counted_paths(subjects: DataFrame, config: InsightConfig) -> DataFrame:
    """(category_path, shared): whether at least ``pool_products`` products have the path."""
    counts = subjects.filter(F.size("category_path") > 0).groupBy("category_path").count()
    several = F.size("category_path") > 1
    return counts.select(
        "category_path", (several & (F.col("count") >= config.pool_products)).alias("shared")
    )


def candidate_pools(
    facts: DataFrame,
    subjects: DataFrame,
    config: InsightConfig = DEFAULT_CONFIG,
    staging: Staging | None = None,
    top: DataFrame | None = None,
) -> DataFrame:
    """(category_path, pool): the ordered candidates that products of ``subjects`` look up.

    ``facts`` is the catalog searched, ``subjects`` the products to advise on; both
    are typed product frames. Only categories on some path of the subjects are ranked.

    A path that many products share has a row of its own. All other paths refer to their
    categories: these are rows too, under the path of that category alone, however many
    paths they are on. So the table holds each list of candidates once, and grows with
    the categories and the shared paths, not with the paths. With ``staging`` shelves and
    counted paths, which both kinds of rows need, are stored and computed once. ``top`` is a
    result of ``category_top`` or of a maintained index, if there is one.
    """
    check_page_size(facts.sparkSession, config)
    paths = _counted_paths(subjects, config)
    if staging is not None:
        paths = staging.table(paths, "paths")
    if top is None:
        top = category_top(facts, config, path_slugs(paths))
    shelves = category_shelves(top)
    if staging is not None:
        shelves = staging.table(shelves, "shelves")
    shared = path_shelves(paths.filter("shared"), shelves, config)
    referred = path_slugs(paths.filter(~F.col("shared")))
    alone = shelves.join(referred, "slug", "left_semi")
    return shared.select("category_path", F.flatten("kept").alias("pool")).union(
        alone.select(F.array("slug").alias("category_path"), F.col("shelf").alias("pool"))
    )


def check_page_size(spark: SparkSession, config: InsightConfig) -> None:
    """Fail early where Spark would not cut groups before the shuffle."""
    setting = "spark.sql.optimizer.windowGroupLimitThreshold"
    limit = int(spark.conf.get(setting))
    if config.page_size > limit:
        raise ValueError(
            f"page_size {config.page_size} exceeds {setting} ({limit}): raise that setting,"
            " or whole categories would be shuffled"
        )
