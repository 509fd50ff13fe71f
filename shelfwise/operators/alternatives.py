"""Healthier alternatives of each product."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import DEFAULT_CONFIG, InsightConfig
from shelfwise.functions import scoring
from shelfwise.operators.candidates import dealt_shelves, parts_of, without_earlier
from shelfwise.operators.spread import spread

# Products without any category are spread over this many join keys of their own.
_SPREAD = 4096


def hot_paths(subjects: DataFrame, config: InsightConfig = DEFAULT_CONFIG) -> DataFrame:
    """(category_path, parts): paths of more than ``path_rows`` products, and in how many parts.

    There are at most as many rows as ``path_rows`` fits into the number of products,
    which is why this table, and no other, is broadcast by hand.
    """
    counts = subjects.filter(F.size("category_path") > 0).groupBy("category_path").count()
    return counts.filter(F.col("count") > config.path_rows).select(
        "category_path", parts_of(F.col("count"), config).alias("parts")
    )


def hot_keys(subjects: DataFrame, config: InsightConfig = DEFAULT_CONFIG) -> DataFrame:
    """(key, parts): the same of whole paths and of single slugs, which are paths of one."""
    slugs = F.transform(F.slice("category_path", 1, config.category_depth), lambda s: F.array(s))
    keys = F.array_distinct(F.concat(F.array("category_path"), slugs))
    counts = subjects.filter(F.size("category_path") > 0).select(F.explode(keys).alias("key")).groupBy("key").count()
    return counts.filter(F.col("count") > config.path_rows).select(
        "key", parts_of(F.col("count"), config).alias("parts")
    )


def _keyed(rows: DataFrame, mark: Column, path: Column, part: Column) -> DataFrame:
    """With the join key: a mark, a path, and the part of a hot path."""
    return rows.withColumn("_path_key", F.concat(F.array(mark), path, F.array(part.cast("string"))))


def _with_own_lists(products: DataFrame, pools: DataFrame) -> DataFrame:
    """Add ``_own``: whether the product's path has a list of its own, or refers to none."""
    several = pools.filter(F.size("category_path") > 1).select("category_path", F.lit(True).alias("_own"))
    own = F.coalesce("_own", F.size("category_path") <= 1)
    return products.join(several, "category_path", "left").withColumn("_own", own)


def _with_shelf(products: DataFrame, shelves: DataFrame, level: int) -> DataFrame:
    """Add the list of one category of products without a list of their own.

    All others have keys that match nothing, spread over many, and no list so far to
    carry along.
    """
    slug = F.get("category_path", F.lit(level))
    spread = F.pmod(F.xxhash64("barcode"), F.lit(_SPREAD)).cast("string")
    refers = ~F.col("_own") & slug.isNotNull()
    key = F.when(refers, F.array(F.lit(""), slug)).otherwise(F.array(spread))
    lists = shelves.select(
        F.concat(F.array(F.lit("")), "category_path").alias("_slug_key"), F.col("pool").alias(f"_shelf_{level}")
    )
    return products.withColumn("_slug_key", key).join(lists, "_slug_key", "left").drop("_slug_key")


def _merged(shelves: list[Column]) -> Column:
    """One list of the shelves, specific to broad, without what an earlier one holds."""
    kept: list[Column] = []
    for shelf in shelves:
        kept.append(without_earlier(shelf, kept))
    return F.concat(*kept)


def with_pool(
    subjects: DataFrame, pools: DataFrame, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Add the candidates of the product's category path; null without a path.

    Products of a path with a list of its own look that up. The others look up the list of
    each of their categories, at most ``category_depth``, and put them together in their row.
    Catalyst broadcasts the lists if they are small and shuffles on the path or category
    otherwise; products are joined with the long lists of shared paths last, so that no
    earlier shuffle carries those.

    The work is in the rows, not in the bytes, so a path of very many products is dealt
    out by their number: its products go to ``parts`` keys, and its list to each of them.
    Products without any path are spread over keys of their own. Broad categories, which
    very many paths refer to, are left to adaptive execution: lists are unique by key, so it
    can split such a key on the products' side.
    """
    hot = F.broadcast(hot_paths(subjects, config))
    hashed = F.xxhash64("barcode")
    bare = F.pmod(hashed, F.lit(_SPREAD)).cast("string")
    products = _with_own_lists(subjects, pools)
    shelves = pools.filter(F.size("category_path") == 1)
    for level in range(config.category_depth):
        products = _with_shelf(products, shelves, level)
    mark = F.when((F.size("category_path") > 0) & F.col("_own"), "").otherwise(bare)
    parts = F.coalesce("parts", F.lit(1))
    products = products.join(hot, "category_path", "left")
    products = _keyed(products, mark, F.col("category_path"), F.pmod(hashed, parts)).drop("parts")
    copies = (
        pools.select("category_path", "pool")
        .join(hot, "category_path", "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    )
    keyed = _keyed(copies, F.lit(""), F.col("category_path"), F.col("_part")).select("_path_key", "pool")
    found = products.join(keyed, "_path_key", "left")
    none = F.array().cast(pools.schema["pool"].dataType)
    levels = [F.coalesce(f"_shelf_{level}", none) for level in range(config.category_depth)]
    pool = F.when(F.col("_own"), F.col("pool")).otherwise(_merged(levels))
    return found.withColumn("pool", pool).select(*subjects.columns, "pool")


def comparable(
    subjects: DataFrame, pools: DataFrame, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Products with their pool and what comparing needs of them."""
    return with_pool(subjects, pools, config).withColumns(scoring.product_side())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _best(pool: Column, keep: Callable, score: Callable, most: int, first: int) -> Column:
    """The best scored candidates among those kept, equal scores in pool order."""
    scored = F.transform(
        F.filter(pool, keep),
        lambda c, i: F.struct((-score(c)).alias("loss"), (i + first).alias("place"), c.alias("c")),
    )
    return F.slice(F.sort_array(scored), 1, most)


def best_candidates(pool: Column, most: int, first: int = 0) -> Column:
    """Better graded candidates, best first; all others only if there is none.

    A product's own name is left out here, after its category's candidates were
    chosen: it takes one of their places, as it does in a catalog search. Places
    count from ``first``.

    This is one expression on purpose: the lists in between hold up to a whole
    pool, and each as a column of its own would be copied from row to row.
    """
    better = _best(
        pool, lambda c: scoring.is_better(c) & scoring.other_name(c), scoring.better_score, most, first
    )
    others = _best(pool, scoring.other_name, scoring.discovery_score, most, first)
    return _let(better, lambda found: F.when(F.size(found) > 0, found).otherwise(others))


def _best_of(so_far: Column, here: Column, most: int) -> Column:
    """The best of two lists of best candidates: better graded ones, if either has any."""

    def graded(best: Column) -> Column:
        return F.coalesce(scoring.is_better(F.get(best, F.lit(0))["c"]), F.lit(False))

    both = F.slice(F.sort_array(F.concat(so_far, here)), 1, most)
    return (
        F.when(F.size(here) == 0, so_far)
        .when((F.size(so_far) == 0) | (graded(here) & ~graded(so_far)), here)
        .when(graded(so_far) & ~graded(here), so_far)
        .otherwise(both)
    )


# Places of one level of a path; more than any list holds.
_PLACES = 1_000_000


def with_best(
    subjects: DataFrame, pools: DataFrame, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Add ``best``: the best candidates of the product's list, or of all the lists it refers to.

    A list is compared where the product meets it, and dropped before the next shuffle: products
    carry the best so far, and by digests the keys of the lists seen, which later ones leave out.
    Paths and categories of very many products are dealt out as in ``with_pool``.
    """
    most = config.max_results
    hot = hot_keys(subjects, config)
    products = spread(subjects, "barcode", "name_key", "url")
    hashed = F.xxhash64("barcode")
    bare = F.array(F.pmod(hashed, F.lit(_SPREAD)).cast("string"))
    part = F.pmod(hashed, F.coalesce("parts", F.lit(1))).cast("string")
    size = F.size("category_path")

    several = F.broadcast(hot.filter(F.size("key") > 1).withColumnRenamed("key", "category_path"))
    path_key = F.when(size > 1, F.concat(F.array(F.lit("")), "category_path", F.array(part))).otherwise(bare)
    copies = (
        pools.filter(size > 1)
        .join(several, "category_path", "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    )
    lists = _keyed(copies, F.lit(""), F.col("category_path"), F.col("_part")).select("_path_key", "pool")
    rows = products.join(several, "category_path", "left").withColumn("_path_key", path_key)
    rows = rows.drop("parts").join(lists, "_path_key", "left").withColumns(scoring.product_side())
    kept = [F.col(name) for name in subjects.columns]
    # Unfolding a list of one changes nothing, but later filters stay above
    # it; Catalyst would otherwise copy the whole comparison into them.
    rows = rows.select("*", F.explode(F.array(best_candidates(F.col("pool"), most))).alias("_here"))
    none = F.array().cast(rows.schema["_here"].dataType)
    rows = rows.select(
        *kept, F.col("pool").isNotNull().alias("_own"), F.coalesce("_here", none).alias("best"),
        F.array().cast("array<binary>").alias("_seen"),
    )

    alone = hot.filter(F.size("key") == 1).select(F.get("key", F.lit(0)).alias("slug"), "parts")
    shelves = pools.filter(size == 1).select(F.get("category_path", F.lit(0)).alias("slug"), F.col("pool").alias("shelf"))
    shelves = dealt_shelves(shelves, alone)
    unseen = F.filter("shelf", lambda c, i: ~F.array_contains("_seen", F.get("digests", i)))
    for level in range(config.category_depth):
        slug = F.get("category_path", F.lit(level))
        key = F.when(~F.col("_own") & slug.isNotNull(), F.array(slug, part)).otherwise(bare)
        rows = rows.withColumn("slug", slug).join(F.broadcast(alone), "slug", "left")
        rows = rows.withColumn("_slug_key", key).drop("slug", "parts").join(shelves, "_slug_key", "left")
        here = _let(unseen, lambda shelf: best_candidates(shelf, most, (level + 1) * _PLACES))  # noqa: B023
        rows = rows.withColumns(scoring.product_side()).select("*", F.explode(F.array(here)).alias("_here"))
        best = F.when(F.col("_here").isNull(), F.col("best")).otherwise(_best_of(F.col("best"), F.col("_here"), most))
        seen = F.when(F.col("digests").isNull(), F.col("_seen")).otherwise(F.concat("_seen", "digests"))
        rows = rows.select(*kept, "_own", best.alias("best"), seen.alias("_seen"))
    return rows.select(*kept, "best")


def _entry(c: Column, score: Column) -> Column:
    better = scoring.is_better(c)
    confidence = F.when(better, scoring.better_confidence(c, score)).otherwise(
        scoring.DISCOVERY_CONFIDENCE
    )
    reason = F.when(better, scoring.better_reason(c, score)).otherwise(scoring.discovery_reason(c))
    return F.struct(
        c["name"].alias("name"),
        F.coalesce(c["grade_text"], F.lit("N/A")).alias("nutriscore_grade"),
        reason.alias("reason"),
        score.alias("score"),
        confidence.alias("confidence"),
        c["url"].alias("url"),
    )


def with_alternatives(
    subjects: DataFrame, pools: DataFrame, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Add ``similar_products``: the best ``max_results`` alternatives, best first.

    Each product is compared with a list inside its own row, so no (product,
    candidate) pair is ever shuffled or sorted across rows; reasons are written
    for the chosen ones only.

    Unfolding a list of one keeps later filters above the comparison: Catalyst would copy it
    into them, and hold such a filter once for every choice of columns of the product's side.
    """
    candidates = F.transform("best", lambda pick: pick["c"])
    scores = F.transform("best", lambda pick: -pick["loss"])
    entries = F.zip_with(candidates, scores, _entry)
    picked = (
        with_best(subjects, pools, config)
        .withColumns(scoring.product_side())
        .select(*subjects.columns, F.explode(F.array(entries)).alias("similar_products"))
    )
    none = F.array().cast(picked.schema["similar_products"].dataType)
    return picked.select(
        *subjects.columns, F.coalesce("similar_products", none).alias("similar_products")
    )


def scored_candidates(subjects: DataFrame, pools: DataFrame) -> DataFrame:
    """Every comparison as a row, with its score, confidence and reason.

    Unfolds the pools in place (a narrow step); at most
    ``category_depth * page_size`` rows per product.
    """
    def compared(c: Column, place: Column) -> Column:
        better = scoring.is_better(c)
        score = F.when(better, scoring.better_score(c)).otherwise(scoring.discovery_score(c))
        return _let(
            score,
            lambda s: F.struct(place.alias("place"), better.alias("is_better"), _entry(c, s).alias("entry")),
        )

    # Inside the row on purpose: written out per row, the comparison is a generated
    # method too large for the JVM to compile.
    entries = F.transform(F.filter("pool", scoring.other_name), compared)
    return (
        comparable(spread(subjects, "barcode", "name_key", "url"), pools)
        .select("barcode", F.inline(entries))
        .select("barcode", "place", "is_better", "entry.*")
    )
