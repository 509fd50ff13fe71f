"""The most scanned products of every category as a stored index that changes are merged into.

A category keeps more candidates than a search shows: ``page_size`` times ``SPARE``, in search
order, and whether these are all it has. New, changed and deleted products are merged into the
lists of the categories they touch. What ranks behind the end of a list that is not all of its
category cannot be placed and is left off, so a list may become shorter; only when less than
a page is left is the category ranked again from the catalog. Every update writes the lists of
the categories it touches, in a folder of its own, and nothing else; the newest list of a
category counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.config import DEFAULT_CONFIG, InsightConfig
from shelfwise.functions.scoring import candidate_struct
from shelfwise.operators.candidates import category_members, check_page_size
from shelfwise.operators.topk import top_k_per_group
from shelfwise.sources.snapshots import Conflict, FolderTable

#: How many pages of a category are kept.
SPARE = 2
TRIES = 5


def _kept(config: InsightConfig) -> int:
    return SPARE * config.page_size


def _search_order() -> Column:
    """A value that sorts as a search does: most scanned first, unknown last, then by barcode."""
    scans = F.col("unique_scans_n")
    return F.struct(scans.isNull().alias("unknown"), (-scans).alias("loss"), F.col("barcode").alias("barcode"))


def _ranked(members: DataFrame, config: InsightConfig) -> DataFrame:
    """(slug, entries, complete): the first candidates of each category in search order."""
    kept = _kept(config)
    top = top_k_per_group(
        members,
        ["slug"],
        [F.desc_nulls_last("unique_scans_n"), F.asc("barcode")],
        kept + 1,
        config.shards,
        "position",
    )
    entry = F.struct(
        _search_order().alias("place"), F.col("unique_scans_n"), candidate_struct().alias("candidate")
    )
    lists = top.groupBy("slug").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return lists.select(
        "slug", F.slice("entries", 1, kept).alias("entries"), (F.size("entries") <= kept).alias("complete")
    )


def _stored(lists: DataFrame, version: int, later: int = 0) -> DataFrame:
    """Lists as they are written: of two of one category the one of larger ``stamp`` counts."""
    short = F.col("short") if "short" in lists.columns else F.lit(False).alias("short")
    return lists.select("slug", "entries", "complete", short, F.lit(2 * version + later).cast("long").alias("stamp"))


def _newest(rows: DataFrame) -> DataFrame:
    """(slug, entries, complete) as of the last update of each category."""
    last = F.max_by(F.struct("entries", "complete"), "stamp").alias("last")
    return rows.groupBy("slug").agg(last).select("slug", "last.*")


def build_index(
    spark: SparkSession, path: str, facts: DataFrame, config: InsightConfig = DEFAULT_CONFIG
) -> int:
    """Write the index of a whole catalog (typed products), in place of any earlier one."""
    _check(spark, config)
    table = FolderTable(spark, path)
    version, folders = table.state()
    rows = _stored(_ranked(category_members(facts), config), version + 1)
    return table.commit([table.write(rows, "built")], folders, base=version)


def _check(spark: SparkSession, config: InsightConfig) -> None:
    # one more than is kept is ranked, to see whether there are more
    check_page_size(spark, InsightConfig(page_size=_kept(config) + 1))


def _merged(
    current: DataFrame, added: DataFrame, changed: DataFrame, config: InsightConfig
) -> DataFrame:
    """(slug, entries, complete, short): the lists of touched categories after the changes.

    ``short`` lists have less than a page and may miss products of the catalog.
    """
    listed = current.select("slug", F.explode("entries").alias("entry"))
    listed = listed.withColumn("barcode", F.col("entry.place.barcode"))
    hit = listed.join(changed, "barcode", "left_semi").select("slug")
    touched = hit.union(added.select("slug")).distinct()
    ends = current.join(touched, "slug", "left_semi").select(
        "slug", F.col("complete").alias("was_complete"), F.try_element_at("entries", F.lit(-1))["place"].alias("end")
    )
    stay = listed.join(touched, "slug", "left_semi").join(changed, "barcode", "left_anti")
    entries = stay.select("slug", "entry").union(added.select("slug", F.explode("entries").alias("entry")))
    lists = entries.groupBy("slug").agg(F.sort_array(F.collect_list("entry")).alias("all"))
    kept = _kept(config)
    # a category without a list so far had no product at all
    whole = F.coalesce("was_complete", F.lit(True))
    known = F.when(whole, F.col("all")).otherwise(F.filter("all", lambda e: e["place"] <= F.col("end")))
    return (
        touched.join(ends, "slug", "left")
        .join(lists, "slug", "left")
        .withColumn("all", F.coalesce("all", F.array().cast(lists.schema["all"].dataType)))
        .withColumns({"known": known, "whole": whole})
        .select(
            "slug",
            F.slice("known", 1, kept).alias("entries"),
            (F.col("whole") & (F.size("known") <= kept)).alias("complete"),
            (~F.col("whole") & (F.size("known") < config.page_size)).alias("short"),
        )
    )


def update_index(
    spark: SparkSession,
    path: str,
    facts: DataFrame,
    changed: DataFrame,
    deleted: DataFrame | None = None,
    config: InsightConfig = DEFAULT_CONFIG,
) -> int:
    """Merge changes into the index; returns the version it has then.

    ``changed`` are the new and changed products (typed, one row per barcode), ``deleted`` the
    barcodes that are gone, ``facts`` all products as they are after the change: of these only
    categories are read of which less than a page is left. Updates that meet are done one after
    the other.
    """
    _check(spark, config)
    table = FolderTable(spark, path)
    barcodes = changed.select("barcode")
    if deleted is not None:
        barcodes = barcodes.union(deleted.select("barcode"))
    for _ in range(TRIES):
        version, folders = table.state()
        if not folders:
            raise ValueError(f"there is no index at {path}")
        current = _newest(table.rows_of(folders))
        added = _ranked(category_members(changed), config)
        merged = _merged(current, added, barcodes.distinct(), config)
        written = table.write(_stored(merged, version + 1), "update")
        rows = table.rows_of([written])
        short = rows.filter("short").select("slug")
        names = [written]
        if not short.isEmpty():
            names.append(table.write(_stored(_refilled(facts, short, config), version + 1, later=1), "refill"))
        try:
            return table.commit(names, base=version)
        except Conflict:
            for name in names:
                table.discard(name)
    raise Conflict(f"no update of {path} in {TRIES} tries")


def _refilled(facts: DataFrame, slugs: DataFrame, config: InsightConfig) -> DataFrame:
    """The lists of some categories, ranked from the catalog; empty ones of those without products."""
    ranked = _ranked(category_members(facts).join(slugs, "slug", "left_semi"), config)
    none = F.array().cast(ranked.schema["entries"].dataType)
    return slugs.join(ranked, "slug", "left").select(
        "slug", F.coalesce("entries", none).alias("entries"), F.coalesce("complete", F.lit(True)).alias("complete")
    )


def compact_index(spark: SparkSession, path: str) -> bool:
    """Put all folders of the index together in one; False if another writer was faster."""
    table = FolderTable(spark, path)
    version, folders = table.state()
    if len(folders) < 2:
        return False
    rows = _newest(table.rows_of(folders)).filter(F.size("entries") > 0)
    merged = table.write(_stored(rows, version + 1), "merged")
    try:
        table.commit([merged], folders, base=version)
    except Conflict:
        table.discard(merged)
        return False
    return True


def indexed_top(
    spark: SparkSession, path: str, config: InsightConfig = DEFAULT_CONFIG
) -> DataFrame:
    """What ``category_top`` gives: (slug, position, barcode, unique_scans_n, candidate)."""
    rows = FolderTable(spark, path).read()
    if rows is None:
        raise ValueError(f"there is no index at {path}")
    page = F.slice("entries", 1, config.page_size)
    listed = _newest(rows).select("slug", F.posexplode(page).alias("at", "entry"))
    position = (F.col("at") + 1).alias("position")
    return listed.select(
        "slug",
        position,
        F.col("entry.place.barcode").alias("barcode"),
        "entry.unique_scans_n",
        F.col("entry.candidate").withField("position", position).alias("candidate"),
    )
