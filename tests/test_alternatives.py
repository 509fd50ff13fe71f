"""Candidates, comparison and ranking of alternatives."""

import pytest
from pyspark.sql import functions as F

import shelfwise
from shelfwise.operators import alternatives as alternative_op
from shelfwise.operators.candidates import candidate_pools, category_paths, category_top, path_slugs
from shelfwise.operators.topk import top_k_per_group
from shelfwise.sources.schema import product_facts

FULL = {"sugars_100g": 10, "fat_100g": 10, "salt_100g": 1, "proteins_100g": 5, "fiber_100g": 2}
JAM = ["en:spreads", "en:jams"]


def product(name, grade=None, nova=None, nutriments=FULL, tags=JAM, scans=1, **more):
    return {"product_name": name, "nutriscore_grade": grade, "nova_group": nova, "nutriments": nutriments,
            "categories_tags": tags, "unique_scans_n": scans, "url": f"https://food.example/{name}", **more}


def similar(catalog, name, config=shelfwise.InsightConfig()):
    found = shelfwise.alternatives(catalog, config=config).join(catalog, "barcode")
    return found.filter(F.col("product_name") == name).first().similar_products


def names(entries):
    return [e.name for e in entries]


def test_detailed_comparison(products):
    better = {"sugars_100g": 5, "fat_100g": 10, "salt_100g": 0.5, "proteins_100g": 6, "fiber_100g": 2}
    entry, = similar(products(product("old", "d", "4"), product(" new ", "A", "1", better)), "old")
    # 0.30*0.5 + 0.15*0.5 + 0.20*0.2 + 0.25*3/4 + 0.15*1
    assert entry.score == pytest.approx(0.6025)
    assert entry.confidence == 71
    assert (entry.name, entry.nutriscore_grade, entry.url) == ("new", "A", "https://food.example/ new ")
    assert entry.reason == (
        "NutriScore A; Sugar: 10.0g → 5.0g; Salt: 1.00g → 0.50g; Protein: 5.0g → 6.0g; NOVA: 4 → 1 (confidence: 71%)"
    )


def test_missing_metrics_weigh_nothing_but_read_as_zero(products):
    catalog = products(product("old", "c"), product("new", "b", None, {"fat_100g": 5, "fiber_100g": 2}))
    entry, = similar(catalog, "old")
    assert entry.score == pytest.approx(0.20 * 0.5 + 0.25 / 4)
    assert entry.reason == (
        "NutriScore B; Sugar: 10.0g → 0.0g; Fat: 10.0g → 5.0g; Salt: 1.00g → 0.00g (confidence: 55%)"
    )


@pytest.mark.parametrize(
    "theirs",
    [{"fat_100g": 1}, {"proteins_100g": 1, "fiber": 2}],
    ids=["too few metrics", "two metrics each, none shared"],
)
def test_simple_comparison(products, theirs):
    mine = {"sugars_100g": 1, "salt_100g": 1}
    catalog = products(product("old", "d", "4", mine), product("new", "b", "3", theirs))
    entry, = similar(catalog, "old")
    assert (entry.score, entry.confidence) == (0.5, 75)
    assert entry.reason == (
        "Better NutriScore (B); significantly better nutritional quality; lower processing (NOVA 4 -> 3)"
    )


def test_ungraded_product_prefers_simple_scores(products):
    catalog = products(product("old", "unknown"), product("full", "b"), product("thin", "a", None, {}))
    entries = similar(catalog, "old")
    assert names(entries) == ["thin", "full"]
    assert entries[0].score == 24.75
    assert entries[1].score == 0.0


def test_any_better_one_hides_all_others(products):
    catalog = products(product("old", "c", "3"), product("same", "c", "2"), product("worse", "e", "3"))
    entries = similar(catalog, "old")
    assert [(e.name, round(e.score, 9), e.confidence) for e in entries] == [("same", -0.02, 60), ("worse", -0.15, 60)]
    assert entries[0].reason == "Category discovery option; same NutriScore (C); lower processing (NOVA 3 -> 2)"
    assert entries[1].reason == "Category discovery option; similar processing (NOVA 3)"
    more = products(product("old", "c", "3"), product("same", "c", "2"), product("better", "b", "4"))
    assert names(similar(more, "old")) == ["better"]


def test_unknown_grades(products):
    catalog = products(product("old", "unknown"), product("x", "unknown"), product("y", ""))
    entries = similar(catalog, "old")
    assert [(e.name, e.nutriscore_grade, e.reason) for e in entries] == [
        ("x", "UNKNOWN", "Category discovery option; same NutriScore (UNKNOWN)"),
        ("y", "N/A", "Category discovery option"),
    ]


def test_ties_keep_level_then_search_order(products):
    catalog = products(
        product("old", "c"),
        product("broad", "b", tags=["en:spreads"], scans=99),
        product("less", "b", scans=1),
        product("more", "b", scans=5),
        product("none", "b", scans=None),
    )
    assert names(similar(catalog, "old")) == ["more", "less", "none", "broad"]


def test_best_five_only(products):
    catalog = products(product("old", "e"), *[product(f"n{i}", "a", scans=i) for i in range(9)])
    assert names(similar(catalog, "old")) == ["n8", "n7", "n6", "n5", "n4"]
    assert len(similar(catalog, "old", shelfwise.InsightConfig(max_results=2))) == 2


def test_repeats_and_unnamed_are_dropped(products):
    twin = product("Twin", "a", url="https://food.example/t ")
    catalog = products(
        product("old", "c"), product("OLD ", "a"), product(" ", "a"), product(None, "a"),
        twin, {**twin, "product_name": " twin", "url": "HTTPS://food.example/T", "nutriscore_grade": "b"},
        product("Twin", "b", url="https://food.example/other"),
    )
    assert [(e.name, e.nutriscore_grade) for e in similar(catalog, "old")] == [("Twin", "A"), ("Twin", "B")]


def test_own_name_takes_a_place_among_the_candidates(products):
    catalog = products(*[product(f"p{i}", "abc"[i % 3], scans=100 - i) for i in range(5)])
    config = shelfwise.InsightConfig(page_size=3)
    assert names(similar(catalog, "p1", config)) == ["p0"]
    # p2 is third most scanned: only p0 and p1 are left, though p3 would be better.
    assert names(similar(catalog, "p2", config)) == ["p0", "p1"]


def test_category_levels(products):
    catalog = products(
        product("deep", "c", tags=["en:top", "en:a", "en:b", "en:c"]),
        product("at top", "a", tags=["en:top"]),
        product("at a", "a", tags=["fr:A"]),
        product("blank", "c", tags=["en:a", "fr:"]),
        product("nowhere", "c", tags=["en:none"]),
        product("no tags", "c", tags=None),
    )
    assert names(similar(catalog, "deep")) == ["at a"]
    assert names(similar(catalog, "blank")) == ["at a"]
    assert similar(catalog, "nowhere") == []
    assert similar(catalog, "no tags") == []


def test_nova_scores_are_clamped(products):
    catalog = products(product("old", "b", "9", {}), product("new", "b", "1", {}))
    entry, = similar(catalog, "old")
    assert entry.score == pytest.approx(-0.05 + 0.1)


def test_stored_pools_and_filters_give_the_same(products, tmp_path):
    catalog = products(*[product(f"p{i}", "abcde"[i % 5], str(i % 4), scans=i) for i in range(40)])
    pools = shelfwise.pools(catalog)
    pools.write.parquet(str(tmp_path / "pools"))
    stored = catalog.sparkSession.read.parquet(str(tmp_path / "pools"))
    direct = shelfwise.alternatives(catalog)
    assert sorted(direct.collect()) == sorted(shelfwise.alternatives(catalog, pools=stored).collect())
    some = direct.filter(F.size("similar_products") > 0)
    assert some.count() == direct.count()
    # The comparison is in the plan once: a later filter does not copy it.
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(transform(filter(pool") == 2


@pytest.mark.parametrize("shards", [1, 3, 64])
def test_top_k_does_not_depend_on_shards(spark, shards):
    df = spark.range(5000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        (F.col("id") * 7919 % 1009).alias("v"), "id",
    )
    got = top_k_per_group(df, ["key"], [F.desc("v"), F.asc("id")], 5, shards, "rank")
    groups = {}
    for row in df.collect():
        groups.setdefault(row.key, []).append((-row.v, row.id))
    expected = {(k, n, i) for k, rows in groups.items() for n, (_, i) in enumerate(sorted(rows)[:5], 1)}
    assert {(r["key"], r["rank"], r["id"]) for r in got.collect()} == expected


def test_hot_path_is_dealt_out_by_rows(spark, products):
    """One path with half the catalog, at Spark's own thresholds but the one for broadcasts."""
    catalog = products(
        *[product(f"hot{i}", "abcde"[i % 5], "3", scans=i) for i in range(300)],
        *[product(f"cold{i}", "b", tags=[f"en:c{i % 60}"]) for i in range(200)],
        *[product(f"bare{i}", "b", tags=None) for i in range(100)],
    )
    config = shelfwise.InsightConfig(path_rows=20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = shelfwise.alternatives(catalog, config=config)
        rows = {r.barcode: r.similar_products for r in found.collect()}
        facts = product_facts(catalog, config)
        pools = candidate_pools(facts, facts, config)
        keyed = alternative_op.with_pool(facts, pools, config)
        plan = keyed._jdf.queryExecution().executedPlan().toString()
        parts = keyed.filter(F.size("category_path") > 0).groupBy("category_path").agg(F.count("*").alias("n"))
        sizes = {tuple(r["category_path"]): r["n"] for r in parts.collect()}
        hot = {tuple(r["category_path"]): r["parts"] for r in alternative_op.hot_paths(facts, config).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == {r.barcode: r.similar_products for r in shelfwise.alternatives(catalog).collect()}
    assert len(hot) == 1 and all(sizes[path] <= n * 20 for path, n in hot.items()) and max(hot.values()) == 15
    assert sum(sizes.values()) == 500 and "SortMergeJoin [_path_key" in plan


def test_asked_slugs_are_filtered_before_the_first_window(products):
    catalog = products(*[product(f"p{i}", "abcde"[i % 5], scans=i, tags=["en:broad", "en:x", "en:y", f"en:c{i}"]) for i in range(20)])
    facts = product_facts(catalog)
    slugs = path_slugs(category_paths(facts.limit(1)))
    plan = category_top(facts, slugs=slugs)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    windows = [k for k, line in enumerate(lines) if "Window" in line]
    semi = [k for k, line in enumerate(lines) if "LeftSemi" in line]
    assert windows and semi and max(windows) < min(semi)
    pools = candidate_pools(facts, facts.limit(1))._jdf.queryExecution().optimizedPlan().toString()
    # one below the ranking of either kind of lists, and one that picks the categories referred to
    assert pools.count("LeftSemi") == 3


def test_products_are_not_shuffled_for_a_small_stored_pool(spark, products):
    catalog = products(*[product(f"p{i}", "abcde"[i % 5], scans=i) for i in range(40)])
    with shelfwise.Staging(spark) as staging:
        found = shelfwise.alternatives(catalog, staging=staging)
        assert {r.barcode: r.similar_products for r in found.collect()} == {
            r.barcode: r.similar_products for r in shelfwise.alternatives(catalog).collect()
        }
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin [_path_key") == 1


def test_lists_of_categories_and_of_shared_paths_give_the_same(spark, products):
    """Whatever number of products gives a path a list of its own, with and without broadcasts."""
    rows = [product(f"p{i}", "abcde"[i % 5], scans=i % 50, tags=["en:broad", f"en:mid{i % 4}", f"en:leaf{i % 23}"]) for i in range(200)]
    rows += [product(f"twin{i}", "a", scans=90, tags=["en:mid1", "en:broad"], url="same") for i in range(3)]
    rows += [product(f"one{i}", "c", tags=["en:broad"]) for i in range(5)] + [product("bare", "b", tags=None)]
    rows += [product("twice", "e", tags=["en:broad", "en:x", "en:broad"]), product("blank", "e", tags=["en:mid1", "fr:"])]
    catalog = products(*rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = {}
    for least in (1, 10, 1000):
        config = shelfwise.InsightConfig(pool_products=least, page_size=7)
        pools = shelfwise.pools(catalog, config=config).collect()
        keys = [tuple(r.category_path) for r in pools]
        assert len(keys) == len(set(keys)) and (least < 1000 or all(len(k) == 1 for k in keys))
        found[least] = {r.barcode: r.similar_products for r in shelfwise.alternatives(catalog, config=config).collect()}
        with shelfwise.Staging(spark) as staging:
            staged = shelfwise.alternatives(catalog, config=config, staging=staging)
            assert {r.barcode: r.similar_products for r in staged.collect()} == found[least]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shuffled = shelfwise.alternatives(catalog, config=shelfwise.InsightConfig(pool_products=10, page_size=7)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found[1] == found[10] == found[1000] == {r.barcode: r.similar_products for r in shuffled}
    assert sum(len(v) > 0 for v in found[1].values()) > 150


def test_page_size_beyond_the_cut_fails_early(products):
    with pytest.raises(ValueError, match="windowGroupLimitThreshold"):
        shelfwise.alternatives(products(product("a", "b")), config=shelfwise.InsightConfig(page_size=1001))
