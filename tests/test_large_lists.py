"""What products and paths carry through shuffles, and in how many parts they are compared."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import shelfwise
from shelfwise.operators import alternatives as alternative_op
from shelfwise.operators.candidates import (
    candidate_pools,
    category_paths,
    category_shelves,
    category_top,
    path_candidates,
)
from shelfwise.sources.schema import product_facts


@pytest.fixture(scope="module", autouse=True)
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _catalog(products):
    rows = [
        {"barcode": None if i % 7 == 0 else str(i % 25), "product_name": f"P{i % 20}", "url": f"u{i % 20}",
         "nutriscore_grade": "abcde"[i * 7 % 5], "nova_group": str(i % 4 + 1), "unique_scans_n": i % 6,
         "categories_tags": ["en:x", "en:top", f"en:mid{i % 3}", f"en:own{i}" if i % 5 else "en:top"][: i % 4 + 1]}
        for i in range(60)
    ]
    return products(*rows, {"product_name": "bare", "categories_tags": None})


def _shuffled(plan: str, key: str) -> list[str]:
    lines = plan.splitlines()
    return [lines[k + 1] for k, line in enumerate(lines) if f"Exchange hashpartitioning({key}" in line]


def test_paths_carry_no_candidates(products):
    config = shelfwise.InsightConfig(page_size=9, path_rows=4)
    facts = product_facts(_catalog(products), config)
    shelves = category_shelves(category_top(facts, config))
    rows = path_candidates(category_paths(facts), shelves, config)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(level" in plan and "shelf" not in plan.split("collect_list(struct(level")[1].splitlines()[0]
    held = {r["slug"]: r["shelf"] for r in shelves.collect()}
    expected = []
    for path in (tuple(r[0]) for r in category_paths(facts).collect()):
        seen = set()
        for level, slug in enumerate(path):
            fresh = [c for c in held.get(slug, []) if c["key"] not in seen]
            expected += [(path, level, c["position"], c["name"], c["url"]) for c in fresh]
            seen |= {c["key"] for c in held.get(slug, [])}
    got = [(tuple(r[0]), r[1], r[2], r[3]["name"], r[3]["url"]) for r in rows.collect()]
    assert sorted(got) == sorted(expected) and len(got) > 100


def test_products_drop_each_list_before_the_next_shuffle(products):
    catalog = _catalog(products)
    found = {}
    for shared in (1, 10**9):
        config = shelfwise.InsightConfig(page_size=9, path_rows=4, pool_products=shared)
        rows = shelfwise.alternatives(catalog, config=config).collect()
        found[shared] = sorted((r["barcode"] or "", str(r["similar_products"])) for r in rows)
    assert found[1] == found[10**9] and len(found[1]) == 61
    facts = product_facts(catalog, config)
    plan = alternative_op.with_best(facts, candidate_pools(facts, facts, config), config)
    below = _shuffled(plan._jdf.queryExecution().executedPlan().toString(), "_slug_key")
    assert below and not any("barcode" in line and "shelf" in line for line in below)


def test_every_comparison_is_made_inside_the_row(products):
    facts = product_facts(_catalog(products))
    rows = alternative_op.scored_candidates(facts, candidate_pools(facts, facts))
    assert "Generate inline(transform(filter(pool" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_prompts_are_made_in_many_parts(spark, products):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = shelfwise.prompts(_catalog(products).coalesce(1))
    assert made.rdd.getNumPartitions() == parts
    plan = alternative_op.with_best(*(lambda f: (f, candidate_pools(f, f)))(product_facts(_catalog(products))))
    assert "RepartitionByExpression [barcode" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert made.filter(F.col("task") == "summary").count() == 61


def test_filters_of_alternatives_stay_above_the_comparison(products):
    """A filter that holds the comparison makes Catalyst derive it anew for every choice of columns."""
    best = shelfwise.alternatives(_catalog(products))
    rows = best.select("barcode", F.inline("similar_products")).filter(F.col("reason").startswith("Category discovery option"))
    plan = rows._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().splitlines()
    assert any("zip_with" in line for line in lines)
    assert not any("Filter" in line and "zip_with" in line for line in lines)
    assert plan.constraints().size() < 100
    assert rows.count() == sum(
        a.reason.startswith("Category discovery option") for r in best.collect() for a in r.similar_products
    )
