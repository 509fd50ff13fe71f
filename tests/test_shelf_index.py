"""The maintained index of categories against a full ranking."""

from __future__ import annotations

import random

import pytest

import shelfwise
from shelfwise.operators import shelf_index
from shelfwise.operators.candidates import category_top
from shelfwise.sources.schema import product_facts
from shelfwise.sources.snapshots import FolderTable

CONFIG = shelfwise.InsightConfig(page_size=4)


def product(k, scans, *tags, **more):
    return {"barcode": f"{k:04d}", "product_name": f"Food {k}", "unique_scans_n": scans, "categories_tags": [f"en:{t}" for t in tags],
            "nutriments": {"fat_100g": k % 9, "sugars_100g": 1}, **more}


def listed(top):
    return sorted((r.slug, r.position, r.barcode, r.unique_scans_n, tuple(map(str, r.candidate))) for r in top.collect())


def equal(spark, path, facts):
    assert listed(shelfwise.indexed_top(spark, path, CONFIG)) == listed(category_top(facts, CONFIG))


def barcodes(spark, *codes):
    return spark.createDataFrame([(c,) for c in codes], "barcode string")


def written(spark, path, before):
    """Slugs in the folders of the versions since."""
    table = FolderTable(spark, path)
    new = [f for f in table.state()[1] if f not in before]
    return {r.slug for r in table.rows_of(new).select("slug").distinct().collect()}


def test_updates_equal_a_full_run(spark, products, tmp_path):
    """Products that come, change, move between categories and go, in any order."""
    rng, path = random.Random(3), str(tmp_path / "index")
    slugs = [f"s{k}" for k in range(5)]
    some = lambda k: product(k, rng.choice([None, *range(12)]), *rng.sample(slugs, rng.randint(0, 2)))
    catalog = {k: some(k) for k in range(60)}
    shelfwise.build_index(spark, path, product_facts(products(*catalog.values())), CONFIG)
    equal(spark, path, product_facts(products(*catalog.values())))
    for step in range(6):
        gone = rng.sample(sorted(catalog), 12 if step == 3 else 5)
        new = [rng.choice(sorted(catalog)) for _ in range(4)] + [100 * (step + 1) + k for k in range(rng.choice([0, 8]))]
        new = {k: some(k) for k in new if k not in gone}
        catalog = {k: v for k, v in catalog.items() if k not in gone} | new
        facts = product_facts(products(*catalog.values()))
        deleted = barcodes(spark, *(f"{k:04d}" for k in gone))
        shelfwise.update_index(spark, path, facts, product_facts(products(*new.values())), deleted, CONFIG)
        equal(spark, path, facts)
        if step == 4:
            assert shelfwise.compact_index(spark, path) and len(FolderTable(spark, path).state()[1]) == 1
            equal(spark, path, facts)


def test_only_touched_categories_are_written(spark, products, tmp_path):
    path = str(tmp_path / "index")
    rows = [product(k, 100 - k, "broad", f"c{k % 4}") for k in range(40)]
    shelfwise.build_index(spark, path, product_facts(products(*rows)), CONFIG)
    before = FolderTable(spark, path).state()[1]
    new = product(50, 500, "c1")
    facts = product_facts(products(*rows, new))
    shelfwise.update_index(spark, path, facts, product_facts(products(new)), None, CONFIG)
    assert written(spark, path, before) == {"c1"}
    equal(spark, path, facts)
    # a product far behind the kept ones changes no list when it goes
    before = FolderTable(spark, path).state()[1]
    facts = product_facts(products(*[r for r in rows if r["barcode"] != "0039"], new))
    shelfwise.update_index(spark, path, facts, product_facts(products(new)).limit(0), barcodes(spark, "0039"), CONFIG)
    assert "broad" not in written(spark, path, before)
    equal(spark, path, facts)


def test_the_catalog_is_read_only_for_lists_that_ran_short(spark, products, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rows = [product(k, 100 - k, "full", "many") for k in range(30)] + [product(60 + k, k, "few") for k in range(3)]
    shelfwise.build_index(spark, path, product_facts(products(*rows)), CONFIG)
    refilled = []
    refill = shelf_index._refilled
    monkeypatch.setattr(shelf_index, "_refilled", lambda f, s, c: refilled.append(sorted(r.slug for r in s.collect())) or refill(f, s, c))

    def delete(*codes):
        rows[:] = [r for r in rows if r["barcode"] not in codes]
        facts = product_facts(products(*rows))
        shelfwise.update_index(spark, path, facts, facts.limit(0), barcodes(spark, *codes), CONFIG)
        equal(spark, path, facts)

    delete("0000", "0001")  # six of eight are left, a page is four
    delete("0060", "0061", "0062")  # a whole category: nothing to look for
    assert refilled == []
    delete("0002", "0003", "0004")
    assert refilled == [["full", "many"]]
    assert "few" not in {r.slug for r in shelfwise.indexed_top(spark, path, CONFIG).collect()}


def test_another_update_in_between_is_kept(spark, products, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rows = [product(k, k, "x") for k in range(9)]
    shelfwise.build_index(spark, path, product_facts(products(*rows)), CONFIG)
    one, two = product(20, 50, "x"), product(21, 60, "y")
    facts = product_facts(products(*rows, one, two))
    write = FolderTable.write

    def slow(self, frame, name):
        folder = write(self, frame, name)
        monkeypatch.setattr(FolderTable, "write", write)
        shelfwise.update_index(spark, path, facts, product_facts(products(two)), None, CONFIG)
        return folder

    monkeypatch.setattr(FolderTable, "write", slow)
    shelfwise.update_index(spark, path, facts, product_facts(products(one)), None, CONFIG)
    equal(spark, path, facts)


def test_pools_out_of_the_index(spark, products, tmp_path):
    path = str(tmp_path / "index")
    catalog = products(*[product(k, k, "a", f"b{k % 3}", nutriscore_grade="abcde"[k % 5]) for k in range(40)])
    shelfwise.build_index(spark, path, product_facts(catalog), CONFIG)
    pools = shelfwise.pools(catalog, config=CONFIG, top=shelfwise.indexed_top(spark, path, CONFIG))
    found = shelfwise.alternatives(catalog, pools=pools, config=CONFIG)
    assert sorted(found.collect()) == sorted(shelfwise.alternatives(catalog, config=CONFIG).collect())


def test_no_index_and_too_large_a_page(spark, products, tmp_path):
    facts = product_facts(products(product(1, 1, "x")))
    with pytest.raises(ValueError, match="no index"):
        shelfwise.indexed_top(spark, str(tmp_path / "none"), CONFIG)
    with pytest.raises(ValueError, match="no index"):
        shelfwise.update_index(spark, str(tmp_path / "none"), facts, facts, None, CONFIG)
    with pytest.raises(ValueError, match="windowGroupLimitThreshold"):
        shelfwise.build_index(spark, str(tmp_path / "big"), facts, shelfwise.InsightConfig(page_size=500))
