"""Rejected lines, product versions, typed amounts and resolved requests."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import shelfwise
from shelfwise.__main__ import arguments, run
from shelfwise.sources import readers
from shelfwise.sources.schema import REQUEST_SCHEMA, product_facts

LINES = {
    '{"barcode":"1","product_name":"Jam","nova_group":4.0}': None,
    ' {"barcode":"2","nutriments":{"fat":1}} ': None,
    '{"barcode":"3","product_name":': readers.MALFORMED,
    '{"barcode":"4"} {"barcode":"5"}': readers.MALFORMED,
    '{"barcode":"6"}]': readers.MALFORMED,
    '{"barcode":"6"}, {"barcode":"7"}': readers.MALFORMED,
    "no json": readers.MALFORMED,
    '[{"barcode":"7"}]': readers.NOT_AN_OBJECT,
    "12": readers.NOT_AN_OBJECT,
    "null": readers.NOT_AN_OBJECT,
    '"text"': readers.NOT_AN_OBJECT,
    '{"product_name":"x"}': readers.NO_BARCODE,
    '{"barcode":null}': readers.NO_BARCODE,
    '{"barcode":" \\t"}': readers.NO_BARCODE,
    "{}": readers.NO_BARCODE,
    '{"barcode":"8","categories_tags":7}': readers.WRONG_TYPE,
    '{"barcode":"9","nutriments":[1]}': readers.WRONG_TYPE,
    '{"barcode":"10","unique_scans_n":"many"}': readers.WRONG_TYPE,
    '{"barcode":"11","unknown_field":{"a":[1]}}': None,
}


@pytest.fixture
def lines(tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text("\n".join([*LINES, "", "   "]) + "\n")
    return str(tmp_path / "lines")


def test_each_line_is_a_product_or_a_reject(spark, lines):
    rows = readers.read_catalog_lines(spark, lines)
    assert {r.line: r.reason for r in shelfwise.rejected(rows).collect()} == {k: v for k, v in LINES.items() if v}
    products = {r.barcode: r for r in shelfwise.accepted(rows).collect()}
    assert set(products) == {"1", "2", "11"} and products["1"].nova_group == "4"
    assert all(v is None for r in rows.filter("reason IS NOT NULL").drop("line", "reason").collect() for v in r)


def test_products_and_rejects_are_written_by_one_job(spark, lines, tmp_path):
    out = str(tmp_path / "checked")
    shelfwise.write_checked(readers.read_catalog_lines(spark, lines), out)
    assert sorted(p.name for p in (tmp_path / "checked").glob("outcome=*")) == ["outcome=accepted", "outcome=rejected"]
    assert spark.read.parquet(f"{out}/outcome=accepted").count() == 3
    assert spark.read.parquet(f"{out}/outcome=rejected").count() == len(LINES) - 3


def test_command_line_checks_and_resolves_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"barcode": "1", "product_name": name, "unique_scans_n": n} for n, name in enumerate(["Old", "New"])]
    (tmp_path / "in" / "a.json").write_text("\n".join([*map(json.dumps, rows), "broken"]))
    where = {name: str(tmp_path / name) for name in ("in", "out", "checked")}
    run(spark, arguments(["prompts", "--catalog", where["in"], "--catalog-format", "json", "--out", where["out"],
                          "--checked", where["checked"], "--version-column", "unique_scans_n"]))
    assert spark.read.parquet(where["out"]).filter("task = 'summary'").count() == 1
    assert "New" in spark.read.parquet(where["out"]).filter("task = 'summary'").first().prompt
    assert spark.read.parquet(where["checked"]).filter("outcome = 'rejected'").first().line == "broken"
    with pytest.raises(ValueError, match="JSON"):
        run(spark, arguments(["prompts", "--catalog", where["checked"], "--out", where["out"], "--checked", "x"]))


def test_the_newest_version_of_each_barcode(spark):
    rows = [("1", 5, "b"), ("1", 9, "c"), ("1", None, "a"), ("2", None, "x"), (None, 3, "n"), ("3", 4, "same"), ("3", 4, "same"),
            ("4", 7, "p"), ("4", 7, "q")]
    catalog = spark.createDataFrame(rows, "barcode string, last_modified_t long, product_name string")
    catalog = catalog.withColumn("nutriments", F.create_map(F.lit("fat"), F.lit("1")))
    found = {r.barcode: r.product_name for r in shelfwise.latest_versions(catalog.repartition(3)).collect()}
    assert set(found) == {"1", "2", "3", "4"} and (found["1"], found["2"], found["3"]) == ("c", "x", "same")
    assert all(shelfwise.latest_versions(catalog.repartition(k)).filter("barcode = '4'").first().product_name == found["4"] for k in (1, 5))
    assert shelfwise.latest_versions(catalog).columns == catalog.columns


def test_hot_barcodes_are_reduced_before_the_shuffle(spark):
    catalog = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', cast(id AS string)) AS barcode", "id AS last_modified_t")
    found = shelfwise.latest_versions(catalog)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and found.count() == 20_001
    assert found.filter("barcode = 'hot'").first().last_modified_t == 29_997


def test_resolving_versions_before_a_join(spark):
    """Jobs that expect one row per barcode get it."""
    catalog = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("2", 1, "c")], "barcode string, last_modified_t long, product_name string")
    requests = spark.createDataFrame([(7, "1"), (8, "3")], REQUEST_SCHEMA)
    rows = shelfwise.resolve_requests(requests, shelfwise.latest_versions(catalog)).collect()
    assert [(r.request_id, r.product_name) for r in rows] == [(7, "b")]


@pytest.mark.parametrize(
    "entry, plain, expected",
    [("0", "5", 5.0), ('"0"', "5", 0.0), ('"0.0"', "5", 0.0), ('""', "5", 5.0), ("null", "5", 5.0), ("false", "5", 5.0), ("true", "5", 1.0),
     ('"x"', "5", 0.0), ("2.5", "5", 2.5), ('" 2.5 "', "5", 2.5), (None, "5", 5.0), (None, '"5"', 5.0), ("0", '"0"', 0.0), ('"NaN"', "5", 0.0)],
)
def test_json_amounts_keep_their_type(spark, tmp_path, entry, plain, expected):
    (tmp_path / "in").mkdir()
    stated = "" if entry is None else f'"fat_100g":{entry},'
    (tmp_path / "in" / "a.json").write_text(f'{{"barcode":"1","nutriments":{{{stated}"fat":{plain}}}}}')
    row = product_facts(shelfwise.read_catalog(spark, str(tmp_path / "in"), "json")).first()
    assert row.fat == expected and row.has_fat and not row.has_sugars


def test_requests_with_and_without_a_product_come_from_one_join(spark, tmp_path):
    catalog = spark.createDataFrame([("0011", "Jam"), ("12", "Oil"), (None, "Nameless")], "barcode string, product_name string")
    asked = [(1, " 0011 "), (2, "https://food.example/product/12/oil"), (3, "13"), (4, "https://food.example/about"), (5, None), (6, "0011")]
    requests = spark.createDataFrame(asked, REQUEST_SCHEMA)
    resolved = shelfwise.resolved(requests, catalog)
    rows = {r.request_id: r for r in resolved.collect()}
    assert {k: r.outcome for k, r in rows.items()} == {
        1: "found", 2: "found", 3: "unknown", 4: "unreadable", 5: "unreadable", 6: "found"
    }
    assert rows[2].product_name == "Oil" and rows[1].error is None
    missing = {r.request_id: r.error for r in shelfwise.requests_not_found(requests, catalog).collect()}
    assert {k: r.error for k, r in rows.items() if r.outcome != "found"} == missing
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    shelfwise.write_resolved(resolved, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("outcome=*")) == ["outcome=found", "outcome=unknown", "outcome=unreadable"]
