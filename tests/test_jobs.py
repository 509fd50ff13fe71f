"""Requests, sources and sinks, the whole report, the stream."""

import json

import pytest
from pyspark.sql import functions as F

import shelfwise
from checks import derived
from shelfwise.sources.snapshots import FolderTable
from shelfwise.sources import readers, sinks
from shelfwise.sources.schema import REQUEST_SCHEMA, product_facts
from shelfwise.streaming import views as view_jobs

RULES = shelfwise.InsightConfig(fallback_to_rules=True)


def requests(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), REQUEST_SCHEMA)


def test_requests_are_split_into_found_and_not_found(spark, products):
    catalog = products({"product_name": "x"}, {"product_name": "y"})
    asked = requests(
        spark, " 0000000000001 ", "https://food.example/product/0000000000000/x", "77",
        "https://food.example/none", "0000000000001",
    )
    found = shelfwise.resolve_requests(asked, catalog).orderBy("request_id").collect()
    assert [(r.request_id, r.product_name) for r in found] == [(0, "y"), (1, "x"), (4, "y")]
    missing = shelfwise.requests_not_found(asked, catalog).orderBy("request_id").collect()
    assert [(r.request_id, r.barcode, r.error) for r in missing] == [
        (2, "77", "Product not found for barcode: 77"),
        (3, None, "Could not extract barcode from URL: https://food.example/none"),
    ]


def test_json_catalog_and_saved_responses(spark, tmp_path):
    record = {"barcode": "0007", "product_name": "Jam", "nova_group": 4, "nutriments": {"fat_100g": 20.5, "salt": "x"},
              "categories_tags": ["en:jams"], "unknown_field": 1}
    (tmp_path / "c.jsonl").write_text(json.dumps(record))
    catalog = readers.read_catalog(spark, str(tmp_path / "c.jsonl"), "json")
    row = shelfwise.analyse(catalog).first()
    assert row.barcode == "0007"
    assert row.risk_indicators == ["High fat", "Ultra-processed food (NOVA 4)"]

    saved = [
        {"code": "0007", "status": 1, "product": record},
        {"code": "1", "status": 0, "status_verbose": "product not found"},
        {"code": "2", "status_verbose": "product not found", "product": {}},
        {"code": "3", "product": {"product_name": "No status"}},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, saved)))
    found = readers.read_responses(spark, str(tmp_path / "r.jsonl")).orderBy("barcode").collect()
    assert [(r.barcode, r.product_name) for r in found] == [("0007", "Jam"), ("3", "No status")]
    with pytest.raises(ValueError):
        readers.read_catalog(spark, str(tmp_path / "c.jsonl"), "csv")


def test_request_and_reply_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text("request_id,barcode_or_url\n5,0042\n")
    assert readers.read_requests(spark, str(tmp_path / "q.csv"), "csv").first() == (5, "0042")
    (tmp_path / "a.jsonl").write_text(json.dumps({"barcode": "1", "task": "nova", "reply": "x"}))
    assert readers.read_replies(spark, str(tmp_path / "a.jsonl"), "json").first() == ("1", "nova", None, "x")


def test_report_is_nested_and_written(spark, products, seed_spread, flakes, tmp_path):
    catalog = products(
        {**seed_spread, "image_url": "i", "brands": "b"},
        {**flakes, "categories_tags": ["en:spreads"], "url": "u"},
        {"nova_group": "x"},
    )
    report = shelfwise.report(catalog, config=RULES)
    sinks.write_report(report, str(tmp_path / "report"), "json")
    rows = [json.loads(line) for line in spark.read.text(str(tmp_path / "report")).toPandas()["value"]]
    first, second, third = sorted(rows, key=lambda r: r["barcode"])
    assert first["product"] == {
        "name": "Roasted Seed Spread", "image_url": "i", "nutriscore": "c", "nova": 4, "brands": "b"
    }
    assert set(first["score_explanation"]) == {"nutriscore", "nova", "nutrient_density"}
    assert [(s["name"], s["nutriscore_grade"], s["url"]) for s in first["similar_products"]] == [("Barley Flakes", "A", "u")]
    assert first["pairings"][0] == "banana"
    assert second["similar_products"][0]["confidence"] == 60
    assert third["product"] == {"name": "Unknown product"}
    assert third["similar_products"] == [] and third["pairings"][0] == "water"
    typed = sinks.stage(report, "report").schema
    assert typed["similar_products"].dataType.simpleString() == (
        "array<struct<name:string,nutriscore_grade:string,reason:string,score:double,confidence:int,url:string>>"
    )


def test_jobs_run_from_files_to_files(spark, products, seed_spread, flakes, tmp_path):
    from shelfwise.__main__ import arguments, run

    catalog, out = str(tmp_path / "catalog"), str(tmp_path / "out")
    products(seed_spread, {**flakes, "categories_tags": ["en:spreads"]}).write.parquet(catalog)
    requests(spark, "0000000000000", "0000000000000", "9").write.parquet(str(tmp_path / "requests"))
    run(spark, arguments(["report", "--catalog", catalog, "--out", out, "--fallback",
                          "--requests", str(tmp_path / "requests")]))
    row, = spark.read.parquet(f"{out}/report").collect()
    assert row.product.name == "Roasted Seed Spread"
    assert [s.name for s in row.similar_products] == ["Barley Flakes"]
    assert spark.read.parquet(f"{out}/not_found").count() == 1
    run(spark, arguments(["pools", "--catalog", catalog, "--out", f"{out}/pools"]))
    run(spark, arguments(["alternatives", "--catalog", catalog, "--out", out, "--pools", f"{out}/pools"]))
    assert spark.read.parquet(f"{out}/alternatives").count() == 2
    run(spark, arguments(["prompts", "--catalog", catalog, "--out", f"{out}/prompts"]))
    assert spark.read.parquet(f"{out}/prompts").count() == 10


def test_a_csv_list_against_a_parquet_catalog(spark, products, flakes, tmp_path):
    from shelfwise.__main__ import arguments, run

    catalog, out, asked = str(tmp_path / "catalog"), str(tmp_path / "out"), tmp_path / "asked.csv"
    products(flakes, {**flakes, "product_name": "Other", "nutriscore_grade": "b"}).write.parquet(catalog)
    asked.write_text("request_id,barcode_or_url\n1,0000000000001\n2,https://food.example/product/0000000000001/x\n3,5\n")
    run(spark, arguments(["report", "--catalog", catalog, "--out", out, "--fallback", "--requests", str(asked),
                          "--requests-format", "csv", "--page-size", "1", "--category-depth", "2"]))
    row, = spark.read.parquet(f"{out}/report").collect()
    assert [s.name for s in row.similar_products] in ([], ["Barley Flakes"])
    assert spark.read.parquet(f"{out}/not_found").count() == 1


def test_staged_tables_are_removed(spark, tmp_path):
    with sinks.Staging(spark) as staging:
        assert staging.table(spark.range(5), "five").count() == 5
        assert sinks.finished_folders(spark, staging.folder)
    assert sinks.finished_folders(spark, staging.folder) == []


def test_json_numbers_lose_their_fraction_and_texts_do_not(spark, tmp_path):
    lines = [{"barcode": str(i), "nova_group": v} for i, v in enumerate([4, 4.0, 3.7, "4", "4.0", None, True, [1]])]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = readers.read_catalog(spark, str(tmp_path / "c.jsonl"), "json").orderBy("barcode").collect()
    assert [r.nova_group for r in rows] == ["4", "4", "3", "4", "4.0", None, None, None]
    facts = [r.nova for r in product_facts(readers.read_catalog(spark, str(tmp_path / "c.jsonl"), "json")).orderBy("barcode").collect()]
    assert facts == [4, 4, 3, 4, 0, 0, 0, 0]


def test_repeated_barcodes_are_reported(products):
    catalog = products({"product_name": "x"}, {"product_name": "y"}, {"product_name": "z"})
    assert readers.repeated_barcodes(catalog).count() == 0
    twice = catalog.union(catalog.limit(1))
    assert [(r["barcode"], r["count"]) for r in readers.repeated_barcodes(twice).collect()] == [("0" * 13, 2)]


def test_report_covers_each_requested_product_once(spark, products):
    catalog = products({"product_name": "x"}, {"product_name": "y"})
    asked = requests(spark, "0000000000001", "0000000000001", "5", "https://food.example/none")
    rows = shelfwise.report(catalog, asked, config=RULES).collect()
    assert [r.product.name for r in rows] == ["y"]
    missing = shelfwise.requests_not_found(asked, catalog)
    assert missing.count() == 2


def test_parts_of_the_report_equal_the_single_jobs(spark, sf_dir):
    catalog, replies = derived.catalog(spark, sf_dir), derived.replies(spark, sf_dir)
    report = {r.barcode: r for r in shelfwise.report(catalog, replies=replies, config=RULES).collect()}
    for row in shelfwise.analyse(catalog, replies, RULES).collect():
        assert report[row.barcode].risk_indicators == row.risk_indicators
        assert report[row.barcode].positive_indicators == row.positive_indicators
    for row in shelfwise.alternatives(catalog, config=RULES).collect():
        assert report[row.barcode].similar_products == row.similar_products
    for row in shelfwise.pair(catalog, replies, RULES).collect():
        assert report[row.barcode].pairings == row.pairings


def test_shared_folder_is_the_one_of_the_session(spark):
    assert sinks.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_projections_shuffle_nothing(products, flakes):
    catalog = products(flakes)
    for job in (shelfwise.analyse, shelfwise.explain, shelfwise.summarise, shelfwise.pair):
        assert "Exchange" not in job(catalog, config=RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shelfwise.prompts(catalog)._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark, products, flakes, tmp_path):
    products(flakes).write.parquet(str(tmp_path / "c"))
    catalog = spark.read.parquet(str(tmp_path / "c"))
    plan = shelfwise.pair(catalog, config=RULES).filter(F.col("barcode") == "0000000000000")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<barcode:string,categories_tags:array<string>>" in text
    assert "EqualTo(barcode,0000000000000)" in text


def test_stream_keeps_the_last_view_over_several_runs(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp_ntz, url string"
    pages = "https://food.example/product/{}/x"

    def add(name, *rows):
        data = [(u, e, __import__("datetime").datetime(2024, 1, 1, h), url) for u, e, h, url in rows]
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in" / name))

    def state():
        return {r.user_id: r.barcode for r in view_jobs.read_latest_viewed(spark, str(tmp_path / "out")).collect()}

    def run(checkpoint="check", folder="in", **options):
        stream = spark.readStream.schema(schema).options(**options).parquet(str(tmp_path / folder / "*"))
        query = view_jobs.start_latest_viewed(
            stream, str(tmp_path / "out"), str(tmp_path / checkpoint), compact_every=3
        )
        query.awaitTermination()
        return state()

    assert state() == {}

    add("a", (1, 1, 5, pages.format(11)), (1, 2, 6, pages.format(12)), (2, 3, 1, pages.format(21)), (3, 4, 1, "https://food.example/about/1"))
    assert run() == {1: "12", 2: "21"}
    # A late view changes nothing; a later one does; equal times go by event.
    add("b", (1, 5, 2, pages.format(13)), (2, 6, 1, pages.format(22)), (4, 7, 1, pages.format(41)))
    assert run() == {1: "12", 2: "22", 4: "41"}
    whole = spark.read.schema(schema).parquet(str(tmp_path / "in" / "*"))
    assert {r.user_id: r.barcode for r in view_jobs.latest_viewed(whole).collect()} == {1: "12", 2: "22", 4: "41"}

    # Another checkpoint counts its batches from 0 again and loses nothing.
    add("../more/a", (5, 8, 1, pages.format(51)))
    assert run("check2", "more") == {1: "12", 2: "22", 4: "41", 5: "51"}
    # The folders stay few: every third batch puts them together.
    for k in range(10):
        add(f"../many/{k}", (6, 10 + k, k, pages.format(60 + k)))
    found = run("check3", "many", maxFilesPerTrigger=1)
    assert found == {1: "12", 2: "22", 4: "41", 5: "51", 6: "69"}
    assert len(FolderTable(spark, str(tmp_path / "out")).state()[1]) <= 4
