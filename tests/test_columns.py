"""Conversions, formatting, tags, addresses and nutrient reading."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.fixed_values import WHITESPACE
from shelfwise.functions import scalars, tags, urls
from shelfwise.sources.schema import product_facts


def values(spark, column, inputs, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {type_}")
    return [row[0] for row in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_whitespace_is_all_of_unicode():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_to_double(spark):
    inputs = ["3.14", None, "abc", " 4 ", "1e3", ".5", "5.", "", "1.5d", "1f", "0x1p3", "nan", "inf", "1e999", " 7 "]
    expected = [3.14, 0.0, 0.0, 4.0, 1000.0, 0.5, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 7.0]
    assert values(spark, scalars.to_double, inputs) == expected
    assert values(spark, lambda c: scalars.to_double(c, 1.0), ["abc"]) == [1.0]


def test_to_int(spark):
    assert values(spark, scalars.to_int, ["4", None, "4.0", "x", " 3 ", "", "-2"]) == [4, 0, 0, 0, 3, 0, -2]
    assert values(spark, scalars.to_int, [4.7, -4.7, float("nan")], "double") == [4, -4, 0]


def test_numbers_are_printed_as_python_does(spark):
    rng = random.Random(7)
    numbers = [0.25, 0.35, 0.125, 0.375, 2.5, 3.5, 0.5, 0.05, 0.15, 1e-5, 0.0005, 1e7, 1.5e16, 0.0, -0.04, 999.95]
    numbers += [round(rng.random() * 900, rng.choice([1, 2, 3])) for _ in range(2000)]
    numbers += [rng.random() * 10 ** rng.randint(-6, 8) for _ in range(1000)]
    for places in (0, 1, 2):
        printed = values(spark, lambda c: scalars.decimals_text(c, places), numbers, "double")
        assert printed == [f"{n:.{places}f}" for n in numbers]
    assert values(spark, scalars.shortest_text, numbers, "double") == [repr(n) for n in numbers]


def test_grades(spark):
    inputs = ["C", None, "", " a ", "unknown", " B\t"]
    assert values(spark, tags.normalise_grade, inputs) == ["c", None, None, "a", "unknown", "b"]
    assert values(spark, tags.grade_rank, ["a", "e", "unknown", None]) == [0, 4, 99, 99]


def test_tags(spark):
    lists = [["en:peanuts", "en:tree-nuts", "en:peanuts"], [], None, ["plain", "a:b:c-d"]]
    type_ = "array<string>"
    assert values(spark, tags.allergen_names, lists, type_) == [
        ["peanuts", "tree nuts", "peanuts"], [], [], ["plain", "b:c d"]
    ]
    assert values(spark, tags.additive_names, [["en:e471"], None], type_) == [["E471"], []]
    paths = [["en:A", "en:b"], ["en:a", "en:b", "en:c", "fr:D"], ["en:a", "en:b", "fr:"], [], None]
    assert values(spark, lambda c: tags.category_path(c, 3), paths, type_) == [
        ["b", "a"], ["d", "c", "b"], ["b", "a"], [], []
    ]
    assert values(spark, tags.first_slug, [["en:", "en:Nut-Butters"], []], type_) == ["nut-butters", ""]
    assert values(spark, tags.last_slug, [["en:a", "fr:"], ["en:X"], [], None], type_) == ["", "x", "", ""]
    candy = [["en:Sweets"], ["en:gummies"], ["en:breads"], []]
    assert values(spark, tags.is_candy_like, candy, type_) == [True, True, False, False]


def test_barcodes(spark):
    inputs = [
        "https://x.example/product/0068100084245/peanut-butter",
        "https://x.example/product/0068100084245///",
        "https://x.example/no-barcode-here",
        "https://x.example/12a/34/56",
        " 0068100084245 ",
        "abc",
    ]
    assert values(spark, urls.requested_barcode, inputs) == [
        "0068100084245", "0068100084245", None, "34", "0068100084245", "abc"
    ]


def test_page_barcodes(spark):
    inputs = [
        "https://ca.food.example/product/00123/jam",
        "https://ca.food.example/product/00123?x=1",
        "https://ca.food.example/product/00123abc",
        "https://CA.FOOD.EXAMPLE/PRODUCT/77/x",
        "https://ca.food.example/fr/product/00123",
        None,
    ]
    assert values(spark, urls.page_barcode, inputs) == ["00123", "00123", None, None, None, None]
    assert values(spark, lambda c: urls.page_barcode(c, "prefix", "food.example"), inputs) == [
        "00123", "00123", "00123", "77", None, None
    ]
    with pytest.raises(ValueError):
        urls.page_barcode(F.lit("x"), "other")


def test_nutrient_reading(products):
    nutriments = [
        {"fat_100g": 25}, {"fat": 12}, {}, {"fat_100g": 0, "fat": 3}, {"fat_100g": "", "fat": 4},
        {"fat_100g": "abc", "fat": 5}, {"fat_100g": "nan", "fat": 6}, {"fat_100g": None, "fat": 7},
        {"fat_100g": None}, None, {"fat_100g": " ", "fat": 8}, {"fat_100g": "0.0", "fat": "x"},
    ]
    facts = product_facts(products(*[{"nutriments": n} for n in nutriments]))
    rows = facts.orderBy("barcode").select("fat", "has_fat").collect()
    assert [r.fat for r in rows] == [25, 12, 0, 3, 4, 0, 0, 7, 0, 0, 0, 0]
    assert [r.has_fat for r in rows] == [True, True, False, True, True, True, True, True, True, False, True, True]


def test_nutriments_as_struct_read_only_used_fields(spark, tmp_path):
    layout = T.StructType([T.StructField(n, T.DoubleType()) for n in ("fat_100g", "fat", "salt_100g", "zinc_100g")])
    schema = T.StructType([T.StructField("barcode", T.StringType()), T.StructField("nutriments", layout)])
    rows = [("1", (25.0, 1.0, None, 9.0)), ("2", (0.0, 3.0, 0.5, 9.0)), ("3", (None, None, None, None)), ("4", None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "c"))
    facts = product_facts(spark.read.parquet(str(tmp_path / "c")))
    got = facts.orderBy("barcode").select("fat", "salt", "fiber", "has_fat", "has_salt", "has_fiber").collect()
    assert [tuple(r) for r in got] == [
        (25.0, 0.0, 0.0, True, False, False), (3.0, 0.5, 0.0, True, True, False),
        (0.0, 0.0, 0.0, False, False, False), (0.0, 0.0, 0.0, False, False, False),
    ]
    plan = facts.select("fat")._jdf.queryExecution().executedPlan().toString()
    assert "nutriments:struct<fat_100g:double,fat:double>" in plan


def test_nutriments_of_another_type_are_refused(spark):
    with pytest.raises(TypeError):
        product_facts(spark.createDataFrame([("1", "x")], "barcode string, nutriments string"))
