from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.llm import jaccard_join
from shelfwise.llm.key_bits import key_bits, may_hold
from shelfwise.sources.sinks import _file_system


def test_no_key_is_missed_and_few_others_are_marked(spark, documents):
    documents([])  # ships the package
    keys = spark.range(0, 40_000, 2).select("id", F.md5(F.col("id").cast("string")).alias("name"))
    keys = keys.union(spark.sql("select cast(null as long), cast(null as string)"))
    rows = spark.range(40_000).select("id", F.md5(F.col("id").cast("string")).alias("name"))
    marked = rows.withColumn("marked", may_hold(key_bits(keys, "id", "name"), "id", "name"))
    assert marked.filter("marked and id % 2 = 0").count() == 20_000
    assert marked.filter("marked and id % 2 = 1").count() < 200
    assert not rows.filter(may_hold(key_bits(keys.limit(0), "id"), "id")).head()


def test_texts_without_a_partner_are_left_out_before_the_shuffle(documents, monkeypatch):
    """Sets are made of marked rows only, when the wide tables of all rows are gone."""
    seen, table = {}, jaccard_join.Staging.table

    def noted(self, df, name):
        if name == "sets":
            system, folder = _file_system(self._spark, self.folder)
            seen["held"] = {s.getPath().getName().rpartition("-")[0] for s in system.listStatus(folder)}
            seen["plan"] = df._jdf.queryExecution().optimizedPlan().toString()
        return table(self, df, name)

    monkeypatch.setattr(jaccard_join.Staging, "table", noted)
    own = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(50)]
    frame = documents([*own, (50, own[0][1] + " more")])
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(frame, 4, 85).collect()}
    assert found == {i: i % 50 for i in range(51)}
    assert "marked(" in seen["plan"] and not seen["held"] & {"rows", "classes", "shared", "postings"}
