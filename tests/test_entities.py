"""Small operators over extracted entities, where the queries have no such rows."""

import re

from pyspark.sql import functions as F

from procgraph.operators import entities


def test_evidence_switched_off(spark):
    e = spark.createDataFrame([("Task", "1"), ("Process", "1"), ("Other", "2")], "label string, id string")
    c = spark.createDataFrame([("c",)], "chunk_id string")
    x = spark.createDataFrame([("1", "c"), ("2", "c"), ("1", "gone")], "entity_id string, chunk_id string")
    assert [tuple(r) for r in entities.labelled_evidence(e, c, x).collect()] == [("Process", "1", "c")]
    assert entities.labelled_evidence(e, c, x, "off").count() == 0


def test_empty_and_null_values(spark):
    df = spark.createDataFrame([(" x " * 3, None, "high"), (None, "d", "0.8"), ("n", "", None)], "n string, d string, c string")
    assert [r[0] for r in df.select(entities.search_text("n", "d")).collect()] == [" x " * 3, ". d", "n"]
    assert [r[0] for r in df.select(entities.shortened(F.col("n"), 4)).collect()] == ["x  x…", "", "n"]
    assert [r[0] for r in df.withColumn("a", F.lit("map")).select(entities.decided("a", "c")).collect()] == ["none", "map", "none"]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", df.select(entities.now_iso()).first()[0])


def test_explicit_mappings(spark):
    m = spark.createDataFrame([("check", "A", 0), ("check", "B", 1), ("nothing", "A", 2), ("check order", "unknown", 3), ("", "A", 4)], "task_name string, target_name string, seq int")
    t = spark.createDataFrame([("t1", "Ship", 0), ("t2", "Check order", 1), ("t3", "check", 2)], "task_id string, name string, seq int")
    x = spark.createDataFrame([("a", "A", 0), ("b", "b", 1)], "id string, name string, seq int")
    assert {tuple(r) for r in entities.explicit(m, t, x).collect()} == {("t2", "b"), ("t1", "a")}
