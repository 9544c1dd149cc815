"""Bucketed rollups and long response files."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators import scope
from hearthpanel.sources import landed, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def without_broadcast(spark):
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        # Else a scan that only filters leaves its buckets out of the plan's text.
        "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    }
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_clustered_rollups_join_without_exchange_and_prune_by_district(spark, tmp_path, without_broadcast):
    layout = sinks.Clustering(buckets=8)
    rows = spark.range(4000).selectExpr("lpad(string(id % 40), 5, '0') AS district_code", "format_string('20%02d-01', id div 40) AS ym", "id AS n")
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    for name in names:
        sinks.write_clustered(rows, name, str(tmp_path / name), layout)
        assert len(list((tmp_path / name).glob("*.parquet"))) <= 8
    a, b = (spark.table(n) for n in names)
    both = a.join(b.withColumnRenamed("n", "m"), ["district_code", "ym"])
    assert "Exchange" not in plan(both) and both.filter("n = m").count() == 4000
    one = a.filter("district_code = '00007'")
    assert re.search(r"SelectedBucketsCount: 1 out of 8", plan(one)) and one.count() == 100
    spark.sql(f"DROP TABLE {names[0]}")  # the files of an external table stay
    again = sinks.open_clustered(spark, names[0], str(tmp_path / names[0]), rows.schema, layout)
    assert "Exchange" not in plan(again.join(b, ["district_code", "ym"])) and again.agg(F.sum("n")).first()[0] == sum(range(4000))
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    with pytest.raises(ValueError, match="at least one bucket"):
        sinks.Clustering(buckets=0)


def test_long_response_files_are_split(spark, tmp_path):
    head = "<?xml version='1.0'?><response><header><resultCode>{}</resultCode></header><body><items>"
    items = "".join(f"<item n='1'>\n<a> {i} </a><b>x&lt;{i}</b>\n</item>\n" for i in range(3000))
    (tmp_path / "long.xml").write_text(head.format("000") + items + "</items></body></response>")
    (tmp_path / "error.xml").write_text(head.format("22") + items[:200] + "</items></body></response>")
    (tmp_path / "plain.xml").write_text("<item><a>p</a></item><item><a>q</item><item/><item></item>\n<item><a>cut</a><b>of")
    (tmp_path / "empty.xml").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = landed.read_items(spark, str(tmp_path), ["a", "b"]).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    long = [r for r in got if r.file.endswith("long.xml")]
    assert sorted((int(r.a), r.b) for r in long) == [(i, f"x<{i}") for i in range(3000)]
    assert len({r.part for r in long}) > 3 and all(r.malformed is None for r in long)
    rest = [r for r in got if not r.file.endswith("long.xml")]
    assert {r.file.rsplit("/", 1)[-1] for r in rest} == {"plain.xml"}
    assert sorted((r.a or "", r.malformed is not None) for r in rest) == [("", False), ("", True), ("", True), ("p", False)]


def test_first_usable(spark):
    frame = spark.createDataFrame([(None, float("nan"), 2, "x")], "a int, b double, c int, d string")
    assert scope.first_usable(frame, ["z", "a", "b", "c"]) == "c"
    assert scope.first_usable(frame, ["a", "b"]) is None and scope.first_usable(frame, ["z"]) is None
