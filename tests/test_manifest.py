"""Downloads are judged once on their way into the manifest, and a hot address is split."""

from pyspark.sql import functions as F

from siftweb.operators import audit
from siftweb.scale import only

KINDS = "url string, path string, item_kind string, content_type string, status int, expected long, actual long, md5 string, expected_md5 string, problem string"


def _manifest(spark, rows):
    items = spark.createDataFrame([("http://h/a.jpg", "al", 3, 4, 0.0), ("http://h/a.jpg", "zz", 3, 4, 0.0)], "url string, album string, width long, height long, duration double")
    judged = audit.download_verdict(spark.createDataFrame(rows, KINDS).repartition(3))
    return audit.manifest_line(audit.manifest_rows(only(judged, F.col("ok")).withColumn("size", F.col("actual")), items)).select("path", "url", "line")


def _row(url, path, status=200):
    return url, path, "", "image/jpeg", status, 10, 10, "m", None, ""


def test_downloads_are_judged_once(spark):
    lines = _manifest(spark, [_row("http://h/a.jpg", "p1"), _row("http://h/b.jpg", "p2"), _row("http://h/a.jpg", "p3", 404), _row(None, "p4")])
    assert {(r.path, r.line and r.line.split("\n")[0]) for r in lines.collect()} == {("p1", "[image] al 3x4 http://h/a.jpg"), ("p2", "[image] http://h/b.jpg"), ("p4", None)}
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("MD5校验失败") == 1


def test_a_hot_address_is_split(spark):
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1"}
    before = {name: spark.conf.get(name) for name in small}
    try:
        for name, value in {**small, "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}.items():
            spark.conf.set(name, value)
        rows = [_row("http://h/a.jpg" if i % 3 else None, f"p{i}") for i in range(6000)] + [_row(f"http://h/{i}.jpg", f"q{i}") for i in range(200)]
        lines = _manifest(spark, rows)
        lines.collect()
        assert "skew=true" in lines._jdf.queryExecution().executedPlan().toString()
        assert lines.filter(F.col("line").contains("al 3x4")).count() == 4000 and lines.count() == 6200
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
