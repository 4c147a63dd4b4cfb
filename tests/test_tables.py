"""Snapshots of keyed tables: the same rows with and without, readers that are open meanwhile, folders that are read."""

import re

from siftweb.sources import tables


def _write(spark, at, seq, rows):
    tables.upsert_media_items(spark.createDataFrame(rows, "task_id long, url string, album string"), at, seq)


def _read(spark, at, task=None):
    return sorted((r["url"], r["album"]) for r in tables.read_media_items(spark, at, task).select("url", "album").collect())


def test_snapshots(spark, tmp_path):
    at = str(tmp_path / "items")
    _write(spark, at, 1, [(t, f"http://h/{t}/{i}", "one") for t in range(3) for i in range(4)])
    _write(spark, at, 2, [(1, "http://h/0/0", "moved"), (2, "http://h/2/1", "two")])
    plain = {t: _read(spark, at, t) for t in (None, 0, 1, 2)}
    opened = tables.read_media_items(spark, at, 1)
    assert tables.compact_media_items(spark, at) == 2
    assert {t: _read(spark, at, t) for t in (None, 0, 1, 2)} == plain
    assert sorted((r["url"], r["album"]) for r in opened.select("url", "album").collect()) == plain[1]
    _write(spark, at, 3, [(2, "http://h/1/2", "three"), (0, "http://h/9", "new")])
    after = {t: _read(spark, at, t) for t in (None, 0, 1, 2)}
    assert ("http://h/1/2", "three") in after[2] and ("http://h/1/2", "one") not in after[1] and len(after[None]) == len(plain[None]) + 1
    assert tables.compact_media_items(spark, at) == 3 == tables.compact_media_items(spark, at)
    assert {t: _read(spark, at, t) for t in (None, 0, 1, 2)} == after
    _write(spark, at, 3, [(2, "http://h/1/2", "three"), (0, "http://h/9", "new")])  # a write that is repeated
    assert {t: _read(spark, at, t) for t in (None, 0, 1, 2)} == after
    plan = tables.read_media_items(spark, at, 1)._jdf.queryExecution().executedPlan().toString()
    tested = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert len(tested) == 2 and any(re.search(r"task_id#\d+L? = 1", t) for t in tested) and any(re.search(r"write_seq#\d+L? > 3", t) for t in tested)


def test_an_unfinished_snapshot_does_not_count(spark, tmp_path):
    at = tmp_path / "items"
    _write(spark, str(at), 1, [(1, "http://h/a", "x")])
    (at / "_snapshots" / "upto=1" / "task_id=1").mkdir(parents=True)
    assert _read(spark, str(at), 1) == [("http://h/a", "x")]


def test_addresses_are_remembered_over_restarts(spark, tmp_path):
    from siftweb.streaming import jobs

    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    seen = []
    for run, names in enumerate((["a", "b", "a"], ["b", "c"], ["c", "a"], [None, "d"])):
        spark.createDataFrame([(n,) for n in names], "url string").coalesce(1).write.mode("append").parquet(source)
        jobs.run_first_seen(jobs.read_event_stream(spark, source, "url string"), out, mark)
        seen.append(sorted(r["url"] for r in spark.read.parquet(out).filter(f"write_seq = {run} AND url IS NOT NULL").collect()))
    assert seen == [["a", "b"], ["c"], [], ["d"]]
    # a batch that is run again gives the same
    query = jobs.read_event_stream(spark, source, "url string")
    jobs.run_first_seen(query, str(tmp_path / "again"), str(tmp_path / "mark2"))
    jobs.run_first_seen(jobs.read_event_stream(spark, source, "url string"), str(tmp_path / "again"), str(tmp_path / "mark3"))
    assert sorted(r["url"] or "" for r in spark.read.parquet(str(tmp_path / "again")).collect()) == ["", "a", "b", "c", "d"]
