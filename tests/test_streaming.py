"""Streams that run to their end give what the batch forms give."""

from __future__ import annotations

from quarry.sources import project
from quarry.streaming import events

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def drained(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_tumbling_equals_batch(spark, tables, tmp_path):
    (tmp_path / "events.parquet").symlink_to(f"{tables}/events.parquet")
    got = drained(events.tumbling(events.event_stream(spark, str(tmp_path), SCHEMA), "event_type"), "tumbled")
    want = events.tumbling(spark.read.parquet(f"{tables}/events.parquet"), "event_type")
    key = lambda rows: sorted((str(r.start), r.event_type, r.n) for r in rows.collect())
    assert key(got) == key(want)


def test_incremental_work_covers_dependents(spark):
    old = project.in_memory(spark, {"a.gd": "1", "b.gd": "2", "c.gd": "3", "gone.gd": "4"}).select("path", project.content_hash().alias("content_hash"))
    new = project.in_memory(spark, {"a.gd": "9", "b.gd": "2", "c.gd": "3", "d.gd": "5"}).select("path", project.content_hash().alias("content_hash"))
    changes = events.changed_files(old, new)
    assert {(r.path, r.change) for r in changes.collect()} == {("a.gd", "Modified"), ("gone.gd", "Deleted"), ("d.gd", "Added")}
    edges = spark.createDataFrame([("b.gd", "a.gd"), ("c.gd", "b.gd")], "src string, dst string")
    assert {r.path for r in events.affected(changes, edges).collect()} == {"a.gd", "b.gd", "c.gd", "d.gd", "gone.gd"}


def test_recompute_hands_over_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gd").write_text("var a = 1")
    stream = spark.readStream.schema("value string").option("wholetext", True).text(str(tmp_path / "in"))
    seen = []
    handle = lambda rows, _epoch: seen.extend(r.value for r in rows.collect())
    for text in (None, "var b = 2"):
        if text:
            (tmp_path / "in" / "b.gd").write_text(text)
        events.recompute(stream, handle, str(tmp_path / "state")).awaitTermination(120)
    assert seen == ["var a = 1", "var b = 2"]
