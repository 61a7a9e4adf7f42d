"""Structured Streaming forms: debounced bursts, tumbling counts, and incremental recomputation of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import graph


def event_stream(spark: SparkSession, folder: str, schema: str, watermark: str = "10 minutes") -> DataFrame:
    """Parquet files of a folder as a stream with event time ``ts`` and a watermark."""
    raw = spark.readStream.schema(schema).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def debounced(stream: DataFrame, group: str, gap: str = "10 minutes") -> DataFrame:
    """One row per burst, sent once the watermark passes its gap."""
    return stream.groupBy(group, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(group, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def tumbling(stream: DataFrame, group: str, width: str = "1 day") -> DataFrame:
    return stream.groupBy(F.window("ts", width).alias("w"), group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two (path, content_hash) snapshots."""
    both = old.select("path", F.col("content_hash").alias("a")).join(new.select("path", F.col("content_hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Deleted").when(F.col("a") != F.col("b"), "Modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def affected(changes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Changed paths and all that depend on them, directly or not."""
    seeds = changes.select(F.col("path").alias("node"))
    back = graph.closure(dependencies.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)
    return seeds.select(F.col("node").alias("path")).unionByName(back.select(F.col("dst").alias("path"))).distinct()


def recompute(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of (path, text) to ``handle`` once, all that is there now."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watched_files(spark: SparkSession, folder: str, pattern: str = "*.gd") -> DataFrame:
    """(path, text, ts): files of a folder as a stream; a file that is written again comes again under its new name or folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("ts"))


def two_tier(stream: DataFrame, group: str, fast: str = "300 milliseconds", slow: str = "800 milliseconds") -> tuple[DataFrame, DataFrame]:
    """Bursts by a short and a longer gap: syntax is told early, meaning once edits pause longer."""
    return debounced(stream, group, fast), debounced(stream, group, slow)


def newest_versions(edits: DataFrame) -> DataFrame:
    """(path, version, text): of documents the highest version; an open document (version given) stands before the file on disk."""
    return edits.groupBy("path").agg(F.max_by(F.struct("version", "text"), F.coalesce(F.col("version"), F.lit(-1))).alias("e")).select("path", "e.version", "e.text")


def renamed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path, path): files gone and come with one content; of equal contents the least paths meet."""
    gone = old.join(new.select("path"), "path", "left_anti").groupBy("content_hash").agg(F.min("path").alias("old_path"))
    come = new.join(old.select("path"), "path", "left_anti").groupBy("content_hash").agg(F.min("path").alias("path"))
    return gone.join(come, "content_hash").select("old_path", "path")


def direct_dependents(changes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Changed paths and those that depend on them directly: what one change invalidates."""
    one = changes.select("path").distinct()
    hop = dependencies.join(one.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path"))
    return one.unionByName(hop).distinct()


def scripts_of_scenes(changes: DataFrame, scene_nodes: DataFrame) -> DataFrame:
    """(path): scripts to look at again when scenes change."""
    return scene_nodes.join(changes.select("path").distinct(), "path", "left_semi").where("script IS NOT NULL").select(F.substring("script", 7, 4096).alias("path")).distinct()


def renamed_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, line, old_name, name): nodes of scenes whose name changed while line, type and parent stayed."""
    key = ["path", "line", "type", "parent"]
    a = old.select(*key, F.col("name").alias("old_name"))
    same = F.lit(True)
    for k in key:
        same = same & new[k].eqNullSafe(a[k])
    return new.join(a, same).where(new["name"] != F.col("old_name")).select(new["path"], new["line"], "old_name", new["name"])


def changed_calls(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) call sites between two versions of a project's calls."""
    columns = [c for c in old.columns if c in new.columns]
    return old.select(*columns).exceptAll(new.select(*columns)), new.select(*columns).exceptAll(old.select(*columns))


def watch(stream: DataFrame, report: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Append what ``report`` finds in each micro-batch of files to a folder, with the batch's number."""

    def handle(batch: DataFrame, number: int) -> None:
        report(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(folder)

    return recompute(stream, handle, checkpoint)
