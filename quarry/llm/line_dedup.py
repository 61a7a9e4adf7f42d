"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with
A-Z lower-cased; its hash is 128 bits of BLAKE2b.  ``LevelledRuns`` keeps, in
the shared folder, runs of (key, number of documents) in sorted buckets.  Each
new batch of documents is merge-anti-joined with the run of settled keys (those
that already reached the threshold need no further counting) and what is left
becomes a run of level 0; ``fanout`` runs of one level are merged into one run
of the next, bucket by bucket.  Lines whose key is settled at the end go from every document.

Defined results: a null or empty text is one empty line, never dropped
(an empty key is below ``min_chars``); a row counts once for each of its
distinct keys, so a line repeated within one document counts once; rows that
repeat a doc_id count each; an empty table gives an empty result; the input
row travels in the struct column ``doc``, so no input column name can clash.
Very long texts are handled line by line within one row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.staging import small_arrow_batches, staged, staging_dir

_STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int = 1) -> list[bytes | None]:
    """A 16-byte key hash for each line; None for keys below ``min_chars`` code points."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8").lower().split(b"\n"):
        key = line.strip(_STRIP)
        short = len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8")) < min_chars)
        out.append(None if short else hashlib.blake2b(key, digest_size=16).digest())
    return out


def _distinct_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for rk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for k in line_keys(text, min_chars) if k is not None}
                rows.extend([rk] * len(own))
                keys.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary())], names=["rk", "key"])

    return run


def _dropper(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                gone = set(drop or ())
                if gone:
                    stay = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key not in gone]
                else:
                    stay = lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["doc", "n_lines", "n_dropped", "kept"],
            )

    return run


class LevelledRuns:
    """Sorted runs of (key, n) in levels; ``fanout`` runs of a level merge into the next.

    A run is a table of sorted buckets by key, each one file; runs have equally
    many buckets, so merges and anti-joins go bucket by bucket and no run is
    ever shuffled again.  Only a new batch is.
    """

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 2, buckets: int | None = None):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.settled: DataFrame | None = None
        self.tables: list[str] = []

    def _run(self, counts: DataFrame) -> DataFrame:
        """``counts`` written as a run; it has to be dealt by key already."""
        name = f"quarry_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{staging_dir(self.spark)}/{name}").saveAsTable(name, format="parquet")
        self.tables.append(name)
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One (key, n) of several runs, joined bucket by bucket."""
        out = runs[0]
        for run in runs[1:]:
            more = run.select("key", F.col("n").alias("more")).hint("merge")
            out = out.join(more, "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return out

    def add(self, counts: DataFrame) -> None:
        """Take a batch's (key, n); keys that are settled already are left out."""
        dealt = counts.repartition(self.buckets, "key")
        if self.settled is not None:
            dealt = dealt.join(self.settled.hint("merge"), "key", "left_anti")
        self._put(self._run(dealt), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._run(self._merged(self.levels[level]))
            self.levels[level] = []
            fresh = merged.where(F.col("n") >= self.threshold).select("key")
            self.settled = self._run(fresh if self.settled is None else self.settled.join(fresh.hint("merge"), "key", "full"))
            self._put(merged, level + 1)

    def frequent(self) -> DataFrame | None:
        """Keys of at least ``threshold`` documents over all batches, once each."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        summed = self._merged(runs).where(F.col("n") >= self.threshold).select("key")
        return summed if self.settled is None else self.settled.join(summed.hint("merge"), "key", "full")

    def drop(self) -> None:
        """Forget the runs' tables; what was made of them has to be staged."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def line_dedup(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, batch_docs: int = 4_000_000, least_batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc struct, n_lines, n_dropped, kept) for every row of ``docs``."""
    small_arrow_batches(docs.sparkSession)
    body: Column = docs[text].cast("string")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), body.alias("_text"))
    # A row key from all of the row: equal rows share it, and a chance collision only
    # adds frequent keys to a row that has no line with them.
    keyed = whole.select("doc", "_text", F.xxhash64("doc", "_text").alias("rk"))
    has_key = keyed.select("rk", "_text").mapInArrow(_distinct_keys(min_chars), "rk long, key binary")
    batches = max(least_batches, -(-docs.count() // batch_docs))
    counts = has_key.groupBy(F.pmod(F.xxhash64("rk"), F.lit(batches)).cast("int").alias("batch"), "key").agg(F.count("*").alias("n"))
    folder = f"{staging_dir(docs.sparkSession)}/line-batches-{uuid.uuid4().hex}"
    counts.write.partitionBy("batch").parquet(folder)
    runs = LevelledRuns(docs.sparkSession, min_docs, fanout)
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("batch", T.IntegerType())])
    try:
        for b in range(batches):
            runs.add(docs.sparkSession.read.schema(schema).parquet(folder).where(F.col("batch") == b).select("key", "n"))
        frequent = staged(runs.frequent(), "line-frequent")
    finally:
        runs.drop()
    drops = has_key.join(frequent, "key", "left_semi").groupBy("rk").agg(F.collect_set("key").alias("drop"))
    schema = T.StructType(
        [
            T.StructField("doc", whole.schema["doc"].dataType),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    return keyed.join(drops, "rk", "left").select("doc", "_text", "drop").mapInArrow(_dropper(min_chars), schema)
