"""Staging for the corpus operators, and the size of their Arrow batches."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession

from quarry.staging import drop_staged, shared_dir, staged, staging_dir

__all__ = ["ARROW_BYTES", "drop_staged", "free_shuffles", "shared_dir", "small_arrow_batches", "staged", "staging_dir"]

#: What one Arrow batch of whole texts may hold in a Python worker (one row at least).
ARROW_BYTES = 8 << 20


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; one setting for all operators, so frames that run later keep their bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's collector find the shuffles that only past, staged work used, so that their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
