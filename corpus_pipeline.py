"""Corpus pipeline: five stages, each calling one operator of ``quarry.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage as Parquet
into the shared folder and reads it back for the next.

Columns beside those of ``documents`` pass through the filtering stages, also
where their names are those of results; rows with a null or repeated id are
rows like others.  A null or empty text scores as an empty text, fails the base
quality rule and goes there.  Where line dedup changes a text, ``n_chars`` is
its new length.  Of near duplicates the row of the least id stays, of equal ids
that of the least row key, of equal rows one.  Very long texts are rows like
others; an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.jaccard_join import jaccard_components
from quarry.llm.line_dedup import line_dedup
from quarry.llm.packing import pack
from quarry.llm.quality_rules import quality_filter
from quarry.llm.staging import staged
from quarry.llm.toxicity import fit_toxicity, score_toxicity

TOXIC_FROM = 0.7


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    net = fit_toxicity(docs, _labels(spark, sf_dir))
    return score_toxicity(docs, net).where(F.col("score") < TOXIC_FROM).select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    return quality_filter(docs, _labels(spark, sf_dir)).where("kept").select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents share."""
    done = line_dedup(docs)
    fresh = {"text": F.when(F.col("doc.text").isNotNull(), F.col("kept")), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("doc.n_chars"))}
    return done.select(*[(fresh[c] if c in fresh else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the smallest id."""
    groups = jaccard_components(docs)
    single = groups.where(F.col("rk") == F.col("component_rk")).groupBy("rk").agg(F.max("n_shingles").alias("n"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.xxhash64(docs["doc_id"], docs["text"].cast("string")).alias("rk"))
    kept = keyed.join(single.hint("merge"), "rk")
    # Rows with one row key are equal but for extra columns; of those with shingles one stays.
    alone = kept.where("n = 0").select("doc")
    first = kept.where("n > 0").groupBy("rk").agg(F.first("doc").alias("doc")).select("doc")
    return alone.unionByName(first).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("packing", packing)]

#: Learned stages have no SQL form; tests hold ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
