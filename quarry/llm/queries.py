"""Registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.license_scan import license_scan

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan(docs, keep=["doc_id"])
    return found.select("doc.doc_id", "license_family", F.round("probability", 6).alias("probability"), F.round("template_share", 6).alias("template_share"), F.array_join("families", ",").alias("families"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.warc import read_archives, write_archives

    archives = write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.html_text import extract_text

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, keep=["page_id", "url"]).select("doc.page_id", "doc.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.line_dedup import line_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.hamming_topk import hamming_topk

    return hamming_topk(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10, bits=64)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quarry.llm.byte_bpe import round_trip_digests

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quarry.llm.packing import pack

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import fit_toxicity, held_out, score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, net, keep=["doc_id"]).select("doc.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_rules import quality_filter

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_filter(docs, _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_jaccard_join": op1_jaccard_join, "op2_hamming_topk": op2_hamming_topk, "op3_byte_bpe": op3_byte_bpe, "op4_packing": op4_packing, "op5_toxicity": op5_toxicity, "op6_quality_rules": op6_quality_rules, "op7_license_scan": op7_license_scan, "op8_warc": op8_warc, "op9_html_text": op9_html_text, "op10_line_dedup": op10_line_dedup}

