"""The pipeline again, plainly: the two learned stages by their operators, the rest by brute force."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from test_text_operators import LOWER, components


def plain_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality(spark, corpus_pipeline.toxicity(spark, docs, sf_dir), sf_dir)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    spread = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    rows = [(i, "\n".join(x for x in (t or "").split("\n") if not key(x) or spread[key(x)] < 10)) for i, t in rows]
    lead = components(rows)
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows if lead[i][1] == i or lead[i][0] == 0}, rows
