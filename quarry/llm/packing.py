"""Packing: first-fit decreasing into sequences of 2048 tokens.

Every text is tokenised whole; token id 1 ends each document.  A document is
cut into full pieces and one rest; pieces are dealt at random into groups of
about ``group_size`` and each group is packed on its own by first-fit
decreasing, the first bin that has room being found in a tournament tree of
bin capacities (the winner of a node is its largest free capacity).  Groups are
bounded, so no source, copy group or long document can fill a task.

Ids are those of the ``tokenizers`` library for the given file.  Texts of code
points below U+0250 without a special token are encoded by ``tiktoken`` with
the same vocabulary, which gives the same ids several times as fast (a test
compares both on every pair of these code points next to letters, digits and
white space); all other texts by ``tokenizers`` itself.

Defined results: a null or empty text is the single id 1; rows that repeat an
id are packed each; an empty table packs into nothing; extra columns are not
read; a very long text is cut into as many pieces as it needs, in row order.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.staging import small_arrow_batches, staged

CAPACITY = 2048
END_ID = 1
_PLAIN = re.compile("[\\x00-ɏ]*")


@lru_cache(maxsize=4)
def _encoders(json_path: str, ranks_path: str, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return slow, fast, special


def token_ids(text: str | None, json_path: str, ranks_path: str, pattern: str) -> np.ndarray:
    """The text's ids, then the end id."""
    slow, fast, special = _encoders(json_path, ranks_path, pattern)
    text = text or ""
    if _PLAIN.fullmatch(text) and not any(s in text for s in special):
        ids = fast.encode_to_numpy(text, disallowed_special=())
    else:
        ids = np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids.astype("<u4"), np.array([END_ID], "<u4"))


class Tournament:
    """Free capacities of bins; every node knows the largest below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, capacity that was free) of the first bin with room for ``size``."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        had = free[at]
        free[at] = had - size
        bin_no = at - self.leaves
        while at > 1:
            at //= 2
            top = free[2 * at] if free[2 * at] >= free[2 * at + 1] else free[2 * at + 1]
            if free[at] == top:
                break
            free[at] = top
        return bin_no, had


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, the longest placed first (ties in order)."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree = Tournament(max(1, len(lengths)), capacity)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        bin_no, had = tree.place(lengths[i])
        out[i] = (bin_no, capacity - had)
    return out


def _cutter(json_path: str, ranks_path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rng = np.random.default_rng(context.partitionId() if context else 0)
        for batch in batches:
            row, start, length, crc, total, ids_of = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = token_ids(text, json_path, ranks_path, pattern)
                for at in range(0, len(ids), CAPACITY):
                    piece = ids[at : at + CAPACITY]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        ids_of.append(piece.astype(np.int32))
            columns = {
                "doc_id": batch.column(0).take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "lot": pa.array(rng.integers(0, 1 << 62, len(row))),
            }
            if with_ids:
                columns["ids"] = pa.array(ids_of, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _pack_group(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("lot", kind="stable")
    placed = first_fit_decreasing(pieces["length"].tolist())
    group = int(pieces["group"].iloc[0])
    pieces["sequence_id"] = [(group << 24) + b for b, _ in placed]
    pieces["offset"] = [o for _, o in placed]
    return pieces.drop(columns=["lot", "group"])


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, text: str = "text", group_size: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    small_arrow_batches(docs.sparkSession)
    body = docs.select("doc_id", docs[text].cast("string").alias("text"))
    kind = body.schema["doc_id"].dataType.simpleString()
    tail = ", ids array<int>" if with_ids else ""
    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = staged(body.mapInArrow(_cutter(json_path, ranks_path, pattern, with_ids), f"{columns}, lot long{tail}"), "pieces")
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.withColumn("group", F.pmod("lot", F.lit(groups)).cast("long"))
    packed = dealt.groupBy("group").applyInPandas(_pack_group, f"{columns}{tail}, sequence_id long, offset long")
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
