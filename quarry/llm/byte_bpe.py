"""Byte-level BPE by backtracking over an Aho-Corasick automaton.

Token bytes are mapped to Latin-1 characters, so that one automaton finds every
token of a piece in one pass.  Encoding takes the longest token at each place
and steps back when it can't stand next to its left neighbour.  Whether two
tokens may be neighbours (merging their joined bytes gives just these two) is
worked out once per pair and kept.  A token row whose neighbours are all
compatible is the row that merging by rank gives, so the result is exact; every
place is left for good at most once, so the work is linear in the piece.

Pieces (matches of the pre-tokeniser's pattern) repeat, so their ids are kept
too, in a memo of bounded size.  Decoding joins the bytes of ids.

Defined results: null is the empty text, which has no ids; equal rows get
equal ids; a long text is one row's work, in pieces; extra columns travel in
the struct ``doc``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.staging import small_arrow_batches

MEMO_PIECES, MEMO_PAIRS = 300_000, 1_000_000

# The characters of the Unicode property White_Space, as a class body.
_WHITE_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def piece_pattern(pattern: str) -> regex.Pattern:
    """The pattern with ``\\s`` as the Unicode property, also inside classes."""
    pattern = pattern.replace(r"[^\s", f"[^{_WHITE_SPACE}").replace(r"\S", f"[^{_WHITE_SPACE}]").replace(r"\s", f"[{_WHITE_SPACE}]")
    return regex.compile(pattern)


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition: join the neighbours of lowest rank until none can be joined."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


class _Pieces(dict):
    """Ids of pieces; a missing piece is encoded, and the memo starts anew when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMO_PIECES:
            self.clear()
        ids = self[piece] = tuple(self.encode(piece.encode("utf-8")))
        return ids


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.find = piece_pattern(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self.encode_piece)

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = merge_by_rank(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        starting: list[list[int]] = [[] for _ in range(n)]  # ids of the tokens from a place, short to long
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            starting[end + 1 - length].append(rank)
        out: list[int] = []
        choice: list[int] = []  # which of its place's tokens each id of ``out`` is
        dead = bytearray(n + 1)  # places from which the rest can't be encoded
        at, pick = 0, len(starting[0]) - 1
        while at < n:
            while pick >= 0:
                rank = starting[at][pick]
                to = at + len(self.bytes_of[rank])
                if not dead[to] and (not out or self.compatible(out[-1], rank)):
                    break
                pick -= 1
            if pick >= 0:
                out.append(rank)
                choice.append(pick)
                at = to
                pick = len(starting[at]) - 1 if at < n else -1
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the ranks don't cover all bytes of the text")
                at -= len(self.bytes_of[out.pop()])
                pick = choice.pop() - 1
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> ByteBPE:
    """One codec per Python worker."""
    return ByteBPE(load_ranks(ranks_path), pattern)


def _packed(docs: DataFrame, text: str) -> DataFrame:
    small_arrow_batches(docs.sparkSession)
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[text].alias("_text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc struct, ids array<int>) for every row."""
    packed = _packed(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for b in batches:
            ids = pa.array([own.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc", "ids"])

    return packed.mapInArrow(run, T.StructType([packed.schema["doc"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """(doc struct, decoded binary) for every row with an array of ids."""
    packed = _packed(rows, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for b in batches:
            data = pa.array([own.decode(i or []) for i in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data], names=["doc", "decoded"])

    return packed.mapInArrow(run, T.StructType([packed.schema["doc"], T.StructField("decoded", T.BinaryType())]))


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, without shipping either."""
    small_arrow_batches(docs.sparkSession)
    body = docs.select("doc_id", docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for b in batches:
            n, coded, back = [], [], []
            for t in b.column(1).to_pylist():
                ids = own.encode(t or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return body.mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
