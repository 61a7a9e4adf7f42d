"""Exact top-k search over binary codes by incremental multi-index hashing, in joins.

A code is the signs of a vector, cut into 16-bit segments.  One index holds
every code under each of its segments' values.  All open queries grow their
search radius together: in a round with radii ``low`` to ``high`` the segment
values asked for meet the values held within that distance, their rows are
verified, and every query keeps its k nearest.  After radius r every row
within Hamming distance m (r + 1) - 1 of a query (m segments) has been met, so
a query closes once its k-th verified distance is at most that.  The last
radius reaches every value, so no query needs another way.  A row is verified
for a query once, at the first of its segments of least distance.

Of rows with equal codes only the k of least id can be answers, so no more are
indexed; queries with equal codes ask once.  The values asked and held are at
most 65,536 a segment, whatever the number of rows, so flips are made for
values, not for queries.  A segment value that many rows share is a hot key of
two plain joins, which adaptive execution splits.

Defined results: a null vector has no code and neither asks nor answers; null
ids don't ask, and as answers come last among equals; repeated rows answer
each, and ask once per id and code; missing, null and NaN coordinates count as
not positive and those beyond ``bits`` are left out; a query is among its own
answers; ties at the k-th distance go to the smallest ids; with fewer than k
rows all are returned; an empty table or no query gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.staging import staged

SEGMENT, WORD = 16, 64
#: Radii of the rounds: the first ones have few values each and go together.
FIRST_RADIUS = 2
#: Up to so many segments their held values (at most 2 ** 19 rows of 8 bytes) are broadcast.
BROADCAST_SEGMENTS = 8


def sign_words(vector: Column, bits: int) -> list[Column]:
    """The signs of the first ``bits`` coordinates as 64-bit words, first coordinate highest."""
    wide = vector.cast("array<double>")

    def bit(at: int) -> Column:
        positive = F.coalesce(F.nanvl(F.get(wide, F.lit(at)), F.lit(0.0)), F.lit(0.0)) > 0
        place = 1 << (WORD - 1 - at % WORD)
        return F.when(positive, F.lit(place - (1 << WORD) if place >> 63 else place).cast("long")).otherwise(F.lit(0).cast("long"))

    return [reduce(lambda x, y: x.bitwiseOR(y), [bit(at) for at in range(w, min(w + WORD, bits))]) for w in range(0, bits, WORD)]


def _segments(words: list[Column], n: int) -> list[Column]:
    return [F.shiftrightunsigned(words[s * SEGMENT // WORD], WORD - SEGMENT - s * SEGMENT % WORD).bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int") for s in range(n)]


def _posted(rows: DataFrame, words: list[str], n: int) -> DataFrame:
    """``rows`` once for every segment, with (segment, value)."""
    values = F.array(*_segments([F.col(w) for w in words], n))
    return rows.select("*", F.posexplode(values).alias("segment", "value"))


def _met(asked: DataFrame, index: DataFrame, low: int, high: int, words: list[str], n: int) -> DataFrame:
    """(q words, vec_id, distance) of the rows whose nearest segment is ``low`` to ``high`` from the query's."""
    flips = F.split(F.lit(",".join(str(x) for x in range(1 << SEGMENT) if low <= x.bit_count() <= high)), ",").cast("array<int>")
    q = [f"q{w}" for w in words]
    posted = _posted(asked.select(*[F.col(c).alias(w) for c, w in zip(q, words)], "kth"), words, n).select(*[F.col(w).alias(c) for c, w in zip(q, words)], "kth", "segment", F.col("value").alias("asked"))
    held = index.select("segment", "value").distinct()
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = posted.select("segment", "asked").distinct().repartition(parts, F.xxhash64("segment", "asked"))  # each row becomes many
    wanted = spread.select("segment", "asked", F.explode(flips).alias("flip")).select("segment", "asked", F.col("asked").bitwiseXOR(F.col("flip")).alias("value"))
    # The values held number at most 65,536 a segment; the pairs of buckets have no such bound.
    held = F.broadcast(held) if n <= BROADCAST_SEGMENTS else held.hint("merge")
    buckets = wanted.join(held, ["segment", "value"])
    pairs = buckets.hint("merge").join(posted, ["segment", "asked"]).join(index.hint("merge"), ["segment", "value"])
    apart = [F.col(a).bitwiseXOR(F.col(w)) for a, w in zip(q, words)]
    near = [F.bit_count(s) for s in _segments(apart, n)]
    least = F.least(*near) if n > 1 else near[0]
    first = reduce(lambda rest, s: F.when(near[s] == least, F.lit(s)).otherwise(rest), reversed(range(n)), F.lit(n))
    distance = reduce(add, [F.bit_count(x) for x in apart]).cast("int")
    fits = (first == F.col("segment")) & (least >= low) & (F.col("kth").isNull() | (distance <= F.col("kth")))
    return pairs.where(fits).select(*q, "vec_id", distance.alias("distance"))


def hamming_topk(rows: DataFrame, is_query: Column, k: int = 10, bits: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows of every query row, ties by id."""
    n = -(-bits // SEGMENT)
    vectors = rows.where(rows["embedding"].isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), "embedding")
    columns = sign_words(F.col("embedding"), bits)
    words = [f"w{i}" for i in range(len(columns))]
    q = [f"q{w}" for w in words]
    codes = staged(vectors.select("vec_id", "asks", *[c.alias(w) for c, w in zip(columns, words)]), "codes")
    least_ids = Window.partitionBy(*words).orderBy(F.col("vec_id").asc_nulls_last())
    answers = codes.select("vec_id", *words, F.row_number().over(least_ids).alias("place")).where(F.col("place") <= k).drop("place")
    index = staged(_posted(answers, words, n), "index")
    want = min(k, codes.count())
    asking = codes.where("asks AND vec_id IS NOT NULL").select(F.col("vec_id").alias("query_id"), *[F.col(w).alias(c) for c, w in zip(q, words)]).distinct()
    queries = staged(asking.select(*q).distinct(), "queries")
    nearest = Window.partitionBy(*q).orderBy("distance", F.col("vec_id").asc_nulls_last())
    best: DataFrame | None = None
    asked = queries.withColumn("kth", F.lit(None).cast("int"))
    low, high = 0, FIRST_RADIUS
    while True:
        found = _met(asked, index, low, high, words, n)
        found = found if best is None else best.drop("rank").unionByName(found)
        best = staged(found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k), "best")
        low, high = high + 1, high + 1
        if high > SEGMENT:
            break
        kth = best.groupBy(*q).agg(F.when(F.count("*") >= want, F.max("distance")).alias("kth"))
        asked = staged(queries.join(kth, q, "left").where(F.col("kth").isNull() | (F.col("kth") > n * low - 1)), "asked")
        if asked.isEmpty():
            break
    return asking.join(best, q).select("query_id", "rank", "vec_id", "distance")
