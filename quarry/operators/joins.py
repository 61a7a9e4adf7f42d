"""Lookups between tables: used and unused, ranked resolution, division, containment, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(entities: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    return entities.join(uses.select(key), key, "left_anti")


def used(entities: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    return entities.join(uses.select(key), key, "left_semi")


def resolve_first(candidates: DataFrame, key: str, rank: list[str], value: str) -> DataFrame:
    """One row per key: the value of the lowest rank (an aggregation, not a sort)."""
    best = candidates.groupBy(key).agg(F.min(F.struct(*rank, value)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in [*rank, value]])


def divide(pairs: DataFrame, required: DataFrame, left: str, right: str) -> DataFrame:
    """Relational division: lefts that have every required right."""
    need = required.select(right).distinct()
    have = pairs.join(need, right).groupBy(left).agg(F.countDistinct(right).alias("n"))
    return have.join(need.agg(F.count("*").alias("n")), "n").select(left)


def consensus(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys all of whose values agree."""
    return rows.groupBy(key).agg(F.min(value).alias("value"), F.max(value).alias("_high"), F.count("*").alias("n")).where("value = _high").drop("_high")


def first_match(conditions: list[tuple[Column, str]], otherwise: str) -> Column:
    """The reason of the first condition that holds."""
    out = F.when(conditions[0][0], conditions[0][1])
    for test, reason in conditions[1:]:
        out = out.when(test, reason)
    return out.otherwise(otherwise)


def fuzzy_pairs(names: DataFrame, candidates: DataFrame, name: str, candidate: str, most: int = 3) -> DataFrame:
    """(name, candidate, distance) with a Levenshtein distance of 1 to ``most``.

    Two names that near share one of ``most`` + 1 pieces of the longer blocking
    key at a place shifted by at most ``most``; blocks are those pieces, so no
    pair is formed that shares none.
    """
    parts = most + 1

    def piece(column: Column, i: Column, n: Column, shift: Column) -> Column:
        size = F.ceil(n / parts).cast("int")
        long = F.greatest(F.least(size, n - i * size), F.lit(0))
        return F.struct(i.cast("int").alias("i"), F.lower(F.substring(column, F.greatest(i * size + 1 + shift, F.lit(1)).cast("int"), long.cast("int"))).alias("p"), n.cast("int").alias("n"))

    def pieces(column: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: piece(column, i, F.length(column), F.lit(0)))

    def windows(column: Column) -> Column:
        """The pieces of a name of each near length, read at each near place.

        A piece moved by ``shift`` in names whose lengths differ by ``apart`` takes at
        least |shift| edits before it and |apart + shift| after it.
        """
        near = range(-most, most + 1)
        every = [(i, apart, shift) for i in range(parts) for apart in near for shift in near if abs(shift) + abs(apart + shift) <= most]
        places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(apart).alias("apart"), F.lit(shift).alias("shift")) for i, apart, shift in every])
        return F.array_distinct(F.transform(places, lambda c: piece(column, c["i"], F.length(column) + c["apart"], c["shift"])))

    left = names.select(name, F.explode(pieces(F.col(name))).alias("k"))
    right = candidates.select(candidate, F.explode(windows(F.col(candidate))).alias("k"))
    pairs = left.join(right, "k").select(name, candidate).distinct()
    distance = F.levenshtein(F.col(name), F.col(candidate), most)
    return pairs.withColumn("distance", distance).where((F.col("distance") > 0) & (F.col("distance") <= most))


def contained(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points within a span of the same key."""
    return points.join(spans, key).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
