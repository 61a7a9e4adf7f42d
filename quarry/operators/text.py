"""Line and token views of text tables, and the rollups over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scores import maintainability_index


def line_counts(text: Column, comment: str = "#") -> list[Column]:
    """Total, blank, comment and code lines of a text as columns, without exploding it.

    Lines end at CRLF or LF; an empty or null text has no lines.
    """
    lines = F.when(F.length(text) > 0, F.split(text, "\r\n|\n")).otherwise(F.array().cast("array<string>"))
    trimmed = F.transform(lines, lambda x: F.trim(F.translate(x, "\t\r", "  ")))
    total = F.size(trimmed).cast("long")
    blank = F.size(F.filter(trimmed, lambda x: x == "")).cast("long")
    notes = F.size(F.filter(trimmed, lambda x: x.startswith(comment))).cast("long")
    return [total.alias("total"), blank.alias("blank"), notes.alias("comment"), (total - blank - notes).alias("code")]


def lines(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line from 1, text) rows."""
    return table.select(key, F.posexplode(F.split(F.col(text), "\r\n|\n")).alias("pos", "line_text")).select(key, (F.col("pos") + 1).alias("line"), "line_text")


def average_of_averages(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Mean over the groups' means, as a project's averages are built from its files'."""
    return rows.groupBy(outer, inner).agg(F.avg(value).alias("_m")).groupBy(outer).agg(F.avg("_m").alias(f"avg_{value}"), F.count("*").alias("groups"))


def with_maintainability(rows: DataFrame, loc: str, cyclomatic: str, cognitive: str) -> DataFrame:
    return rows.withColumn("maintainability", maintainability_index(F.col(loc), F.col(cyclomatic), F.col(cognitive)))


def normalised_token(token: Column, keywords: list[str]) -> Column:
    """Identifiers, strings and numbers as classes; keywords and signs as they are; comments and blanks as null."""
    return (
        F.when(F.trim(token).eqNullSafe("") | token.isNull() | token.startswith("#"), None)
        .when(token.rlike("^[\"']"), F.lit("$STR"))
        .when(token.rlike("^[0-9]"), F.lit("$NUM"))
        .when(token.isin(keywords), token)
        .when(token.rlike("^[A-Za-z_]"), F.lit("$ID"))
        .otherwise(token)
    )


def mode_of(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, ties by value: two aggregations, no window."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))).alias("b"))
    return best.select(group, F.col("b.v").alias("mode"), (-F.col("b.less")).alias("n"))
