"""Edits as rows: text changes, rename plans, formatting, and positions to symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import code


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open spans that share a place."""
    return (a_start < b_end) & (b_start < a_end)


def text_change(old: Column, new: Column) -> Column:
    """struct(start, removed, inserted): the one replacement between two texts, by their common ends."""
    both = F.least(F.length(old), F.length(new))
    places = F.sequence(F.lit(0), both)
    # Every prefix and suffix is compared, which suits lines and members rather than whole books.
    head = F.array_max(F.filter(places, lambda i: F.substring(old, 1, i) == F.substring(new, 1, i)))
    room = both - head
    tail = F.array_max(F.filter(F.sequence(F.lit(0), room), lambda i: F.right(old, i) == F.right(new, i)))
    return F.struct(head.alias("start"), F.substring(old, head + 1, F.length(old) - head - tail).alias("removed"), F.substring(new, head + 1, F.length(new) - head - tail).alias("inserted"))


def apply_change(text: Column, change: Column) -> Column:
    return F.concat(F.substring(text, 1, change["start"]), change["inserted"], F.substring(text, change["start"] + F.length(change["removed"]) + 1, F.length(text)))


def symbol_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """The innermost node of each (path, line): an interval join, then the deepest by one aggregation."""
    spans = nodes.select("path", "node_id", "kind", "name", "start_line", "end_line")
    inside = points.join(spans, "path").where("line BETWEEN start_line AND end_line")
    best = inside.groupBy("path", "line").agg(F.max(F.struct("node_id", "kind", "name")).alias("b"))
    return best.select("path", "line", "b.kind", "b.name")


def rename_plan(nodes: DataFrame, uses: DataFrame, old: str, new: str) -> DataFrame:
    """(path, line, col, old, new, confidence): declarations and uses of a member's name.

    Uses in files that declare it or inherit it, or on a receiver typed so, are
    Strict; other uses of the name are Potential.
    """
    declared = code.symbols(nodes).where((F.col("name") == old) & F.col("kind").isin("func", "var", "const", "signal", "class", "enum"))
    homes = declared.select("path").distinct()
    heirs = code.inheritance(nodes).join(homes.select(F.col("path").alias("ancestor_path")), "ancestor_path", "left_semi").select("path")
    strict = homes.unionByName(heirs).distinct().withColumn("home", F.lit(True))
    classes = code.scripts(nodes).join(strict, "path").select(F.lower("type_name").alias("t")).where("t IS NOT NULL").distinct().withColumn("typed", F.lit(True))
    known = code.symbols(nodes).where("type_name IS NOT NULL").groupBy("path", F.col("name").alias("receiver")).agg(F.min(F.lower("type_name")).alias("t"))
    found = uses.where(F.col("name") == old).join(strict, "path", "left").join(known, ["path", "receiver"], "left").withColumn("t", F.coalesce("t", F.lower("receiver"))).join(classes, "t", "left")
    sure = F.when((F.col("receiver").isNull() | F.col("receiver").isin("self", "super")) & F.col("home"), "Strict").when(F.col("typed"), "Strict").otherwise("Potential")
    own = declared.select("path", "line", "col", F.lit("Strict").alias("confidence"))
    rows = own.unionByName(found.select("path", "line", "col", sure.alias("confidence")))
    return rows.groupBy("path", "line", "col").agg(F.max("confidence").alias("confidence")).select("path", "line", "col", F.lit(old).alias("old"), F.lit(new).alias("new"), "confidence")


def formatted(text: Column, indent: str = "\t", spaces: int = 4) -> Column:
    """Formatting as expressions: no trailing blanks, one kind of indent, at most two blank lines, one newline at the end."""
    lines = F.split(text, "\r?\n")
    lead = lambda x: F.regexp_extract(x, r"^([ \t]*)", 1)
    unit = " " * spaces
    tidy = F.transform(lines, lambda x: F.rtrim(F.concat(F.replace(lead(x), F.lit(unit), F.lit("\t")) if indent == "\t" else F.replace(lead(x), F.lit("\t"), F.lit(unit)), F.substring(x, F.length(lead(x)) + 1, F.length(x)))))
    tidy = F.transform(tidy, lambda x: F.regexp_replace(F.regexp_replace(x, r"\t+$", ""), r",(?=[^\s\"'\])}])", ", "))
    joined = F.regexp_replace(F.array_join(tidy, "\n"), "\n{4,}", "\n\n\n")
    return F.when(F.length(text) > 0, F.concat(F.regexp_replace(joined, "\n+$", ""), F.lit("\n"))).otherwise(text)


def quick_fixes(issues: DataFrame) -> DataFrame:
    """The kind of fix a lint issue has."""
    kinds = {"GDL502": "RemoveText", "GDL503": "InsertText", "GDL002": "RenameSymbol", "GDL003": "RenameSymbol", "GDL004": "RenameSymbol", "GDL201": "RemoveText", "GDL202": "RenameSymbol", "GDL251": "RemoveText"}
    fix = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return issues.withColumn("fix", fix[F.col("rule")]).where("fix IS NOT NULL")
