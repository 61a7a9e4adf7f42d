"""Types of expressions and flow facts over parsed scripts.

Types are strings; a union is a sorted array.  Per-method facts that depend on
statement order are window functions over a method's nodes, so methods are
worked on side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import code

#: Conversions that need no cast, from -> to.
IMPLICIT = [("int", "float"), ("String", "StringName"), ("StringName", "String"), ("int", "enum"), ("enum", "int"), ("String", "NodePath")]


def literal_type(value: Column) -> Column:
    """The type of a literal, constructor, array or dictionary; null if it isn't one."""
    made = F.regexp_extract(value, r"^([A-Z]\w*) \(", 1)
    return (
        F.when(value.rlike(r"^-? ?(0[xX][0-9a-fA-F_]+|0[bB][01_]+|[0-9][0-9_]*)$"), "int")
        .when(value.rlike(r"^-? ?([0-9][0-9_]*)?\.?[0-9_]*([eE][+-]?[0-9]+)?\.?$") & value.rlike("[0-9]"), "float")
        .when(value.isin("true", "false"), "bool").when(value == "null", "null")
        .when(value.rlike("^&[\"']"), "StringName").when(value.rlike("^\\^[\"']"), "NodePath").when(value.rlike("^r?[\"']"), "String")
        .when(value.rlike(r"^\["), "Array").when(value.rlike(r"^\{"), "Dictionary").when(value.rlike(r"^\$|^%[A-Za-z_]"), "Node").when(value.rlike(r"^func\b"), "Callable")
        .when(made != "", made).when(value.rlike(r"^[A-Z]\w* \. new \("), F.regexp_extract(value, r"^([A-Z]\w*)", 1))
        .when(value.rlike(r" (==|!=|<|>|<=|>=|and|or|is|in) |^not ") & ~value.contains(" if "), "bool")
    )


def compatible(source: Column, target: Column) -> Column:
    """Whether a value of one type may be put where the other is wanted."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in IMPLICIT])
    return (source == target) | source.isin("Variant", "null") | (target == "Variant") | F.array_contains(pairs, F.concat_ws(">", source, target))


def declared_types(nodes: DataFrame) -> DataFrame:
    """(path, node_id, name, type, origin): written types, else those of the literal set."""
    rows = nodes.where("kind IN ('var', 'const')")
    inferred = literal_type(F.col("value"))
    return rows.select("path", "node_id", "method_id", "name", F.coalesce("type_name", inferred, F.lit("Variant")).alias("type"), F.when(F.col("type_name").isNotNull(), "annotation").when(inferred.isNotNull(), "literal").otherwise("unknown").alias("origin"))


def return_types(nodes: DataFrame) -> DataFrame:
    """(path, method, declared, types): the union of what a method returns, with null where its end may be reached."""
    methods = nodes.where("kind = 'func'").select("path", F.col("node_id").alias("method_id"), F.col("name").alias("method"), F.col("type_name").alias("declared"))
    given = nodes.where("kind = 'return'").select("path", "method_id", F.when(F.col("value").isNull(), "null").otherwise(F.coalesce(literal_type(F.col("value")), F.lit("Variant"))).alias("t"), (F.col("parent_id") == F.col("method_id")).alias("top"))
    found = given.groupBy("path", "method_id").agg(F.collect_set("t").alias("t"), F.max("top").alias("ends"))
    rows = methods.join(found, ["path", "method_id"], "left")
    open_end = F.when(F.coalesce("ends", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("null")))
    return rows.select("path", "method", "declared", F.sort_array(F.array_union(F.coalesce("t", F.array().cast("array<string>")), open_end)).alias("types"))


def parameter_types(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, method, types, agreed): the literal types of first arguments at known call sites of untyped methods."""
    target = code.scripts(nodes).select("path", F.lower(F.coalesce("type_name", F.regexp_extract("path", r"([^/]+)\.gd$", 1))).alias("target_class"))
    methods = nodes.where("kind = 'func' AND size(params) > 0").where("params[0].type IS NULL AND NOT startswith(params[0].name, '_')").select("path", F.col("name").alias("method"), F.lower("name").alias("target"), F.col("params")[0]["name"].alias("parameter"))
    calls = code.call_sites(nodes, uses).select("path", "line", "col", "target_class", "target").join(uses.where("role IN ('call', 'member_call')").select("path", "line", "col", "argument"), ["path", "line", "col"]).drop("path")
    typed = calls.withColumn("t", F.coalesce(literal_type(F.col("argument")), F.lit("Variant")))
    seen = methods.join(target, "path").join(typed, ["target_class", "target"]).groupBy("path", "method", "parameter").agg(F.sort_array(F.collect_set("t")).alias("types"))
    return seen.withColumn("agreed", F.when((F.size("types") == 1) & (F.col("types")[0] != "Variant"), F.col("types")[0]))


def type_conflicts(nodes: DataFrame) -> DataFrame:
    """Assignments of a literal that its variable's written type doesn't take."""
    typed = nodes.where("kind = 'var' AND type_name IS NOT NULL").groupBy("path", "name").agg(F.min("type_name").alias("want"), F.count("*").alias("n")).where("n = 1")
    given = nodes.where("kind IN ('assign', 'var') AND value IS NOT NULL").select("path", "name", F.col("start_line").alias("line"), literal_type(F.col("value")).alias("got")).where("got IS NOT NULL")
    plain = F.regexp_extract("want", r"^(\w+)", 1)
    return given.join(typed, ["path", "name"]).where(~compatible(F.col("got"), plain)).select("path", "line", "name", "want", "got")


def narrowings(nodes: DataFrame) -> DataFrame:
    """(path, name, type, from_line, to_line): what a condition's branch knows of a variable."""
    rows = nodes.where("kind IN ('if', 'elif', 'while') AND value IS NOT NULL")
    parts = rows.select("path", "node_id", "start_line", "end_line", "last_id", F.explode(F.split("value", r" (?:and|&&) ")).alias("c"))
    parts = parts.withColumn("body_end", F.col("end_line"))
    guard = lambda p, k: F.regexp_extract("c", p, k)
    is_type, not_null, truthy, valid, method = r"^(\w+) is (\w+)$", r"^(\w+) != null$", r"^(\w+)$", r"^is_instance_valid \( (\w+) \)$", r"^(\w+) \. has_method \( [\"'](\w+)[\"'] \)$"
    name = F.coalesce(*[F.nullif(guard(p, 1), F.lit("")) for p in (is_type, not_null, truthy, valid, method)])
    kind = F.when(guard(is_type, 1) != "", guard(is_type, 2)).when(guard(method, 1) != "", F.concat(F.lit("has:"), guard(method, 2))).otherwise("not null")
    return parts.select("path", name.alias("name"), kind.alias("type"), (F.col("start_line") + 1).alias("from_line"), F.col("body_end").alias("to_line")).where("name IS NOT NULL")


def may_be_null(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """Member uses of a variable last set to null, outside a branch that knows better."""
    writes = nodes.where("kind IN ('assign', 'var')").select("path", F.coalesce("method_id", F.lit(-1)).alias("m"), "name", F.col("start_line").alias("line"), F.lit(1).alias("first"), F.when(F.col("value").isNull() & (F.col("kind") == "var") & F.col("type_name").rlike("^[A-Z]"), "null").otherwise(F.coalesce(literal_type(F.col("value")), F.lit("?"))).alias("t"))
    reads = uses.where("role IN ('member', 'member_call') AND receiver IS NOT NULL").join(nodes.select("path", "node_id", "method_id"), ["path", "node_id"]).select("path", F.coalesce("method_id", F.lit(-1)).alias("m"), F.col("receiver").alias("name"), "line", F.lit(2).alias("first"), F.lit(None).cast("string").alias("t"))
    w = Window.partitionBy("path", "m", "name").orderBy("line", "first").rowsBetween(Window.unboundedPreceding, 0)
    state = writes.unionByName(reads).withColumn("last", F.last("t", ignorenulls=True).over(w)).where("t IS NULL AND last = 'null'").select("path", "name", "line")
    known = narrowings(nodes).select("path", "name", "from_line", "to_line")
    safe = state.join(known, ["path", "name"]).where("line BETWEEN from_line AND to_line").select("path", "name", "line")
    return state.distinct().join(safe, ["path", "name", "line"], "left_anti")


def duck_types(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, method_id, name, needs, fits): members an untyped parameter must have, and the scripts that have all."""
    params = code.symbols(nodes).where("kind = 'param' AND type_name IS NULL").select("path", "method_id", "name")
    asked = uses.where("role IN ('member', 'member_call') AND receiver IS NOT NULL").join(nodes.select("path", "node_id", "method_id"), ["path", "node_id"]).select("path", "method_id", F.col("receiver").alias("name"), F.col("name").alias("member"))
    needs = asked.distinct().join(params, ["path", "method_id", "name"])
    have = code.symbols(nodes).where("method_id IS NULL OR kind = 'func'").select(F.col("path").alias("type"), F.col("name").alias("member")).distinct()
    total = needs.groupBy("path", "method_id", "name").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("member")).alias("needs"))
    fits = needs.join(have, "member").groupBy("path", "method_id", "name", "type").agg(F.count("*").alias("n"))
    full = fits.join(total.select("path", "method_id", "name", "n"), ["path", "method_id", "name", "n"]).groupBy("path", "method_id", "name").agg(F.sort_array(F.collect_set("type")).alias("fits"))
    return total.drop("n").join(full, ["path", "method_id", "name"], "left")
