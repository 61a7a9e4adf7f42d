"""The operator shapes bound to the driver's tables; each query covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.patterns import directory, matches_any, name_glob_regex, url_path
from quarry.functions.scores import health, maintainability_index, ratio
from quarry.operators import duplicates, graph, joins, security, text, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", "source", "lang", "text", *text.line_counts(F.col("text")))


@_query
def line_stats(spark, sf):
    return _stats(spark, sf).select("doc_id", "total", "blank", "comment", "code", F.size(F.filter(F.split("text", "\r\n|\n"), lambda x: F.length(x) < 40)).cast("long").alias("short"))


@_query
def file_rollup(spark, sf):
    return _stats(spark, sf).groupBy("source").agg(F.count("*").alias("files"), F.sum("total").alias("lines"), F.round(F.avg("total"), 6).alias("avg_lines"), F.max("total").alias("max_lines"))


@_query
def project_rollup(spark, sf):
    rows = text.average_of_averages(_stats(spark, sf), "lang", "source", "total")
    return rows.select("lang", F.round("avg_total", 6).alias("avg_of_avgs"), "groups")


@_query
def maintainability(spark, sf):
    rows = _stats(spark, sf).withColumn("cc", 1 + F.size(F.split("text", ",")).cast("long") - 1)
    return rows.select("doc_id", "cc", F.round(maintainability_index(F.col("code"), F.col("cc"), F.lit(0)), 6).alias("mi"))


@_query
def dup_exact(spark, sf):
    docs = _t(spark, sf, "documents").select(duplicates.block_hash(F.lower(F.trim("text"))).alias("hash"), "source")
    found = docs.groupBy("hash").agg(F.count("*").alias("instances"), F.countDistinct("source").alias("files")).where("instances >= 2")
    return found.withColumn("suggestion", duplicates.suggestion(F.col("files")))


@_query
def dup_line_blocks(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return duplicates.exact_duplicates(duplicates.line_windows(docs, "doc_id", 3))


@_query
def dup_instances_merged(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    blocks = duplicates.line_windows(docs, "doc_id", 2)
    again = duplicates.exact_duplicates(blocks)
    spans = blocks.join(again, "hash").select("doc_id", "start", (F.col("start") + 1).alias("end"))
    return duplicates.merge_intervals(spans, ["doc_id"], "start", "end")


@_query
def dup_baseline_diff(spark, sf):
    docs = _t(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("l")).select("lang", duplicates.block_hash(F.col("l")).alias("hash"))
    return duplicates.baseline_diff(docs.where("lang = 'de'"), docs.where("lang = 'fr'"), "hash")


def _token_lists(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.split(F.lower(F.trim("text")), r"\s+").alias("tokens"))


@_query
def dup_similar(spark, sf):
    """Pairs between the least documents of equal token lists; dup_similar_classes has the members."""
    return duplicates.similar_blocks(_token_lists(spark, sf), "doc_id", "tokens", distinct=True).select("a", "b", F.round("score", 6).alias("score"))


@_query
def dup_similar_classes(spark, sf):
    return duplicates.block_classes(_token_lists(spark, sf), "doc_id", "tokens")


@_query
def secrets_scan(spark, sf):
    lines = text.lines(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return security.scan_lines(lines, "doc_id", "line_text")


@_query
def severity_pivot(spark, sf):
    return security.severity_counts(secrets_scan(spark, sf), "code")


@_query
def insecure_url(spark, sf):
    return _t(spark, sf, "pages").where(security.finding(F.col("url"), "SEC030")).select("page_id", "url")


@_query
def suppression_filter(spark, sf):
    events = _t(spark, sf, "events")
    directive = F.when(F.col("event_type") == "click", "off").when(F.col("event_type") == "view", "on")
    rows = windows.suppressed(F.col("event_type") == "error", directive, ["ts", "event_id"], "user_id", events)
    return rows.where("coalesce(state, 'on') = 'on'").select("event_id", "user_id")


@_query
def regex_name_filter(spark, sf):
    return _t(spark, sf, "part").where(F.col("p_name").rlike(name_glob_regex("*wid?et")) & F.col("p_name").rlike("(?i)^(red|blue)")).select("p_partkey", "p_name")


@_query
def glob_path_filter(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    return pages.where(matches_any(F.col("path"), ["en/*", "de", "**/7??"]))


@_query
def sorted_topk(spark, sf):
    return _t(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@_query
def topk_per_group(spark, sf):
    rows = windows.top_per_group(_t(spark, sf, "lineitem"), "l_suppkey", [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 5)
    return rows.select("l_suppkey", "rank", F.col("l_extendedprice").alias("price"))


def _supplies(spark, sf):
    return _t(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))


@_query
def fan_in_out(spark, sf):
    return graph.degrees(_supplies(spark, sf)).select("node", F.col("fan_out").cast("long").alias("fan_out"), F.col("fan_in").cast("long").alias("fan_in"))


@_query
def coupling(spark, sf):
    d = fan_in_out(spark, sf)
    return d.select("node", (F.col("fan_in") + F.col("fan_out")).alias("coupling"), F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 6).alias("instability"))


@_query
def dir_rollup(spark, sf):
    pages = _t(spark, sf, "pages").select(directory(url_path(F.col("url")), 1).alias("dir"), F.length("html").cast("long").alias("n"))
    return pages.groupBy("dir").agg(F.count("*").alias("files"), F.sum("n").alias("chars"))


def _geography(spark, sf):
    n, c = _t(spark, sf, "nation"), _t(spark, sf, "customer")
    first = n.select((F.col("n_regionkey") + 1000000000).cast("long").alias("src"), (F.col("n_nationkey") + 500000000).cast("long").alias("dst"))
    return first.unionByName(c.select((F.col("c_nationkey") + 500000000).cast("long").alias("src"), F.col("c_custkey").alias("dst")))


@_query
def closure(spark, sf):
    return graph.closure(_geography(spark, sf)).select("src", "dst")


@_query
def topo_level(spark, sf):
    return graph.levels(_geography(spark, sf)).select("node", F.col("level").cast("long").alias("level"))


def _functional(spark, sf):
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"))
    n = s.agg(F.count("*").alias("n"))
    return s.join(F.broadcast(n)).select("src", ((F.col("src") * 7 + 3) % F.col("n")).alias("dst"))  # n is one row


@_query
def cycle_flag(spark, sf):
    return graph.in_cycle(_functional(spark, sf))


@_query
def strong_components(spark, sf):
    return graph.strong_components(_functional(spark, sf))


@_query
def unused_entities(spark, sf):
    return joins.unused(_t(spark, sf, "documents").select("doc_id", "lang"), _t(spark, sf, "labels"), "doc_id")


@_query
def semi_used(spark, sf):
    return joins.used(_t(spark, sf, "documents").select("doc_id", "lang"), _t(spark, sf, "labels"), "doc_id")


@_query
def missing_targets(spark, sf):
    pages = _t(spark, sf, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("path"))
    there = pages.select(url_path(F.col("url")).alias("path"))
    return joins.unused(links.where("path <> ''"), there, "path").groupBy("path").agg(F.count("*").alias("n"))


@_query
def liveness_cascade(spark, sf):
    part, line = _t(spark, sf, "part"), _t(spark, sf, "lineitem")
    uses = line.where("l_quantity >= 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max((F.col("l_quantity") >= 50) & (F.col("l_returnflag") == "R")).alias("called"))
    seen = part.join(uses, "p_partkey", "left")
    brands = seen.groupBy("p_brand").agg(F.count("called").alias("peers"))
    reason = joins.first_match([(F.col("called"), "Strict"), (F.col("called").isNotNull(), "Potential"), (F.col("peers") > 0, "NameMatch")], "Dead")
    return seen.join(brands, "p_brand").select("p_partkey", reason.alias("verdict"))


@_query
def relational_division(spark, sf):
    segments = _t(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()
    return joins.divide(segments, segments.where("c_nationkey = 0"), "c_nationkey", "c_mktsegment")


@_query
def set_union_types(spark, sf):
    rows = _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s"))
    return rows.select("c_nationkey", F.array_join("s", "|").alias("types"))


@_query
def consensus(spark, sf):
    return joins.consensus(_t(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@_query
def name_lookup_priority(spark, sf):
    tables = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")]
    rows = None
    for rank, (table, key, name) in enumerate(tables):
        one = _t(spark, sf, table).select(F.regexp_extract(name, "[0-9]+$", 0).try_cast("int").cast("string").alias("name"), F.lit(rank).alias("rank"), F.col(key).cast("long").alias("id"))
        rows = one if rows is None else rows.unionByName(one)
    return joins.resolve_first(rows.where("name IS NOT NULL"), "name", ["rank"], "id")


@_query
def theta_filter_join(spark, sf):
    rules = spark.createDataFrame([("begins", "red"), ("ends", "ring"), ("contains", "wid")], "kind string, value string")
    name, value = F.col("p_name"), F.col("value")
    test = ((F.col("kind") == "begins") & name.startswith(value)) | ((F.col("kind") == "ends") & name.endswith(value)) | ((F.col("kind") == "contains") & name.contains(value))
    return _t(spark, sf, "part").join(F.broadcast(rules), test).groupBy("kind", "value").agg(F.count("*").alias("n"))  # three literal rules


@_query
def fuzzy_match(spark, sf):
    names = _t(spark, sf, "part").select("p_name").distinct()
    pairs = joins.fuzzy_pairs(names, names.select(F.col("p_name").alias("candidate")), "p_name", "candidate")
    return windows.top_per_group(pairs, "p_name", [F.col("distance"), F.col("candidate")], 3).select("p_name", "candidate", "distance")


@_query
def self_join_same_key(spark, sf):
    line = _t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers"))
    return line.where("suppliers >= 2")


@_query
def interval_containment(spark, sf):
    orders, line = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    spans = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    ships = line.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", "l_shipdate")
    return joins.contained(ships, spans, "o_custkey", "l_shipdate", "first", "last").groupBy("o_custkey").agg(F.count("*").alias("n"))


@_query
def equal_runs(spark, sf):
    rows = windows.runs(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")
    return rows.where("length >= 3").groupBy("user_id", "event_type").agg(F.count("*").alias("runs"), F.max("length").alias("longest"))


@_query
def order_violations(spark, sf):
    return windows.order_violations(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").groupBy("user_id").agg(F.count("*").alias("n"))


@_query
def useless_assignment(spark, sf):
    return windows.lost_writes(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", "click").select("event_id", "user_id")


@_query
def snapshot_diff(spark, sf):
    docs = _t(spark, sf, "documents").select("lang", "n_chars", "doc_id")
    side = lambda lang: docs.where(F.col("lang") == lang).groupBy("n_chars").agg(F.count("*").alias("n"))
    return windows.snapshot_diff(side("de"), side("en"), "n_chars", "n").groupBy("change").agg(F.count("*").alias("n"))


@_query
def coverage_ratios(spark, sf):
    rows = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("known"), F.sum("toxic").alias("toxic"))
    return rows.select("lang", F.round(ratio(F.col("known"), F.col("n")), 6).alias("coverage"), F.round(ratio(F.col("toxic"), F.col("known"), 0.0), 6).alias("toxic_share"))


@_query
def health_summary(spark, sf):
    files = _stats(spark, sf).agg(F.count("*").alias("files"), F.round(F.avg("total"), 6).alias("avg_lines"))
    cover = _t(spark, sf, "labels").agg(F.count("*").alias("labels"))
    one = files.crossJoin(F.broadcast(cover))  # one row by one row
    return one.select("files", "avg_lines", "labels", health(F.col("avg_lines"), 10, 20, falling=True).alias("size_health"), health(ratio(F.col("labels"), F.col("files")), 80, 50).alias("cover_health"))


KEYWORDS = ["and", "or", "not", "if", "else", "for", "while", "return", "is", "in", "as"]


@_query
def token_normalise(spark, sf):
    tokens = _t(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z_0-9]*|[0-9]+|\"[^\"\n]*\"|[.,:;=]"), F.lit(0))).alias("t"))
    named = tokens.select(text.normalised_token(F.col("t"), KEYWORDS).alias("class"))
    return named.groupBy("class").agg(F.count("*").alias("n"))


@_query
def style_mode(spark, sf):
    return text.mode_of(_t(spark, sf, "documents").select("lang", "source"), "lang", "source")


@_query
def stream_debounce(spark, sf):
    rows = windows.debounced(_t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "10 minutes")
    return rows.where("n >= 2").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@_query
def stream_tumbling(spark, sf):
    w = F.window("ts", "1 day")
    return _t(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "n", "total")


@_query
def incremental_recompute(spark, sf):
    edges = _geography(spark, sf)
    changed = _t(spark, sf, "nation").where("n_regionkey = 0").select((F.col("n_nationkey") + 500000000).cast("long").alias("node"))
    after = graph.closure(edges, changed).select(F.col("dst").alias("node"))
    return changed.unionByName(after).distinct()
