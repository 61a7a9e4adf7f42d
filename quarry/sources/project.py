"""Project sources: scripts, scenes, resources and settings as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.sources.script_parser import NODE_SCHEMA, USE_SCHEMA, parse


def scan(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of all files below ``root`` that match a name pattern; paths are relative."""
    # binaryFile keeps a file's last newline, which the text reader drops.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    # Bytes that aren't UTF-8 become the replacement character; the file keeps its row.
    return files.select(F.regexp_replace("path", f"^.*?{re.escape(base)}/", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def in_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(path, text) from literal texts."""
    return spark.createDataFrame(sorted(files.items()), "path string, text string")


def content_hash(text: str = "text"):
    """The first 16 hex digits of SHA-256, the key of incremental work."""
    return F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 16)


def parsed(files: DataFrame) -> DataFrame:
    """(path, nodes, uses, error): each script parsed once, in one Arrow pass."""
    node, use = T.StructType.fromDDL(NODE_SCHEMA), T.StructType.fromDDL(USE_SCHEMA)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("nodes", T.ArrayType(node)), T.StructField("uses", T.ArrayType(use)), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    nodes, uses = parse(text)
                    rows.append({"path": path, "nodes": nodes, "uses": uses, "error": None})
                except Exception as e:  # noqa: BLE001 - whatever one file does to the parser is a row with an error, not a lost job
                    rows.append({"path": path, "nodes": [], "uses": [], "error": type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "text").mapInArrow(run, schema)


def analysed(files: DataFrame) -> DataFrame:
    """(path, facts, issues, error): the semantic facts and style issues of each script, one Arrow pass.

    A file that can't be analysed is a row with an error and no facts.
    """
    from quarry.sources import semantics, style, syntax

    fact = T.StructType.fromDDL(semantics.FACT_SCHEMA)
    issue = T.StructType.fromDDL("rule string, line int, col int, message string")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("facts", T.ArrayType(fact)), T.StructField("issues", T.ArrayType(issue)), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = syntax.script(text)
                    facts = [dict(zip(fact.names, f, strict=True)) for f in semantics.Analysis(text, tree).facts]
                    issues = [dict(zip(issue.names, i, strict=True)) for i in style.issues(text, tree)]
                    rows.append({"path": path, "facts": facts, "issues": issues, "error": None})
                except Exception as e:  # noqa: BLE001
                    rows.append({"path": path, "facts": [], "issues": [], "error": type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "text").mapInArrow(run, schema)


def syntax_rows(files: DataFrame) -> DataFrame:
    """(path, pre, last, parent, depth, kind, value, ...): the whole syntax tree of each script."""
    from quarry.sources import syntax

    row = T.StructType.fromDDL(syntax.ROW_SCHEMA)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("rows", T.ArrayType(row))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = syntax.rows(syntax.script(text))
                except RecursionError:  # nested too deep: the file's row alone
                    found = syntax.rows(syntax.Syn("ClassDeclaration", line=1, end_line=1))
                yield pa.RecordBatch.from_pylist([{"path": path, "rows": [dict(zip(row.names, r, strict=True)) for r in found]}], schema=arrow)

    return files.select("path", "text").mapInArrow(run, schema).select("path", F.inline("rows"))


def method_tokens(files: DataFrame) -> DataFrame:
    """(path, method, line, tokens): each method's tokens with names, texts and numbers as classes; comments and blanks left out."""
    from quarry.sources import syntax
    from quarry.sources.script_parser import KEYWORDS, tokens

    classes = {"string": "$STR", "number": "$NUM", "node": "$STR"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [t for t in tokens(text or "") if t.kind not in ("space", "newline", "comment", "join")]
                for m in (n for n in syntax.script(text).walk() if n.kind == "MethodDeclaration"):
                    own = [t for t in found if (m.line, m.col) <= (t.line, t.col) < (m.end_line, m.end_col)]
                    rows.append((path, m.value, m.line, [classes.get(t.kind) or ("$ID" if t.kind == "name" and t.text not in KEYWORDS else t.text) for t in own]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=["path", "method", "line", "tokens"])

    return files.select("path", "text").mapInArrow(run, "path string, method string, line int, tokens array<string>")


def nodes(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.select("path", F.inline("nodes"))


def uses(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.select("path", F.inline("uses"))


def sections(files: DataFrame) -> DataFrame:
    """(path, line, section, header, key, value): INI-like files, with the header a line stands under."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "l"))
    w = Window.partitionBy("path").orderBy("pos")
    header = F.when(F.col("l").rlike(r"^\[.*\]\s*$"), F.trim("l"))
    rows = lines.select("path", (F.col("pos") + 1).alias("line"), F.last(header, ignorenulls=True).over(w).alias("header"), F.when(header.isNotNull(), F.col("pos")).alias("_h"), "l", "pos")
    rows = rows.withColumn("section", F.last("_h", ignorenulls=True).over(w))
    pair = F.regexp_extract("l", r"^([^=\[\"]+?)\s*=", 1)
    return rows.select("path", "line", "section", "header", F.when(pair != "", pair).alias("key"), F.regexp_extract("l", r"^[^=\[\"]+?\s*=\s*(.*)$", 1).alias("value"))


def _attribute(name: str):
    found = F.regexp_extract("header", rf'[\s\[]{name}="([^"]*)"', 1)
    return F.when(found != "", found)


def _headers(files: DataFrame, kind: str) -> DataFrame:
    """One row a section, with its pairs as a map; of a key that is there twice the last line counts."""
    rows = sections(files).where(F.col("header").startswith(f"[{kind} "))
    pairs = rows.groupBy("path", "section", "header", "key").agg(F.min("line").alias("line"), F.max_by("value", "line").alias("value"))
    return pairs.groupBy("path", "section", "header").agg(F.min("line").alias("line"), F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))).alias("props"))


def autoloads(settings: DataFrame) -> DataFrame:
    """(name, target, singleton, kind) of a settings file's autoload section."""
    rows = sections(settings).where("header = '[autoload]' AND key IS NOT NULL")
    value = F.regexp_extract("value", r'^"(\*?)(.*)"$', 2)
    kind = F.when(value.endswith(".gd"), "script").when(value.endswith(".tscn"), "scene").when(value.endswith(".cs"), "csharp").otherwise("other")
    return rows.select(F.col("key").alias("name"), value.alias("target"), F.col("value").startswith('"*').alias("singleton"), kind.alias("kind"))


def engine_version(settings: DataFrame) -> DataFrame:
    return sections(settings).where("key = 'config/features'").select("path", F.regexp_extract("value", r'"(\d+\.\d+)', 1).alias("version"))


def scene_resources(scenes: DataFrame) -> DataFrame:
    return _headers(scenes, "ext_resource").select("path", _attribute("id").alias("id"), _attribute("type").alias("type"), _attribute("path").alias("target"), "line")


def scene_nodes(scenes: DataFrame) -> DataFrame:
    """Nodes with their path in the tree, script and instanced scene resolved through the resource table."""
    ids = lambda c: F.regexp_extract(c, r'ExtResource\(\s*"?([^")\s]+)"?\s*\)', 1)
    rows = _headers(scenes, "node").select("path", "line", _attribute("name").alias("name"), _attribute("type").alias("type"), _attribute("parent").alias("parent"), ids("header").alias("_i"), ids(F.col("props")["script"]).alias("_s"), F.coalesce(F.col("props")["unique_name_in_owner"] == "true", F.lit(False)).alias("is_unique"), F.regexp_extract_all("header", F.lit(r'groups=\[([^\]]*)\]'), F.lit(1)).alias("_g"))
    resources = scene_resources(scenes)
    for mark, column in (("_i", "instance"), ("_s", "script")):
        rows = rows.join(resources.select("path", F.col("id").alias(mark), F.col("target").alias(column)), ["path", mark], "left")
    place = F.when(F.col("parent").isNull(), ".").when(F.col("parent") == ".", F.col("name")).otherwise(F.concat_ws("/", "parent", "name"))
    groups = F.flatten(F.transform("_g", lambda g: F.regexp_extract_all(g, F.lit('"([^"]*)"'), F.lit(1))))
    return rows.select("path", place.alias("node_path"), "parent", "name", "type", "script", "instance", "is_unique", groups.alias("groups"), "line")


def scene_connections(scenes: DataFrame) -> DataFrame:
    return _headers(scenes, "connection").select("path", _attribute("signal").alias("signal"), _attribute("from").alias("from_node"), _attribute("to").alias("to_node"), _attribute("method").alias("method"), "line")


def resource_properties(resources: DataFrame) -> DataFrame:
    """(path, script_class, key, value) of resource files."""
    rows = sections(resources)
    kind = rows.where(F.col("header").startswith("[gd_resource")).groupBy("path").agg(F.max(_attribute("script_class")).alias("script_class"))
    return rows.where("header = '[resource]' AND key IS NOT NULL").join(kind, "path", "left").select("path", "script_class", "key", "value")


def scene_edges(scenes: DataFrame) -> DataFrame:
    """(src, dst, kind): sub-scenes, scripts and other resources that a scene uses."""
    kind = F.when(F.col("type") == "PackedScene", "SubScene").when(F.col("type") == "Script", "Script").otherwise("Resource")
    return scene_resources(scenes).select(F.col("path").alias("src"), F.regexp_replace("target", "^res://", "").alias("dst"), kind.alias("kind"))
