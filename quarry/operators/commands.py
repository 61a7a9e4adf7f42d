"""Whole reports, as a command line would ask for them, and where they go: texts, JSON, files, caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import code, diagnostics, views
from quarry.operators.diagnostics import Model
from quarry.sources import project
from quarry.sources.settings import Settings, apply
from quarry.staging import staged


class Analysed:
    """A project's files with everything the reports need, each part parsed once and staged."""

    def __init__(self, files: DataFrame, scenes: DataFrame | None = None, settings: Settings | None = None):
        self.files, self.scenes, self.settings = files, scenes, settings or Settings()
        analysed = staged(project.analysed(files), "analysed")
        self.facts, self.errors = analysed.select("path", F.inline("facts")), analysed.where("error IS NOT NULL").select("path", "error")
        self.issues = analysed.select("path", F.inline("issues"))
        self.model = Model(self.facts)

    def rows(self) -> DataFrame:
        return project.syntax_rows(self.files)


def analyze(a: Analysed, least: str = "hint", most: int | None = None) -> DataFrame:
    """(path, rule, line, col, severity, message): findings and style issues under the project's settings.

    A file that could not be analysed is one finding, GD0001.
    """
    there = a.files.select("path")
    nodes = links = None
    if a.scenes is not None:
        there = there.unionByName(a.scenes.select("path"))
        nodes, links = project.scene_nodes(a.scenes), project.scene_connections(a.scenes)
    found = diagnostics.diagnose(a.model, there, nodes, links).select("path", F.col("code").alias("rule"), "line", "col", "severity", F.col("detail").alias("message"))
    style = a.issues.select("path", "rule", "line", "col", F.lit("hint").alias("severity"), "message")
    broken = a.errors.select("path", F.lit("GD0001").alias("rule"), F.lit(1).alias("line"), F.lit(0).alias("col"), F.lit("error").alias("severity"), F.col("error").alias("message"))
    every = apply(reduce(DataFrame.unionByName, [found, style, broken]), a.settings)
    order = ["hint", "warning", "error"]
    kept = every.where(F.col("severity").isin(order[order.index(least) :] + ["info"] * (least == "hint")))
    return kept if most is None else kept.orderBy("path", "line", "col", "rule").limit(most)


def check(a: Analysed) -> DataFrame:
    """One row (errors, warnings, hints, code): the counts and the exit code."""
    found = analyze(a)
    n = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("int")), F.lit(0))
    counts = found.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("hint").alias("hints"))
    fails = F.lit(a.settings.fail_on_warning) & (F.col("warnings") > 0)
    return counts.withColumn("code", F.when(F.col("errors") > 0, 2).when(fails, 1).otherwise(0))


def stats(files: DataFrame, nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """One row: size, complexity and coverage of a project."""
    metrics = code.project_metrics(code.file_metrics(files, code.method_metrics(nodes, uses)))
    coverage = code.type_coverage(nodes).agg(F.sum("annotated").alias("annotated"), F.sum("inferred").alias("inferred"), F.sum("untyped").alias("untyped"))
    return metrics.withColumn("one", F.lit(1)).join(coverage.withColumn("one", F.lit(1)), "one").drop("one")


def list_all(a: Analysed) -> DataFrame:
    """(path, kind, name, line): every class and member."""
    rows = diagnostics.of_kind(a.facts, "member").select("path", F.col("owner").alias("kind"), "name", "line")
    return rows.unionByName(views.list_classes(a.facts).select("path", F.lit("class").alias("kind"), "name", F.lit(1).alias("line")).where("name IS NOT NULL")).distinct()


def extract_style(files: DataFrame) -> DataFrame:
    """(path, indent, width, longest, blank_lines): the conventions a file follows."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("p", "l"))
    lead = F.regexp_extract("l", r"^([ \t]+)\S", 1)
    marked = lines.select("path", "p", "l", lead.alias("lead"), (F.trim("l") == "").alias("blank"))
    kind = F.when(F.sum((F.col("lead").startswith("\t")).cast("int")) >= F.sum((F.col("lead").startswith(" ")).cast("int")), "tabs").otherwise("spaces")
    width = F.min(F.when(F.col("lead") != "", F.length("lead")))
    return marked.groupBy("path").agg(kind.alias("indent"), width.alias("width"), F.max(F.length("l")).alias("longest"), F.sum(F.col("blank").cast("int")).alias("blank_lines"))


def find_refs(a: Analysed, name: str) -> DataFrame:
    return views.references(a.model, name)


def validate(a: Analysed) -> DataFrame:
    """Errors alone: syntax, types and meaning."""
    return analyze(a, "error")


def print_tree(files: DataFrame) -> DataFrame:
    """(path, tree): a script's syntax as indented lines."""
    rows = project.syntax_rows(files)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("kind"), F.coalesce(F.concat(F.lit(" "), "value"), F.lit("")))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", line.alias("t")))), lambda x: x["t"]), "\n").alias("tree"))


# --- sinks -------------------------------------------------------------------------------------


def text_report(found: DataFrame) -> DataFrame:
    """(path, report): one text a file, its findings by line."""
    line = F.format_string("%5d:%-3d %s %s %s", "line", "col", "rule", "severity", "message")
    return found.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "col", "rule", line.alias("t")))), lambda x: x["t"]), "\n").alias("report"))


def json_report(found: DataFrame) -> DataFrame:
    """(value): one JSON text a finding."""
    return found.select(F.to_json(F.struct(*found.columns)).alias("value"))


def dead_code_report(found: DataFrame) -> DataFrame:
    """(path, report): dead members by kind, as the report's lines."""
    line = F.format_string("  %d %s: %s [%s] [%s]", "line", "kind", "name", "reason", "confidence")
    return found.groupBy("path").agg(F.concat(F.lit("file: "), F.first("path"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "kind", "name", line.alias("t")))), lambda x: x["t"]), "\n")).alias("report"))


def write_edited(edited: DataFrame, folder: str) -> None:
    """Write edited files (path, text) below a folder of a file system that all executors share."""

    def write(rows) -> None:
        import pathlib

        for r in rows:
            target = pathlib.Path(folder.removeprefix("file://")) / r.path
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(f".{target.name}.part")
            part.write_text(r.text, encoding="utf-8", newline="")
            part.replace(target)  # whole or not at all, also when a task runs twice

    edited.select("path", "text").foreachPartition(write)


# --- caches ------------------------------------------------------------------------------------


class ResultCache:
    """Analyses by (path, content hash) in a folder; only what changed is analysed again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _rows(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/analysed")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.folder}/analysed") if fs.exists(path) else None

    def stale(self, files: DataFrame) -> DataFrame:
        """Files whose text has no cached analysis."""
        keyed = files.withColumn("content_hash", project.content_hash())
        rows = self._rows()
        return keyed if rows is None else keyed.join(rows.select("path", "content_hash"), ["path", "content_hash"], "left_anti")

    def analysed(self, files: DataFrame) -> DataFrame:
        """(path, content_hash, facts, issues, error) of all files, from the cache where it has them."""
        stale = staged(self.stale(files), "stale")
        if not stale.isEmpty():
            fresh = project.analysed(stale).join(stale.select("path", "content_hash"), "path")
            fresh.select("path", "content_hash", "facts", "issues", "error").write.mode("append").parquet(f"{self.folder}/analysed")
        rows = self._rows()
        keyed = files.select("path", project.content_hash().alias("content_hash"))
        if rows is None:
            return project.analysed(files).join(keyed, "path").select("path", "content_hash", "facts", "issues", "error")
        once = rows.dropDuplicates(["path", "content_hash"])
        return keyed.join(once, ["path", "content_hash"])


class MemoryCache:
    """Frames kept by name for a session."""

    def __init__(self) -> None:
        self.frames: dict[str, DataFrame] = {}

    def get(self, name: str, make) -> DataFrame:
        if name not in self.frames:
            self.frames[name] = make().persist()
        return self.frames[name]

    def drop(self, name: str | None = None) -> None:
        for n in [name] if name else list(self.frames):
            self.frames.pop(n).unpersist()
