"""Analyses over parsed scripts: symbols, metrics, coverage, call graph, liveness, dependencies, lint, suppression.

Inputs are the views of ``quarry.sources.project``: ``nodes`` and ``uses`` with
a path.  Names compare without case across files and exactly within one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scores import maintainability_index, ratio
from quarry.operators import graph

MEMBERS = ["func", "var", "const", "signal", "enum", "class"]
TERMINATORS = ["return", "break", "continue"]
# Methods that the engine calls by itself.
ENGINE_CALLBACKS = [
    "_init", "_ready", "_process", "_physics_process", "_input", "_unhandled_input", "_unhandled_key_input", "_gui_input", "_draw", "_enter_tree", "_exit_tree",
    "_notification", "_get", "_set", "_get_property_list", "_to_string", "_static_init", "_get_configuration_warnings", "_integrate_forces", "_shortcut_input",
]


def scripts(nodes: DataFrame) -> DataFrame:
    """(path, type_name, base): a script's declared name and what it extends."""
    own = nodes.where("parent_id = 0 AND kind IN ('class_name', 'extends')")
    every = nodes.where("kind = 'file'").select("path")
    named = own.groupBy("path").agg(F.min(F.when(F.col("kind") == "class_name", F.col("name"))).alias("type_name"), F.min(F.when(F.col("kind") == "extends", F.col("name"))).alias("base"))
    return every.join(named, "path", "left")


def symbols(nodes: DataFrame) -> DataFrame:
    """Declarations and parameters: (path, node_id, class_id, method_id, kind, name, type_name, is_static, is_public, line, col)."""
    head = ["path", "node_id", "class_id", "method_id"]
    plain = nodes.where(F.col("kind").isin([*MEMBERS, "enum_value", "for"]) & F.col("name").isNotNull())
    kind = F.when(F.col("kind") == "for", "iterator").when((F.col("kind") == "var") & F.array_contains("modifiers", "local"), "local").otherwise(F.col("kind"))
    declared = plain.select(*head, kind.alias("kind"), "name", "type_name", F.array_contains("modifiers", "static").alias("is_static"), "modifiers", F.col("start_line").alias("line"), "col")
    given = nodes.where("kind = 'func'").select("path", "node_id", "class_id", F.col("node_id").alias("method_id"), F.col("start_line").alias("line"), "col", F.explode("params").alias("p"))
    params = given.select(*head, F.lit("param").alias("kind"), F.col("p.name").alias("name"), F.col("p.type").alias("type_name"), F.lit(False).alias("is_static"), F.array().cast("array<string>").alias("modifiers"), "line", "col")
    return declared.unionByName(params).withColumn("is_public", ~F.col("name").startswith("_"))


@dataclass(frozen=True)
class SymbolFilter:
    """The listing filters: all that are given must hold."""

    kind: str | None = None
    static: bool | None = None
    public: bool | None = None
    modifier: str | None = None
    type_name: str | None = None

    def column(self) -> Column:
        tests = [F.lit(True)]
        if self.kind:
            tests.append(F.col("kind") == self.kind)
        if self.static is not None:
            tests.append(F.col("is_static") == self.static)
        if self.public is not None:
            tests.append(F.col("is_public") == self.public)
        if self.modifier:
            tests.append(F.array_contains("modifiers", self.modifier))
        if self.type_name:
            tests.append(F.lower("type_name") == self.type_name.lower())
        return reduce(lambda a, b: a & b, tests)


def method_metrics(nodes: DataFrame, uses: DataFrame, compat: bool = False) -> DataFrame:
    """Per method: complexity, nesting, parameters, locals, returns, lines and index.

    Cyclomatic complexity counts if, elif, loops, cases beyond a match's first,
    boolean operators and ternaries; cognitive complexity adds the nesting.
    ``compat`` gives the figures of reports that never add it: each structure
    counts one and nesting is 0 or 1.
    """
    kind, one = F.col("kind"), F.lit(1)
    inside = nodes.where("method_id IS NOT NULL").groupBy("path", "method_id").agg(
        F.sum(F.when(kind.isin("if", "elif", "for", "while"), one).when((kind == "case") & (F.col("position") > 0), one).otherwise(0)).alias("branches"),
        F.sum(F.when(kind.isin("if", "for", "while", "match"), one if compat else one + F.col("depth")).when(kind.isin("elif", "else"), one).otherwise(0)).alias("structure"),
        F.max(F.col("depth")).alias("deepest"), F.count_if((kind == "var") & F.array_contains("modifiers", "local")).alias("locals"), F.count_if(kind == "return").alias("returns"),
    )
    words = uses.where("role = 'operator' AND name IN ('and', 'or', 'if', '&&', '||')").join(nodes.select("path", "node_id", F.coalesce("method_id", F.when(kind == "func", F.col("node_id"))).alias("method_id")), ["path", "node_id"]).groupBy("path", "method_id").agg(F.count("*").alias("words"))
    methods = nodes.where("kind = 'func'").select("path", F.col("node_id").alias("method_id"), F.col("name").alias("method"), "start_line", F.col("depth").alias("own_depth"), F.size("params").alias("parameters"), (F.col("end_line") - F.col("start_line") + 1).alias("loc"))
    rows = methods.join(inside, ["path", "method_id"], "left").join(words, ["path", "method_id"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = rows.select("path", "method_id", "method", "start_line", F.col("parameters").cast("long").alias("parameters"), F.col("loc").cast("long").alias("loc"), (1 + count("branches") + count("words")).alias("cyclomatic"), (count("structure") + count("words")).alias("cognitive"), F.greatest(count("deepest") - F.col("own_depth"), F.lit(0)).alias("nesting"), count("locals").alias("locals"), count("returns").alias("returns"))
    rows = rows.withColumn("nesting", F.least("nesting", F.lit(1).cast(rows.schema["nesting"].dataType))) if compat else rows
    return rows.withColumn("maintainability", F.round(maintainability_index(F.col("loc"), F.col("cyclomatic"), F.col("cognitive")), 6))


def file_metrics(files: DataFrame, methods: DataFrame) -> DataFrame:
    """Per file: lines and the methods' counts, means and peaks; without methods 0, and 100 for the index."""
    from quarry.operators.text import line_counts

    mean = methods.groupBy("path").agg(F.count("*").alias("methods"), F.avg("cyclomatic").alias("avg_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), F.max("nesting").alias("max_nesting"), F.avg("maintainability").alias("index"))
    rows = files.select("path", *line_counts(F.col("text"))).join(mean, "path", "left")
    return rows.fillna({"methods": 0, "avg_cyclomatic": 0.0, "max_cyclomatic": 0, "max_nesting": 0, "index": 100.0})


def project_metrics(file_rows: DataFrame) -> DataFrame:
    """One row; means are means of the files' means, over files with a method."""
    some = lambda c: F.avg(F.when(F.col("methods") > 0, F.col(c)))
    return file_rows.agg(F.count("*").alias("files"), F.sum("total").alias("lines"), F.sum("code").alias("code"), F.sum("methods").alias("methods"), F.round(F.coalesce(some("avg_cyclomatic"), F.lit(0.0)), 6).alias("avg_cyclomatic"), F.round(F.coalesce(some("index"), F.lit(100.0)), 6).alias("index"))


def type_coverage(nodes: DataFrame) -> DataFrame:
    """Per file: annotated, inferred and untyped declarations, and the ratios."""
    s = symbols(nodes).where("kind IN ('var', 'local', 'param', 'iterator')")
    values = nodes.where("kind IN ('var')").select("path", "node_id", F.col("value").isNotNull().alias("set"))
    defaults = nodes.where("kind = 'func'").select("path", "node_id", F.explode("params").alias("p")).select("path", "node_id", F.col("p.name").alias("name"), F.col("p.has_default").alias("default"))
    rows = s.join(values, ["path", "node_id"], "left").join(defaults, ["path", "node_id", "name"], "left")
    state = F.when(F.col("type_name").isNotNull(), "annotated").when((F.col("kind") == "iterator") | F.col("default") | F.array_contains("modifiers", "inferred") | F.col("set"), "inferred").otherwise("untyped")
    typed = rows.select("path", state.alias("state")).groupBy("path").agg(*[F.count_if(F.col("state") == k).alias(k) for k in ("annotated", "inferred", "untyped")])
    total = F.col("annotated") + F.col("inferred") + F.col("untyped")
    return typed.withColumn("annotated_share", F.round(ratio(F.col("annotated"), total), 6)).withColumn("typed_share", F.round(ratio(F.col("annotated") + F.col("inferred"), total), 6))


def inheritance(nodes: DataFrame) -> DataFrame:
    """(path, ancestor_path, depth) over scripts that extend scripts by name or path."""
    s = scripts(nodes)
    named = s.where("type_name IS NOT NULL").groupBy(F.lower("type_name").alias("key")).agg(F.min("path").alias("dst"))
    by_name = s.where("base IS NOT NULL").select(F.col("path").alias("src"), F.lower("base").alias("key")).join(named, "key").select("src", "dst")
    by_path = s.where("base LIKE 'res://%'").select(F.col("path").alias("src"), F.regexp_replace("base", "^res://", "").alias("dst")).join(s.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")
    return graph.closure(by_name.unionByName(by_path)).select(F.col("src").alias("path"), F.col("dst").alias("ancestor_path"), "depth")


def dependencies(nodes: DataFrame, uses: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind): extends, preload and load edges between project files, and scenes' resources."""
    s = scripts(nodes)
    named = s.where("type_name IS NOT NULL").groupBy(F.lower("type_name").alias("key")).agg(F.min("path").alias("dst"))
    extends = s.where("base IS NOT NULL").select(F.col("path").alias("src"), F.lower("base").alias("key")).join(named, "key").select("src", "dst", F.lit("extends").alias("kind"))
    target = F.regexp_extract("argument", r"^[\"']res://([^\"']*)[\"']$", 1)
    loads = uses.where("role = 'call' AND name IN ('preload', 'load')").select(F.col("path").alias("src"), target.alias("dst"), F.col("name").alias("kind")).where("dst <> ''")
    paths = s.where("base LIKE 'res://%'").select(F.col("path").alias("src"), F.regexp_replace("base", "^res://", "").alias("dst"), F.lit("extends").alias("kind"))
    edges = extends.unionByName(loads).unionByName(paths)
    if scenes is not None:
        edges = edges.unionByName(scenes.where("target IS NOT NULL").select(F.col("path").alias("src"), F.regexp_replace("target", "^res://", "").alias("dst"), F.lit("scene").alias("kind")))
    return edges.distinct()


def dependency_report(edges: DataFrame, transitive: bool = True) -> DataFrame:
    """Per file: direct fan-out, dependents (transitive, as project reports count them, or direct), and whether it is on a cycle."""
    into_edges = graph.closure(edges.select("src", "dst")) if transitive else edges.select("src", "dst").distinct()
    nodes_ = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    out = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("path")).agg(F.count("*").alias("fan_out"))
    into = into_edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("fan_in"))
    ring = graph.in_cycle(edges.select("src", "dst")).select(F.col("node").alias("path"), F.lit(True).alias("in_cycle"))
    return nodes_.join(out, "path", "left").join(into, "path", "left").join(ring, "path", "left").fillna({"fan_out": 0, "fan_in": 0, "in_cycle": False})


def most_coupled(edges: DataFrame, most: int = 10) -> DataFrame:
    """(path, fan_out, fan_in, coupling): the files with most direct edges, ties by path."""
    ends = graph.degrees(edges).withColumnRenamed("node", "path").withColumn("coupling", F.col("fan_out") + F.col("fan_in"))
    return ends.orderBy(F.desc("coupling"), "path").limit(most)


def call_sites(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, caller, target_class, target, line, col, receiver): calls with the class they are known to go to ("*": any)."""
    s = scripts(nodes).select("path", F.lower(F.coalesce("type_name", F.regexp_extract("path", r"([^/]+)\.gd$", 1))).alias("own"), F.lower("base").alias("up"))
    methods = nodes.select("path", "node_id", F.coalesce("method_id", F.when(F.col("kind") == "func", F.col("node_id"))).alias("m"))
    names = nodes.where("kind = 'func'").select("path", F.col("node_id").alias("m"), F.col("name").alias("caller"))
    calls = uses.where("role IN ('call', 'member_call')").join(methods, ["path", "node_id"]).join(names, ["path", "m"], "left").join(s, "path")
    typed = symbols(nodes).where("type_name IS NOT NULL AND kind IN ('var', 'local', 'param')").groupBy("path", F.col("name").alias("receiver")).agg(F.min(F.lower("type_name")).alias("known"))
    known = s.select(F.col("own").alias("receiver_key")).distinct().withColumn("is_class", F.lit(True))
    rows = calls.join(typed, ["path", "receiver"], "left").join(known, F.lower("receiver") == F.col("receiver_key"), "left")
    target = F.when((F.col("role") == "call") | (F.col("receiver") == "self"), F.col("own")).when(F.col("receiver") == "super", F.coalesce("up", F.lit("*"))).when(F.col("is_class"), F.lower("receiver")).otherwise(F.coalesce("known", F.lit("*")))
    return rows.select("path", "caller", target.alias("target_class"), F.lower("name").alias("target"), "line", "col", "receiver")


def dead_code(nodes: DataFrame, uses: DataFrame, connections: DataFrame | None = None, reflection: bool = True) -> DataFrame:
    """Unused members with the reason's code and the confidence, by a chain of semi and anti joins.

    A function lives by a call on one of its effective classes, a connection, a
    use of its name in its file, an override of a called method, or its name in
    a string (Potential).  What only an untyped receiver's call may reach is
    reported as Potential (FDT), the rest as Strict (FNC).
    """
    s = symbols(nodes).where("kind IN ('func', 'var', 'const', 'signal', 'enum_value', 'class', 'param', 'local')")
    names = scripts(nodes).select("path", F.lower(F.coalesce("type_name", F.regexp_extract("path", r"([^/]+)\.gd$", 1))).alias("own"), F.col("type_name").isNotNull().alias("global_name"))
    chain = inheritance(nodes)
    below = chain.join(names.select("path", F.col("own").alias("effective")), "path").select(F.col("ancestor_path").alias("path"), "effective")
    above = chain.join(names.select(F.col("path").alias("ancestor_path"), F.col("own").alias("effective")), "ancestor_path").select("path", "effective")
    effective = names.select("path", F.col("own").alias("effective")).unionByName(below).unionByName(above).distinct()
    calls = call_sites(nodes, uses).where(~F.col("caller").eqNullSafe(F.col("target")))  # a method that calls itself has no caller by that
    owner = nodes.select("path", "node_id", F.coalesce("method_id", F.when(F.col("kind") == "func", F.col("node_id"))).alias("m"))
    heads = nodes.where("kind = 'func'").select("path", F.col("node_id").alias("m"), F.col("name").alias("inside"))
    key = s.select("path", "node_id", "kind", "name", "line", "col", "is_public", "modifiers", "method_id", F.lower("name").alias("key"))
    flag = lambda rows, name, keys: rows.select(*keys).distinct().withColumn(name, F.lit(True))
    called = key.where("kind = 'func'").join(effective, "path").join(calls.select(F.col("target_class").alias("effective"), F.col("target").alias("key")).distinct(), ["effective", "key"])
    duck = calls.where("target_class = '*'").select(F.col("target").alias("key"))
    placed = uses.where("role IN ('read', 'member', 'call', 'member_call', 'operator')").join(owner, ["path", "node_id"]).join(heads, ["path", "m"], "left")
    local = placed.where(~F.col("inside").eqNullSafe(F.col("name"))).select("path", "name")
    in_method = placed.select("path", F.col("m").alias("method_id"), "name")
    members = uses.where("role IN ('member', 'member_call', 'write') AND receiver IS NOT NULL").select(F.lower("name").alias("key"), F.col("path").alias("other"))
    texts = uses.where("role = 'string'").select(F.lower(F.regexp_replace("name", "^[&^]?[\"']|[\"']$", "")).alias("key"))
    emitted = uses.where("role IN ('call', 'member_call') AND name IN ('emit', 'emit_signal', 'connect')").select(F.lower(F.coalesce(F.when(F.col("name") == "emit_signal", F.regexp_replace("argument", "[\"'&]", "")), "receiver")).alias("key"))
    rows = key.join(flag(called, "called", ["path", "node_id"]), ["path", "node_id"], "left")
    rows = rows.join(flag(duck, "duck", ["key"]), "key", "left").join(flag(local, "local", ["path", "name"]), ["path", "name"], "left")
    rows = rows.join(flag(in_method, "in_method", ["path", "method_id", "name"]), ["path", "method_id", "name"], "left")
    rows = rows.join(flag(members, "elsewhere", ["key"]), "key", "left").join(flag(texts, "named", ["key"]), "key", "left").join(flag(emitted, "emitted", ["key"]), "key", "left")
    if connections is not None:
        rows = rows.join(flag(connections.select(F.lower("method").alias("key")), "connected", ["key"]), "key", "left")
    else:
        rows = rows.withColumn("connected", F.lit(None).cast("boolean"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.col("kind")
    alive = (
        F.when(kind == "func", yes("called") | yes("connected") | yes("local") | F.col("name").isin(ENGINE_CALLBACKS) | (yes("named") if reflection else F.lit(False)))
        .when(kind == "signal", yes("emitted"))
        .when(kind.isin("param", "local"), yes("in_method") | F.col("name").startswith("_"))
        .otherwise(yes("local") | yes("elsewhere"))
    )
    code = (
        F.when(kind == "func", F.when(yes("duck"), "FDT").otherwise("FNC"))
        .when(kind == "var", F.when(F.array_contains("modifiers", "export"), "VEX").when(F.array_contains("modifiers", "onready"), "VOR").otherwise("VNR"))
        .when(kind == "local", "VNR").when(kind == "const", "CNU").when(kind == "signal", "SNE").when(kind == "param", "PNU").when(kind == "enum_value", "ENU").otherwise("ICU")
    )
    dead = rows.where(~alive).join(names, "path").withColumn("reason", code)
    public = F.col("global_name") & F.col("is_public") & kind.isin("func", "const", "signal") & (F.col("reason") != "FDT")
    return dead.select("path", "kind", "name", "line", "col", F.when(public, "FPA").otherwise(F.col("reason")).alias("reason"), F.when(public | F.col("reason").isin("FDT", "VEX", "VOR", "ENU"), "Potential").otherwise("Strict").alias("confidence"))


def unreachable(nodes: DataFrame, compat: bool = False) -> DataFrame:
    """Statements after a return, break or continue among their siblings; ``compat``: at a method's top level alone."""
    ends = nodes.where(F.col("kind").isin(TERMINATORS)).groupBy("path", "parent_id").agg(F.min("position").alias("cut"))
    found = nodes.join(ends, ["path", "parent_id"]).where("position > cut")
    return (found.where("parent_id = method_id") if compat else found).select("path", F.col("start_line").alias("line"), "kind")


def todo_tags(files: DataFrame, tags: tuple[str, ...] = ("TODO", "FIXME", "HACK", "NOTE", "BUG", "XXX")) -> DataFrame:
    """(path, line, tag, note) of tags in comments."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "l"))
    pattern = rf"#.*?\b({'|'.join(tags)})\b:?\s*(.*)$"
    return lines.where(F.col("l").rlike(pattern)).select("path", (F.col("pos") + 1).alias("line"), F.regexp_extract("l", pattern, 1).alias("tag"), F.trim(F.regexp_extract("l", pattern, 2)).alias("note"))


SNAKE, PASCAL, SCREAMING = r"^_*[a-z][a-z0-9]*(_[a-z0-9]+)*_?$", r"^_?[A-Z][A-Za-z0-9]*$", r"^_?[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"


@dataclass(frozen=True)
class LintOptions:
    """Limits of the counting rules."""

    max_line_length: int = 100
    max_file_lines: int = 1000
    max_parameters: int = 5
    max_function_length: int = 50
    max_returns: int = 6
    max_nesting: int = 4
    max_locals: int = 15
    max_class_variables: int = 20
    max_public_methods: int = 20
    max_inner_classes: int = 5
    max_complexity: int = 10


def lint(files: DataFrame, nodes: DataFrame, uses: DataFrame, options: LintOptions | None = None) -> DataFrame:
    """(path, line, rule, name) of all rules; every rule is a filter or an aggregate, put together by one union."""
    o = options or LintOptions()
    s = symbols(nodes)
    found: list[DataFrame] = []

    def rule(code: str, title: str, rows: DataFrame, line: str = "line") -> None:
        found.append(rows.select("path", F.col(line).cast("int").alias("line"), F.lit(code).alias("rule"), F.lit(title).alias("name")))

    def case(code: str, title: str, test: Column, pattern: str) -> None:
        rule(code, title, s.where(test & ~F.col("name").rlike(pattern)))

    kind = F.col("kind")
    rule("GDL001", "class-name-case", nodes.where((kind == "class_name") & ~F.col("name").rlike(PASCAL)), "start_line")
    case("GDL002", "function-name-case", kind == "func", SNAKE)
    case("GDL003", "variable-name-case", kind.isin("var", "local"), SNAKE)
    case("GDL004", "constant-name-case", kind == "const", SCREAMING)
    case("GDL005", "signal-name-case", kind == "signal", SNAKE)
    case("GDL006", "enum-name-case", kind == "enum", PASCAL)
    case("GDL007", "enum-value-case", kind == "enum_value", SCREAMING)
    case("GDL009", "inner-class-name-case", kind == "class", PASCAL)
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "l")).select("path", (F.col("pos") + 1).alias("line"), "l")
    rule("GDL101", "line-length", lines.where(F.length("l") > o.max_line_length))
    rule("GDL102", "max-file-lines", lines.groupBy("path").agg(F.max("line").alias("line")).where(F.col("line") > o.max_file_lines))
    rule("GDL502", "trailing-whitespace", lines.where(F.col("l").rlike(r"[ \t]+$")))
    last = files.select("path", F.size(F.split("text", "\n")).alias("line"), "text")
    rule("GDL503", "trailing-newline", last.where((F.length("text") > 0) & (~F.col("text").endswith("\n") | F.col("text").endswith("\n\n"))))
    indent = lines.where(F.col("l").rlike(r"^[ \t]+\S")).groupBy("path").agg(F.count_if(F.col("l").startswith("\t")).alias("tabs"), F.count_if(F.col("l").startswith(" ")).alias("spaces"), F.min("line").alias("line"))
    rule("GDL501", "indentation-consistency", indent.where("tabs > 0 AND spaces > 0"))
    rule("GDL237", "commented-code", lines.where(F.col("l").rlike(r"^\s*#\s*(var|func|if|for|while|return|elif|match)\b.*[:=(]|^\s*#\s*\w+(\.\w+)*\s*(=|\()[^=].*$")))
    local_use = uses.where("role <> 'write'").join(nodes.select("path", "node_id", F.coalesce("method_id", F.when(kind == "func", F.col("node_id"))).alias("method_id")), ["path", "node_id"]).select("path", "method_id", "name").distinct()
    unread = s.where("name NOT LIKE '\\\\_%'").join(local_use, ["path", "method_id", "name"], "left_anti")
    rule("GDL201", "unused-variable", unread.where("kind = 'local'"))
    rule("GDL202", "unused-parameter", unread.where("kind = 'param'"))
    body = nodes.where("kind <> 'pass'").select("path", F.col("parent_id").alias("node_id")).distinct()
    func = nodes.where("kind = 'func'")
    rule("GDL203", "empty-function", func.join(body, ["path", "node_id"], "left_anti"), "start_line")
    metrics = method_metrics(nodes, uses)
    for code, title, test in (
        ("GDL205", "max-parameters", F.col("parameters") > o.max_parameters), ("GDL206", "max-function-length", F.col("loc") > o.max_function_length), ("GDL208", "cyclomatic-complexity", F.col("cyclomatic") > o.max_complexity),
        ("GDL223", "max-returns", F.col("returns") > o.max_returns), ("GDL225", "max-nesting-depth", F.col("nesting") > o.max_nesting), ("GDL226", "max-local-variables", F.col("locals") > o.max_locals),
    ):
        rule(code, title, metrics.where(test), "start_line")
    emits = uses.where("role = 'member_call' AND name = 'emit'").select("path", F.col("receiver").alias("name")).unionByName(uses.where("name = 'emit_signal'").select("path", F.regexp_replace("argument", "[\"'&]", "").alias("name"))).distinct()
    rule("GDL207", "unused-signal", s.where("kind = 'signal'").join(emits, ["path", "name"], "left_anti"))
    rule("GDL210", "dead-code", unreachable(nodes))
    outer = s.where("kind IN ('var', 'const')").select("path", "class_id", "name").distinct()
    rule("GDL211", "variable-shadowing", s.where("kind IN ('local', 'param')").join(outer, ["path", "class_id", "name"], "left_semi"))
    loops = nodes.where("kind IN ('for', 'while')").select("path", F.col("node_id").alias("from_id"), "last_id")
    in_loop = lambda rows: rows.join(loops, "path").where("node_id > from_id AND node_id <= last_id").select("path", "node_id", "line").distinct()
    rule("GDL212", "await-in-loop", in_loop(uses.where("role = 'operator' AND name = 'await'").select("path", "node_id", "line")))
    rule("GDL240", "allocation-in-loop", in_loop(uses.where("role = 'member_call' AND name = 'new'").select("path", "node_id", "line")))
    process = func.where("name IN ('_process', '_physics_process')").select("path", F.col("node_id").alias("from_id"), "last_id")
    lookups = uses.where("role = 'node_path' OR (role = 'call' AND name IN ('get_node', 'find_child'))").select("path", "node_id", "line")
    rule("GDL241", "process-get-node", lookups.join(process, "path").where("node_id > from_id AND node_id <= last_id").distinct())
    rule("GDL213", "self-comparison", nodes.where(F.col("value").rlike(r"(?:^|\s|\()([A-Za-z_][\w. ]*?) (?:==|!=|<=|>=|<|>) \1(?:$|\s|\))") & kind.isin("if", "elif", "while", "return", "expr")), "start_line")
    rule("GDL230", "no-self-assign", nodes.where((kind == "assign") & (F.col("type_name") == "=") & (F.col("name") == F.col("value"))), "start_line")
    loads = uses.where("role = 'call' AND name IN ('load', 'preload') AND argument IS NOT NULL").groupBy("path", "argument").agg(F.count("*").alias("n"), F.max("line").alias("line"))
    rule("GDL219", "duplicated-load", loads.where("n > 1"))
    rule("GDL218", "private-method-call", uses.where("role = 'member_call' AND name LIKE '\\\\_%' AND receiver NOT IN ('self', 'super')"))
    rule("GDL238", "no-debug-print", uses.where("role = 'call' AND name IN ('print', 'prints', 'printt', 'print_debug', 'print_rich', 'printerr')"))
    done = nodes.where("kind = 'return'").select("path", F.col("parent_id").alias("node_id"))
    before = nodes.where("kind IN ('if', 'elif')").join(done, ["path", "node_id"], "left_semi").select("path", "parent_id", (F.col("position") + 1).alias("position"))
    after = nodes.join(before, ["path", "parent_id", "position"], "left_semi")
    rule("GDL216", "no-elif-return", after.where("kind = 'elif'"), "start_line")
    rule("GDL217", "no-else-return", after.where("kind = 'else'"), "start_line")
    only = nodes.groupBy("path", "parent_id").agg(F.count("*").alias("n"), F.min("kind").alias("first"), F.count_if(kind == "pass").alias("passes"))
    rule("GDL233", "no-lonely-if", nodes.where("kind = 'else'").join(only.where("n = 1 AND first = 'if'").select("path", F.col("parent_id").alias("node_id")), ["path", "node_id"], "left_semi"), "start_line")
    rule("GDL251", "unnecessary-pass", nodes.where("kind = 'pass'").join(only.where("n > 1 AND passes > 0").select("path", "parent_id"), ["path", "parent_id"], "left_semi"), "start_line")
    returns = nodes.where("kind = 'return'").groupBy("path", "method_id").agg(F.count_if(F.col("value").isNotNull()).alias("full"), F.count_if(F.col("value").isNull()).alias("bare"), F.min("start_line").alias("line"))
    rule("GDL234", "consistent-return", returns.where("full > 0 AND bare > 0"))
    members = s.where("method_id IS NULL").groupBy("path", "class_id").agg(F.count_if(kind == "var").alias("vars"), F.count_if((kind == "func") & F.col("is_public")).alias("methods"), F.count_if(kind == "class").alias("classes"), F.min("line").alias("line"))
    rule("GDL227", "max-class-variables", members.where(F.col("vars") > o.max_class_variables))
    rule("GDL222", "max-public-methods", members.where(F.col("methods") > o.max_public_methods))
    rule("GDL232", "max-inner-classes", members.where(F.col("classes") > o.max_inner_classes))
    private = s.where("kind = 'func' AND NOT is_public").where(~F.col("name").isin(ENGINE_CALLBACKS))
    rule("GDL252", "unused-function", private.join(uses.where("role <> 'write'").select("path", "name").distinct(), ["path", "name"], "left_anti"))
    rank = F.when(kind == "signal", 1).when(kind == "enum", 2).when(kind == "const", 3).when(kind == "var", F.when(F.array_contains("modifiers", "export"), 4).when(F.array_contains("modifiers", "onready"), 6).otherwise(5)).when(kind == "func", 7).when(kind == "class", 8)
    ordered = nodes.where(kind.isin(MEMBERS) & F.col("method_id").isNull()).withColumn("rank", rank).withColumn("highest", F.max("rank").over(Window.partitionBy("path", "parent_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)))
    rule("GDL301", "member-ordering", ordered.where("rank < highest"), "start_line")
    return reduce(DataFrame.unionByName, found)


def suppressions(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, kind, rules, line, end_line): directive comments with the lines they cover."""
    pattern = r"#\s*gdlint:\s*(ignore-file|ignore-function|ignore|disable|enable)\s*(?:=\s*([\w\-, ]+))?"
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "l")).where(F.col("l").rlike(pattern))
    rules = F.filter(F.transform(F.split(F.regexp_extract("l", pattern, 2), ","), F.trim), lambda x: x != "")
    rows = lines.select("path", (F.col("pos") + 1).alias("line"), F.regexp_extract("l", pattern, 1).alias("kind"), rules.alias("rules"), (~F.trim("l").startswith("#")).alias("inline"))
    func = nodes.where("kind = 'func'").select("path", F.col("start_line").alias("f"), F.col("end_line").alias("e"))
    near = rows.where("kind = 'ignore-function'").join(func, "path").where("f >= line").groupBy("path", "line").agg(F.min(F.struct("f", "e")).alias("b"))
    return rows.join(near.select("path", "line", F.col("b.e").alias("end_line")), ["path", "line"], "left")


def unsuppressed(issues: DataFrame, directives: DataFrame) -> DataFrame:
    """Issues that no directive covers; the latest of disable and enable before a line holds."""
    i = issues.withColumn("_id", F.monotonically_increasing_id())
    d = directives.select("path", F.col("line").alias("at"), "kind", "rules", "inline", "end_line").withColumnRenamed("kind", "directive")
    pairs = i.select("_id", "path", "line", "rule", "name").join(d, "path").where((F.size("rules") == 0) | F.array_contains("rules", F.col("name")) | F.array_contains("rules", F.col("rule")))
    k = F.col("directive")
    hit = (k == "ignore-file") | ((k == "ignore") & (F.when(F.col("inline"), F.col("line") == F.col("at")).otherwise(F.col("line") == F.col("at") + 1))) | ((k == "ignore-function") & F.col("line").between(F.col("at"), F.col("end_line")))
    block = F.max(F.when(k.isin("disable", "enable") & (F.col("at") <= F.col("line")), F.struct("at", (k == "disable").alias("off"))))
    off = pairs.groupBy("_id").agg(F.max(hit).alias("hit"), block.alias("block")).where("hit OR block.off")
    return i.join(off.select("_id"), "_id", "left_anti").drop("_id")


# Calls that run or open what they are given.
UNSAFE = [("SEC010", "OS", "execute", "Critical"), ("SEC011", "OS", "shell_open", "High"), ("SEC012", None, "str2var", "Medium"), ("SEC012", None, "str_to_var", "Medium")]


def unsafe_calls(uses: DataFrame) -> DataFrame:
    """(path, line, code, severity): unsafe calls, and paths put together inside a load or open."""
    calls = uses.where("role IN ('call', 'member_call')")
    tests = [((F.col("name") == name) & (F.col("receiver") == receiver if receiver else F.lit(True)), c, severity) for c, receiver, name, severity in UNSAFE]
    joined = F.col("name").isin("load", "open") & F.col("argument").contains(" + ") & F.col("argument").rlike("(?i)user|input|path")
    tests.append((joined, "SEC020", "High"))
    hits = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for t, c, s in tests]))
    return calls.select("path", "line", F.explode(hits).alias("h")).select("path", "line", "h.code", "h.severity")


def signal_connections(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, signal, callback, line): connect calls on signals and by name."""
    connects = uses.where("role IN ('member_call', 'call') AND name = 'connect'")
    by_name = F.regexp_extract("argument", "^[&]?[\"'](.*)[\"']$", 1)
    callback = F.regexp_extract("argument", r"^(?:self \. )?(\w+)(?: \. bind .*)?$", 1)
    return connects.select("path", F.when(by_name != "", by_name).otherwise(F.col("receiver")).alias("signal"), F.when(by_name == "", F.nullif(callback, F.lit(""))).alias("callback"), "line")
