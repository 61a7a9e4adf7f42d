"""Queries over the project that is generated from the supplier table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import code, commands, diagnostics, duplicates, liveness, refactor, rules, views
from quarry.sources import generated, project, settings
from quarry.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


class Generated:
    """The generated scripts and scenes, parsed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.suppliers = generated.keys(spark, sf_dir)
        self.files = staged(generated.feature_files(self.suppliers, generated.FINDINGS).unionByName(generated.own_files(self.suppliers)), "files")
        self.scenes = generated.scene_files(self.suppliers)
        self.facts = staged(project.analysed(self.files).select("path", F.inline("facts")), "facts")

    def findings(self) -> DataFrame:
        there = self.files.select("path").unionByName(self.scenes.select("path"))
        model = diagnostics.Model(self.facts)
        found = diagnostics.diagnose(model, there, project.scene_nodes(self.scenes), project.scene_connections(self.scenes))
        return found.where(~F.col("path").startswith("s/"))


_SCENE_FOUND = f"SELECT 'GD4011/'||s_suppkey||'.tscn' AS path, 'GD4013' AS code, 1::BIGINT AS n FROM supplier WHERE s_suppkey % {generated.TURNS} = {generated._place(generated.FINDINGS, 'GD4011')}"
_FOUND = f"SELECT path, code, sum(n)::BIGINT AS n FROM ({generated.expected(generated.FINDINGS, 'code')} UNION ALL {_SCENE_FOUND}) GROUP BY ALL"


@_query(_FOUND)
def project_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each code is found in each file of the project."""
    return Generated(spark, sf_dir).findings().groupBy("path", "code").agg(F.count("*").alias("n"))


# --- the features' scripts ----------------------------------------------------------------------


@_query(generated.expected(generated.STYLE, "rule"))
def style_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each style rule is broken in each file."""
    files = generated.feature_files(generated.keys(spark, sf_dir), generated.STYLE)
    return project.analysed(files).select("path", F.inline("issues")).groupBy("path", "rule").agg(F.count("*").alias("n"))


_SEVERITIES = ", ".join(f"('{c}', '{'error' if c in diagnostics.ERRORS else 'hint' if c in diagnostics.HINTS else 'warning'}')" for c in diagnostics.CODES)


@_query(f"SELECT severity, sum(n)::BIGINT AS n FROM ({_FOUND}) JOIN (VALUES {_SEVERITIES}) AS c(code, severity) USING (code) GROUP BY severity")
def project_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Generated(spark, sf_dir).findings().groupBy("severity").agg(F.count("*").alias("n"))


@_query("SELECT 2 AS code")
def project_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.exit_code(Generated(spark, sf_dir).findings())


def _turn(name: str, features: list[generated.Feature] = generated.FINDINGS) -> str:
    return f"s_suppkey % {generated.TURNS} = {generated._place(features, name)}"


def _feature_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = generated.feature_files(generated.keys(spark, sf_dir), generated.FINDINGS)
    return staged(project.analysed(files).select("path", F.inline("facts")), "facts")


@_query(" UNION ALL ".join(f"SELECT '{n}/'||s_suppkey||'.gd' AS path, 'f' AS method, 'a' AS parameter, '{m}' AS needs FROM supplier WHERE {_turn(n)}" for n, m in (("GD7002", "width"), ("GD7003", "run"), ("GD7012", "go"), ("guarded", "go"))))
def parameter_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parameter_needs(_feature_facts(spark, sf_dir))


@_query(f"SELECT 'GD3025/'||s_suppkey||'.gd' AS path, 'f' AS method, 'a' AS name, 2::BIGINT AS puts, 'int' AS types FROM supplier WHERE {_turn('GD3025')}")
def container_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.container_profiles(_feature_facts(spark, sf_dir))


@_query(f"SELECT 'docs/'||s_suppkey||'.gd' AS path, 'hello' AS name, 6 AS line, 'Says hello.'||chr(10)||'Twice.' AS doc FROM supplier WHERE {_turn('docs')}")
def doc_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = generated.feature_files(generated.keys(spark, sf_dir), generated.FINDINGS)
    return views.doc_comments(files, project.syntax_rows(files))


@_query(f"SELECT 'DUA' AS reason, count(*) AS n FROM supplier WHERE {_turn('docs')} HAVING count(*) > 0")
def annotation_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = generated.feature_files(generated.keys(spark, sf_dir), generated.FINDINGS)
    return liveness.suppressed(liveness.annotations(project.syntax_rows(files)))


# --- the scenes -------------------------------------------------------------------------------------

_SCENE = f"FROM supplier WHERE {_turn('GD4011')}"


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.scene_files(generated.keys(spark, sf_dir))


@_query(f"SELECT 'GD4011/'||s_suppkey||'.tscn' AS path, 4::BIGINT AS nodes, 1::BIGINT AS scripted, 1::BIGINT AS instances {_SCENE}")
def list_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_scenes(project.scene_nodes(_scenes(spark, sf_dir)))


@_query(f"SELECT 'GD4011/'||s_suppkey||'.tscn' AS path, node_path, depth, children::BIGINT AS children FROM supplier, (VALUES ('.', 0, 2), ('Here', 1, 1), ('Here/Below', 2, 0), ('Unique', 1, 0)) AS v(node_path, depth, children) WHERE {_turn('GD4011')}")
def scene_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scene_tree(project.scene_nodes(_scenes(spark, sf_dir)))


@_query(f"SELECT 'GD4011/'||s_suppkey||'.tscn' AS path, node_path, child, type, 'own' AS by FROM supplier, (VALUES ('.', 'Here', 'Timer'), ('Here', 'Below', 'Node'), ('.', 'Unique', 'Node')) AS v(node_path, child, type) WHERE {_turn('GD4011')}")
def scene_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.possible_children(project.scene_nodes(_scenes(spark, sf_dir)))


@_query(f"SELECT 'GD4011/'||s_suppkey||x AS path, i::BIGINT AS incoming, o::BIGINT AS outgoing FROM (SELECT s_suppkey, unnest(['.tscn', '.gd']) AS x, unnest([0, 1]) AS i, unnest([2, 0]) AS o {_SCENE} UNION ALL SELECT s_suppkey, NULL, 1, 0 {_SCENE}) WHERE x IS NOT NULL UNION ALL SELECT 'GD4011/gone_'||s_suppkey||'.tscn', 1, 0 {_SCENE}")
def scene_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scene_links(project.scene_edges(_scenes(spark, sf_dir)))


@_query(f"SELECT 'g'||s_suppkey AS \"group\", 'Timer' AS types, 1::BIGINT AS members {_SCENE} UNION ALL SELECT 'all', 'Timer', count(*) {_SCENE} HAVING count(*) > 0")
def node_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.node_groups(project.scene_nodes(_scenes(spark, sf_dir)))


@_query(f"SELECT 'GD4011/'||s_suppkey||'.gd' AS path, 'script' AS category, true AS used, false AS missing {_SCENE} UNION ALL SELECT 'GD4011/gone_'||s_suppkey||'.tscn', 'scene', true, true {_SCENE} UNION ALL SELECT 's/'||s_suppkey||'.gd', 'script', false, false FROM supplier")
def list_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = generated.keys(spark, sf_dir)
    scripts = generated.feature_files(suppliers, generated.FINDINGS).where("path LIKE 'GD4011/%'").unionByName(generated.own_files(suppliers))
    return views.list_resources(project.scene_resources(_scenes(spark, sf_dir)), scripts)


# --- the suppliers' own classes -----------------------------------------------------------------------


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.own_files(generated.keys(spark, sf_dir))


def _own_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(project.analysed(_own(spark, sf_dir)).select("path", F.inline("facts")), "facts")


def _own_model(spark: SparkSession, sf_dir: str) -> diagnostics.Model:
    return diagnostics.Model(_own_facts(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = _own(spark, sf_dir)
    parsed = staged(project.parsed(files), "parsed")
    return files, project.nodes(parsed), project.uses(parsed)


def _each(columns: str, rows: str, more: str = "") -> str:
    """SQL of rows that every supplier's script gives; ``{k}`` in texts is the key."""
    return f"SELECT 's/'||s_suppkey||'.gd' AS path, {columns} FROM supplier, (VALUES {rows}) AS v {more}"


_K = "replace({0}, '{{k}}', s_suppkey::VARCHAR)"


@_query("SELECT 's/'||s_suppkey||'.gd' AS path, 'S'||s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'RefCounted' ELSE 'S'||(s_suppkey-1) END AS base, false AS inner, false AS abstract FROM supplier")
def list_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_classes(_own_facts(spark, sf_dir), top_only=True)


@_query(_each(f"{_K.format('col0')} AS name, col1 AS parameters, col2 AS emitted, col3 AS connected", "('paid', 1, true, false), ('never_{k}', 0, false, false)"))
def list_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_signals(_own_facts(spark, sf_dir))


_METHODS = "('_ready', 'void', 0, 14), ('base_{k}', 'int', 0, 21), ('make', 'int', 1, 25), ('_used', 'void', 1, 29), ('_unused', 'void', 1, 38)"


@_query(_each(f"'S'||s_suppkey AS class_name, {_K.format('col0')} AS name, col1 AS type, col2 AS parameters, col3 AS line", _METHODS))
def list_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_members(_own_facts(spark, sf_dir), "func")


@_query(_each("'S'||s_suppkey AS class_name, col0 AS name, col1 AS type, 0 AS parameters, col2 AS line", "('balance', 'float', 8), ('_later', 'Variant', 9), ('_count', 'Variant', 10), ('_unread', 'Variant', 11)"))
def list_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_members(_own_facts(spark, sf_dir), "var")


@_query(_each("'_ready' AS name, 'lifecycle' AS category", "(0)"))
def list_engine_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_engine_callbacks(_own_facts(spark, sf_dir))


@_query(_each("'S'||s_suppkey AS class_name, 'State' AS name, 'enum' AS type, 0 AS parameters, 6 AS line", "(0)"))
def list_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_members(_own_facts(spark, sf_dir), "enum")


_BELOW = "FROM supplier WHERE s_suppkey % 5 <> 0"


@_query(f"SELECT 's/'||s_suppkey||'.gd' AS path, unnest(['_ready', 'make', '_used', '_unused']) AS name, 's/'||(s_suppkey-1)||'.gd' AS base_path {_BELOW}")
def implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.implementations(_own_model(spark, sf_dir))


@_query(f"SELECT 's/'||(s_suppkey-1)||'.gd' AS path, unnest(['_ready', 'make', '_used', '_unused']) AS name, 1::BIGINT AS overrides {_BELOW}")
def polymorphic_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.polymorphic(_own_model(spark, sf_dir))


@_query("SELECT 's/'||s_suppkey||'.gd' AS path, 'S'||s_suppkey AS class_name, least(4, (SELECT max(s_suppkey) FROM supplier)-s_suppkey)::BIGINT AS below FROM supplier WHERE s_suppkey % 5 = 0")
def hierarchy_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hierarchy_roots(_own_model(spark, sf_dir))


@_query("SELECT 's/'||b.s_suppkey||'.gd' AS path, 'S'||b.s_suppkey AS class_name FROM supplier a JOIN supplier b ON a.s_suppkey = 0 AND b.s_suppkey < 5")
def types_with_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.types_with_method(_own_model(spark, sf_dir), "base_0")


@_query(f"SELECT 's/'||s_suppkey||'.gd' AS src, 's/'||(s_suppkey-1)||'.gd' AS dst, 1::BIGINT AS uses {_BELOW}")
def type_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.type_dependencies(_own_model(spark, sf_dir))


@_query(_each("col0 AS method, 's/'||s_suppkey||'.gd' AS target_path, col1 AS target", "('_ready', '_used'), ('_used', 'make')"))
def inference_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.inference_dependencies(_own_model(spark, sf_dir))


@_query(_each("col0 AS method, 's/'||s_suppkey||'.gd' AS target_path, col1 AS target, 1::BIGINT AS sites", "('_ready', '_used'), ('_used', 'make')"))
def incoming_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.incoming_calls(_own_model(spark, sf_dir))


@_query(_each("col0 AS method, 1::BIGINT AS targets, 1::BIGINT AS sites", "('_ready'), ('_used')"))
def outgoing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.outgoing_calls(_own_model(spark, sf_dir))


@_query(_each(f"{_K.format('col0')} AS name, col1 AS member, col2::BIGINT AS \"references\"", "('paid', 'signal', 1), ('never_{k}', 'signal', 0), ('State', 'enum', 2), ('LIMIT', 'const', 1), ('balance', 'var', 1), ('_later', 'var', 0), ('_count', 'var', 4), ('_unread', 'var', 0), ('_ready', 'func', 0), ('base_{k}', 'func', 0), ('make', 'func', 1), ('_used', 'func', 1), ('_unused', 'func', 0)"))
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reference_counts(_own_model(spark, sf_dir))


@_query(_each("col0 AS line, col1 AS col, col2 AS role, 'Strict' AS confidence", "(29, 0, 'declaration'), (18, 1, 'read')"))
def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.references(_own_model(spark, sf_dir), "_used")


@_query(_each("'_used' AS method, 'i' AS name, 1::BIGINT AS writes, 5::BIGINT AS reads, 'int' AS types", "(0)"))
def variable_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.variable_profiles(_own_facts(spark, sf_dir))


@_query(_each("col0 AS name, col1::BIGINT AS writes, col2::BIGINT AS reads, col3 AS types", "('balance', 0, 1, 'float'), ('_later', 0, 0, 'null'), ('_count', 1, 3, 'int'), ('_unread', 0, 0, 'int')"))
def class_variable_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.class_variable_profiles(_own_facts(spark, sf_dir))


@_query(_each(f"{_K.format('col0')} AS method, col1 AS declared, col2 AS types, col3 AS returns", "('_ready', 'void', 'void', 0), ('base_{k}', 'int', 'Variant', 1), ('make', 'int', 'Variant', 1), ('_used', 'void', 'void', 0), ('_unused', 'void', 'void', 0)"))
def return_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.return_profiles(_own_facts(spark, sf_dir))


@_query(_each("col0 AS method, col1 AS parameter, col2 AS expected, col3 AS actual, '' AS extra", "('_used', 'amount', 'int', 'Variant'), ('make', 'given', 'Variant', 'int')").replace("'' AS extra", "CASE WHEN col2 = 'Variant' THEN '' ELSE 'Variant' END AS extra"))
def parameter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parameter_diff(_own_model(spark, sf_dir))


@_query("SELECT 'paid' AS name, count(*) AS emits, 0::BIGINT AS connects FROM supplier")
def signal_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.signal_hubs(_own_facts(spark, sf_dir))


@_query(_each("30 AS line, 'i' AS name, 'int' AS type", "(0)"))
def inlay_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.inlay_hints(_own_facts(spark, sf_dir))


@_query(_each("col0 AS kind, col1 AS line, col2 AS end_line", "('MethodDeclaration', 14, 18), ('MethodDeclaration', 21, 22), ('MethodDeclaration', 25, 26), ('MethodDeclaration', 29, 35), ('ForStatement', 30, 35), ('IfStatement', 31, 35), ('MethodDeclaration', 38, 39)"))
def folding_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.folding_ranges(project.syntax_rows(_own(spark, sf_dir)))


@_query(_each(f"{_K.format('col0')} AS name, col1 AS kind, col2 AS line, col3 AS container", "('paid', 'signal', 4, NULL), ('never_{k}', 'signal', 5, NULL), ('State', 'enum', 6, NULL), ('IDLE', 'enum_value', 6, 'State'), ('BUSY', 'enum_value', 6, 'State'), ('LOST', 'enum_value', 6, 'State'), ('LIMIT', 'variable', 7, NULL), ('balance', 'variable', 8, NULL), ('_later', 'variable', 9, NULL), ('_count', 'variable', 10, NULL), ('_unread', 'variable', 11, NULL), ('_ready', 'method', 14, NULL), ('base_{k}', 'method', 21, NULL), ('make', 'method', 25, NULL), ('_used', 'method', 29, NULL), ('_unused', 'method', 38, NULL)"))
def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.document_symbols(project.syntax_rows(_own(spark, sf_dir)))


@_query("SELECT col0 AS kind, (col1 * (SELECT count(*) FROM supplier))::BIGINT AS n FROM (VALUES ('ClassDeclaration', 1), ('ClassNameAttribute', 1), ('ExtendsAttribute', 1), ('SignalDeclaration', 2), ('EnumDeclaration', 1), ('EnumValueDeclaration', 3), ('VariableDeclaration', 5), ('MethodDeclaration', 5), ('ParameterDeclaration', 4), ('ForStatement', 1), ('IfStatement', 1), ('IfBranch', 1), ('ElifBranch', 1), ('ReturnExpression', 2), ('PassExpression', 1), ('CallExpression', 7), ('DualOperatorExpression', 6), ('MemberOperatorExpression', 3), ('CustomAttribute', 2))")
def syntax_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "ClassDeclaration ClassNameAttribute ExtendsAttribute SignalDeclaration EnumDeclaration EnumValueDeclaration VariableDeclaration MethodDeclaration ParameterDeclaration ForStatement IfStatement IfBranch ElifBranch ReturnExpression PassExpression CallExpression DualOperatorExpression MemberOperatorExpression CustomAttribute"
    return views.syntax_kinds(project.syntax_rows(_own(spark, sf_dir)).where(F.col("kind").isin(kinds.split())))


def _points(spark: SparkSession, sf_dir: str, line: int, col: int) -> DataFrame:
    return generated.keys(spark, sf_dir).select(F.concat(F.lit("s/"), F.col("k").cast("string"), F.lit(".gd")).alias("path"), F.lit(line).alias("line"), F.lit(col).alias("col"))


@_query(_each("31 AS line, 5 AS col, 'IdentifierExpression' AS kind, 'i' AS value", "(0)"))
def node_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.deepest(project.syntax_rows(_own(spark, sf_dir)), _points(spark, sf_dir, 31, 5))


@_query(_each("18 AS line, 1 AS col, '_used' AS name, 's/'||s_suppkey||'.gd' AS at, 29 AS at_line", "(0)"))
def go_to_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.definitions(_own_model(spark, sf_dir), _points(spark, sf_dir, 18, 1))


@_query(_each("16 AS line, 11 AS col, 'balance' AS name, 'float' AS type, NULL::VARCHAR AS doc", "(0)"))
def hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hover(_own_model(spark, sf_dir), _points(spark, sf_dir, 16, 11))


@_query(_each("'_count' AS name, col0 AS line, col1 AS col", "(10, 0), (15, 1), (17, 7), (18, 7), (22, 8)"))
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.highlights(_own_facts(spark, sf_dir), _points(spark, sf_dir, 17, 7))


@_query(_each("col0 AS name, col1 AS line, col2 AS col, col3 AS token", "('i', 31, 5, 'variable'), ('i', 31, 20, 'variable'), ('i', 32, 9, 'variable'), ('i', 33, 7, 'variable'), ('i', 35, 14, 'variable'), ('make', 35, 9, 'function'), ('LIMIT', 15, 10, 'constant')"))
def semantic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.semantic_tokens(_own_facts(spark, sf_dir)).where("name IN ('i', 'make', 'LIMIT')")


@_query("SELECT 's/'||s_suppkey||'.gd' AS path, name, kind, line FROM supplier, (VALUES ('balance', 'var', 8), ('base', 'func', 21)) AS v(stem, kind, line), LATERAL (SELECT CASE WHEN stem = 'base' THEN 'base_'||s_suppkey ELSE stem END AS name)")
def workspace_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.workspace_symbols(_own_facts(spark, sf_dir), "BA")


_LIMITED = "SELECT 's/'||s_suppkey||'.gd' AS path, 'LIMIT' AS name, s_suppkey::VARCHAR AS value FROM supplier"


@_query(_LIMITED)
def static_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.static_values(project.syntax_rows(_own(spark, sf_dir)))


_DEAD = "('enum_value', 'LOST', 6, 'ENU', 'Potential'), ('func', '_unused', 38, 'FNC', 'Strict'), ('func', 'base_{k}', 21, 'FPA', 'Potential'), ('signal', 'never_{k}', 5, 'FPA', 'Potential'), ('var', '_later', 9, 'VOR', 'Potential'), ('var', '_unread', 11, 'VNR', 'Strict')"


@_query(_each(f"col0 AS kind, {_K.format('col1')} AS name, col2 AS line, col3 AS reason, col4 AS confidence", _DEAD))
def liveness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.report(liveness.Evidence(_own_model(spark, sf_dir)))


@_query(f"SELECT kind, reason, confidence, count(*) AS n FROM supplier, (VALUES {_DEAD}) AS v(kind, name, line, reason, confidence) GROUP BY ROLLUP (kind, reason, confidence)")
def liveness_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.rollup(liveness.report(liveness.Evidence(_own_model(spark, sf_dir))))


@_query("SELECT 's/'||s_suppkey||'.gd' AS path, 6::BIGINT AS n, 2::BIGINT AS strict FROM supplier ORDER BY 1 LIMIT 10")
def liveness_worst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.worst_files(liveness.report(liveness.Evidence(_own_model(spark, sf_dir))))


@_query(_each(f"{_K.format('col0')} AS method, col1 AS parameters, col2 AS loc, col3 AS cyclomatic, col4 AS cognitive, col5 AS nesting, col6 AS returns", "('_ready', 0, 5, 1, 0, 0, 0), ('base_{k}', 0, 2, 1, 0, 0, 1), ('make', 1, 2, 1, 0, 0, 1), ('_used', 1, 7, 5, 5, 2, 0), ('_unused', 1, 2, 1, 0, 0, 0)"))
def method_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nodes, uses = _parsed(spark, sf_dir)
    return code.method_metrics(nodes, uses).select("path", "method", "parameters", "loc", "cyclomatic", "cognitive", "nesting", "returns")


@_query(_each("40 AS total, 12 AS blank, 1 AS comment, 27 AS code, 5 AS methods, 1.8::DOUBLE AS avg_cyclomatic, 5 AS max_cyclomatic, 2 AS max_nesting", "(0)"))
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, nodes, uses = _parsed(spark, sf_dir)
    return code.file_metrics(files, code.method_metrics(nodes, uses)).select("path", "total", "blank", "comment", "code", "methods", "avg_cyclomatic", "max_cyclomatic", "max_nesting")


@_query(_each("2 AS annotated, 4 AS inferred, 2 AS untyped, 25.0::DOUBLE AS annotated_share, 75.0::DOUBLE AS typed_share", "(0)"))
def type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.type_coverage(_parsed(spark, sf_dir)[1])


@_query("SELECT 's/'||a.s_suppkey||'.gd' AS path, 's/'||b.s_suppkey||'.gd' AS ancestor_path, (a.s_suppkey-b.s_suppkey)::INT AS depth FROM supplier a JOIN supplier b ON a.s_suppkey // 5 = b.s_suppkey // 5 AND a.s_suppkey > b.s_suppkey")
def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.inheritance(_parsed(spark, sf_dir)[1])


@_query(_each("34 AS line, 'TODO' AS tag, 'price of '||s_suppkey AS note", "(0)"))
def todo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.todo_tags(_own(spark, sf_dir))


@_query(_each("col0 AS rule, col1::BIGINT AS n", "('GDL301', 2), ('GDL238', 3), ('GDL202', 1), ('GDL203', 1), ('GDL252', 1), ('GDL207', 1)"))
def lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, nodes, uses = _parsed(spark, sf_dir)
    return code.lint(files, nodes, uses).groupBy("path", "rule").agg(F.count("*").alias("n"))


@_query(_each("34 AS line, 0 AS col, 35 AS end_line, 0 AS end_col, '' AS text", "(0)"))
def plan_remove_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refactor.plan(_own(spark, sf_dir), "remove_comments")


@_query(_each("col0 AS line, col1 AS col, col0 AS end_line, col1 AS end_col, ': int' AS text", "(10, 10), (11, 11)"))
def plan_type_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refactor.plan(_own(spark, sf_dir), "add_type_annotations")


@_query(_each("31 AS line, col0 AS col, 31 AS end_line, col1 AS end_col, col2 AS text", "(5, 25, 'i % 2 != 0 or i <= 3')"))
def plan_invert_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refactor.plan(_own(spark, sf_dir), "invert_condition", 31)


@_query(_each("'tabs' AS indent, 1 AS width, 38 AS longest, 12::BIGINT AS blank_lines", "(0)"))
def extract_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.extract_style(_own(spark, sf_dir))


@_query(_each("col0 AS rule, col1 AS line, col2 AS severity, col3 AS message", "('X1', 34, 'warning', 'todo'), ('X2', 30, 'hint', 'loop over i'), ('X3', 31, 'error', 'two conditions')"))
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rules over lines, syntax rows and trees."""
    registry = rules.Registry()
    registry.add(rules.line_rule("X1", "todo", r"# TODO", "todo", skip_comments=False))
    registry.add(rules.node_rule("X2", "loops", F.col("kind") == "ForStatement", F.concat(F.lit("loop over "), "value"), "hint"))
    registry.add(rules.visitor_rule("X3", "conditions", lambda tree: [(n.line, "two conditions") for n in tree.walk() if n.kind == "DualOperatorExpression" and n.value == "And"], "error"))
    files = _own(spark, sf_dir)
    return registry.run(rules.Views(files, project.syntax_rows(files)))


@_query("SELECT 0 AS files, 0::BIGINT AS autoloads, 0::BIGINT AS nodes, false AS reachable".replace("0 AS files", "0::BIGINT AS files"))
def csharp_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "name string, target string, singleton boolean, kind string")
    return settings.csharp_index(_own(spark, sf_dir), none, project.scene_nodes(_scenes(spark, sf_dir)))


# --- duplicates over tokens, couplings, groupings --------------------------------------------------------

_TOKENS = "('_ready', 32), ('base_{k}', 9), ('make', 10), ('_used', 45), ('_unused', 9)"


@_query(_each(f"{_K.format('col0')} AS method, col1 AS n_tokens", _TOKENS))
def method_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens each method has, comments and blanks left out."""
    return project.method_tokens(_own(spark, sf_dir)).select("path", "method", F.size("tokens").alias("n_tokens"))


@_query("SELECT col0 AS n_tokens, count(*) AS instances FROM supplier, (VALUES (32), (9), (10), (45), (9)) AS v GROUP BY col0 HAVING count(*) > 1")
def dup_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that are equal but for names, texts and numbers, by their number of tokens."""
    methods = project.method_tokens(_own(spark, sf_dir)).select(F.size("tokens").alias("n_tokens"), duplicates.block_hash(F.array_join("tokens", " ")).alias("hash"))
    return methods.groupBy("n_tokens", "hash").agg(F.count("*").alias("n")).groupBy("n_tokens").agg(F.sum("n").alias("instances")).where("instances > 1")


@_query(_each("'_used' AS method, 6::BIGINT AS windows", "(0)"))
def dup_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of forty tokens in each method that has so many."""
    methods = project.method_tokens(_own(spark, sf_dir))
    windows = duplicates.token_windows(methods, ["path", "method"], "tokens", 40)
    again = duplicates.exact_duplicates(windows).select("hash")
    return windows.join(again, "hash").groupBy("path", "method").agg(F.count("*").alias("windows"))


@_query("SELECT *, (fan_out + fan_in)::BIGINT AS coupling FROM (SELECT 's/'||(s_suppkey)||'.gd' AS path, (CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END)::BIGINT AS fan_out, (1 + CASE WHEN s_suppkey % 5 < 4 AND s_suppkey < top THEN 1 ELSE 0 END)::BIGINT AS fan_in FROM supplier, (SELECT max(s_suppkey) AS top FROM supplier)) ORDER BY coupling DESC, path LIMIT 10")
def most_coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts with most direct dependencies both ways: each extends the one before it and is preloaded once."""
    suppliers = generated.keys(spark, sf_dir)
    files = generated.own_files(suppliers).unionByName(generated.texts(suppliers, generated.RISKY, "r", ".gd"))
    parsed = staged(project.parsed(files), "parsed")
    return code.most_coupled(code.dependencies(project.nodes(parsed), project.uses(parsed)))


@_query(_each(f"{_K.format('col0')} AS method, col1 AS cognitive, col2 AS nesting", "('_ready', 0, 0), ('base_{k}', 0, 0), ('make', 0, 0), ('_used', 4, 1), ('_unused', 0, 0)"))
def method_metrics_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as reports give them that never add nesting."""
    _, nodes, uses = _parsed(spark, sf_dir)
    return code.method_metrics(nodes, uses, compat=True).select("path", "method", "cognitive", "nesting")


@_query("SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS lengths FROM documents GROUP BY CUBE (lang, source)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.cube("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("n_chars").alias("lengths"))


@_query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


@_query(_each("col0 AS kind, col1 AS type, col2::BIGINT AS n", "('CallExpression', 'Variant', 1), ('CallExpression', 'Array[int]', 1), ('CallExpression', 'int', 1), ('CallExpression', 'void', 4), ('DualOperatorExpression', 'bool', 4), ('DualOperatorExpression', 'int', 1), ('MemberOperatorExpression', 'int', 2)"))
def expression_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many expressions of each kind have which type."""
    return diagnostics.of_kind(_own_facts(spark, sf_dir), "expression").groupBy("path", F.col("owner").alias("kind"), "type").agg(F.count("*").alias("n"))


@_query(_each("1::BIGINT AS unknown, 13::BIGINT AS known", "(0)"))
def inference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.inference_report(_own_facts(spark, sf_dir))


# --- how things are wired -----------------------------------------------------------------------------------


def _wired(columns: str, rows: str) -> str:
    return f"SELECT 'wired/'||s_suppkey||'.gd' AS path, {columns} FROM supplier, (VALUES {rows}) AS v WHERE {_turn('wired')}"


def _wired_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = generated.feature_files(generated.keys(spark, sf_dir), generated.FINDINGS).where("path LIKE 'wired/%'")
    return staged(project.analysed(files).select("path", F.inline("facts")), "facts")


@_query(_wired("col0 AS name, '_ready' AS method, col1 AS how", "('_set', 'unconditional'), ('_maybe', 'conditional')"))
def initialised_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.initialised(_wired_facts(spark, sf_dir))


@_query(_wired("col0 AS method, col1 AS safe", "('_ready', true), ('_late', true), ('_by_name', false), ('_by_text', false)"))
def ready_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ready_safe(diagnostics.Model(_wired_facts(spark, sf_dir)))


@_query(_wired("col0 AS name, 'self' AS receiver, col1 AS by, col2 AS line", "('_by_name', 'Callable', 14), ('_by_text', 'Expression', 16)"))
def named_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.named_calls(_wired_facts(spark, sf_dir))


@_query(_wired("'_by_name' AS method, 26 AS line, 'get_method_list' AS list, 'self' AS receiver, false AS in_loop", "(0)"))
def reflection_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reflection_sites(_wired_facts(spark, sf_dir))


@_query(f"SELECT 'g'||s_suppkey AS \"group\", 1::BIGINT AS members FROM supplier WHERE {_turn('wired')}")
def script_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.script_groups(_wired_facts(spark, sf_dir))


@_query(_wired("'_by_text' AS method, 1::BIGINT AS instantiated, 1::BIGINT AS added, 0::BIGINT AS scripted, 0::BIGINT AS freed", "(0)"))
def instantiations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.instantiations(_wired_facts(spark, sf_dir))


@_query(_wired("'_late' AS method, '_list' AS name, col0 AS step, col1 AS line, col2 AS type", "(1, 21, 'Variant'), (2, 22, 'String')"))
def container_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.container_provenance(_wired_facts(spark, sf_dir))


@_query(_wired("33 AS line, 1::BIGINT AS parameters, true AS in_call", "(0)"))
def lambdas(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = generated.feature_files(generated.keys(spark, sf_dir), generated.FINDINGS).where("path LIKE 'wired/%'")
    return views.lambdas(project.syntax_rows(files))


@_query(f"SELECT 'GD4011/'||s_suppkey||'.gd' AS path, col0 AS line, col1 AS node, col2 AS type FROM supplier, (VALUES (5, 'Here', 'Timer'), (6, 'Here/Below', 'Node'), (8, 'Unique', 'Node')) AS v WHERE {_turn('GD4011')}")
def scene_node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that scenes give to their scripts' node paths."""
    return views.node_types(_feature_facts(spark, sf_dir), project.scene_nodes(_scenes(spark, sf_dir)))


@_query(_each("col0 AS method, col1 AS name, col2 AS step, col3 AS line, col4 AS type", "('_used', 'i', 1, 30, 'int'), ('_used', 'amount', 1, 29, 'int'), ('make', 'given', 1, 25, 'Variant'), ('_unused', 'spare', 1, 38, 'Variant'), ('_ready', '_count', 1, 15, 'int')"))
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.provenance(_own_facts(spark, sf_dir))
