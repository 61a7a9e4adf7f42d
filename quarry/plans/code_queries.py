"""Queries over parsed scripts of the project that is generated from the supplier table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import code, edits, types
from quarry.sources import generated, project, sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Project:
    """The views of a set of scripts and scenes; scripts are parsed once and staged."""

    def __init__(self, files: DataFrame, scenes: DataFrame):
        from quarry.staging import staged

        self.files, self.scenes = files, scenes
        parsed = staged(project.parsed(files), "parsed")
        self.nodes, self.uses = project.nodes(parsed), project.uses(parsed)


def sample_project(spark: SparkSession) -> Project:
    """The small project of the tests."""
    return Project(project.in_memory(spark, sample.SCRIPTS), project.in_memory(spark, sample.SCENES))


def made_project(spark: SparkSession, sf_dir: str) -> Project:
    """Two scripts of every supplier, and the scenes."""
    suppliers = generated.keys(spark, sf_dir)
    return Project(generated.own_files(suppliers).unionByName(generated.texts(suppliers, generated.RISKY, "r", ".gd")), generated.scene_files(suppliers))


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f"code_{f.__name__}"] = f
    return f


@_query
def ast_nodes(spark, sf_dir):
    return made_project(spark, sf_dir).nodes.select("path", "node_id", "parent_id", "kind", "name", "start_line", "end_line", "depth")


@_query
def symbols(spark, sf_dir):
    return code.symbols(made_project(spark, sf_dir).nodes).select("path", "kind", "name", "type_name", "is_static", "is_public", "line")


@_query
def list_public_functions(spark, sf_dir):
    return code.symbols(made_project(spark, sf_dir).nodes).where(code.SymbolFilter(kind="func", public=True).column()).select("path", "name", "line")


@_query
def list_exports(spark, sf_dir):
    return code.symbols(made_project(spark, sf_dir).nodes).where(code.SymbolFilter(kind="var", modifier="export").column()).select("path", "name", "type_name")


@_query
def method_metrics(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.method_metrics(p.nodes, p.uses).drop("method_id")


@_query
def file_metrics(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.file_metrics(p.files, code.method_metrics(p.nodes, p.uses)).withColumn("index", F.round("index", 6))


@_query
def project_metrics(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.project_metrics(code.file_metrics(p.files, code.method_metrics(p.nodes, p.uses))).withColumn("avg_cyclomatic", F.round("avg_cyclomatic", 6)).withColumn("index", F.round("index", 6))


@_query
def type_coverage(spark, sf_dir):
    return code.type_coverage(made_project(spark, sf_dir).nodes)


@_query
def inheritance(spark, sf_dir):
    return code.inheritance(made_project(spark, sf_dir).nodes)


@_query
def dependencies(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.dependencies(p.nodes, p.uses, project.scene_resources(p.scenes))


@_query
def dependency_report(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.dependency_report(code.dependencies(p.nodes, p.uses, project.scene_resources(p.scenes)))


@_query
def missing_resources(spark, sf_dir):
    p = made_project(spark, sf_dir)
    there = p.files.select("path").unionByName(p.scenes.select("path")).select(F.concat(F.lit("res://"), "path").alias("target"))
    return project.scene_resources(p.scenes).join(there, "target", "left_anti").select("path", "target", "type")


@_query
def call_sites(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.call_sites(p.nodes, p.uses)


@_query
def dead_code(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.dead_code(p.nodes, p.uses, project.scene_connections(p.scenes))


@_query
def unreachable(spark, sf_dir):
    return code.unreachable(made_project(spark, sf_dir).nodes)


@_query
def lint(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.lint(p.files, p.nodes, p.uses)


@_query
def lint_unsuppressed(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.unsuppressed(code.lint(p.files, p.nodes, p.uses), code.suppressions(p.files, p.nodes))


@_query
def todo_tags(spark, sf_dir):
    return code.todo_tags(made_project(spark, sf_dir).files)


@_query
def scene_nodes(spark, sf_dir):
    return project.scene_nodes(generated.scene_files(generated.keys(spark, sf_dir))).withColumn("groups", F.array_join("groups", ","))


@_query
def scene_connections(spark, sf_dir):
    return project.scene_connections(generated.scene_files(generated.keys(spark, sf_dir)))


@_query
def autoloads(spark, sf_dir):
    return project.autoloads(generated.texts(generated.keys(spark, sf_dir), generated.SETTINGS, "p", "/project.godot"))


@_query
def resource_properties(spark, sf_dir):
    return project.resource_properties(generated.texts(generated.keys(spark, sf_dir), generated.RESOURCE, "t", ".tres"))


@_query
def declared_types(spark, sf_dir):
    return types.declared_types(made_project(spark, sf_dir).nodes)


@_query
def return_types(spark, sf_dir):
    return types.return_types(made_project(spark, sf_dir).nodes).withColumn("types", F.array_join("types", "|"))


@_query
def parameter_types(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return types.parameter_types(p.nodes, p.uses).withColumn("types", F.array_join("types", "|"))


@_query
def type_conflicts(spark, sf_dir):
    return types.type_conflicts(made_project(spark, sf_dir).nodes)


@_query
def narrowings(spark, sf_dir):
    return types.narrowings(made_project(spark, sf_dir).nodes)


@_query
def may_be_null(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return types.may_be_null(p.nodes, p.uses)


@_query
def duck_types(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return types.duck_types(p.nodes, p.uses).select("path", "name", F.array_join("needs", ",").alias("needs"), F.array_join("fits", ",").alias("fits"))


@_query
def rename_plan(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return edits.rename_plan(p.nodes, p.uses, "_count", "amount")


@_query
def formatted(spark, sf_dir):
    files = made_project(spark, sf_dir).files
    return files.select("path", edits.formatted(F.col("text")).alias("text"))


@_query
def quick_fixes(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return edits.quick_fixes(code.lint(p.files, p.nodes, p.uses))


@_query
def unsafe_calls(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.unsafe_calls(p.uses)


@_query
def signal_connections(spark, sf_dir):
    p = made_project(spark, sf_dir)
    return code.signal_connections(p.nodes, p.uses)


@_query
def scene_edges(spark, sf_dir):
    return project.scene_edges(generated.scene_files(generated.keys(spark, sf_dir)))
