"""Settings files: the tool's JSON, a linter's rc file, project input actions, and C# files beside scripts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.patterns import path_glob_regex
from quarry.sources import project

# Rules of the other linter's rc file and the rules here that they stand for.
RC_RULES = {
    "class-name": "GDL001", "function-name": "GDL002", "class-variable-name": "GDL003", "constant-name": "GDL004", "signal-name": "GDL005", "enum-name": "GDL006", "enum-element-name": "GDL007", "sub-class-name": "GDL009", "max-line-length": "GDL101", "max-file-lines": "GDL102",
    "unused-argument": "GDL202", "unnecessary-pass": "GDL251", "function-arguments-number": "GDL205", "max-returns": "GDL223", "max-public-methods": "GDL222", "comparison-with-itself": "GDL213", "duplicated-load": "GDL219", "no-elif-return": "GDL216", "no-else-return": "GDL217",
    "private-method-call": "GDL218", "expression-not-assigned": "GDL224", "class-definitions-order": "GDL301", "trailing-whitespace": "GDL502", "mixed-tabs-and-spaces": "GDL501",
}
SEVERITIES = ("error", "warning", "info", "hint")


@dataclass
class Settings:
    """What a project says about its checks."""

    enabled: dict[str, bool] = field(default_factory=dict)
    severity: dict[str, str] = field(default_factory=dict)
    limits: dict[str, int] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    indent: str = "tabs"
    max_line_length: int = 120
    fail_on_warning: bool = False


#: Settings to start from.
PRESETS = {"default": Settings(), "strict": Settings(enabled={"GDL204": True, "GDL215": True, "GDL209": True}, fail_on_warning=True), "relaxed": Settings(enabled={"GDL101": False, "GDL301": False}, max_line_length=160)}


def from_json(text: str | None) -> Settings:
    """Settings of a JSON text; what is missing or unknown is left as it is by default."""
    try:
        given = json.loads(text or "{}")
    except json.JSONDecodeError:
        return Settings()
    if not isinstance(given, dict):
        return Settings()
    known = {f.name: f for f in fields(Settings)}
    base = asdict(Settings())
    return Settings(**(base | {k: v for k, v in given.items() if k in known and type(v) is type(base[k])}))


def to_json(settings: Settings) -> str:
    return json.dumps(asdict(settings), indent=2, sort_keys=True)


def problems(text: str | None) -> list[str]:
    """What is wrong with a JSON settings text: its form, unknown names, kinds, ranges."""
    try:
        given = json.loads(text or "{}")
    except json.JSONDecodeError as e:
        return [f"not JSON: {e.msg} at line {e.lineno}"]
    if not isinstance(given, dict):
        return ["not an object"]
    base = asdict(Settings())
    out = [f"unknown setting: {k}" for k in given if k not in base]
    out += [f"{k} should be {type(base[k]).__name__}" for k, v in given.items() if k in base and type(v) is not type(base[k])]
    severity = given.get("severity")
    out += [f"unknown severity: {v}" for v in (severity.values() if isinstance(severity, dict) else ()) if v not in SEVERITIES]
    if isinstance(given.get("max_line_length"), int) and not 20 <= given["max_line_length"] <= 1000:
        out.append("max_line_length should be 20 to 1000")
    if given.get("indent") not in (None, "tabs", "spaces"):
        out.append("indent should be tabs or spaces")
    return out


def from_rc(text: str | None) -> Settings:
    """Settings of a linter's rc file: ``rule: value`` lines, lists as ``- item`` or ``[a, b]``."""
    out = Settings()
    name = None
    for line in (text or "").split("\n"):
        line = line.split("#")[0].rstrip()
        if not line.strip():
            continue
        if line.lstrip().startswith("- "):
            item = line.strip()[2:].strip().strip("\"'")
            if name == "disable" and item in RC_RULES:
                out.enabled[RC_RULES[item]] = False
            elif name == "excluded_directories":
                out.exclude.append(item)
            continue
        name, _, value = (x.strip() for x in line.partition(":"))
        items = [x.strip().strip("\"'") for x in value.strip("[]").split(",") if x.strip()] if value.startswith("[") else []
        if name == "disable":
            out.enabled |= {RC_RULES[x]: False for x in items if x in RC_RULES}
        elif name == "excluded_directories":
            out.exclude += items
        elif name == "max-line-length" and value.isdigit():
            out.max_line_length = int(value)
        elif name in RC_RULES and value.isdigit():
            out.limits[RC_RULES[name]] = int(value)
        elif name in RC_RULES and value in ("null", "false"):
            out.enabled[RC_RULES[name]] = False
    return out


def apply(findings: DataFrame, settings: Settings, rule: str = "rule") -> DataFrame:
    """Findings under settings: rules that are off and excluded paths go, severities change."""
    off = [r for r, on in settings.enabled.items() if not on]
    out = findings.where(~F.col(rule).isin(off)) if off else findings
    for pattern in settings.exclude:
        out = out.where(~F.col("path").rlike(path_glob_regex(pattern)))
    if settings.severity and "severity" in out.columns:
        own = F.create_map(*[F.lit(x) for pair in settings.severity.items() for x in pair])
        out = out.withColumn("severity", F.coalesce(F.try_element_at(own, F.col(rule)), F.col("severity")))
    return out


def input_actions(settings_files: DataFrame) -> DataFrame:
    """(name) of the input actions of a project's settings file."""
    return project.sections(settings_files).where("header = '[input]' AND key IS NOT NULL").select(F.col("key").alias("name")).distinct()


def csharp(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the C# files below a folder."""
    return project.scan(spark, root, "*.cs").select("path")


def csharp_index(files: DataFrame, autoloads: DataFrame, scene_nodes: DataFrame) -> DataFrame:
    """One row (files, autoloads, nodes, reachable): what C# there is, and whether it may reach scripts."""
    n = files.where(F.col("path").endswith(".cs")).agg(F.count("*").alias("files"))
    a = autoloads.where("kind = 'csharp'").agg(F.count("*").alias("autoloads"))
    s = scene_nodes.where(F.col("script").endswith(".cs")).agg(F.count("*").alias("nodes"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731 - three one-row aggregates meet on a constant
    return one(n).join(one(a), "one").join(one(s), "one").select("files", "autoloads", "nodes", (F.col("files") > 0).alias("reachable"))
