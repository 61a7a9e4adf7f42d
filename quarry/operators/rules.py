"""Extension points: own rules over lines, nodes and facts, own fixes, formats, constants and types.

A rule is a name with a function of a project's views that gives (path, line,
message); a registry runs those that are on and joins their severity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import syntax
from quarry.sources.syntax import Syn


@dataclass(frozen=True)
class Views:
    """What rules may look at."""

    files: DataFrame
    rows: DataFrame | None = None
    facts: DataFrame | None = None


@dataclass(frozen=True)
class Rule:
    rule: str
    name: str
    category: str
    severity: str
    find: Callable[[Views], DataFrame]
    enabled: bool = True


def line_rule(rule: str, name: str, pattern: str, message: str, severity: str = "warning", skip_comments: bool = True) -> Rule:
    """A rule that a pattern finds in lines."""

    def find(views: Views) -> DataFrame:
        lines = views.files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("p", "l")).where(F.col("l").rlike(pattern))
        lines = lines.where(~F.ltrim("l").startswith("#")) if skip_comments else lines
        return lines.select("path", (F.col("p") + 1).alias("line"), F.lit(message).alias("message"))

    return Rule(rule, name, "text", severity, find)


def node_rule(rule: str, name: str, condition: Column, message: Column, severity: str = "warning") -> Rule:
    """A rule that a condition finds in syntax rows."""
    return Rule(rule, name, "syntax", severity, lambda views: views.rows.where(condition).select("path", "line", message.alias("message")))


def visitor_rule(rule: str, name: str, visit: Callable[[Syn], list[tuple[int, str]]], severity: str = "warning") -> Rule:
    """A rule that a function finds in a script's syntax tree: (line, message) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, *f) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in visit(syntax.script(t))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], names=["path", "line", "message"])

    return Rule(rule, name, "visitor", severity, lambda views: views.files.select("path", "text").mapInArrow(run, "path string, line int, message string"))


@dataclass
class Registry:
    """Rules by their code; later ones replace earlier ones of the same code."""

    rules: dict[str, Rule] = field(default_factory=dict)

    def add(self, rule: Rule) -> Registry:
        self.rules[rule.rule] = rule
        return self

    def remove(self, rule: str) -> bool:
        return self.rules.pop(rule, None) is not None

    def get(self, rule: str) -> Rule | None:
        return self.rules.get(rule)

    def of_category(self, category: str) -> list[Rule]:
        return [r for r in self.rules.values() if r.category == category]

    def run(self, views: Views, only: set[str] | None = None) -> DataFrame:
        """(path, rule, line, severity, message) of the rules that are on."""
        parts = [r.find(views).select("path", F.lit(r.rule).alias("rule"), "line", F.lit(r.severity).alias("severity"), "message") for r in self.rules.values() if (r.rule in only if only is not None else r.enabled)]
        if not parts:
            return views.files.limit(0).select("path", F.lit("").alias("rule"), F.lit(0).alias("line"), F.lit("").alias("severity"), F.lit("").alias("message"))
        return reduce(DataFrame.unionByName, parts)


@dataclass
class Modules:
    """Handlers by name; of several the one of highest priority answers."""

    handlers: dict[str, list[tuple[int, Callable]]] = field(default_factory=dict)

    def register(self, name: str, handler: Callable, priority: int = 0) -> None:
        self.handlers.setdefault(name, []).append((priority, handler))
        self.handlers[name].sort(key=lambda h: -h[0])

    def call(self, name: str, *given):
        if name not in self.handlers:
            raise KeyError(f"no handler for {name}")
        return self.handlers[name][0][1](*given)


def formatted(text: Column, rules: list[Callable[[Column], Column]]) -> Column:
    """A text after own format rules, one after another."""
    return reduce(lambda t, rule: rule(t), rules, text)


def fixes(issues: DataFrame, providers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(path, line, rule, fix): what providers suggest for the issues of their rule."""
    parts = [provider(issues.where(F.col("rule") == rule)).select("path", "line", F.lit(rule).alias("rule"), "fix") for rule, provider in providers.items()]
    return reduce(DataFrame.unionByName, parts)


def static_values(rows: DataFrame, own: dict[str, str] | None = None) -> DataFrame:
    """(path, name, value): constants whose value is one literal; ``own`` adds names and values to all files."""
    named = rows.where("kind = 'VariableDeclaration' AND array_contains(marks, 'const')").select("path", F.col("pre").alias("parent"), F.col("value").alias("name"))
    literals = rows.where("kind IN ('NumberExpression', 'StringExpression', 'BoolExpression', 'StringNameExpression')").select("path", "parent", "value")
    out = named.join(literals, ["path", "parent"]).select("path", "name", F.regexp_replace("value", "^[&^r]?[\"']|[\"']$", "").alias("value"))
    for name, value in (own or {}).items():
        out = out.unionByName(rows.select("path").distinct().select("path", F.lit(name).alias("name"), F.lit(value).alias("value")))
    return out


def string_values(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, name, value): texts that a name may hold: its constant, or literals it is set to."""
    constants = static_values(rows)
    spots = rows.where("kind = 'StringExpression'").select("path", "parent", "value")
    variables = rows.where("kind IN ('VariableDeclaration', 'VariableDeclarationStatement')").select("path", F.col("pre").alias("parent"), F.col("value").alias("name"))
    first = variables.join(spots, ["path", "parent"]).select("path", "name", F.regexp_replace("value", "^[\"']|[\"']$", "").alias("value"))
    return constants.unionByName(first).distinct()
