"""What a project never uses, by an ordered cascade of evidence, with reason codes and confidence.

A function is asked for evidence of life step by step, the first that holds
decides: a call on its class, a signal, a use in its file, an access from
another, an override that is called, an accessor, a use in a class below,
reflection, a Callable or Expression by name.  A call of its name on an unknown
type makes it doubtful, and nothing makes it dead.  What is dead then loses
confidence where others may reach it.  Evidence is joined on (path, name);
nothing is compared pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.patterns import path_glob_regex
from quarry.operators.code import ENGINE_CALLBACKS
from quarry.operators.diagnostics import Model, of_kind

# Reason codes.
REASONS = {
    "VNR": "variable never read", "VEX": "exported variable", "VOR": "variable set when ready", "FNC": "function has no callers", "FDT": "function may be called on an unknown type", "SNE": "signal never emitted", "SCB": "signal connected but never emitted",
    "CNU": "constant never used", "PNU": "parameter never used", "UCR": "unreachable code", "ENU": "enum value never used", "ICU": "inner class unused", "FPA": "public API of a named class", "CSI": "may be reached from C#", "VDA": "may be accessed dynamically", "TRF": "named in a resource file",
    "VPW": "only written on a local object", "PAA": "marked as public API", "DUA": "marked as dynamically used", "CUA": "marked by an own annotation", "APA": "public API of an add-on",
}
#: Confidences from sure to doubtful.
ORDER = {"Strict": 0, "Potential": 1, "NameMatch": 2}


@dataclass(frozen=True)
class LivenessOptions:
    """What counts and what is left out; fixed values, the defaults of the report that users know."""

    name_match: bool = False
    include_private: bool = True
    include_parameters: bool = False
    addons: tuple[str, ...] = ("addons/",)
    framework_prefixes: tuple[str, ...] = ()
    annotations: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    skip_tests: bool = False
    csharp: bool = False
    compat: bool = True  # enum values are looked for in their own file alone, unreachable code at a method's top level alone


OUT = ["path", "kind", "name", "line", "reason", "confidence"]
_ANNOTATED = {"public_api": "PAA", "dynamic_use": "DUA"}


@dataclass
class Evidence:
    """The joins' right sides, each (path, name) at the script that the name is looked up in."""

    model: Model
    signals: DataFrame | None = None  # scene connections: (script path, method)
    resources: DataFrame | None = None  # (path, key) of resource files' properties
    autoloads: DataFrame | None = None  # (path)
    cache: dict = field(default_factory=dict)

    def calls(self) -> DataFrame:
        """(path, name): methods called on self, on a class by name or type, here or in scripts below."""
        rows = of_kind(self.model.facts, "call").where("owner <> '*'").withColumn("type_name", F.regexp_replace("owner", "^class ", ""))
        homes = self.model.types().select(F.col("class_name").alias("type_name"), "home")
        placed = rows.join(homes, "type_name", "left").withColumn("at", F.when(F.col("owner").isin("self", "super"), F.col("path")).otherwise(F.col("home"))).where("at IS NOT NULL")
        # A method that only calls itself has no caller.
        other = placed.where(~((F.col("at") == F.col("path")) & F.col("method").eqNullSafe(F.col("name")) & (F.col("owner") == "self")))
        at = other.select("at", "name", (F.col("owner") == "super").alias("up")).distinct()
        members = self.model.members.where("member = 'func'").select(F.col("path").alias("at"), "name", F.col("at").alias("home"))
        return at.join(members, ["at", "name"]).select(F.col("home").alias("path"), "name").distinct()

    def connected(self) -> DataFrame:
        rows = of_kind(self.model.facts, "connect").where("owner IS NOT NULL AND owner <> 'lambda'").select("path", F.col("owner").alias("name"))
        if self.signals is not None:
            rows = rows.unionByName(self.signals.select("path", "name"))
        members = self.model.members.where("member = 'func'").select("path", "name", F.col("at").alias("home"))
        return rows.join(members, ["path", "name"]).select(F.col("home").alias("path"), "name").distinct()

    def used(self) -> DataFrame:
        """(path, name): read or handed on by name in the file itself, not in a call of itself."""
        rows = of_kind(self.model.facts, "use").where("owner <> 'local'").where(~F.col("method").eqNullSafe(F.col("name")))
        return rows.select("path", "name").distinct()

    def accessed(self) -> DataFrame:
        """(path, name): members accessed from elsewhere on a typed receiver, at the script that declares them."""
        rows = of_kind(self.model.facts, "access").where("owner NOT IN ('*', 'self', 'super')").withColumn("class_name", F.regexp_replace("owner", "^class ", ""))
        homes = rows.drop("path", "class_name").withColumn("class_name", F.regexp_replace("owner", "^class ", "")).join(self.model.types(), "class_name").select(F.col("home").alias("path"), "name")
        if self.resources is not None:
            homes = homes.unionByName(self.resources.select("path", F.col("key").alias("name")))
        members = self.model.members.select("path", "name", F.col("at").alias("declared"))
        return homes.join(members, ["path", "name"]).select(F.col("declared").alias("path"), "name").distinct()

    def inherited_uses(self) -> DataFrame:
        """(path, name): names used in scripts below and declared above."""
        rows = of_kind(self.model.facts, "use", "unresolved", "assign", "call", "access").where("owner IS NULL OR owner IN ('self', 'super', 'member')").select("path", "name").distinct()
        members = self.model.members.where("at <> path").select("path", "name", F.col("at").alias("declared"))
        return rows.join(members, ["path", "name"]).select(F.col("declared").alias("path"), "name").distinct()

    def overrides(self) -> DataFrame:
        """(path, name): methods that override one that is called."""
        called = self.calls().select(F.col("path").alias("dst"), "name")
        below = self.model.above.select(F.col("src").alias("path"), "dst")
        own = self.model.members.where("member = 'func' AND at = path").select("path", "name")
        return own.join(below, "path").join(called, ["dst", "name"]).select("path", "name").distinct()

    def accessors(self) -> DataFrame:
        rows = of_kind(self.model.facts, "accessor").where("name IS NOT NULL").select("path", "name")
        members = self.model.members.select("path", "name", F.col("at").alias("declared"))
        return rows.join(members, ["path", "name"]).select(F.col("declared").alias("path"), "name").distinct()

    def named(self) -> DataFrame:
        """(path, name): members named by a text in call, get, set, Callable or Expression."""
        rows = of_kind(self.model.facts, "dynamic_call", "dynamic_property").select("path", "name")
        members = self.model.members.select("path", "name", F.col("at").alias("declared"))
        return rows.join(members, ["path", "name"]).select(F.col("declared").alias("path"), "name").distinct()

    def duck(self) -> DataFrame:
        """(name): members asked of unknown types."""
        return of_kind(self.model.facts, "call", "access").where("owner = '*'").select("name").distinct()

    def any_target(self) -> DataFrame:
        return of_kind(self.model.facts, "call").select("name").distinct()


def _mark(df: DataFrame, evidence: DataFrame, name: str) -> DataFrame:
    on = [c for c in ("path", "name") if c in evidence.columns]
    return df.join(evidence.select(*on).distinct().withColumn(name, F.lit(True)), on, "left")


def _own(model: Model, *kinds: str) -> DataFrame:
    """(path, name, member, line, marks, class): members of the scripts' own classes."""
    roots = model.classes.select("path", F.col("class_name").alias("root"))
    rows = of_kind(model.facts, "member").where(F.col("owner").isin(*kinds)).join(roots, "path").where(F.col("class_name").eqNullSafe(F.col("root")))
    return rows.select("path", "name", F.col("owner").alias("member"), "line", "root").distinct()


def _downgraded(df: DataFrame, evidence: Evidence, options: LivenessOptions, dynamic: bool = False) -> DataFrame:
    """Strict findings of public members that others may reach: FPA, CSI, VDA, APA, in this order."""
    public = ~F.col("name").startswith("_")
    sure = (F.col("confidence") == "Strict") & public
    addon = reduce(lambda a, b: a | b, [F.col("path").startswith(p) for p in options.addons], F.lit(False))
    csharp = F.lit(options.csharp) & F.coalesce(F.col("autoload"), F.lit(False))
    reason = F.when(sure & F.col("root").isNotNull(), "FPA").when(sure & csharp, "CSI")
    reason = reason.when(sure & F.coalesce(F.col("given"), F.lit(False)), "VDA") if dynamic else reason
    reason = reason.when(sure & addon, "APA")
    less = df.withColumn("less", reason)
    return less.withColumn("confidence", F.when(F.col("less").isNotNull(), "Potential").otherwise(F.col("confidence"))).withColumn("reason", F.coalesce("less", "reason")).drop("less")


def _with_autoload(df: DataFrame, evidence: Evidence) -> DataFrame:
    if evidence.autoloads is None:
        return df.withColumn("autoload", F.lit(False))
    return df.join(evidence.autoloads.select("path").distinct().withColumn("autoload", F.lit(True)), "path", "left")


def functions(evidence: Evidence, options: LivenessOptions) -> DataFrame:
    """Functions by the cascade; (…, step) is the evidence that decided."""
    rows = _own(evidence.model, "func").where(~F.col("name").isin(ENGINE_CALLBACKS))
    for prefix in options.framework_prefixes:
        rows = rows.where(~F.col("name").startswith(prefix))
    if not options.include_private:
        rows = rows.where(~F.col("name").startswith("_"))
    steps = [("s1", evidence.calls()), ("s2", evidence.connected()), ("s3", evidence.used()), ("s4", evidence.accessed()), ("s5", evidence.overrides()), ("s6", evidence.accessors()), ("s8", evidence.inherited_uses()), ("s10", evidence.named()), ("s12", evidence.duck())]
    if options.name_match:
        steps.append(("s13", evidence.any_target()))
    for name, found in steps:
        rows = _mark(rows, found, name)
    step = reduce(lambda rest, s: F.when(F.col(s[0]), s[0]).otherwise(rest), reversed(steps), F.lit("s14"))
    rows = rows.withColumn("step", step).where(F.col("step").isin("s12", "s13", "s14"))
    rows = rows.withColumn("reason", F.when(F.col("step") == "s14", "FNC").otherwise("FDT")).withColumn("confidence", F.when(F.col("step") == "s12", "Potential").when(F.col("step") == "s13", "NameMatch").otherwise("Strict"))
    return _downgraded(_with_autoload(rows, evidence), evidence, options).withColumn("kind", F.lit("func")).select(*OUT)


def variables(evidence: Evidence, options: LivenessOptions) -> DataFrame:
    """Member variables that nothing reads."""
    facts = evidence.model.facts
    rows = _own(evidence.model, "var")
    for name, found in (("s3", evidence.used()), ("s4", evidence.accessed()), ("s8", evidence.inherited_uses()), ("s10", evidence.named()), ("s12", evidence.duck())):
        rows = _mark(rows, found, name)
    rows = rows.where("s3 IS NULL AND s4 IS NULL AND s8 IS NULL AND s10 IS NULL")
    marks = of_kind(facts, "variable").groupBy("path", "name").agg(F.max("detail").alias("marks"))
    given = of_kind(facts, "call", "emit").where(F.array_contains(F.split(F.coalesce("detail", F.lit("")), ","), F.coalesce("class_name", F.lit("self")))).select("path").distinct().withColumn("given", F.lit(True))
    rows = rows.join(marks, ["path", "name"], "left").join(given, "path", "left")
    has = lambda m: F.exists(F.split(F.coalesce("marks", F.lit("")), ","), lambda x: x.startswith(m))
    rows = rows.withColumn("reason", F.when(has("export"), "VEX").when(has("onready"), "VOR").otherwise("VNR"))
    rows = rows.withColumn("confidence", F.when((F.col("reason") != "VNR") | F.col("s12"), "Potential").otherwise("Strict"))
    return _downgraded(_with_autoload(rows, evidence), evidence, options, dynamic=True).withColumn("kind", F.lit("var")).select(*OUT)


def signals(evidence: Evidence, options: LivenessOptions) -> DataFrame:
    facts = evidence.model.facts
    rows = _own(evidence.model, "signal")
    homes = evidence.model.members.where("member = 'signal'").select("path", "name", F.col("at").alias("home"))
    at = lambda kind: of_kind(facts, kind).select("path", "name").join(homes, ["path", "name"]).select(F.col("home").alias("path"), "name").distinct()
    rows = _mark(_mark(_mark(rows, at("emit"), "emitted"), at("connect"), "connected"), evidence.accessed(), "s4")
    rows = rows.where("emitted IS NULL AND s4 IS NULL").withColumn("reason", F.when(F.col("connected"), "SCB").otherwise("SNE")).withColumn("confidence", F.when(F.col("connected"), "Potential").otherwise("Strict"))
    return _downgraded(_with_autoload(rows, evidence), evidence, options).withColumn("kind", F.lit("signal")).select(*OUT)


def constants(evidence: Evidence, options: LivenessOptions) -> DataFrame:
    rows = _own(evidence.model, "const")
    for name, found in (("s3", evidence.used()), ("s4", evidence.accessed()), ("s8", evidence.inherited_uses())):
        rows = _mark(rows, found, name)
    rows = rows.where("s3 IS NULL AND s4 IS NULL AND s8 IS NULL").withColumn("reason", F.lit("CNU")).withColumn("confidence", F.lit("Strict"))
    return _downgraded(_with_autoload(rows, evidence), evidence, options).withColumn("kind", F.lit("const")).select(*OUT)


def enum_values(evidence: Evidence, options: LivenessOptions) -> DataFrame:
    """Enum values that their own file never names; with ``compat`` off, no file does."""
    facts = evidence.model.facts
    rows = of_kind(facts, "enum_value").select("path", "name", "line").distinct()
    here = of_kind(facts, "use", "access").select("path", "name").distinct()
    rows = rows.join(here, ["path", "name"], "left_anti") if options.compat else rows.join(here.select("name").distinct(), "name", "left_anti")
    return rows.select("path", F.lit("enum_value").alias("kind"), "name", "line", F.lit("ENU").alias("reason"), F.lit("Potential").alias("confidence"))


def inner_classes(evidence: Evidence, options: LivenessOptions) -> DataFrame:
    facts = evidence.model.facts
    rows = of_kind(facts, "member").where("owner = 'class'").select("path", "name", "line").distinct()
    used = of_kind(facts, "use", "type_ref", "generic_ref").select("path", "name").unionByName(of_kind(facts, "call").where("name = 'new'").select("path", F.col("owner").alias("name"))).distinct()
    return rows.join(used, ["path", "name"], "left_anti").select("path", F.lit("class").alias("kind"), "name", "line", F.lit("ICU").alias("reason"), F.lit("Potential").alias("confidence"))


def parameters(evidence: Evidence, options: LivenessOptions) -> DataFrame:
    facts = evidence.model.facts
    rows = of_kind(facts, "param").where(~F.col("name").startswith("_") & ~F.coalesce(F.col("owner"), F.lit("")).isin(ENGINE_CALLBACKS)).select("path", F.col("owner").alias("method"), "name", "line").distinct()
    used = of_kind(facts, "use", "assign", "duck").select("path", F.when(F.col("kind") == "duck", F.col("owner")).otherwise(F.col("method")).alias("method"), "name").distinct()
    return rows.join(used, ["path", "method", "name"], "left_anti").select("path", F.lit("param").alias("kind"), "name", "line", F.lit("PNU").alias("reason"), F.lit("Strict").alias("confidence"))


def unreachable(evidence: Evidence, options: LivenessOptions) -> DataFrame:
    rows = of_kind(evidence.model.facts, "finding").where("name = 'GD5004'")
    rows = rows.where("col <= 1") if options.compat else rows  # a method's top level stands one indent in
    return rows.select("path", F.lit("statement").alias("kind"), F.coalesce("method", F.lit("")).alias("name"), "line", F.lit("UCR").alias("reason"), F.lit("Strict").alias("confidence"))


def test_path(path: Column) -> Column:
    """Paths that begin with "test" or hold "/test"."""
    return path.startswith("test") | F.contains(path, F.lit("/test"))


def report(evidence: Evidence, options: LivenessOptions = LivenessOptions(), annotations: DataFrame | None = None) -> DataFrame:
    """(path, kind, name, line, reason, confidence) of everything dead; ``annotations`` (path, name, mark) take members out."""
    parts = [functions, variables, signals, constants, enum_values, inner_classes, unreachable, *([parameters] if options.include_parameters else [])]
    out = reduce(DataFrame.unionByName, [p(evidence, options) for p in parts])
    for pattern in options.exclude:
        out = out.where(~F.col("path").rlike(path_glob_regex(pattern)))
    if options.skip_tests:
        out = out.where(~test_path(F.col("path")))
    if annotations is not None:
        marks = [*_ANNOTATED, *options.annotations]
        out = out.join(annotations.where(F.col("mark").isin(*marks)).select("path", "name").distinct(), ["path", "name"], "left_anti")
    return out.select(*OUT)


def annotations(rows: DataFrame) -> DataFrame:
    """(path, name, mark) of the members' annotations, from the syntax rows."""
    return rows.where(F.col("kind").endswith("Declaration") & (F.size("marks") > 0) & F.col("value").isNotNull()).select("path", F.col("value").alias("name"), F.explode("marks").alias("mark"))


def suppressed(marks: DataFrame, options: LivenessOptions = LivenessOptions()) -> DataFrame:
    """(reason, n): how many members annotations take out, by code."""
    code = F.when(F.col("mark") == "public_api", "PAA").when(F.col("mark") == "dynamic_use", "DUA").when(F.col("mark").isin(*options.annotations), "CUA")
    return marks.withColumn("reason", code).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def with_confidence(found: DataFrame, most: str) -> DataFrame:
    """Findings at least as sure as ``most``."""
    return found.where(F.col("confidence").isin([c for c, k in ORDER.items() if k <= ORDER[most]]))


def baseline_key(found: DataFrame) -> DataFrame:
    """A key that stays the same while lines move."""
    return found.withColumn("key", F.concat_ws("|", "path", "kind", "name", "reason"))


def new_since(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that a baseline (key) doesn't have."""
    return baseline_key(found).join(baseline.select("key").distinct(), "key", "left_anti")


def rollup(found: DataFrame) -> DataFrame:
    """(kind, reason, confidence, n) with totals: null stands for all."""
    return found.rollup("kind", "reason", "confidence").agg(F.count("*").alias("n"))


def worst_files(found: DataFrame, most: int = 10) -> DataFrame:
    """(path, n, strict): the files with most findings."""
    return found.groupBy("path").agg(F.count("*").alias("n"), F.sum((F.col("confidence") == "Strict").cast("int")).alias("strict")).orderBy(F.desc("n"), "path").limit(most)
