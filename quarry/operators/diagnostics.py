"""Findings over a project: what scripts found alone, and what only shows across files.

Inputs are the facts of ``quarry.sources.project.analysed``.  Names, members and
calls meet in joins: on class name, on (path, member) and on resource path.  All
results are (path, code, line, col, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.sources.semantics import ENGINE, KNOWN, VALUES
from quarry.staging import staged

# The diagnostic codes of the language's checkers, with their names.
CODES: dict[str, str] = {
    "GD1001": "InvalidToken", "GD1002": "MissingSemicolon", "GD1003": "UnexpectedToken", "GD1004": "MissingColon", "GD1005": "MissingBracket", "GD1006": "InvalidNotKeywordUsage",
    "GD2001": "UndefinedVariable", "GD2002": "UndefinedFunction", "GD2003": "DuplicateDeclaration", "GD2004": "VariableUsedBeforeDeclaration", "GD2005": "UndefinedSignal", "GD2006": "UndefinedEnumValue",
    "GD3001": "TypeMismatch", "GD3002": "InvalidOperandType", "GD3003": "InvalidAssignment", "GD3004": "TypeAnnotationMismatch", "GD3005": "UnknownBaseType", "GD3006": "UnknownType", "GD3007": "IncompatibleReturnType", "GD3008": "MemberNotAccessible",
    "GD3009": "PropertyNotFound", "GD3010": "ArgumentTypeMismatch", "GD3011": "ImpossibleTypeAccess", "GD3012": "TypeAnnotationRecommended", "GD3013": "IndexerKeyTypeMismatch", "GD3014": "NotIndexable", "GD3015": "IndexOutOfRange", "GD3016": "WrongGenericParameterCount",
    "GD3017": "InvalidGenericArgument", "GD3018": "DictionaryKeyNotHashable", "GD3019": "ComparisonWithNull", "GD3020": "ComparisonWithPotentiallyNull", "GD3021": "IncompatibleComparisonTypes", "GD3022": "AnnotationWiderThanInferred", "GD3023": "InconsistentReturnTypes",
    "GD3024": "MissingReturnInBranch", "GD3025": "ContainerMissingSpecialization", "GD3026": "ImpossibleCast", "GD4001": "WrongArgumentCount", "GD4002": "MethodNotFound", "GD4003": "InvalidSignalConnection", "GD4004": "NotCallable", "GD4005": "EmitSignalWrongArgCount",
    "GD4006": "UndefinedSignalEmit", "GD4007": "ConnectCallbackMismatch", "GD4008": "ResourceNotFound", "GD4009": "EmitSignalTypeMismatch", "GD4010": "ConnectCallbackTypeMismatch", "GD4011": "InvalidNodePath", "GD4012": "InvalidUniqueNode", "GD4013": "InvalidSignalConnectionMethod",
    "GD5001": "BreakOutsideLoop", "GD5002": "ContinueOutsideLoop", "GD5003": "ReturnOutsideFunction", "GD5004": "UnreachableCode", "GD5005": "YieldOutsideFunction", "GD5006": "AwaitOutsideFunction", "GD5007": "AwaitOnNonAwaitable", "GD5008": "SuperOutsideMethod",
    "GD5009": "SuperInStaticMethod", "GD5010": "ConstantReassignment", "GD5011": "PossibleMissedAwait", "GD6001": "InconsistentIndentation", "GD6002": "UnexpectedIndent", "GD6003": "ExpectedIndent", "GD6004": "UnexpectedDedent", "GD6005": "IndentationMismatch",
    "GD7001": "UnguardedMethodAccess", "GD7002": "UnguardedPropertyAccess", "GD7003": "UnguardedMethodCall", "GD7004": "MemberNotGuaranteed", "GD7005": "PotentiallyNullAccess", "GD7006": "PotentiallyNullIndexer", "GD7007": "PotentiallyNullMethodCall", "GD7008": "ClassVariableMayBeNull",
    "GD7009": "NullableTypeNotChecked", "GD7010": "RedundantTypeGuard", "GD7011": "RedundantNarrowedTypeGuard", "GD7012": "RedundantHasMethodCheck", "GD7013": "RedundantNullCheck", "GD7014": "RedundantTruthinessCheck", "GD7015": "DynamicMethodNotFound", "GD7016": "DynamicPropertyNotFound",
    "GD7017": "ConditionalNodeAccess", "GD7018": "NodeAccessBeforeReady", "GD7019": "TypeWideningAssignment", "GD7020": "CallSiteParameterTypeConsensus", "GD7021": "UntypedContainerElementAccess", "GD7022": "RedundantAnnotation", "GD8001": "AbstractMethodHasBody", "GD8002": "ClassNotAbstract",
    "GD8003": "AbstractMethodNotImplemented", "GD8004": "SuperInAbstractMethod", "GD8005": "AbstractClassInstantiation", "GD9001": "InstanceMethodCalledAsStatic", "GD9002": "StaticMethodCalledOnInstance",
}
# Codes that are named, but that no checker gives.
DECLARED_ONLY = {"GD1002", "GD1003", "GD1004", "GD1005", "GD2002", "GD2004", "GD2005", "GD2006", "GD3003", "GD3008", "GD3011", "GD3012", "GD3015", "GD3016", "GD4003", "GD4010", "GD6003", "GD6004", "GD7001", "GD7004", "GD7008", "GD7009", "GD8003", "GD9002"}
# Methods and signals that every object or node has.
OBJECT_METHODS = set(
    "new free get set call callv call_deferred set_deferred has_method has_signal connect disconnect is_connected emit_signal get_class is_class get_meta set_meta has_meta notification to_string get_script set_script get_instance_id get_property_list get_method_list add_user_signal is_queued_for_deletion duplicate reference unreference init_ref property_list_changed".split()
)
ENGINE_SIGNALS = set("ready tree_entered tree_exiting tree_exited renamed child_entered_tree child_exiting_tree script_changed property_list_changed pressed timeout body_entered body_exited area_entered area_exited finished visibility_changed draw hidden".split())
#: Codes whose findings are hints or errors; the rest are warnings.
HINTS = {"GD3022", "GD3025", "GD7010", "GD7011", "GD7012", "GD7013", "GD7014", "GD7020", "GD7021", "GD7022"}
ERRORS = {c for c in CODES if c[2] in "1256"} - {"GD5004", "GD5011"} | {"GD3001", "GD3004", "GD3005", "GD3006", "GD3007", "GD3010", "GD4001", "GD4002", "GD4004", "GD4005", "GD8001", "GD8002", "GD8004", "GD8005", "GD9001"}

OUT = ["path", "code", "line", "col", "detail"]


def code_table(spark: SparkSession) -> DataFrame:
    """(code, name, severity, given): every code, and whether a checker gives it."""
    return spark.createDataFrame([(c, n, "error" if c in ERRORS else "hint" if c in HINTS else "warning", c not in DECLARED_ONLY) for c, n in CODES.items()], "code string, name string, severity string, given boolean")


def of_kind(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("kind").isin(*kinds))


def classes(facts: DataFrame) -> DataFrame:
    """(path, class_name, base): the scripts' own classes."""
    return of_kind(facts, "class").where("n = 0").select("path", F.col("name").alias("class_name"), F.col("type").alias("base"))


def parents(facts: DataFrame) -> DataFrame:
    """(src, dst): a script and the script it extends, by class name or path; of equal names the least path."""
    own = classes(facts)
    named = own.where("class_name IS NOT NULL").groupBy(F.col("class_name").alias("base")).agg(F.min("path").alias("dst"))
    by_name = own.join(named, "base").select(F.col("path").alias("src"), "dst")
    by_path = own.where(F.col("base").startswith("res://")).select(F.col("path").alias("src"), F.substring("base", 7, 4096).alias("dst"))
    return by_name.unionByName(by_path.join(own.select(F.col("path").alias("dst")), "dst", "left_semi")).where("src <> dst").distinct()


class Model:
    """A project's facts with what follows from its classes; staged, since several reports join it."""

    def __init__(self, facts: DataFrame):
        self.facts = facts
        self.classes = staged(classes(facts), "classes")
        self.above = staged(graph.closure(parents(facts)).groupBy("src", "dst").agg(F.min("depth").alias("depth")), "above")
        self.members = staged(self._members(), "members")
        own = self.classes
        tops = self.above.join(own.select(F.col("path").alias("dst"), "base"), "dst").groupBy(F.col("src").alias("path")).agg(F.max_by("base", "depth").alias("top"))
        self.tops = staged(own.join(tops, "path", "left").select("path", "class_name", F.coalesce("top", "base").alias("top")), "tops")

    def _members(self) -> DataFrame:
        """(path, name, member, type, params, least, most, static, at): a script's members, inherited ones too, the nearest of each name."""
        roots = self.classes.select("path", F.col("class_name").alias("root"))
        own = of_kind(self.facts, "member", "arity").join(roots, "path").where(F.col("class_name").eqNullSafe(F.col("root")))
        flat = own.groupBy("path", "name").agg(
            F.first(F.when(F.col("kind") == "member", F.col("owner")), ignorenulls=True).alias("member"), F.first(F.when(F.col("kind") == "member", F.col("type")), ignorenulls=True).alias("type"), F.first(F.when(F.col("kind") == "member", F.col("detail")), ignorenulls=True).alias("params"),
            F.first(F.when(F.col("kind") == "arity", F.col("n")), ignorenulls=True).alias("least"), F.first(F.when(F.col("kind") == "member", F.col("n")), ignorenulls=True).alias("most"), F.max(F.coalesce((F.col("kind") == "arity") & (F.col("detail") == "static"), F.lit(False))).alias("static"),
        ).where("member IS NOT NULL")
        flat = staged(flat, "own-members")
        up = self.above.select(F.col("src").alias("path"), F.col("dst").alias("at"), "depth")
        every = flat.withColumn("at", F.col("path")).withColumn("depth", F.lit(0)).unionByName(flat.withColumnRenamed("path", "at").join(up, "at"))
        rest = [c for c in every.columns if c not in ("path", "name", "depth")]
        return every.groupBy("path", "name").agg(F.min_by(F.struct(*rest), F.col("depth")).alias("m")).select("path", "name", "m.*")

    def types(self) -> DataFrame:
        """(class_name, path): the least path of every class name."""
        return self.classes.where("class_name IS NOT NULL").groupBy("class_name").agg(F.min("path").alias("home"))


def _found(rows: DataFrame, code: str, detail: Column) -> DataFrame:
    return rows.select("path", F.lit(code).alias("code"), "line", "col", detail.alias("detail"))


def alone(facts: DataFrame) -> DataFrame:
    """What scripts found by themselves."""
    return of_kind(facts, "finding").select("path", F.col("name").alias("code"), "line", "col", "detail")


def names(model: Model, globals_: DataFrame | None = None) -> DataFrame:
    """Unknown names, base types and type names; ``globals_`` (name) are known everywhere, like autoloads."""
    facts = model.facts
    known = model.types().select(F.col("class_name").alias("name"))
    if globals_ is not None:
        known = known.unionByName(globals_.select("name"))
    known = known.distinct()
    own = model.members.select("path", "name")
    open_ = of_kind(facts, "unresolved").select("path", "name", "line", "col").join(known, "name", "left_anti").join(own, ["path", "name"], "left_anti")
    # Engine members are not in the sources: names that only a method call could take are left to the call checks.
    bad_names = _found(open_, "GD2001", F.concat(F.lit("Undefined identifier: '"), "name", F.lit("'")))
    bases = of_kind(facts, "base").select("path", "name", "line", "col").where(~F.col("name").isin(*ENGINE, *VALUES)).join(known, "name", "left_anti")
    paths = model.classes.select(F.concat(F.lit("res://"), "path").alias("name"))
    bad_bases = _found(bases.join(paths, "name", "left_anti"), "GD3005", F.concat(F.lit("Unknown base type: '"), "name", F.lit("'")))
    inner = model.facts.where("kind = 'member' AND owner IN ('class', 'enum', 'const')").select("path", "name").unionByName(own).distinct()
    plain = [*ENGINE, *VALUES, *KNOWN, "void", "Variant", "Error"]
    refs = of_kind(facts, "type_ref", "generic_ref").where((~F.col("name").isin(*plain)) & (F.col("name") != "")).join(known, "name", "left_anti").join(inner, ["path", "name"], "left_anti")
    text = F.concat(F.lit("Unknown type: '"), "name", F.lit("'"))
    return reduce(DataFrame.unionByName, [bad_names, bad_bases, _found(refs.where("kind = 'type_ref'"), "GD3006", text), _found(refs.where("kind = 'generic_ref'"), "GD3017", text)])


def calls(model: Model) -> DataFrame:
    """Calls and properties of project classes: members that aren't there, wrong numbers of arguments, instance methods on classes."""
    facts = of_kind(model.facts, "call", "access").where("n IS NOT NULL")
    by_type = model.types()
    typed = facts.where(~F.col("owner").isin("self", "super", "*")).withColumn("on_class", F.col("owner").startswith("class ")).withColumn("class_name", F.regexp_replace("owner", "^class ", ""))
    typed = typed.drop("type").join(by_type, "class_name")
    # Calls on self that the script's own members answered are checked there already.
    roots = model.classes.select("path", F.col("class_name").alias("root"))
    selfs = facts.where("owner IN ('self', 'super') AND type IS NULL").join(roots, "path").where(F.col("class_name").eqNullSafe(F.col("root"))).withColumn("home", F.col("path")).withColumn("on_class", F.lit(False))
    columns = ["path", "kind", "name", "owner", "detail", "n", "line", "col", "home", "on_class"]
    asked = selfs.select(*columns).unionByName(typed.select(*columns))
    members = model.members.select(F.col("path").alias("home"), "name", "member", "least", "most", "static", "at")
    met = asked.join(members, ["home", "name"], "left").join(model.tops.select(F.col("path").alias("home"), "top"), "home")
    plain = F.coalesce(F.col("top"), F.lit("RefCounted")).isin("RefCounted", "Object", "Resource")
    missing = met.where(F.col("member").isNull() & plain & ~F.col("name").isin(*OBJECT_METHODS) & (F.col("owner") != "super"))
    what = F.concat(F.lit("'"), "name", F.lit("' not found on '"), "owner", F.lit("'"))
    call = F.col("n") >= 0
    found = met.where((F.col("member") == "func") & call)
    few, many = F.col("n") < F.col("least"), F.col("n") > F.col("most")
    return reduce(
        DataFrame.unionByName,
        [
            _found(missing.where(call), "GD4002", F.concat(F.lit("Method "), what)),
            _found(missing.where(~call), "GD3009", F.concat(F.lit("Property "), what)),
            _found(found.where((few | many) & ~F.col("on_class")), "GD4001", F.concat(F.lit("'"), "name", F.lit("' takes "), "least", F.lit(" to "), "most", F.lit(" argument(s), got "), "n")),
            _found(found.where(F.col("on_class") & ~F.col("static")), "GD9001", F.concat(F.lit("Cannot call instance method '"), "name", F.lit("' on class '"), "owner", F.lit("'"))),
            _found(met.where(call & F.col("member").isin("enum", "enum_value", "signal")), "GD4004", F.concat(F.lit("'"), "name", F.lit("' is not a method"))),
        ],
    )


def signals(model: Model) -> DataFrame:
    """Emits and connections against the signals' declarations, inherited ones too."""
    roots = model.classes.select("path", F.col("class_name").alias("root"))
    facts = of_kind(model.facts, "emit", "connect").where("name IS NOT NULL").join(roots, "path").where(F.col("class_name").eqNullSafe(F.col("root")))
    signal = model.members.where("member = 'signal'").select("path", "name", F.col("most").alias("wants"), "params")
    met = facts.join(signal, ["path", "name"], "left")
    unknown = met.where(F.col("wants").isNull() & ~F.col("name").isin(*ENGINE_SIGNALS))
    emits = met.where("kind = 'emit' AND wants IS NOT NULL")
    pairs = F.arrays_zip(F.split("detail", ",").alias("got"), F.split("params", ",").alias("want"))
    typed = emits.where("n = wants AND n > 0").select("path", "name", "line", "col", F.posexplode(pairs).alias("at", "pair"))
    wrong = typed.where(~_may_stand_for(F.col("pair.got"), F.col("pair.want")))
    links = met.where("kind = 'connect' AND wants IS NOT NULL AND n IS NOT NULL")
    return reduce(
        DataFrame.unionByName,
        [
            _found(unknown, "GD4006", F.concat(F.lit("Signal '"), "name", F.lit("' not found on type 'self'"))),
            _found(emits.where("n <> wants"), "GD4005", F.concat(F.lit("Signal '"), "name", F.lit("' expects "), "wants", F.lit(" argument(s), got "), "n")),
            _found(wrong, "GD4009", F.concat(F.lit("Signal '"), "name", F.lit("' parameter "), (F.col("at") + 1).cast("string"), F.lit(" expects '"), "pair.want", F.lit("', got '"), "pair.got", F.lit("'"))),
            _found(links.where((F.col("n") < F.col("wants")) | (F.coalesce(F.col("type").try_cast("int"), F.lit(0)) > F.col("wants"))), "GD4007", F.concat(F.lit("Callback '"), "owner", F.lit("' doesn't take what signal '"), "name", F.lit("' emits"))),
        ],
    )


def _may_stand_for(got: Column, want: Column) -> Column:
    """Whether a type's text may stand for another, as far as values go."""
    values = [*VALUES]
    numbers, texts = ["int", "float", "enum"], ["String", "StringName", "NodePath"]
    g, w = F.regexp_replace(got, r"\[.*$", ""), F.regexp_replace(want, r"\[.*$", "")
    known = g.isin(values) & w.isin(values)
    return ~known | (g == w) | (g.isin(numbers) & w.isin(numbers)) | (g.isin(texts) & w.isin(texts))


def dynamic(model: Model) -> DataFrame:
    """Members named by texts: call("x"), get("x"), set("x")."""
    facts = of_kind(model.facts, "dynamic_call", "dynamic_property").where("owner = 'self'")
    met = facts.join(model.members.select("path", "name", "member"), ["path", "name"], "left")
    method, gone = F.col("kind") == "dynamic_call", F.col("member").isNull()
    plain = ~F.col("name").isin(*OBJECT_METHODS)
    return _found(met.where(method & plain & (gone | (F.col("member") != "func"))), "GD7015", F.concat(F.lit("Method '"), "name", F.lit("' not found on type 'self'"))).unionByName(
        _found(met.where(~method & (gone | (F.col("member") == "func"))), "GD7016", F.concat(F.lit("Property '"), "name", F.lit("' not found on type 'self'")))
    )


def parameters(model: Model) -> DataFrame:
    """Untyped parameters that every call in the project gives one and the same known type."""
    roots = model.types()
    homes = of_kind(model.facts, "call").where("n > 0 AND owner <> '*'").withColumn("type_name", F.regexp_replace("owner", "^class ", ""))
    home = F.when(F.col("owner").isin("self", "super"), F.col("path")).otherwise(F.col("home"))
    calls_ = homes.join(roots.select(F.col("class_name").alias("type_name"), "home"), "type_name", "left").withColumn("at", home).where("at IS NOT NULL")
    given = calls_.select("at", "name", F.posexplode(F.split("detail", ",")).alias("place", "got")).groupBy("at", "name", "place").agg(F.collect_set("got").alias("kinds"))
    wanted = of_kind(model.facts, "param").where("type IS NULL AND detail IS NULL").select("path", F.col("owner").alias("method_"), F.col("name").alias("param"), "line", "col")
    heads = model.members.where("member = 'func' AND at = path").select("path", F.col("name").alias("method_"), F.split("params", ",").alias("types"))
    order = of_kind(model.facts, "param").groupBy("path", F.col("owner").alias("method_")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "col", "name"))), lambda x: x["name"]).alias("order"))
    places = wanted.join(heads, ["path", "method_"]).join(order, ["path", "method_"]).withColumn("place", F.array_position("order", F.col("param")).cast("int") - 1)
    met = places.join(given.select(F.col("at").alias("path"), F.col("name").alias("method_"), "place", "kinds"), ["path", "method_", "place"])
    sure = met.where((F.size("kinds") == 1) & ~F.get("kinds", F.lit(0)).isin("Variant", "null", "") & ~F.contains(F.get("kinds", F.lit(0)), F.lit("|")))
    return _found(sure, "GD7020", F.concat(F.lit("All callers pass '"), F.get("kinds", F.lit(0)), F.lit("' for parameter '"), "param", F.lit("'")))


def resources(model: Model, there: DataFrame) -> DataFrame:
    """Paths given to load and preload that no file of ``there`` (path) has."""
    asked = of_kind(model.facts, "load").where(F.col("name").startswith("res://")).withColumn("target", F.substring("name", 7, 4096))
    return _found(asked.join(there.select(F.col("path").alias("target")).distinct(), "target", "left_anti"), "GD4008", F.concat(F.lit("Resource not found: '"), "name", F.lit("'")))


def scenes(model: Model, nodes: DataFrame, connections: DataFrame) -> DataFrame:
    """Node paths and unique names that no scene of a script has, and connections to methods that aren't there.

    ``nodes`` and ``connections`` are the scene views; a script without a scene is left alone.
    """
    attached = nodes.where("script IS NOT NULL").select(F.substring("script", 7, 4096).alias("path"), F.col("path").alias("scene"), F.col("node_path").alias("root"))
    inside = attached.join(nodes.select(F.col("path").alias("scene"), "node_path", "name", "is_unique"), "scene")
    below = F.when(F.col("root") == ".", F.col("node_path")).when(F.startswith("node_path", F.concat("root", F.lit("/"))), F.expr("substring(node_path, length(root) + 2)"))
    paths = inside.select("path", below.alias("name")).where("name IS NOT NULL").distinct()
    unique = inside.where("is_unique").select("path", "name").distinct()
    asked = model.facts.join(attached.select("path").distinct(), "path", "left_semi")
    plain = asked.where((F.col("kind") == "node_path") & ~F.col("name").startswith("%") & ~F.col("name").startswith("/") & ~F.col("name").startswith("..") & (F.col("name") != "."))
    bad_paths = plain.join(paths, ["path", "name"], "left_anti")
    bad_unique = asked.where("kind = 'unique_node'").join(unique, ["path", "name"], "left_anti")
    target = connections.select(F.col("path").alias("scene"), F.col("to_node").alias("node_path"), "method", "line")
    scripts = nodes.where("script IS NOT NULL").select(F.col("path").alias("scene"), "node_path", F.substring("script", 7, 4096).alias("script"))
    methods = model.members.where("member = 'func'").select(F.col("path").alias("script"), F.col("name").alias("method"))
    known = target.join(scripts, ["scene", "node_path"]).join(model.classes.select(F.col("path").alias("script")), "script", "left_semi")
    bad_links = known.join(methods, ["script", "method"], "left_anti").select(F.col("scene").alias("path"), "line", F.lit(0).alias("col"), "method")
    return reduce(
        DataFrame.unionByName,
        [
            _found(bad_paths, "GD4011", F.concat(F.lit("Node path '"), "name", F.lit("' not found"))),
            _found(bad_unique, "GD4012", F.concat(F.lit("Unique node '"), "name", F.lit("' not found"))),
            _found(bad_links, "GD4013", F.concat(F.lit("Connection to '"), "method", F.lit("', which does not exist"))),
        ],
    )


def actions(model: Model, inputs: DataFrame) -> DataFrame:
    """Input actions that the project's settings (name) don't have."""
    return _found(of_kind(model.facts, "action").join(inputs.select("name").distinct(), "name", "left_anti"), "GDL246", F.concat(F.lit("Unknown input action '"), "name", F.lit("'")))


def diagnose(model: Model, there: DataFrame, nodes: DataFrame | None = None, connections: DataFrame | None = None, globals_: DataFrame | None = None) -> DataFrame:
    """All findings, with severity: (path, code, line, col, detail, severity)."""
    parts = [alone(model.facts), names(model, globals_), calls(model), signals(model), dynamic(model), parameters(model), resources(model, there)]
    if nodes is not None and connections is not None:
        parts.append(scenes(model, nodes, connections))
    every = reduce(DataFrame.unionByName, parts).distinct()
    severity = F.when(F.col("code").isin(*ERRORS), "error").when(F.col("code").isin(*HINTS), "hint").otherwise("warning")
    return every.withColumn("severity", severity)


def cut(findings: DataFrame, least: str = "hint", most: int | None = None) -> DataFrame:
    """Findings of a severity or worse; the first ``most`` by place, which is what the report's limit means."""
    order = {"hint": 0, "warning": 1, "error": 2}
    kept = findings.where(F.col("severity").isin(*[s for s, k in order.items() if k >= order[least]]))
    return kept if most is None else kept.orderBy(*OUT).limit(most)


def exit_code(findings: DataFrame, fail_on_warning: bool = False, fail_on_hint: bool = False) -> DataFrame:
    """One row (code): 2 with errors, 1 with warnings or hints that count, else 0."""
    n = lambda s: F.sum((F.col("severity") == s).cast("int"))
    counts = findings.agg(F.coalesce(n("error"), F.lit(0)).alias("e"), F.coalesce(n("warning"), F.lit(0)).alias("w"), F.coalesce(n("hint"), F.lit(0)).alias("h"))
    return counts.select(F.when(F.col("e") > 0, 2).when(F.lit(fail_on_warning) & (F.col("w") > 0), 1).when(F.lit(fail_on_hint) & (F.col("h") > 0), 1).otherwise(0).alias("code"))


def call_arities(model: Model, catalogue_table: DataFrame) -> DataFrame:
    """(owner, name, calls, least, most): how often scripts call each built-in, by the catalogue."""
    used = of_kind(model.facts, "builtin_call").groupBy("owner", "name").agg(F.count("*").alias("calls"))
    return used.join(catalogue_table.select("owner", "name", "least", "most", "type"), ["owner", "name"])
