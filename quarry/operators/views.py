"""Listings, references, hierarchies, profiles and editor lookups over the facts and syntax of a project.

``facts`` are those of ``project.analysed``, ``rows`` those of
``project.syntax_rows``, ``model`` is a ``diagnostics.Model``.  Points are
DataFrames (path, line, col), so a lookup is a join and many are as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import catalogue
from quarry.operators import graph
from quarry.operators.code import ENGINE_CALLBACKS
from quarry.operators.diagnostics import Model, of_kind
from quarry.sources.semantics import ENGINE

# What kind of moment an engine callback belongs to.
CALLBACK_KINDS = {"_init": "lifecycle", "_ready": "lifecycle", "_enter_tree": "lifecycle", "_exit_tree": "lifecycle", "_notification": "lifecycle", "_static_init": "lifecycle", "_process": "process", "_physics_process": "process", "_integrate_forces": "process", "_input": "input", "_unhandled_input": "input", "_unhandled_key_input": "input", "_shortcut_input": "input", "_gui_input": "input", "_draw": "draw"}
_CATEGORIES = {"png": "image", "jpg": "image", "svg": "image", "webp": "image", "ogg": "audio", "wav": "audio", "mp3": "audio", "tscn": "scene", "scn": "scene", "gd": "script", "cs": "script", "tres": "resource", "res": "resource", "ttf": "font", "otf": "font", "gdshader": "shader"}


# --- listings -------------------------------------------------------------------------------


def list_classes(facts: DataFrame, abstract_only: bool = False, extends: str | None = None, inner_only: bool = False, top_only: bool = False) -> DataFrame:
    """(path, name, base, inner, abstract)."""
    out = of_kind(facts, "class").select("path", "name", F.col("type").alias("base"), (F.col("n") == 1).alias("inner"), F.col("detail").isNotNull().alias("abstract")).where("name IS NOT NULL")
    for asked, condition in ((abstract_only, F.col("abstract")), (extends is not None, F.col("base") == extends), (inner_only, F.col("inner")), (top_only, ~F.col("inner"))):
        out = out.where(condition) if asked else out
    return out


def list_signals(facts: DataFrame) -> DataFrame:
    """(path, name, parameters, emitted, connected)."""
    own = of_kind(facts, "member").where("owner = 'signal'").select("path", "name", F.col("n").alias("parameters"), "line")
    used = of_kind(facts, "emit", "connect").groupBy("path", "name").agg(F.max((F.col("kind") == "emit").cast("int")).alias("e"), F.max((F.col("kind") == "connect").cast("int")).alias("c"))
    return own.join(used, ["path", "name"], "left").select("path", "name", "parameters", (F.coalesce("e", F.lit(0)) == 1).alias("emitted"), (F.coalesce("c", F.lit(0)) == 1).alias("connected"))


def list_members(facts: DataFrame, kind: str, public: bool | None = None) -> DataFrame:
    """(path, class_name, name, type, parameters, line) of one kind of member."""
    out = of_kind(facts, "member").where(F.col("owner") == kind)
    if public is not None:
        out = out.where(F.col("name").startswith("_") != public)
    return out.select("path", "class_name", "name", "type", F.col("n").alias("parameters"), "line")


def list_engine_callbacks(facts: DataFrame) -> DataFrame:
    """(path, name, category): methods that the engine calls by itself."""
    kinds = F.create_map(*[F.lit(x) for pair in CALLBACK_KINDS.items() for x in pair])
    own = of_kind(facts, "member").where((F.col("owner") == "func") & F.col("name").isin(ENGINE_CALLBACKS))
    return own.select("path", "name", F.coalesce(F.try_element_at(kinds, F.col("name")), F.lit("other")).alias("category"))


def list_scenes(scene_nodes: DataFrame) -> DataFrame:
    """(path, nodes, scripted, instances)."""
    return scene_nodes.groupBy("path").agg(F.count("*").alias("nodes"), F.count("script").alias("scripted"), F.count("instance").alias("instances"))


def category(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in _CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))), F.lit("other"))


def list_resources(uses: DataFrame, there: DataFrame, unused_only: bool = False, missing_only: bool = False) -> DataFrame:
    """(path, category, used, missing) of resources that are there or asked for: ``uses`` (target), ``there`` (path)."""
    asked = uses.select(F.regexp_replace("target", "^res://", "").alias("path")).distinct().withColumn("used", F.lit(True))
    out = there.select("path").distinct().withColumn("there", F.lit(True)).join(asked, "path", "full")
    out = out.select("path", category(F.col("path")).alias("category"), F.coalesce("used", F.lit(False)).alias("used"), F.col("there").isNull().alias("missing"))
    return out.where("NOT used") if unused_only else out.where("missing") if missing_only else out


# --- references and hierarchies ----------------------------------------------------------------


def member_accesses(model: Model) -> DataFrame:
    """(path, type_name, member, call, n, line, col, method): members of typed receivers; ``*`` is an unknown type."""
    roots = model.classes.select("path", F.col("class_name").alias("root"))
    own = F.coalesce(F.col("class_name"), F.col("root"), F.lit("self"))
    rows = of_kind(model.facts, "call", "access").join(roots, "path")
    owner = F.when(F.col("owner").isin("self", "super"), own).otherwise(F.regexp_replace("owner", "^class ", ""))
    return rows.select("path", owner.alias("type_name"), F.col("name").alias("member"), (F.col("kind") == "call").alias("call"), "n", "line", "col", "method")


def accesses_of(model: Model, type_name: str | None, member: str) -> DataFrame:
    """Accesses of a member on a type and the types below it; of the name alone without a type."""
    rows = member_accesses(model).where(F.col("member") == member)
    if type_name is None:
        return rows
    home = model.classes.where(F.col("class_name") == type_name).select(F.col("path").alias("dst"))
    below = model.above.join(home, "dst").select(F.col("src").alias("path")).unionByName(home.select(F.col("dst").alias("path")))
    names = model.classes.join(below, "path").select(F.col("class_name").alias("type_name")).where("type_name IS NOT NULL").distinct()
    return rows.join(names, "type_name", "left_semi")


def references(model: Model, name: str) -> DataFrame:
    """(path, line, col, role, confidence): everywhere a name is declared, used, called or named by a text."""
    rows = model.facts.where((F.col("name") == name) & F.col("kind").isin("member", "local", "param", "use", "assign", "call", "access", "emit", "connect", "dynamic_call", "dynamic_property", "enum_value"))
    role = F.when(F.col("kind").isin("member", "local", "param", "enum_value"), "declaration").when(F.col("kind") == "assign", "write").when(F.col("kind").isin("call", "emit", "connect", "dynamic_call"), "call").otherwise("read")
    sure = F.when((F.col("kind").isin("call", "access") & (F.col("owner") == "*")) | F.col("kind").startswith("dynamic"), "Potential").otherwise("Strict")
    return rows.groupBy("path", "line", "col").agg(F.max(role).alias("role"), F.max(sure).alias("confidence"))


def implementations(model: Model) -> DataFrame:
    """(path, name, base_path): methods that override one of a base, and the nearest such base."""
    own = model.members.where("member = 'func' AND at = path").select("path", "name")
    bases = own.select(F.col("path").alias("dst"), "name")
    met = own.join(model.above.withColumnRenamed("src", "path"), "path").join(bases, ["dst", "name"])
    return met.groupBy("path", "name").agg(F.min_by("dst", "depth").alias("base_path"))


def polymorphic(model: Model) -> DataFrame:
    """(path, name, overrides): methods that classes below override."""
    return implementations(model).groupBy(F.col("base_path").alias("path"), "name").agg(F.count("*").alias("overrides"))


def types_with_method(model: Model, name: str) -> DataFrame:
    """(path, class_name): scripts that have a method, their own or inherited."""
    return model.members.where((F.col("member") == "func") & (F.col("name") == name)).select("path").join(model.classes, "path").select("path", "class_name")


def _callees(model: Model) -> DataFrame:
    """(path, method, target_path, target, line): calls whose target is a method of the project."""
    rows = of_kind(model.facts, "call").where("owner <> '*'").withColumn("type_name", F.regexp_replace("owner", "^class ", ""))
    homes = model.types().select(F.col("class_name").alias("type_name"), "home")
    placed = rows.join(homes, "type_name", "left").withColumn("at", F.when(F.col("owner").isin("self", "super"), F.col("path")).otherwise(F.col("home")))
    methods = model.members.where("member = 'func'").select(F.col("path").alias("at"), "name", F.col("at").alias("target_path"))
    met = placed.select("path", "method", "at", "name", "line").join(methods, ["at", "name"])
    return met.select("path", "method", "target_path", F.col("name").alias("target"), "line")


def incoming_calls(model: Model) -> DataFrame:
    """(target_path, target, path, method, sites): callers of every method, their lines together."""
    return _callees(model).groupBy("target_path", "target", "path", "method").agg(F.count("*").alias("sites"))


def outgoing_calls(model: Model) -> DataFrame:
    """(path, method, targets, sites)."""
    return _callees(model).where("method IS NOT NULL").groupBy("path", "method").agg(F.count_distinct("target_path", "target").alias("targets"), F.count("*").alias("sites"))


def reference_counts(model: Model) -> DataFrame:
    """(path, name, member, references): the lens over members; uses in the file and calls from others."""
    own = model.members.where("at = path").select("path", "name", "member")
    here = of_kind(model.facts, "use", "assign").groupBy("path", "name").agg(F.count("*").alias("here"))
    there = _callees(model).where("path <> target_path").groupBy(F.col("target_path").alias("path"), F.col("target").alias("name")).agg(F.count("*").alias("there"))
    return own.join(here, ["path", "name"], "left").join(there, ["path", "name"], "left").select("path", "name", "member", (F.coalesce("here", F.lit(0)) + F.coalesce("there", F.lit(0))).alias("references"))


def hierarchy_roots(model: Model) -> DataFrame:
    """(path, class_name, below): scripts that extend no other script, and how many extend them."""
    below = model.above.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    top = model.classes.join(model.above.select(F.col("src").alias("path")).distinct(), "path", "left_anti")
    return top.join(below, "path", "left").select("path", "class_name", F.coalesce("n", F.lit(0)).alias("below"))


# --- graphs ------------------------------------------------------------------------------------


def type_dependencies(model: Model) -> DataFrame:
    """(src, dst, uses): scripts by the scripts whose class names they write."""
    names = of_kind(model.facts, "type_ref", "generic_ref", "base", "unresolved").select("path", F.col("name").alias("class_name"))
    return names.join(model.types(), "class_name").where("path <> home").groupBy(F.col("path").alias("src"), F.col("home").alias("dst")).agg(F.count("*").alias("uses"))


def inference_dependencies(model: Model) -> DataFrame:
    """(path, method, target_path, target): methods by those whose return type theirs hangs on."""
    return _callees(model).where("method IS NOT NULL").select("path", "method", "target_path", "target").distinct()


def type_flow(facts: DataFrame) -> DataFrame:
    """(src, dst, kind, n): which types flow where: assigned to variables, returned by methods, given to parameters."""
    assigned = of_kind(facts, "assign", "local").where("type IS NOT NULL").select("path", F.when(F.col("kind") == "local", F.col("detail")).otherwise(F.col("type")).alias("src"), F.concat_ws(".", "method", "name").alias("dst"), F.lit("variable").alias("kind"))
    returned = of_kind(facts, "return").select("path", F.col("type").alias("src"), F.col("name").alias("dst"), F.lit("return").alias("kind"))
    given = of_kind(facts, "call").where("n > 0").select("path", F.explode(F.split("detail", ",")).alias("src"), F.col("name").alias("dst"), F.lit("argument").alias("kind"))
    return reduce(DataFrame.unionByName, [assigned, returned, given]).where("src <> ''").groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


def provenance(facts: DataFrame) -> DataFrame:
    """(path, method, name, step, line, type): where a local's values come from, in order."""
    rows = of_kind(facts, "local", "param", "assign").where("method IS NOT NULL")
    types = F.when(F.col("kind") == "assign", F.col("type")).otherwise(F.coalesce("detail", "type", F.lit("Variant")))
    order = Window.partitionBy("path", "method", "name").orderBy("line", "col", "kind")
    return rows.select("path", "method", "name", F.row_number().over(order).alias("step"), "line", types.alias("type"))


def scene_links(edges: DataFrame) -> DataFrame:
    """(path, incoming, outgoing) of the scene graph."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).groupBy("x.path").agg(F.sum("x.i").alias("incoming"), F.sum("x.o").alias("outgoing"))


def scene_tree(nodes: DataFrame) -> DataFrame:
    """(path, node_path, depth, children): every scene's hierarchy."""
    depth = F.when(F.col("node_path") == ".", 0).otherwise(F.size(F.split("node_path", "/")))
    up = F.when(F.col("parent").isNull(), None).otherwise(F.col("parent"))
    kids = nodes.where("parent IS NOT NULL").groupBy("path", F.col("parent").alias("node_path")).agg(F.count("*").alias("children"))
    return nodes.select("path", "node_path", depth.alias("depth"), up.alias("up")).join(kids, ["path", "node_path"], "left").select("path", "node_path", "depth", F.coalesce("children", F.lit(0)).alias("children"))


def possible_children(nodes: DataFrame) -> DataFrame:
    """(path, node_path, child, type, by): children of a node, its own and those of the scene it is an instance of."""
    own = nodes.where("parent IS NOT NULL").select("path", F.col("parent").alias("node_path"), F.col("name").alias("child"), "type", F.lit("own").alias("by"))
    inside = nodes.where("parent = '.'").select(F.concat(F.lit("res://"), "path").alias("instance"), F.col("name").alias("child"), "type")
    made = nodes.where("instance IS NOT NULL").select("path", "node_path", "instance").join(inside, "instance").select("path", "node_path", "child", "type", F.lit("instance").alias("by"))
    return own.unionByName(made)


def scene_hubs(edges: DataFrame, most: int = 10) -> DataFrame:
    """The scenes and resources that most others use."""
    return edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("users")).orderBy(F.desc("users"), "path").limit(most)


def signal_hubs(facts: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """(name, emits, connects): how often each signal name is emitted and connected, scene connections included."""
    rows = of_kind(facts, "emit", "connect").where("name IS NOT NULL").select("name", "kind")
    if connections is not None:
        rows = rows.unionByName(connections.select(F.col("signal").alias("name"), F.lit("connect").alias("kind")))
    return rows.groupBy("name").agg(F.sum((F.col("kind") == "emit").cast("int")).alias("emits"), F.sum((F.col("kind") == "connect").cast("int")).alias("connects"))


def node_groups(nodes: DataFrame, script_facts: DataFrame | None = None) -> DataFrame:
    """(group, types, members): the node types in each group."""
    return nodes.select(F.explode("groups").alias("group"), "type").groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"), F.count("*").alias("members"))


# --- profiles ------------------------------------------------------------------------------------


def variable_profiles(facts: DataFrame) -> DataFrame:
    """(path, method, name, writes, reads, types): locals and what they hold."""
    key = ["path", "method", "name"]
    first = of_kind(facts, "local").select(*key, F.col("detail").alias("t"), F.lit(1).alias("w"), F.lit(0).alias("r"))
    later = of_kind(facts, "assign").where("owner IS NULL").select(*key, F.col("type").alias("t"), F.lit(1).alias("w"), F.lit(0).alias("r"))
    read = of_kind(facts, "use").where("owner = 'local'").select(*key, F.lit(None).cast("string").alias("t"), F.lit(0).alias("w"), F.lit(1).alias("r"))
    every = reduce(DataFrame.unionByName, [first, later, read]).join(of_kind(facts, "local").select(*key).distinct(), key, "left_semi")
    return every.groupBy(*key).agg(F.sum("w").alias("writes"), F.sum("r").alias("reads"), _union("t").alias("types"))


def class_variable_profiles(facts: DataFrame) -> DataFrame:
    """(path, name, writes, reads, types): member variables, their first value and later ones."""
    own = of_kind(facts, "variable").where("NOT contains(detail, 'const')").select("path", "name", F.col("type").alias("t"), F.lit(0).alias("w"), F.lit(0).alias("r"))
    later = of_kind(facts, "assign").where("owner = 'member'").select("path", "name", F.col("type").alias("t"), F.lit(1).alias("w"), F.lit(0).alias("r"))
    read = of_kind(facts, "use").where("owner = 'var'").select("path", "name", F.lit(None).cast("string").alias("t"), F.lit(0).alias("w"), F.lit(1).alias("r"))
    every = reduce(DataFrame.unionByName, [own, later, read]).join(own.select("path", "name").distinct(), ["path", "name"], "left_semi")
    return every.groupBy("path", "name").agg(F.sum("w").alias("writes"), F.sum("r").alias("reads"), _union("t").alias("types"))


def _union(column: str) -> Column:
    """The union of types given as texts with ``|``."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(column, r"\|"))))), "|")


def container_profiles(facts: DataFrame, owner: str = "local") -> DataFrame:
    """(path, method, name, puts, types): what is put into containers; members of classes with ``owner`` "member"."""
    key = ["path", "method", "name"] if owner == "local" else ["path", "name"]
    return of_kind(facts, "element").where(F.col("owner") == owner).groupBy(*key).agg(F.count("*").alias("puts"), _union("type").alias("types"))


def merged_containers(model: Model) -> DataFrame:
    """(path, name, puts, types): member containers, with what scripts below put into them, at the script that declares them."""
    puts = of_kind(model.facts, "element").where("owner = 'member'").select("path", "name", "type")
    homes = model.members.where("member = 'var'").select("path", "name", "at")
    return puts.join(homes, ["path", "name"]).groupBy(F.col("at").alias("path"), "name").agg(F.count("*").alias("puts"), _union("type").alias("types"))


def return_profiles(facts: DataFrame) -> DataFrame:
    """(path, method, declared, types, returns)."""
    return of_kind(facts, "return").select("path", F.col("name").alias("method"), F.col("owner").alias("declared"), F.col("type").alias("types"), F.col("n").alias("returns"))


def parameter_needs(facts: DataFrame) -> DataFrame:
    """(path, method, parameter, needs): members that a parameter's values must have, merged over its uses."""
    rows = of_kind(facts, "duck").join(of_kind(facts, "param").select("path", F.col("owner").alias("method"), "name").distinct(), ["path", "method", "name"], "left_semi")
    return rows.groupBy("path", "method", F.col("name").alias("parameter")).agg(F.array_join(F.array_sort(F.collect_set("detail")), ",").alias("needs"))


def parameter_candidates(model: Model) -> DataFrame:
    """(path, method, parameter, class_name): classes of the project that have all a parameter needs."""
    needs = parameter_needs(model.facts).select("path", "method", "parameter", F.explode(F.split("needs", ",")).alias("name"), F.size(F.split("needs", ",")).alias("all"))
    own = model.members.join(model.classes, "path").where("class_name IS NOT NULL").select("class_name", "name").distinct()
    return needs.join(own, "name").groupBy("path", "method", "parameter", "class_name", "all").agg(F.count("*").alias("n")).where("n = all").select("path", "method", "parameter", "class_name")


def parameter_diff(model: Model) -> DataFrame:
    """(path, method, parameter, expected, actual, extra): declared type against what calls give."""
    heads = model.members.where("member = 'func' AND at = path").select("path", F.col("name").alias("method"), F.posexplode(F.split("params", ",")).alias("place", "expected")).where("expected <> ''")
    order = of_kind(model.facts, "param").groupBy("path", F.col("owner").alias("method")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "col", "name"))), lambda x: x["name"]).alias("order"))
    rows = of_kind(model.facts, "call").where("n > 0 AND owner = 'self'").select("path", F.col("name").alias("method"), F.posexplode(F.split("detail", ",")).alias("place", "got"))
    given = rows.groupBy("path", "method", "place").agg(_union("got").alias("actual"))
    met = heads.join(given, ["path", "method", "place"]).join(order, ["path", "method"])
    extra = F.array_join(F.array_except(F.split("actual", r"\|"), F.split("expected", r"\|")), "|")
    return met.select("path", "method", F.get("order", F.col("place")).alias("parameter"), "expected", "actual", F.when(F.col("expected") == "Variant", "").otherwise(extra).alias("extra"))


def escapes(facts: DataFrame) -> DataFrame:
    """(path, method, name, how, n): locals whose value leaves their method."""
    return of_kind(facts, "escape").groupBy("path", "method", "name", F.col("owner").alias("how")).agg(F.count("*").alias("n"))


def inference_report(facts: DataFrame) -> DataFrame:
    """(path, typed, inferred, unknown): expressions by whether their type is known."""
    kind = F.when(F.col("type").contains("Variant"), "unknown").otherwise("known")
    return of_kind(facts, "expression").groupBy("path").agg(F.sum((kind == "known").cast("int")).alias("known"), F.sum((kind == "unknown").cast("int")).alias("unknown"))


def initialised(facts: DataFrame, methods: tuple[str, ...] = ("_init", "_ready", "_enter_tree")) -> DataFrame:
    """(path, name, method, how): members that lifecycle methods set, on every way through or on some."""
    rows = of_kind(facts, "assign").where((F.col("owner") == "member") & F.col("method").isin(*methods))
    return rows.groupBy("path", "name", "method").agg(F.max("detail").alias("how"))


def ready_safe(model: Model) -> DataFrame:
    """(path, method, safe): whether a method runs only after the script is ready: all its callers do, or the engine calls it then.

    A method is unsafe if one that may run early reaches it by calls; what
    nobody in the project calls may be called at any time.
    """
    late = [c for c, k in CALLBACK_KINDS.items() if k in ("process", "input", "draw")] + ["_ready"]
    own = model.members.where("member = 'func' AND at = path").select("path", F.col("name").alias("method"))
    calls = inference_dependencies(model).select(F.concat_ws("\n", "path", "method").alias("src"), F.concat_ws("\n", "target_path", "target").alias("dst"))
    node = own.select("path", "method", F.concat_ws("\n", "path", "method").alias("node"))
    called = calls.where("src <> dst").select(F.col("dst").alias("node")).distinct()
    early = node.join(called, "node", "left_anti").where(~F.col("method").isin(late)).select("node").unionByName(node.where(F.col("method").isin("_init", "_enter_tree", "_static_init")).select("node"))
    reached = graph.closure(calls, early).select(F.col("dst").alias("node")).unionByName(early).distinct().withColumn("early", F.lit(True))
    return node.join(reached, "node", "left").select("path", "method", (F.col("early").isNull() | F.col("method").isin(late)).alias("safe"))


def instantiations(facts: DataFrame) -> DataFrame:
    """(path, method, instantiated, added, scripted, freed): what methods do with nodes."""
    kinds = {"instantiated": "instantiate", "added": "add_child", "scripted": "set_script", "freed": "queue_free"}
    rows = of_kind(facts, "call").where(F.col("name").isin(*kinds.values()) & F.col("method").isNotNull())
    return rows.groupBy("path", "method").agg(*[F.count_if(F.col("name") == name).alias(k) for k, name in kinds.items()])


def script_groups(facts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(group, members): groups that scripts join in code and, with scene nodes, in scenes."""
    rows = of_kind(facts, "group").select(F.col("name").alias("group"))
    if nodes is not None:
        rows = rows.unionByName(nodes.select(F.explode("groups").alias("group")))
    return rows.groupBy("group").agg(F.count("*").alias("members"))


def reflection_sites(facts: DataFrame) -> DataFrame:
    """(path, method, line, list, receiver, in_loop): where scripts list members at run time."""
    return of_kind(facts, "reflection").select("path", "method", "line", F.col("name").alias("list"), F.col("owner").alias("receiver"), F.col("detail").isNotNull().alias("in_loop"))


def named_calls(facts: DataFrame) -> DataFrame:
    """(path, name, receiver, by, line): methods named by texts, by call, Callable or Expression."""
    return of_kind(facts, "dynamic_call").select("path", "name", F.col("owner").alias("receiver"), F.col("detail").alias("by"), "line")


def node_types(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, line, node, type): the types that scenes give to the node paths and unique names of their scripts."""
    attached = nodes.where("script IS NOT NULL").select(F.substring("script", 7, 4096).alias("path"), F.col("path").alias("scene"), F.col("node_path").alias("root"))
    inside = attached.join(nodes.select(F.col("path").alias("scene"), "node_path", "name", "type", "is_unique"), "scene")
    below = F.when(F.col("root") == ".", F.col("node_path")).when(F.startswith("node_path", F.concat("root", F.lit("/"))), F.expr("substring(node_path, length(root) + 2)"))
    paths = inside.select("path", below.alias("name"), "type", F.lit("node_path").alias("kind")).where("name IS NOT NULL").unionByName(inside.where("is_unique").select("path", "name", "type", F.lit("unique_node").alias("kind")))
    return of_kind(facts, "node_path", "unique_node").select("path", "name", "kind", "line").join(paths.distinct(), ["path", "name", "kind"]).select("path", "line", F.col("name").alias("node"), "type")


def container_provenance(facts: DataFrame) -> DataFrame:
    """(path, method, name, step, line, type): what is put into each container, in order."""
    order = Window.partitionBy("path", "method", "name").orderBy("line", "col")
    return of_kind(facts, "element").select("path", "method", "name", F.row_number().over(order).alias("step"), "line", "type")


def lambdas(rows: DataFrame) -> DataFrame:
    """(path, line, parameters, in_call): lambdas, and whether they are handed to a call."""
    own = rows.where("kind = 'MethodExpression'")
    above = rows.select("path", F.col("pre").alias("parent"), F.col("kind").alias("up"))
    params = rows.where("kind = 'ParameterDeclaration'").join(rows.where("kind = 'ParametersList'").select("path", F.col("pre").alias("parent"), F.col("parent").alias("lambda")), ["path", "parent"]).groupBy("path", F.col("lambda").alias("pre")).agg(F.count("*").alias("parameters"))
    return own.join(above, ["path", "parent"], "left").join(params, ["path", "pre"], "left").select("path", "line", F.coalesce("parameters", F.lit(0)).alias("parameters"), (F.col("up") == "ExpressionsList").alias("in_call"))


# --- syntax and editor lookups --------------------------------------------------------------------


def syntax_kinds(rows: DataFrame) -> DataFrame:
    """(kind, n): how many nodes of each kind there are."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def subtree(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """All rows below ``roots`` (path, pre, last): an interval join within files."""
    r = roots.select("path", F.col("pre").alias("from"), F.col("last").alias("to"))
    return rows.join(r, "path").where("pre BETWEEN from AND to")


def node_tokens(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, from, text): the leaves of each root in source order."""
    leaves = subtree(rows, roots).where("pre = last AND value IS NOT NULL")
    return leaves.groupBy("path", "from").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), " ").alias("text"))


def deepest(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(path, line, col, kind, value): the innermost node at each point (path, line, col)."""
    p = points.select("path", F.col("line").alias("at_line"), F.col("col").alias("at_col"))
    at, begin, end = F.struct("at_line", "at_col"), F.struct(F.col("line"), F.col("col")), F.struct("end_line", "end_col")
    inside = rows.join(p, "path").where((begin <= at) & (at < end))
    best = inside.groupBy("path", "at_line", "at_col").agg(F.max_by(F.struct("kind", "value"), F.col("pre")).alias("n"))
    return best.select("path", F.col("at_line").alias("line"), F.col("at_col").alias("col"), "n.kind", "n.value")


def folding_ranges(rows: DataFrame) -> DataFrame:
    """(path, kind, line, end_line) of what can be folded."""
    kinds = ["MethodDeclaration", "InnerClassDeclaration", "EnumDeclaration", "IfStatement", "ForStatement", "WhileStatement", "MatchStatement", "ArrayInitializerExpression", "DictionaryInitializerExpression"]
    return rows.where(F.col("kind").isin(kinds) & (F.col("end_line") > F.col("line"))).select("path", "kind", "line", "end_line")


def document_symbols(rows: DataFrame) -> DataFrame:
    """(path, name, kind, line, container): declarations with the class they stand in."""
    kinds = {"MethodDeclaration": "method", "VariableDeclaration": "variable", "SignalDeclaration": "signal", "EnumDeclaration": "enum", "InnerClassDeclaration": "class", "EnumValueDeclaration": "enum_value"}
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    own = rows.where(F.col("kind").isin(list(kinds)) & F.col("value").isNotNull())
    holders = rows.where("kind IN ('InnerClassDeclaration', 'EnumDeclaration')").select("path", F.col("pre").alias("from"), F.col("last").alias("to"), F.col("value").alias("container"), F.col("depth").alias("above"))
    met = own.join(holders, (own["path"] == holders["path"]) & (own["pre"] > F.col("from")) & (own["pre"] <= F.col("to")), "left").select(own["path"], "pre", "value", "kind", "line", "container", "above")
    near = met.groupBy("path", "pre", "value", "kind", "line").agg(F.max_by("container", "above").alias("container"))
    return near.select("path", F.col("value").alias("name"), F.try_element_at(names, F.col("kind")).alias("kind"), "line", "container")


def workspace_symbols(facts: DataFrame, query: str) -> DataFrame:
    """(path, name, kind, line): members and classes whose name holds the query, without case."""
    rows = of_kind(facts, "member", "class").where(F.contains(F.lower("name"), F.lit(query.lower())))
    return rows.select("path", "name", F.when(F.col("kind") == "class", "class").otherwise(F.col("owner")).alias("kind"), "line").distinct()


def semantic_tokens(facts: DataFrame) -> DataFrame:
    """(path, line, col, name, token): what each used name is."""
    return of_kind(facts, "use").select("path", "line", "col", "name", F.when(F.col("owner") == "local", "variable").when(F.col("owner") == "func", "function").when(F.col("owner") == "const", "constant").otherwise(F.col("owner")).alias("token")).distinct()


def definitions(model: Model, points: DataFrame) -> DataFrame:
    """(path, line, col, name, at, at_line): what the name at each point (path, line, col) names."""
    used = model.facts.where(F.col("kind").isin("use", "call", "access", "assign", "unresolved")).select("path", "line", "col", "name", "method", "kind", "owner")
    hit = points.select("path", "line", "col").join(used, ["path", "line", "col"])
    local = of_kind(model.facts, "local", "param").groupBy("path", "method", "name").agg(F.min("line").alias("local_line"))
    lines = of_kind(model.facts, "member").groupBy(F.col("path").alias("at"), "name").agg(F.min("line").alias("member_line"))
    members = model.members.select("path", "name", "at").join(lines, ["at", "name"])
    classes = model.types().select(F.col("class_name").alias("name"), F.col("home").alias("class_path"))
    met = hit.join(local, ["path", "method", "name"], "left").join(members, ["path", "name"], "left").join(classes, "name", "left")
    at = F.when(F.col("local_line").isNotNull(), F.col("path")).otherwise(F.coalesce("at", "class_path"))
    return met.select("path", "line", "col", "name", at.alias("at"), F.coalesce("local_line", "member_line", F.when(F.col("class_path").isNotNull(), 1)).alias("at_line")).where("at IS NOT NULL").distinct()


def highlights(facts: DataFrame, points: DataFrame) -> DataFrame:
    """(path, name, line, col): all places in the file of the name at each point."""
    rows = facts.where(F.col("kind").isin("use", "assign", "member", "local", "param", "call", "access")).select("path", "name", "line", "col").distinct()
    asked = points.join(rows, ["path", "line", "col"]).select("path", "name").distinct()
    return rows.join(asked, ["path", "name"])


def hover(model: Model, points: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(path, line, col, name, type, doc): a name's type at each point, with its declaration's comment."""
    used = of_kind(model.facts, "use").select("path", "line", "col", "name", "type").distinct()
    out = points.join(used, ["path", "line", "col"])
    if docs is None:
        return out.withColumn("doc", F.lit(None).cast("string"))
    return out.join(docs.select("path", "name", "doc"), ["path", "name"], "left")


def doc_comments(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, name, line, doc): the ``##`` lines right above a declaration."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("p", "l")).select("path", (F.col("p") + 1).alias("line"), F.regexp_extract("l", r"^\s*##\s?(.*)$", 1).alias("text"), F.col("l").rlike(r"^\s*##").alias("is_doc"))
    w = Window.partitionBy("path").orderBy("line")
    runs = lines.withColumn("run", F.sum((~F.col("is_doc")).cast("int")).over(w)).where("is_doc")
    blocks = runs.groupBy("path", "run").agg((F.max("line") + 1).alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("doc"))
    named = rows.where(F.col("kind").isin("MethodDeclaration", "VariableDeclaration", "SignalDeclaration", "EnumDeclaration", "InnerClassDeclaration", "ClassNameAttribute")).select("path", F.col("value").alias("name"), "line")
    return named.join(blocks.select("path", "line", "doc"), ["path", "line"])


def inlay_hints(facts: DataFrame) -> DataFrame:
    """(path, line, name, type): types of locals that don't write theirs but have one."""
    rows = of_kind(facts, "local").where("(type IS NULL OR type IN ('inferred', 'iterator')) AND NOT contains(detail, 'Variant') AND detail <> 'null'")
    return rows.select("path", "line", "name", F.col("detail").alias("type"))


def signatures(model: Model) -> DataFrame:
    """(path, name, parameters, least, most, type): what a call of each method takes."""
    return model.members.where("member = 'func'").select("path", "name", F.col("params").alias("parameters"), "least", "most", "type")


def completions(model: Model, spark: SparkSession, type_name: str, prefix: str = "") -> DataFrame:
    """(name, kind): members that can follow a value of a type, the project's classes and built-in ones alike."""
    own = model.members.join(model.classes.where(F.col("class_name") == type_name).select("path"), "path").select("name", F.col("member").alias("kind"))
    built = catalogue.table(spark).where(F.col("owner") == type_name).select("name", F.lit("func").alias("kind"))
    return own.unionByName(built).where(F.startswith("name", F.lit(prefix))).distinct()


def type_definitions(model: Model, points: DataFrame) -> DataFrame:
    """(path, line, col, name, type, at): the script of the class of the value at each point."""
    used = of_kind(model.facts, "use").select("path", "line", "col", "name", "type").distinct()
    return points.join(used, ["path", "line", "col"]).join(model.types().select(F.col("class_name").alias("type"), F.col("home").alias("at")), "type").select("path", "line", "col", "name", "type", "at")


def engine_types(spark: SparkSession) -> DataFrame:
    """(name, base): the engine's classes that are known here."""
    return spark.createDataFrame(sorted(ENGINE.items()), "name string, base string")
