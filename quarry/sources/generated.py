"""A project of scripts and scenes made from the supplier table: one script a supplier and feature.

Every feature is a small script that shows one thing (``{k}`` is the supplier's
key) and says what has to be found in it.  A feature is there for the suppliers
whose key leaves its place modulo ``TURNS``, so the project grows with the table
and its expected findings are plain SQL over it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = 7
HEAD = "extends RefCounted\n\n\n"


@dataclass(frozen=True)
class Feature:
    name: str
    text: str
    found: dict[str, int] = field(default_factory=dict)
    whole: bool = False  # the text is the whole file

    def template(self) -> str:
        return self.text if self.whole else HEAD + self.text


def _f(name: str, text: str, more: dict[str, int] | None = None, whole: bool = False) -> Feature:
    return Feature(name, text, {name: 1} | (more or {}), whole)


FINDINGS: list[Feature] = [
    _f("GD1001", "var bad = 1 + +\n"),
    _f("GD1006", "func f(a: int):\n\treturn a not 3\n"),
    _f("GD2001", "func f() -> void:\n\tprint(nowhere)\n"),
    _f("GD2003", "func f() -> void:\n\tvar twice: int\n\tvar twice: float\n\tprint(twice)\n"),
    _f("GD3001", 'func f(a: int) -> void:\n\ta = "x"\n\tprint(a)\n'),
    _f("GD3002", "func f(a: int, b: String) -> void:\n\tprint(a - b)\n"),
    _f("GD3004", 'func f() -> void:\n\tvar a: int = "x"\n\tprint(a)\n'),
    _f("GD3005", "extends Nowhere{k}\n", whole=True),
    _f("GD3006", "var v: Unknown{k}\n"),
    _f("GD3007", 'func f() -> int:\n\treturn "x"\n'),
    _f("GD3009", "func f(s: String) -> void:\n\tprint(s.nothing)\n"),
    _f("GD3010", 'func f(a: int) -> void:\n\tprint(a)\n\n\nfunc g() -> void:\n\tf("x")\n'),
    _f("GD3013", 'func f(a: Array) -> void:\n\tprint(a["x"])\n'),
    _f("GD3014", "func f(a: int) -> void:\n\tprint(a[0])\n"),
    _f("GD3017", "var v: Array[Unknown{k}] = []\n"),
    _f("GD3018", "var v: Dictionary[Array, int] = {}\n"),
    _f("GD3019", "func f(a: int) -> void:\n\tprint(a < null)\n"),
    _f("GD3020", "func f() -> void:\n\tvar a = null\n\tprint(a < 3)\n"),
    _f("GD3021", "func f(a: int, b: String) -> void:\n\tprint(a < b)\n"),
    _f("GD3022", "func f() -> void:\n\tvar a: Variant = 5\n\tprint(a)\n"),
    _f("GD3023", 'func f(a: bool):\n\tif a:\n\t\treturn 1\n\treturn "x"\n'),
    _f("GD3024", "func f(a: bool) -> int:\n\tif a:\n\t\treturn 1\n"),
    _f("GD3025", "func f() -> void:\n\tvar a: Array = []\n\ta.append(1)\n\ta.append(2)\n\tprint(a)\n"),
    _f("GD3026", "func f(a: int) -> void:\n\tprint(a as Node)\n"),
    _f("GD4001", 'func f() -> void:\n\tprint("x".left())\n'),
    _f("GD4002", "func f(s: String) -> void:\n\ts.nothing()\n"),
    _f("GD4004", "func f(a: int) -> void:\n\ta()\n"),
    _f("GD4005", "signal s(a: int)\n\n\nfunc f() -> void:\n\ts.emit()\n"),
    _f("GD4006", 'func f() -> void:\n\temit_signal("nowhere")\n'),
    _f("GD4007", "signal s\n\n\nfunc f(a: int) -> void:\n\tprint(a)\n\n\nfunc g() -> void:\n\ts.connect(f)\n"),
    _f("GD4008", 'func f() -> void:\n\tprint(load("res://gone/{k}.png"))\n\tprint(load("res://s/{k}.gd"))\n'),
    _f("GD4009", 'signal s(a: int)\n\n\nfunc f() -> void:\n\ts.emit("x")\n'),
    _f("GD4011", "extends Node\n\n\nfunc look() -> void:\n\tprint($Here)\n\tprint($Here/Below)\n\tprint($Gone)\n\tprint(%Unique)\n\tprint(%Missing)\n", {"GD4012": 1}, whole=True),
    _f("GD5001", "func f() -> void:\n\tbreak\n"),
    _f("GD5002", "func f() -> void:\n\tcontinue\n"),
    _f("GD5003", "return\n"),
    _f("GD5004", "func f() -> int:\n\treturn 1\n\tprint(2)\n"),
    _f("GD5005", "var v = yield()\n"),
    _f("GD5006", "signal s\nvar v = await s\n"),
    _f("GD5007", "func f() -> void:\n\tawait 5\n"),
    _f("GD5008", "var v = super.thing()\n"),
    _f("GD5009", "static func f() -> void:\n\tsuper.thing()\n"),
    _f("GD5010", "const C = 1\n\n\nfunc f() -> void:\n\tC = 2\n"),
    _f("GD5011", "signal s\n\n\nfunc f() -> void:\n\tawait s\n\n\nfunc g() -> void:\n\tf()\n"),
    _f("GD6001", "func f() -> void:\n\tpass\n\n\nfunc g() -> void:\n    pass\n"),
    _f("GD6002", "func f() -> void:\n\tpass\n\n\nfunc g() -> void:\n\t\t\tpass\n"),
    _f("GD6005", "func f() -> void:\n    if true:\n        pass\n      pass\n"),
    _f("GD7002", "func f(a):\n\tprint(a.width)\n"),
    _f("GD7003", "func f(a):\n\ta.run()\n"),
    _f("GD7005", "func f() -> void:\n\tvar a = null\n\tprint(a.width)\n"),
    _f("GD7006", "func f() -> void:\n\tvar a = null\n\tprint(a[0])\n"),
    _f("GD7007", "func f() -> void:\n\tvar a = null\n\ta.run()\n"),
    _f("GD7010", "func f(a: int) -> void:\n\tif a is int:\n\t\tprint(a)\n"),
    _f("GD7011", "func f(a):\n\tif a is int:\n\t\tif a is int:\n\t\t\tprint(a)\n"),
    _f("GD7012", 'func f(a):\n\tif a.has_method("go"):\n\t\tif a.has_method("go"):\n\t\t\ta.go()\n'),
    _f("GD7013", "func f(a: int) -> void:\n\tif a != null:\n\t\tprint(a)\n"),
    _f("GD7014", "func f() -> void:\n\tvar a: Node = null\n\tif a:\n\t\tif a:\n\t\t\tprint(a)\n"),
    _f("GD7015", 'func f() -> void:\n\tcall("nothing")\n\tcall("f")\n'),
    _f("GD7016", 'var there: int\n\n\nfunc f() -> void:\n\tset("nothing", 1)\n\tset("there", 1)\n'),
    _f("GD7017", 'extends Node\n\n\nfunc f() -> void:\n\tget_node_or_null("X").queue_free()\n\tvar n = get_node_or_null("Y")\n\tif n:\n\t\tn.queue_free()\n', whole=True),
    _f("GD7018", "var v = $Here\n@onready var w = $Here\n"),
    _f("GD7019", "func f(b: Node) -> void:\n\tvar a: Sprite2D = null\n\ta = b\n\tprint(a)\n"),
    _f("GD7020", "func f(a) -> void:\n\tprint(a)\n\n\nfunc g() -> void:\n\tf(1)\n\tf(2)\n"),
    _f("GD7021", "func f(a: Array) -> void:\n\tfor x in a:\n\t\tprint(x.to_upper())\n"),
    _f("GD7022", "var v: int = 5\n"),
    _f("GD8001", "@abstract\nclass A:\n\t@abstract\n\tfunc f() -> void:\n\t\tprint(1)\n"),
    _f("GD8002", "class A:\n\t@abstract\n\tfunc f() -> void\n"),
    _f("GD8004", "@abstract\nclass A:\n\t@abstract\n\tfunc f() -> void:\n\t\tsuper.f()\n", {"GD8001": 1}),
    _f("GD8005", "@abstract\nclass A:\n\tpass\n\n\nfunc f() -> void:\n\tprint(A.new())\n"),
    _f("GD9001", "class A:\n\tfunc go() -> void:\n\t\tpass\n\n\nfunc f() -> void:\n\tA.go()\n"),
    Feature("across", "func f(o: S0) -> void:\n\to.base_0(1)\n\to.gone()\n\tprint(o.missing)\n\tS0.base_0()\n", {"GD4001": 1, "GD4002": 1, "GD3009": 1, "GD9001": 1}),
    Feature("guarded", 'func f(a):\n\tif a is String:\n\t\tprint(a.to_upper())\n\tif a.has_method("go"):\n\t\ta.go()\n\n\nfunc g() -> void:\n\tvar n: Node = null\n\tif n == null:\n\t\treturn\n\tprint(n.name)\n', {}),
    Feature("wired", "extends Node\n\nvar _set\nvar _maybe\nvar _list: Array\n\n\nfunc _ready() -> void:\n\t_set = 1\n\tif is_inside_tree():\n\t\t_maybe = 2\n\tadd_to_group(\"g{k}\")\n\t_late()\n\tvar c = Callable(self, \"_by_name\")\n\tvar e = Expression.new()\n\te.parse(\"_by_text(1)\")\n\tprint(c, e)\n\n\nfunc _late() -> void:\n\t_list.append(_set)\n\t_list.append(\"x\")\n\n\nfunc _by_name() -> void:\n\tfor m in get_method_list():\n\t\tprint(m)\n\n\nfunc _by_text(a: int) -> void:\n\tvar n = preload(\"res://s/{k}.gd\").instantiate()\n\tadd_child(n)\n\tprint([1].map(func(x): return x), a)\n", {}, whole=True),
    Feature("docs", "## Says hello.\n## Twice.\nfunc hello() -> void:\n\tpass\n\n\n@dynamic_use\nfunc _asked() -> void:\n\tpass\n", {}),
    Feature("loops", "func f(a: Array[int]) -> int:\n\tvar total := 0\n\tfor x in a:\n\t\tif x > 3:\n\t\t\tcontinue\n\t\ttotal += x\n\twhile total > 9:\n\t\ttotal -= 1\n\t\tif total == 5:\n\t\t\tbreak\n\tmatch total:\n\t\t1:\n\t\t\treturn 1\n\t\t_:\n\t\t\treturn total\n", {}),
]

STYLE: list[Feature] = [
    Feature("GDL008", "var shown: int\nvar _hidden: int\n", {"GDL008": 1}),
    Feature("GDL204", "var _a = f(1)\n\n\nfunc f(b) -> int:\n\treturn b\n", {"GDL204": 2, "GDL215": 2}),
    Feature("GDL208", "func f(a: int) -> void:\n" + "".join(f"\tif a == {k % 3}:\n\t\tprint(a)\n" for k in range(10)), {"GDL208": 1}),
    Feature("GDL209", "const A = 77\n\n\nfunc f(b: Array) -> int:\n\tprint(b[5])\n\treturn 42\n", {"GDL209": 1}),
    Feature("GDL213", "func f(a: int) -> bool:\n\treturn a == a\n", {"GDL213": 1}),
    Feature("GDL214", 'func f() -> Dictionary:\n\treturn {"a": 1, "b": 2, "a": 1}\n', {"GDL214": 1}),
    Feature("GDL215", "func f():\n\tpass\n", {"GDL215": 1}),
    Feature("GDL224", "func f(a: int) -> void:\n\ta + 1\n\ta\n\tf(a)\n", {"GDL224": 2}),
    Feature("GDL228", "func f(a: int) -> void:\n\tmatch a:\n" + "".join(f"\t\t{k % 2}:\n\t\t\tpass\n" for k in range(13)), {"GDL228": 1, "GDL208": 1}),
    Feature("GDL229", "func f(a: bool) -> void:\n\tif a and a and a and a and a and a:\n\t\tpass\n", {"GDL229": 1}),
    Feature("GDL231", "func f() -> void:\n\tvar a: int = 1\n\ta = 2\n\tprint(a)\n", {"GDL231": 1}),
    Feature("GDL235", "func f(a: bool) -> int:\n\tif a:\n\t\treturn 1\n", {"GDL235": 1}),
    Feature("GDL236", "".join(f"var _v{k}: int\n" for k in range(16)), {"GDL236": 1}),
    Feature("GDL242", 'func f(a: Array) -> String:\n\tvar out: String = ""\n\tfor x in a:\n\t\tout += str(x)\n\treturn out\n', {"GDL242": 1}),
    Feature("GDL245", "func f() -> void:\n\tvar lost: Node = Node.new()\n\tvar kept: Node = Node.new()\n\tadd_child(kept)\n\tprint(lost)\n", {"GDL245": 1}),
    Feature("GDL250", "func f() -> void:\n\tvar a\n\tprint(a)\n", {"GDL250": 1, "GDL204": 1, "GDL215": 1}),
    Feature("GDL302", "func f() -> Array:\n\treturn [\n\t\t1,\n\t\t2\n\t]\n", {"GDL302": 1}),
    Feature("GDL510", "func f() -> void:\n\tvar a: int =1\n\tprint(a)\n", {"GDL510": 1}),
    Feature("GDL511", "func f() -> void:\n\tprint(1,2)\n", {"GDL511": 1}),
    Feature("GDL513", "func f() -> void:\n\tpass\n\nfunc g() -> void:\n\tpass\n", {"GDL513": 1}),
    Feature("clean", "const LIMIT = 10\n\n\nfunc f(a: int) -> int:\n\tif a > LIMIT:\n\t\treturn LIMIT\n\treturn a\n", {}),
]

#: The script of a supplier: every fifth starts a line of classes, the next four extend the one before.
OWN = """class_name S{k}
extends {base}

signal paid(amount: float)
signal never_{k}
enum State { IDLE, BUSY, LOST }
const LIMIT = {k}
@export var balance: float = 0.5
@onready var _later = null
var _count = 0
var _unread = 1


func _ready() -> void:
	_count = LIMIT
	paid.emit(balance)
	print(_count, State.IDLE, State.BUSY)
	_used(_count)


func base_{k}() -> int:
	return _count


static func make(given) -> int:
	return given


func _used(amount: int) -> void:
	for i in range(amount):
		if i % 2 == 0 and i > 3:
			print(i)
		elif i == 7:
			# TODO: price of {k}
			print(make(i))


func _unused(spare) -> void:
	pass
"""
#: A second script of every supplier, with what security, flow and suppression reports look for.
RISKY = """extends Node
# gdlint:disable = unused-variable
const Other = preload("res://s/{k}.gd")
var target: Node2D = null


func _ready():
	self.ready.connect(on_ready)
	OS.execute("rm", [])
	target.show()
	if target != null:
		target.hide()
	greet("me")
	greet("you")


func on_ready():
	var file = load("user://" + user_path)
	return file


func greet(who):
	var size: int = "big"
	print(who, size)


func measure(thing):
	if thing is Node and thing.has_method("step"):
		thing.step(1)
	return 1
	thing = null


func spare():
	var nothing = 1
	var near = null
	near.step()
"""
SETTINGS = """[application]

config/name="Supplier {k}"
config/features=PackedStringArray("4.5", "Forward Plus")

[autoload]

Global="*res://s/{k}.gd"
Fade="res://GD4011/{k}.tscn"

[input]

jump_{k}={
"deadzone": 0.5
}
"""
RESOURCE = """[gd_resource type="Resource" script_class="S{k}" load_steps=2 format=3]

[ext_resource type="Script" path="res://s/{k}.gd" id="1"]

[resource]
script = ExtResource("1")
balance = 3.5
"""
SCENE = """[gd_scene load_steps=3 format=3]

[ext_resource type="Script" path="res://GD4011/{k}.gd" id="1"]
[ext_resource type="PackedScene" path="res://GD4011/gone_{k}.tscn" id="2"]

[node name="Main" type="Node"]
script = ExtResource("1")
x = 1
x = 2

[node name="Here" type="Timer" parent="." groups=["all", "g{k}"]]

[node name="Below" type="Node" parent="Here" instance=ExtResource("2")]

[node name="Unique" type="Node" parent="."]
unique_name_in_owner = true

[connection signal="timeout" from="Here" to="." method="look"]
[connection signal="timeout" from="Here" to="." method="gone_method"]
"""


def _place(features: list[Feature], name: str) -> int:
    return [f.name for f in features].index(name) % TURNS


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))


def _filled(template: F.Column | str) -> F.Column:
    text = F.lit(template) if isinstance(template, str) else template
    return F.replace(text, F.lit("{k}"), F.col("k").cast("string"))


def feature_files(suppliers: DataFrame, features: list[Feature]) -> DataFrame:
    """(path, text) of the features' scripts; the table of features is a literal."""
    spark = suppliers.sparkSession
    table = spark.createDataFrame([(i % TURNS, f.name, f.template()) for i, f in enumerate(features)], "turn int, name string, template string")
    met = suppliers.withColumn("turn", (F.col("k") % TURNS).cast("int")).join(F.broadcast(table), "turn")
    return met.select(F.concat("name", F.lit("/"), F.col("k").cast("string"), F.lit(".gd")).alias("path"), _filled(F.col("template")).alias("text"))


def own_files(suppliers: DataFrame) -> DataFrame:
    """(path, text) of the suppliers' own classes."""
    base = F.when(F.col("k") % 5 == 0, F.lit("RefCounted")).otherwise(F.concat(F.lit("S"), (F.col("k") - 1).cast("string")))
    return suppliers.select(F.concat(F.lit("s/"), F.col("k").cast("string"), F.lit(".gd")).alias("path"), F.replace(_filled(OWN), F.lit("{base}"), base).alias("text"))


def scene_files(suppliers: DataFrame) -> DataFrame:
    """(path, text) of the scenes whose script looks for nodes."""
    some = suppliers.where(F.col("k") % TURNS == _place(FINDINGS, "GD4011"))
    return some.select(F.concat(F.lit("GD4011/"), F.col("k").cast("string"), F.lit(".tscn")).alias("path"), _filled(SCENE).alias("text"))


def texts(suppliers: DataFrame, template: str, folder: str, suffix: str) -> DataFrame:
    """(path, text): one text for every supplier."""
    return suppliers.select(F.concat(F.lit(f"{folder}/"), F.col("k").cast("string"), F.lit(suffix)).alias("path"), _filled(template).alias("text"))


def expected(features: list[Feature], column: str) -> str:
    """SQL of (path, column, n): what the features say has to be found, over the supplier table."""
    rows = ", ".join(f"({i % TURNS}, '{f.name}', '{code}', {n})" for i, f in enumerate(features) for code, n in f.found.items())
    return f"SELECT name||'/'||s_suppkey||'.gd' AS path, code AS {column}, n::BIGINT AS n FROM supplier JOIN (VALUES {rows}) AS v(turn, name, code, n) ON s_suppkey % {TURNS} = turn"
