"""A small project in memory: the input of the code queries and of their tests."""

from __future__ import annotations

SCRIPTS: dict[str, str] = {
    "core/base.gd": '''class_name Base
extends Node

signal changed(amount: int)
signal never_sent

const LIMIT := 10
const badConst = 3
enum State { IDLE, RUNNING, lost }

@export var speed: float = 1.5
var count = 0
var _cache: Dictionary = {}


func _ready() -> void:
\tcount = LIMIT
\tchanged.emit(count)


func step(amount: int, unused_one = 2) -> int:
\tvar total: int = 0
\tfor i in range(amount):
\t\tif i % 2 == 0 and i > 0:
\t\t\twhile total < i:
\t\t\t\ttotal += 1
\t\telif i == 3:
\t\t\ttotal = total if total > 1 else 2
\treturn total


func _never_called() -> void:
\tpass


func pick(kind):
\tmatch kind:
\t\t1:
\t\t\treturn "one"
\t\t2, 3:
\t\t\treturn "few"
\t\t_:
\t\t\treturn "many"
\tprint("never here")
''',
    "core/child.gd": '''extends Base
class_name Child

const Helper = preload("res://util/helper.gd")
var helper: Helper = null
@onready var sprite = $Sprite


func step(amount: int, other = 1) -> int:
\tvar count = super.step(amount)
\treturn count + Helper.twice(amount)


func _process(delta):
\tvar node = get_node("Sprite")
\tnode.custom_call()
\tif delta > 1: return
\telse: print(delta) # gdlint:ignore = no-debug-print
''',
    "util/helper.gd": '''class_name Helper
# TODO: cache results
const Other = preload("res://util/other.gd")

static func twice(value: int) -> int:
\treturn value * 2

func custom_call():
\tpass

class inner_one:
\tvar a = 1
''',
    "util/other.gd": '''extends RefCounted
# gdlint:disable = unused-variable
func load_it():
\tvar skipped = 1
# gdlint:enable = unused-variable
\tvar reported = 2   
\tvar x = load("res://util/helper.gd")
\treturn x
''',
    "core/risky.gd": '''extends Node

var target: Node2D = null


func _ready():
\tself.ready.connect(on_ready)
\tOS.execute("rm", [])
\ttarget.show()
\tif target != null:
\t\ttarget.hide()
\tgreet("me")
\tgreet("you")


func on_ready():
\tvar file = load("user://" + user_path)
\treturn file


func greet(who):
\tvar size: int = "big"
\tprint(who, size)


func measure(thing):
\tif thing is Node and thing.has_method("step"):
\t\tthing.step(1)
\tthing.pick(2)
\treturn 1
\tthing = null
''',
}
SCENES: dict[str, str] = {
    "main.tscn": '''[gd_scene load_steps=3 format=3]

[ext_resource type="Script" path="res://core/child.gd" id="1_c"]
[ext_resource type="PackedScene" path="res://sub.tscn" id="2_s"]

[node name="Main" type="Node2D" groups=["actors", "all"]]
script = ExtResource("1_c")

[node name="Timer" type="Timer" parent="."]
wait_time = 1.0

[node name="Sub" parent="Timer" instance=ExtResource("2_s")]
unique_name_in_owner = true

[connection signal="timeout" from="Timer" to="." method="pick"]
''',
    "sub.tscn": '''[gd_scene format=3]

[ext_resource type="Texture" path="res://gone.png" id="1"]

[node name="Sub" type="Node"]
''',
}
SETTINGS: dict[str, str] = {
    "project.godot": '''[application]

config/name="Sample"
config/features=PackedStringArray("4.5", "Forward Plus")

[autoload]

Global="*res://core/base.gd"
Fade="res://sub.tscn"
''',
}
RESOURCES: dict[str, str] = {
    "item.tres": '''[gd_resource type="Resource" script_class="Child" load_steps=2 format=3]

[ext_resource type="Script" path="res://core/child.gd" id="1"]

[resource]
script = ExtResource("1")
speed = 3.5
''',
}
