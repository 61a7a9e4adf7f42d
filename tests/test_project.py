"""Syntax trees, semantics, settings, rules, liveness, caches and streams on small scripts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import commands, diagnostics, liveness, refactor, rules, views
from quarry.sources import generated, project, semantics, settings, style, syntax
from quarry.streaming import events


def model_of(spark, scripts):
    files = project.in_memory(spark, scripts)
    return diagnostics.Model(project.analysed(files).select("path", F.inline("facts")))


def codes(text):
    return sorted({f[1] for f in semantics.facts(text) if f[0] == "finding"})


# --- syntax -------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["a + b * 2 ** -3", "not a in b and c", "x if y else z", "f(1, g(2))[3].h", "{a: 1, 'b': [1, 2], c = 3}", "x is not Node", "$A/B.c(%U)", "&'s' + r'x' + ^'p'", "preload('x').new()", "!a && b || c", "await t.timeout", "-a ** 2", "~a << 2 | 1", "a as Node"])
def test_expressions_come_back(text):
    tree = syntax.expression(text)
    assert tree.text() == text and syntax.expression(tree.text()).text() == text


@pytest.mark.parametrize("text", ["", "(", ")", "a = = 3", "func f(:", "var", "enum {", "if", "match x:\n\t1", "1 +", "@", "class A:\n\tclass", "f(func(): pass", "\"open", "[1, 2", "{a: }", "for i", "x.y.", "not", "\ufeffextends Node", "var a = func():\n\t\tpass", "\t\tx\n\ty\nz"])
def test_no_text_fails(text):
    rows = syntax.rows(syntax.script(text))
    assert rows[0][4] == "ClassDeclaration" and all(r[0] <= r[1] for r in rows)
    semantics.facts(text), style.issues(text)


def test_precedence_and_associativity():
    shape = lambda t: [(n.kind[:4], n.value) for n in syntax.expression(t).walk() if n.kind.startswith(("Dual", "Sing"))]
    assert shape("a - b - c") == [("Dual", "Subtraction"), ("Dual", "Subtraction")]
    assert syntax.expression("a - b - c").children[1].value == "c"
    assert syntax.expression("a ** b ** c").children[0].value == "a"
    assert syntax.expression("a or b and c").value == "Or" and syntax.expression("not a == b").value == "Not"
    assert syntax.expression("a if b else c if d else e").children[2].kind == "IfExpression"


def test_every_node_kind_is_made():
    text = """@tool
class_name A extends "res://b.gd"
signal s(a: int)
enum E { X = 1, Y }
@export var p: Array[int] = [1, .5]: set = _s, get = _g
var q: Dictionary[String, int] = {"a": 1}:
\tget: return q
\tset(v): q = v
var r: B.C
var t: "res://x.gd"
class I:
\tpass
func f(a, b := 2) -> void:
\tmatch a:
\t\t[var x, ..]: pass
\t\t_ when b: breakpoint
\tif a: return
\telif b: break
\telse: continue
\twhile not a: await s
\tfor i in [func(): return yield(), $N, %U, &"n", ^"p", r"r", \"\"\"t\"\"\", true, (1), a[0], a.b, -1 if a else 2]: pass
\tvar z
\t?
"""
    kinds = {n.kind for n in syntax.script(text).walk()}
    want = "ArrayInitializerExpression AwaitExpression BoolExpression BracketExpression BreakExpression BreakPointExpression CallExpression ContinueExpression DictionaryInitializerExpression GetNodeExpression GetUniqueNodeExpression IdentifierExpression IfExpression IndexerExpression MatchCaseVariableExpression MatchDefaultOperatorExpression MemberOperatorExpression MethodExpression NodePathExpression NumberExpression PassExpression RawStringExpression RestExpression ReturnExpression SingleOperatorExpression StringExpression StringNameExpression YieldExpression ArrayTypeNode DictionaryTypeNode SingleTypeNode StringTypeNode SubTypeNode ClassNameAttribute CustomAttribute ExtendsAttribute ToolAttribute ClassMembersList ExpressionsList ParametersList PathList StatementsList StringPartsList TripleDoubleQuotasStringNode MatchCasesList ElifBranchesList EnumValuesList DictionaryKeyValueDeclarationList DictionaryKeyValueDeclaration EnumDeclaration EnumValueDeclaration InnerClassDeclaration MatchCaseDeclaration MethodDeclaration ParameterDeclaration PassDeclaration SignalDeclaration VariableDeclaration GetAccessorBodyDeclaration GetAccessorMethodDeclaration SetAccessorBodyDeclaration SetAccessorMethodDeclaration VariableDeclarationStatement ForStatement IfStatement MatchStatement WhileStatement ExpressionStatement IfBranch ElifBranch ElseBranch InvalidToken"
    assert set(want.split()) - kinds - {"CallExpression"} == set()


def test_parts_of_scripts():
    assert syntax.type_node("Dictionary[String, Array[int]]").value == "Dictionary[String, Array[int]]"
    assert [s.kind for s in syntax.statements("var a = 1\nif a:\n\tpass\n").children] == ["VariableDeclarationStatement", "IfStatement"]
    assert syntax.statement("a += 1").children[0].value == "AddAndAssign" and syntax.statement("") is None
    assert [k for k, *_ in syntax.unspecified("a # b\n")] == ["name", "space", "comment", "newline"]


def test_tokens_of_nodes_and_walks(spark):
    rows = project.syntax_rows(project.in_memory(spark, {"a.gd": "func f(a):\n\treturn a + 1\n"}))
    calls = rows.where("kind = 'ReturnExpression'")
    assert [r.text for r in views.node_tokens(rows, calls).collect()] == ["a 1"]
    order = [r.kind for r in rows.orderBy("pre").collect()]
    assert [r.kind for r in rows.orderBy(F.desc("pre")).collect()] == order[::-1]


def shape(tree):
    return [(r[3], r[4], r[5], sorted(r[6])) for r in syntax.rows(tree)]


SOURCES = [f.template().replace("{k}", "3") for f in [*generated.FINDINGS, *generated.STYLE] if "GD1" not in f.name and "GD6" not in f.name and f.name not in ("GD5003",)] + [generated.OWN.replace("{k}", "1").replace("{base}", "S0"), generated.RISKY.replace("{k}", "1")]


@pytest.mark.parametrize("text", [*SOURCES, "class_name A\nextends B\n@export_range(0, 5) var x: int = 1: set = _s, get = _g\nvar y := 2:\n\tget:\n\t\treturn y\n\tset(v):\n\t\ty = v\n", "func f():\n\tx.c(func(a):\n\t\tif a:\n\t\t\tpass\n\t\treturn a\n\t)\n\tvar g = func(): return 1\n\tmatch [1, 2]:\n\t\t[var p, ..] when p:\n\t\t\tpass\n\t\t_:\n\t\t\treturn\n"])
def test_trees_are_written_back(text):
    tree = syntax.script(text)
    again = syntax.source(tree)
    assert shape(syntax.script(again)) == shape(tree)
    assert syntax.source(syntax.script(again)) == again


def test_reparse_is_a_parse():
    import random

    rng = random.Random(6)
    text = "extends Node\n\nvar a = 1\n" + "".join(f"\n\nfunc f{i}(x):\n\tif x:\n\t\treturn {i}\n\treturn x\n" for i in range(12))
    kept = 0
    for _ in range(60):
        lines = text.split("\n")
        at = rng.randrange(len(lines))
        kind = rng.random()
        if kind < 0.4:
            lines[at] = lines[at].replace("return", "print") + (" + 1" if "return" in lines[at] else "")
        elif kind < 0.7:
            lines.insert(at, rng.choice(["", "# note", "\tpass", "var z = 3", "func g():"]))
        else:
            del lines[at]
        new = "\n".join(lines)
        tree, n = syntax.reparse(syntax.script(text), text, new)
        assert syntax.rows(tree) == syntax.rows(syntax.script(new)), (at, lines[max(0, at - 2) : at + 3])
        kept += n >= 0
    assert kept > 20 and syntax.reparse(syntax.script(text), text, text)[1] == 0


# --- semantics --------------------------------------------------------------------------------------


@pytest.mark.parametrize("feature", generated.STYLE, ids=lambda f: f.name)
def test_style_features(feature):
    found = [i[0] for i in style.issues(feature.template().replace("{k}", "3"))]
    assert {c: found.count(c) for c in set(found)} == feature.found


def test_given_codes_have_a_feature():
    shown = {c for f in generated.FINDINGS for c in f.found} | {"GD4013"}
    assert set(diagnostics.CODES) - diagnostics.DECLARED_ONLY - shown == set()


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("func f(a):\n\tif not a is String:\n\t\treturn\n\ta.to_upper()\n", []), ("func f(a):\n\tif a == null:\n\t\treturn\n\tprint(a)\n", []),
        ("func f():\n\tvar a = null\n\tif a:\n\t\ta.b()\n", ["GD7003"]), ("func f(c: bool):\n\tvar a = null\n\tif c:\n\t\ta = \"x\"\n\telse:\n\t\ta = \"y\"\n\tprint(a.length())\n", []),
        ("func f(c: bool):\n\tvar a = null\n\tif c:\n\t\ta = \"x\"\n\tprint(a.length())\n", ["GD7007"]), ("func f():\n\tvar a = 1\n\twhile a < 9:\n\t\ta = \"x\"\n\tprint(a + 1)\n", []),
        ("func f() -> int:\n\twhile true:\n\t\tpass\n\treturn 1\n", []), ("func f(a: int) -> int:\n\tmatch a:\n\t\t1: return 1\n\t\t_: return 2\n", []), ("func f(a: int) -> int:\n\tmatch a:\n\t\t1: return 1\n", ["GD3024"]),
        ("func f(x: Array):\n\tx.map(func(y): return y.z)\n", ["GD7002"]), ("func f(n):\n\tif is_instance_valid(n):\n\t\tprint(n)\n", []), ("func f(a):\n\tassert(a is String)\n\tprint(a.length())\n", []),
        ("func f(a):\n\tif a in [1, 2]:\n\t\tprint(a + 1)\n", []), ("func f(a):\n\tif a == \"x\":\n\t\tprint(a - 1)\n", ["GD3002"]),
    ],
)
def test_flow(body, want):
    assert [c for c in codes("extends RefCounted\n\n\n" + body) if c != "GD7020"] == want


def test_types_of_expressions():
    types = lambda e: {f[3] for f in semantics.facts(f"func f(s: String, n: int, a: Array[int]):\n\tvar v = {e}\n") if f[0] == "local"} | {f[4] for f in semantics.facts(f"func f(s: String, n: int, a: Array[int]):\n\tvar v = {e}\n") if f[0] == "local"}
    for e, want in (("n + 1", "int"), ("n * 1.5", "float"), ("s + s", "String"), ("s.length()", "int"), ("a[0]", "int"), ("s.split(\",\")", "PackedStringArray"), ("[1, 2]", "Array[int]"), ("{}", "Dictionary"), ("n > 1", "bool"), ("n if n else s", "String|int"), ("func(): pass", "Callable"), ("Vector2(1, 2)", "Vector2"), ("s as Node", "Node"), ("not n", "bool"), ("n << 2", "int"), ("range(3)", "Array[int]")):
        assert want in types(e), e


def test_many_files_and_broken_ones(spark):
    files = project.in_memory(spark, {"deep.gd": "var a = " + "(" * 5000, "ok.gd": "var a = 1\n"})
    rows = {r.path: r for r in project.analysed(files).collect()}
    assert rows["deep.gd"].error is not None and rows["ok.gd"].error is None and rows["ok.gd"].facts
    found = commands.analyze(commands.Analysed(files)).collect()
    assert [r.rule for r in found if r.path == "deep.gd"] == ["GD0001"]


def test_bad_bytes_and_repeated_keys(spark, tmp_path):
    (tmp_path / "a.gd").write_bytes(b"var a = \"\xff\"\n")
    (tmp_path / "b.gd").write_text("var b = 1\n")
    rows = {r.path: r.text for r in project.scan(spark, str(tmp_path), "*.gd").collect()}
    assert rows["b.gd"] == "var b = 1\n" and "\ufffd" in rows["a.gd"]
    scene = project.in_memory(spark, {"x.tscn": '[node name="A" type="Node"]\nx = 1\nx = 2\n'})
    assert project.scene_nodes(scene).count() == 1


# --- liveness ------------------------------------------------------------------------------------------


def test_liveness_steps(spark):
    model = model_of(spark, {
        "base.gd": "class_name Base\n\nvar shown: int:\n\tget = _get_shown\n\n\nfunc run():\n\thook()\n\n\nfunc hook():\n\tpass\n\n\nfunc _get_shown():\n\treturn 1\n\n\nfunc loop_only():\n\tloop_only()\n",
        "child.gd": "extends Base\n\n\nfunc hook():\n\t_mine()\n\n\nfunc _mine():\n\tcall(\"_named\")\n\n\nfunc _named():\n\tpass\n\n\nfunc _maybe():\n\tpass\n\n\nfunc _linked():\n\tpass\n",
        "user.gd": "func go(b: Base, x):\n\tb.run()\n\tx._maybe()\n",
    })
    links = spark.createDataFrame([("child.gd", "_linked")], "path string, name string")
    found = {(r.path, r.name): (r.reason, r.confidence) for r in liveness.functions(liveness.Evidence(model, signals=links), liveness.LivenessOptions()).collect()}
    assert found == {("base.gd", "loop_only"): ("FPA", "Potential"), ("child.gd", "_maybe"): ("FDT", "Potential"), ("user.gd", "go"): ("FNC", "Strict")}


def test_liveness_options(spark):
    model = model_of(spark, {"addons/x/a.gd": "func open():\n\tpass\n", "tests/t.gd": "func t():\n\tpass\n", "a.gd": "enum E { A, B }\nsignal s\n\n\nclass In:\n\tpass\n\n\nfunc f(p):\n\ts.connect(f)\n\treturn E.A\n\tprint(1)\n", "b.gd": "func g():\n\tprint(B)\n"})
    evidence = liveness.Evidence(model)
    rows = {(r.path, r.kind, r.name): r.reason for r in liveness.report(evidence, liveness.LivenessOptions(skip_tests=True, include_parameters=True)).collect()}
    assert rows["addons/x/a.gd", "func", "open"] == "APA" and not any(p.startswith("tests") for p, *_ in rows)
    assert rows["a.gd", "signal", "s"] == "SCB" and rows["a.gd", "enum_value", "B"] == "ENU" and rows["a.gd", "class", "In"] == "ICU" and rows["a.gd", "statement", "f"] == "UCR" and rows["a.gd", "param", "p"] == "PNU"
    loose = {(r.path, r.kind, r.name) for r in liveness.report(evidence, liveness.LivenessOptions(compat=False)).collect()}
    assert ("a.gd", "enum_value", "B") in loose
    found = liveness.report(evidence)
    keys = liveness.baseline_key(found)
    assert liveness.new_since(found, keys).count() == 0 and liveness.with_confidence(found, "Strict").where("confidence <> 'Strict'").count() == 0


# --- settings, rules, commands ----------------------------------------------------------------------------


def test_settings():
    assert settings.from_json(settings.to_json(settings.PRESETS["strict"])) == settings.PRESETS["strict"]
    assert settings.from_json("{bad") == settings.Settings() and settings.from_json('{"max_line_length": "x", "none": 1}') == settings.Settings()
    assert settings.problems('{"max_line_length": 5, "none": 1, "severity": {"GDL001": "loud"}}') == ["unknown setting: none", "unknown severity: loud", "max_line_length should be 20 to 1000"]
    rc = settings.from_rc("disable:\n- unused-argument\nmax-line-length: 90\nfunction-arguments-number: 7\nexcluded_directories: [addons, .git]\nclass-name: null\n")
    assert rc.enabled == {"GDL202": False, "GDL001": False} and rc.max_line_length == 90 and rc.limits == {"GDL205": 7} and rc.exclude == ["addons", ".git"]


def test_settings_apply(spark):
    rows = spark.createDataFrame([("a.gd", "GDL101", "hint"), ("addons/b.gd", "GDL002", "hint"), ("c.gd", "GDL002", "hint")], "path string, rule string, severity string")
    own = settings.Settings(enabled={"GDL101": False}, severity={"GDL002": "error"}, exclude=["addons"])
    assert [tuple(r) for r in settings.apply(rows, own).collect()] == [("c.gd", "GDL002", "error")]


def test_registry_and_modules(spark):
    files = project.in_memory(spark, {"a.gd": "var a = 1  # x\nprint(a)\n"})
    registry = rules.Registry().add(rules.line_rule("A", "a", "print", "no print")).add(rules.line_rule("B", "b", "var", "no var", "error"))
    assert {(r.rule, r.line, r.severity) for r in registry.run(rules.Views(files)).collect()} == {("A", 2, "warning"), ("B", 1, "error")}
    assert registry.remove("A") and not registry.remove("A") and registry.get("A") is None and len(registry.of_category("text")) == 1
    assert rules.Registry().run(rules.Views(files)).count() == 0
    modules = rules.Modules()
    modules.register("hover", lambda: "plain")
    modules.register("hover", lambda: "better", priority=5)
    assert modules.call("hover") == "better"
    issues = spark.createDataFrame([("a.gd", 1, "A")], "path string, line int, rule string")
    assert rules.fixes(issues, {"A": lambda df: df.withColumn("fix", F.lit("drop"))}).first().fix == "drop"
    assert files.select(rules.formatted(F.col("text"), [F.upper, F.trim]).alias("t")).first().t.startswith("VAR A")


def test_reports_and_sinks(spark, tmp_path):
    files = project.in_memory(spark, {"a.gd": "func f():\n\tbreak\n", "d/b.gd": "var x = 1\n"})
    a = commands.Analysed(files)
    assert commands.check(a).first().code == 2 and commands.validate(a).where("rule = 'GD5001'").count() == 1
    assert commands.analyze(a, "error", 1).count() == 1
    report = commands.text_report(commands.validate(a)).first()
    assert report.path == "a.gd" and "GD5001 error" in report.report
    assert json.loads(commands.json_report(commands.validate(a)).first().value)["rule"] == "GD5001"
    dead = commands.dead_code_report(liveness.report(liveness.Evidence(a.model))).where("path = 'a.gd'").first().report
    assert dead.startswith("file: a.gd\n") and "func: f [FNC] [Strict]" in dead
    assert "MethodDeclaration f" in commands.print_tree(files).where("path = 'a.gd'").first().tree
    assert {r.kind for r in commands.list_all(a).collect()} == {"func", "var"}
    commands.write_edited(refactor.edited(files, refactor.plan(files, "add_type_annotations")), str(tmp_path))
    assert (tmp_path / "d/b.gd").read_text() == "var x: int = 1\n"


def test_result_cache(spark, tmp_path):
    cache = commands.ResultCache(spark, str(tmp_path))
    first = project.in_memory(spark, {"a.gd": "var a = 1\n", "b.gd": "var b = 1\n"})
    assert cache.stale(first).count() == 2 and cache.analysed(first).count() == 2 and cache.stale(first).count() == 0
    second = project.in_memory(spark, {"a.gd": "var a = 1\n", "b.gd": "var b = 2\n"})
    assert [r.path for r in cache.stale(second).collect()] == ["b.gd"] and cache.analysed(second).count() == 2
    memory = commands.MemoryCache()
    assert memory.get("x", lambda: second) is memory.get("x", lambda: first)
    memory.drop()


# --- streams and changes -------------------------------------------------------------------------------------


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("d", "2"), ("c", "9")], "path string, content_hash string")
    assert [tuple(r) for r in events.renamed_files(old, new).collect()] == [("b", "d")]
    deps = spark.createDataFrame([("x", "c"), ("y", "x")], "src string, dst string")
    changed = spark.createDataFrame([("c",)], "path string")
    assert {r.path for r in events.direct_dependents(changed, deps).collect()} == {"c", "x"}
    edits = spark.createDataFrame([("a", None, "disk"), ("a", 1, "one"), ("a", 2, "two"), ("b", None, "disk")], "path string, version int, text string")
    assert {(r.path, r.text) for r in events.newest_versions(edits).collect()} == {("a", "two"), ("b", "disk")}
    nodes = "path string, line int, type string, parent string, name string"
    before = spark.createDataFrame([("s", 1, "Node", None, "A"), ("s", 2, "Node", ".", "B")], nodes)
    after = spark.createDataFrame([("s", 1, "Node", None, "A"), ("s", 2, "Node", ".", "C")], nodes)
    assert [tuple(r) for r in events.renamed_nodes(before, after).collect()] == [("s", 2, "B", "C")]
    removed, added = events.changed_calls(before, after)
    assert removed.first().name == "B" and added.first().name == "C"


def test_watch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.gd").write_text("func f():\n\tbreak\n")
    report = lambda batch: diagnostics.alone(project.analysed(batch).select("path", F.inline("facts")))
    for n in (1, 2):
        events.watch(events.watched_files(spark, str(source)), report, str(out), str(tmp_path / "check")).awaitTermination()
        (source / f"b{n}.gd").write_text("func f():\n\tcontinue\n")
    assert sorted(r.code for r in spark.read.parquet(str(out)).collect()) == ["GD5001", "GD5002"]
