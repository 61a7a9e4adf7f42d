"""The parser and the code analyses on small scripts."""

from __future__ import annotations

import pytest

from quarry.functions.patterns import name_glob_regex, path_glob_regex
from quarry.operators import code, duplicates, graph
from quarry.plans.code_oracles import ORACLES
from quarry.plans.code_queries import QUERIES, Project, sample_project
from quarry.sources import project, sample
from quarry.sources.script_parser import parse


@pytest.fixture(scope="module")
def sampled(spark):
    return sample_project(spark)


def of(spark, scripts, scenes=None):
    return Project(project.in_memory(spark, scripts), project.in_memory(spark, scenes or {"x.tscn": ""}))


def kinds(text):
    return [n["kind"] for n in parse(text)[0]]


def test_parser_nests_blocks():
    nodes, _ = parse("func f(a, b: int = 1) -> int:\n\tfor i in a:\n\t\tif i: return 1\n\t\telse:\n\t\t\tpass\n\treturn 2\n")
    assert [(n["kind"], n["depth"], n["method_id"]) for n in nodes] == [("file", 0, None), ("func", 0, None), ("for", 0, 1), ("if", 1, 1), ("return", 2, 1), ("else", 1, 1), ("pass", 2, 1), ("return", 0, 1)]
    assert nodes[1]["params"] == [{"name": "a", "type": None, "has_default": False}, {"name": "b", "type": "int", "has_default": True}]
    assert nodes[1]["last_id"] == 7 and nodes[1]["end_line"] == 6


@pytest.mark.parametrize("text", ["", "\n\n", "func", "if :", "((((", "var", "enum {", '"""open', "match x:\n\t1:", "@export", "x = = 3", "class A:\n\tclass B:\n\t\tpass", "\\\n", "func f(:\n\tpass", "𝔘 = 1"])
def test_parser_never_fails(text):
    assert parse(text)[0][0]["kind"] == "file"


def test_brackets_and_joins_continue_lines():
    assert kinds("var a = [1,\n2,\n3]\nvar b = 1 + \\\n2\n") == ["file", "var", "var"]


def test_uses_have_roles():
    _, uses = parse("func f():\n\tself.x += g(1, 2)\n\temit_signal(\"s\")\n")
    assert {(u["name"], u["role"], u["n_args"]) for u in uses} >= {("x", "write", 0), ("x", "read", 0), ("g", "call", 2), ("emit_signal", "call", 1)}


def test_all_code_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)  # and are held against it in test_driver_queries


def test_metrics(spark, sampled):
    rows = {(r.path, r.method): r for r in code.method_metrics(sampled.nodes, sampled.uses).collect()}
    step = rows["core/base.gd", "step"]
    assert (step.cyclomatic, step.nesting, step.parameters, step.locals, step.returns, step.loc) == (7, 3, 2, 1, 1, 9)
    assert rows["core/base.gd", "pick"].cyclomatic == 3
    files = code.file_metrics(sampled.files, code.method_metrics(sampled.nodes, sampled.uses))
    empty = code.project_metrics(files.where("path = 'none'")).first()
    assert empty.files == 0 and empty["index"] == 100.0


def test_liveness(spark, sampled):
    dead = {(r.path, r.name): (r.reason, r.confidence) for r in code.dead_code(sampled.nodes, sampled.uses, project.scene_connections(sampled.scenes)).collect()}
    assert dead["core/base.gd", "_never_called"] == ("FNC", "Strict")
    assert dead["util/helper.gd", "custom_call"] == ("FDT", "Potential")
    assert ("core/base.gd", "pick") not in dead  # a scene connects it
    assert ("core/base.gd", "step") not in dead  # an override calls it
    assert ("core/base.gd", "_ready") not in dead  # the engine calls it
    assert ("util/helper.gd", "twice") not in dead
    assert dead["core/base.gd", "never_sent"] == ("FPA", "Potential")


def test_unreachable(spark):
    p = of(spark, {"a.gd": "func f():\n\treturn 1\n\tprint(2)\nfunc g():\n\tif a:\n\t\tbreak\n\t\tx = 1\n"})
    assert [(r.line, r.kind) for r in code.unreachable(p.nodes).orderBy("line").collect()] == [(3, "expr"), (7, "assign")]


def test_lint_and_suppression(spark, sampled):
    issues = code.lint(sampled.files, sampled.nodes, sampled.uses)
    found = {(r.path, r.line, r.rule) for r in issues.collect()}
    assert ("core/base.gd", 8, "GDL004") in found and ("util/other.gd", 6, "GDL502") in found and ("core/child.gd", 15, "GDL241") in found
    left = {(r.path, r.line, r.rule) for r in code.unsuppressed(issues, code.suppressions(sampled.files, sampled.nodes)).collect()}
    gone = found - left
    assert gone == {("core/child.gd", 18, "GDL238"), ("util/other.gd", 4, "GDL201")}
    assert ("util/other.gd", 6, "GDL201") in left


def test_dependencies_and_cycles(spark):
    p = of(spark, {"a.gd": 'const B = preload("res://b.gd")\n', "b.gd": 'const C = preload("res://c.gd")\n', "c.gd": 'var a = load("res://a.gd")\n', "d.gd": 'var a = load("res://a.gd")\n', "e.gd": ""})
    report = {r.path: r for r in code.dependency_report(code.dependencies(p.nodes, p.uses)).collect()}
    assert [report[f"{x}.gd"].in_cycle for x in "abcd"] == [True, True, True, False]
    assert report["a.gd"].fan_in == 4 and report["d.gd"].fan_out == 1 and "e.gd" not in report


def test_graph_kit(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y"), ("x", "z"), ("y", "z")], "src string, dst string")
    assert {r.node for r in graph.in_cycle(edges).collect()} == {"a", "b", "c"}
    assert {(r.node, r.component) for r in graph.strong_components(edges).collect()} >= {("c", "a"), ("d", "d"), ("z", "z")}
    assert {(r.node, r.level) for r in graph.levels(edges).collect()} == {("d", 0), ("x", 0), ("y", 1), ("z", 2)}


def test_scenes_and_settings(spark):
    nodes = {r.node_path: r for r in project.scene_nodes(project.in_memory(spark, sample.SCENES)).where("path = 'main.tscn'").collect()}
    assert nodes["."].script == "res://core/child.gd" and nodes["."].groups == ["actors", "all"]
    assert nodes["Timer/Sub"].instance == "res://sub.tscn" and nodes["Timer/Sub"].is_unique
    loads = {r.name: (r.target, r.singleton, r.kind) for r in project.autoloads(project.in_memory(spark, sample.SETTINGS)).collect()}
    assert loads == {"Global": ("res://core/base.gd", True, "script"), "Fade": ("res://sub.tscn", False, "scene")}
    assert project.engine_version(project.in_memory(spark, sample.SETTINGS)).first().version == "4.5"


def test_scan_reads_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.gd").write_text("var a = 1\n")
    (tmp_path / "b.txt").write_text("no")
    assert [(r.path, r.text) for r in project.scan(spark, str(tmp_path), "*.gd").collect()] == [("sub/a.gd", "var a = 1\n")]


def test_globs():
    import re

    assert re.match(path_glob_regex("a/**"), "a/b/c") and re.match(path_glob_regex("**/x"), "x") and re.match(path_glob_regex("**/x"), "q/x")
    assert re.match(path_glob_regex("addons"), "addons/z.gd") and not re.match(path_glob_regex("addons"), "addons2/z.gd")
    assert not re.match(path_glob_regex("a/*"), "a/b/c") and re.match(name_glob_regex("*Node?"), "MyNode2")


def test_similar_blocks(spark):
    words = "the quick brown fox jumps over the lazy dog and runs away from all of it".split()
    rows = spark.createDataFrame([(1, words), (2, [*words[:-1], "that"]), (3, "nothing like it in any way at all".split()), (4, ["one"])], "id long, t array<string>")
    assert [(r.a, r.b, round(r.score, 3)) for r in duplicates.similar_blocks(rows, "id", "t").collect()] == [(1, 2, 0.938)]
    assert duplicates.lcs_length(list("abcde"), list("xbxd")) == 2


def test_similar_blocks_are_those_of_brute_force(spark, tables):
    import random
    import re

    rng = random.Random(4)
    lists = [rng.choices("abcdefgh", k=rng.randint(0, 6)) for _ in range(60)]
    for _ in range(12):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 80))]
        lists += [base, [f"x{k}" if k % 5 == 4 else w for k, w in enumerate(base)], [w for k, w in enumerate(base) if k % 6], [v for k, w in enumerate(base) for v in ([w, "and"] if k % 4 == 3 else [w])]]
    lists += [["a"] * 30, ["a"] * 28, list("ab"), list("axb")]
    lists += [re.split(r"\s+", r.text.lower().strip()) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    rows = list(enumerate(lists))
    want = set()
    for i, a in rows:
        for j, b in rows[i + 1 :]:
            score = 2 * duplicates.lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0
            if 2 * min(len(a), len(b)) >= 0.79 * (len(a) + len(b)) and score >= 0.8:
                want.add((i, j, round(score, 6)))
    found = duplicates.similar_blocks(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t").collect()
    assert len(found) == len(want) > 50 and {(r.a, r.b, round(r.score, 6)) for r in found} == want


def test_similar_blocks_in_many_blocks_and_tiles(spark, monkeypatch):
    import random

    monkeypatch.setattr(duplicates, "_BLOCK_TOKENS", 600)
    monkeypatch.setattr(duplicates, "_TILE", 8)
    rng = random.Random(8)
    lists = [None, [], [], ["a"], ["a"], ["a", None], ["a", "b"]]
    for n in (5, 12, 40, 41, 90, 130):
        base = [f"w{rng.randint(0, 400)}" for _ in range(n)]
        lists += [base, base, *([w if rng.random() < 0.88 else f"x{rng.randint(0, 9)}" for w in base] for _ in range(20))]
        lists += [[v for k, w in enumerate(base) for v in ([w, "and"] if k % 3 == 2 else [w])]]
    rows = [(f"k{i:03}", t) for i, t in enumerate(lists)] + [(None, ["a"])]
    want = {}
    for i, (a, x) in enumerate(rows[:-1]):
        for b, y in rows[i + 1 : -1]:
            if x is not None and y is not None and (score := 2 * duplicates.lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0) >= 0.8:
                want[a, b] = round(score, 6)
    frame = spark.createDataFrame(rows, "id string, t array<string>").repartition(5)
    found = duplicates.similar_blocks(frame, "id", "t").collect()
    assert len(found) == len(want) > 500 and {(r.a, r.b): round(r.score, 6) for r in found} == want
    least = {tuple(t): k for k, t in reversed(rows[:-1]) if t is not None}.values()
    found = duplicates.similar_blocks(frame, "id", "t", distinct=True).collect()
    assert len(found) < len(want) and {(r.a, r.b): round(r.score, 6) for r in found} == {p: s for p, s in want.items() if {*p} <= {*least}}


def test_similar_blocks_of_a_key_with_several_lists(spark):
    one, two = ([f"{c}{i}" for i in range(30)] for c in "xy")
    rows = [(1, one), (1, two), (1, two), (2, [*one, "z"]), (3, [*two, "z"]), (4, [None, "\n", "[", '"', "é"]), (5, [None, "\n", "[", '"', "é", "?"])]
    found = duplicates.similar_blocks(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", distinct=True).collect()
    assert sorted((r.a, r.b, round(r.score, 3)) for r in found) == [(1, 2, 0.984), (1, 3, 0.984), (4, 5, 0.909)]
    rows = spark.createDataFrame([(2, []), (1, []), (3, ["a", None]), (4, ["a"]), (5, None), (None, ["a"]), (6, ["a", None]), (6, ["a", None])], "id long, t array<string>")
    assert sorted(map(tuple, duplicates.block_classes(rows, "id", "t").collect())) == [(1, 1), (2, 1), (3, 3), (4, 4), (6, 3)]


def test_lcs_is_the_table_s():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert duplicates.lcs_length(a, b) == table[-1][-1]


def test_liveness_looks_inside_methods(spark):
    """A local of one method isn't used by its name in another, and a method that calls itself has no caller."""
    p = of(spark, {"a.gd": "func a():\n\tvar x = 1\n\n\nfunc b(x):\n\tprint(x)\n\n\nfunc again(n):\n\tagain(n)\n"})
    rows = {(r.kind, r.name) for r in code.dead_code(p.nodes, p.uses).collect()}
    assert ("local", "x") in rows and ("param", "x") not in rows and ("func", "again") in rows
