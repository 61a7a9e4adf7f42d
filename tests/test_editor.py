"""An editor session over a small project."""

from __future__ import annotations

import pytest

from quarry.operators import editor
from quarry.sources import project

BASE = "class_name Base\nextends RefCounted\n\n## How many.\nvar count: int = 0\n\n\nfunc run(times: int) -> int:\n\tfor i in range(times):\n\t\tcount += i\n\treturn count\n"
CHILD = "extends Base\n\n\nfunc run(times: int) -> int:\n\treturn go(times)\n\n\nfunc go(n: int) -> int:\n\tif n > 1:\n\t\treturn run(n)\n\treturn n\n"
USER = "func use(b: Base) -> void:\n\tprint(b.run(1))\n"


@pytest.fixture(scope="module")
def session(spark):
    e = editor.Editor(spark, project.in_memory(spark, {"base.gd": BASE, "child.gd": CHILD, "user.gd": USER}))
    assert e.request("initialize")["capabilities"]["hoverProvider"] and e.request("initialized") is None
    return e


def at(uri, line, character, **more):
    return {"textDocument": {"uri": uri}, "position": {"line": line, "character": character}} | more


def test_lookups(session):
    assert session.request("textDocument/definition", at("child.gd", 4, 9)) == [{"at": "child.gd", "line": 7}]
    assert session.request("textDocument/hover", at("base.gd", 10, 10)) == {"name": "count", "type": "int", "doc": "How many."}
    assert {r["path"] for r in session.request("textDocument/references", at("base.gd", 7, 6))} == {"base.gd", "child.gd", "user.gd"}
    assert session.request("textDocument/implementation", at("base.gd", 7, 6)) == [{"path": "child.gd", "name": "run", "base_path": "base.gd"}]
    assert session.request("textDocument/typeDefinition", at("user.gd", 1, 7)) == [{"type": "Base", "at": "base.gd"}]
    assert [s["name"] for s in session.request("workspace/symbol", {"query": "COUNT"})] == ["count"]
    assert {s["name"] for s in session.request("textDocument/documentSymbol", at("base.gd", 0, 0))} == {"count", "run"}
    assert len(session.request("textDocument/documentHighlight", at("base.gd", 10, 10))) >= 2
    assert session.request("textDocument/signatureHelp", at("child.gd", 4, 11))["parameters"] == "int"
    assert {c["name"] for c in session.request("textDocument/completion", at("base.gd", 0, 0))} == {"count", "run"}
    assert session.request("textDocument/foldingRange", at("base.gd", 0, 0))
    assert session.request("textDocument/semanticTokens/full", at("base.gd", 0, 0))
    assert [h["name"] for h in session.request("textDocument/inlayHint", at("base.gd", 0, 0))] == ["i"]
    assert {lens["name"]: lens["references"] for lens in session.request("textDocument/codeLens", at("base.gd", 0, 0))}["count"] >= 2


def test_calls(session):
    item = session.request("textDocument/prepareCallHierarchy", at("child.gd", 7, 6))[0]
    assert item == {"name": "go", "at": "child.gd"}
    assert [c["method"] for c in session.request("callHierarchy/incomingCalls", {"item": item})] == ["run"]
    assert [c["target"] for c in session.request("callHierarchy/outgoingCalls", {"item": item})] == ["run"]


def test_edits(session):
    assert session.request("textDocument/prepareRename", at("base.gd", 4, 5)) == {"placeholder": "count"}
    plan = session.request("textDocument/rename", at("base.gd", 4, 5, newName="total"))
    assert set(plan) == {"base.gd"} and all(e["newText"] == "total" for e in plan["base.gd"])
    assert session.request("textDocument/formatting", at("base.gd", 0, 0)) == BASE
    line = {"start": {"line": 8, "character": 0}}
    assert "invert_condition" in session.request("textDocument/codeAction", {"textDocument": {"uri": "child.gd"}, "range": line})


def test_documents(spark):
    e = editor.Editor(spark, project.in_memory(spark, {"a.gd": "var a = 1\n"}))
    e.request("initialize")
    assert e.request("textDocument/didOpen", {"textDocument": {"uri": "a.gd", "version": 1, "text": "func f():\n\tbreak\n"}})[0]["rule"] == "GD5001"
    change = {"textDocument": {"uri": "a.gd", "version": 2}, "contentChanges": [{"range": {"start": {"line": 1, "character": 1}, "end": {"line": 1, "character": 6}}, "text": "pass"}]}
    assert e.request("textDocument/didChange", change) == [] and e.text_of("a.gd") == "func f():\n\tpass\n"
    assert e.request("textDocument/didChange", change | {"textDocument": {"uri": "a.gd", "version": 1}}) is None
    assert e.request("workspace/executeCommand", {"command": "snippet", "arguments": ["a.gd", 1, "signal"]}).startswith("signal name()")
    assert e.request("textDocument/didSave", {"textDocument": {"uri": "a.gd"}}) == []
    e.request("$/setTrace", {"value": "verbose"}), e.request("workspace/didChangeConfiguration", {"settings": {"x": 1}})
    assert e.trace == "verbose" and e.settings == {"x": 1}
    e.request("textDocument/didClose", {"textDocument": {"uri": "a.gd"}})
    assert e.text_of("a.gd") == "var a = 1\n"
    e.request("shutdown")
    with pytest.raises(RuntimeError):
        e.request("textDocument/hover")
    assert e.request("exit") == 0


def test_commands(session):
    for name in ("analyze", "check", "validate", "list", "dead-code", "deps", "extract-style", "parse", "symbols", "lint", "stats", "metrics", "type-coverage", "format", "list classes", "list signals", "list methods", "list variables", "list enums", "list exports", "list engine-callbacks"):
        assert isinstance(session.request("workspace/executeCommand", {"command": name}), list), name
    assert session.request("workspace/executeCommand", {"command": "find-refs", "arguments": ["run"]})
    assert session.request("workspace/executeCommand", {"command": "rename", "arguments": ["count", "n"]})
    assert set(editor.METHODS.values()) >= set(editor.CAPABILITIES)
