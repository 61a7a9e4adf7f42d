"""Lint rules that need the syntax tree of one script: style, habits and size.

``issues`` gives (rule, line, col, message) for every rule here; which of them
count is a join with the rule settings afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from quarry.sources import syntax
from quarry.sources.semantics import is_a, own_nodes
from quarry.sources.syntax import Syn


@dataclass(frozen=True)
class StyleOptions:
    """Limits of the rules; fixed values, the defaults of the linter that users know."""

    allowed_numbers: frozenset = frozenset({"0", "1", "-1", "2", "0.0", "1.0", "0.5", "-1.0", "0x0", "0x1", "0b0", "0b1"})
    max_branches: int = 12
    max_boolean: int = 5
    max_complexity: int = 10
    god_variables: int = 15
    god_methods: int = 20
    god_lines: int = 500
    empty_lines: int = 2


# Operators whose result has to be used.
PURE = {"Addition", "Subtraction", "Multiply", "Division", "Mod", "Power", "Equal", "NotEqual", "LessThan", "LessThanOrEqual", "MoreThan", "MoreThanOrEqual", "And", "And2", "Or", "Or2", "BitwiseAnd", "BitwiseOr", "Xor", "BitShiftLeft", "BitShiftRight"}
LITERALS = {"NumberExpression", "StringExpression", "BoolExpression", "ArrayInitializerExpression", "DictionaryInitializerExpression"}
CONSUMERS = {"add_child", "add_sibling", "call_deferred", "queue_free", "free"}
LOGICAL = {"And", "And2", "Or", "Or2"}
Issue = tuple[str, int, int, str]


def _methods(tree: Syn) -> Iterator[Syn]:
    return (n for n in tree.walk() if n.kind == "MethodDeclaration")


def _value(n: Syn) -> Syn | None:
    return next((c for c in n.children if c.kind.endswith("Expression")), None)


def _type(n: Syn) -> Syn | None:
    return next((c for c in n.children if c.kind.endswith("TypeNode")), None)


def naming(tree: Syn) -> Iterator[Issue]:
    for n in tree.walk():
        if n.kind == "VariableDeclaration" and "const" not in n.marks and not (n.value or "").startswith("_"):
            yield "GDL008", n.line, n.col, f"Consider prefixing private variable '{n.value}' with underscore"


def hints(tree: Syn) -> Iterator[Issue]:
    """Type hints that are suggested (GDL204) or required (GDL215)."""
    for n in tree.walk():
        if n.kind in ("VariableDeclaration", "VariableDeclarationStatement") and "const" not in n.marks and "inferred" not in n.marks and _type(n) is None:
            word = "Class variable" if n.kind == "VariableDeclaration" else "Local variable"
            yield "GDL204", n.line, n.col, f"{word} '{n.value}' has no type hint"
            yield "GDL215", n.line, n.col, f"{word} '{n.value}' requires type hint"
        elif n.kind == "ParameterDeclaration" and _type(n) is None:
            yield "GDL204", n.line, n.col, f"Parameter '{n.value}' has no type hint"
            yield "GDL215", n.line, n.col, f"Parameter '{n.value}' requires type hint"
        elif n.kind == "MethodDeclaration" and _type(n) is None:
            yield "GDL215", n.line, n.col, f"Function '{n.value}' requires return type hint"


def numbers(tree: Syn, options: StyleOptions) -> Iterator[Issue]:
    def visit(n: Syn, free: bool) -> Iterator[Issue]:
        if n.kind == "NumberExpression" and not free and n.value not in options.allowed_numbers:
            yield "GDL209", n.line, n.col, f"Magic number '{n.value}' should be a named constant"
        named = (n.kind in ("VariableDeclaration", "VariableDeclarationStatement") and "const" in n.marks) or n.kind == "EnumDeclaration"
        for k, c in enumerate(n.children):
            yield from visit(c, free or named or (n.kind == "IndexerExpression" and k == 1 and c.kind == "NumberExpression"))

    return visit(tree, False)


def collections(tree: Syn, found: list[syntax.Token]) -> Iterator[Issue]:
    """Repeated keys (GDL214) and commas at the end of collections over several lines (GDL302)."""
    for n in tree.walk():
        if n.kind == "DictionaryInitializerExpression":
            seen: set[str] = set()
            for pair in n.children[0].children:
                key = pair.children[0].text() if pair.children else ""
                key = key.strip("\"'") if pair.value == "=" or (pair.children and pair.children[0].kind == "StringExpression") else f"<{key}>"
                if pair.kind == "DictionaryKeyValueDeclaration" and (pair.children[0].kind in LITERALS or pair.value == "=") and key in seen:
                    yield "GDL214", pair.line, pair.col, f"Duplicate dictionary key '{key}'"
                seen.add(key)
    stack: list[tuple[syntax.Token, bool]] = []
    before: syntax.Token | None = None
    for t in found:
        if t.kind in ("space", "newline", "comment", "join"):
            continue
        if t.kind == "op" and t.text in "([{":
            call = t.text == "[" and before is not None and (before.kind in ("name", "string") and before.text not in ("in", "return", "and", "or", "not", "if", "else", "elif") or before.text in (")", "]"))
            stack.append((t, t.text != "(" and not call))
        elif t.kind == "op" and t.text in ")]}" and stack:
            opened, collection = stack.pop()
            if collection and opened.line != t.line and before is not None and before is not opened and before.text != ",":
                yield "GDL302", before.line, before.col, "Missing trailing comma in multiline " + ("array" if t.text == "]" else "dictionary")
        before = t


def unused(tree: Syn) -> Iterator[Issue]:
    """Statements that are only values."""
    for n in tree.walk():
        e = n.children[0] if n.kind == "ExpressionStatement" and n.children else None
        if e is None:
            continue
        if e.kind in LITERALS or (e.kind == "DualOperatorExpression" and e.value in PURE):
            yield "GDL224", e.line, e.col, "Expression result is not used"
        elif e.kind == "IdentifierExpression":
            yield "GDL224", e.line, e.col, f"Expression result of '{e.value}' is not used"


def sizes(tree: Syn, options: StyleOptions) -> Iterator[Issue]:
    for m in _methods(tree):
        inside = list(own_nodes(m))
        branches = sum(n.kind in ("IfBranch", "ElifBranch", "ElseBranch", "MatchCaseDeclaration", "ForStatement", "WhileStatement") for n in inside)
        if branches > options.max_branches:
            yield "GDL228", m.line, m.col, f"'{m.value}' has {branches} branches (max {options.max_branches})"
        complexity = 1 + sum(n.kind in ("IfBranch", "ElifBranch", "ForStatement", "WhileStatement", "MatchCaseDeclaration", "IfExpression") or (n.kind == "DualOperatorExpression" and n.value in LOGICAL) for n in inside)
        if complexity > options.max_complexity:
            yield "GDL208", m.line, m.col, f"'{m.value}' has cyclomatic complexity {complexity} (max {options.max_complexity})"
    for n in tree.walk():
        if n.kind in ("IfBranch", "ElifBranch", "WhileStatement") and n.children:
            count = sum(x.kind == "DualOperatorExpression" and x.value in LOGICAL for x in n.children[0].walk()) + 1
            if count > options.max_boolean:
                yield "GDL229", n.line, n.col, f"Condition has {count} boolean expressions (max {options.max_boolean})"
        members = n.children[0] if n.kind == "ClassDeclaration" and n.children else n.child("ClassMembersList") if n.kind == "InnerClassDeclaration" else None
        if members is not None:
            variables = sum(c.kind == "VariableDeclaration" and "const" not in c.marks for c in members.children)
            methods = sum(c.kind == "MethodDeclaration" for c in members.children)
            lines = n.end_line - n.line + 1
            for count, limit, what in ((variables, options.god_variables, "member variables"), (methods, options.god_methods, "methods"), (lines, options.god_lines, "lines")):
                if count > limit:
                    yield "GDL236", n.line, n.col, f"'{n.value or 'script'}' is a god class: too many {what} ({count} > {limit})"
                    break


def assignments(tree: Syn) -> Iterator[Issue]:
    """Values that are overwritten unread (GDL231) and variables read before they have one (GDL250)."""
    for m in _methods(tree):
        block = m.child("StatementsList")
        pending: dict[str, list[tuple[Syn, bool]]] = {}
        used: set[str] = set()
        empty: dict[str, bool] = {}

        def read(n: Syn | None) -> Iterator[Issue]:
            for x in n.walk() if n is not None else ():
                if x.kind == "IdentifierExpression":
                    used.add(x.value or "")
                    if x.value in pending:
                        pending[x.value][-1] = (pending[x.value][-1][0], True)
                    if empty.get(x.value or ""):
                        empty[x.value or ""] = False
                        yield "GDL250", x.line, x.col, f"Variable '{x.value}' may be used before initialization"

        for s in block.children if block else ():
            e = s.children[0] if s.kind == "ExpressionStatement" and s.children else None
            if s.kind == "VariableDeclarationStatement":
                value = _value(s)
                yield from read(value)
                if value is not None:
                    pending.setdefault(s.value or "", []).append((s, False))
                elif _type(s) is None:
                    empty[s.value or ""] = True
            elif e is not None and e.kind == "DualOperatorExpression" and (e.value == "Assignment" or (e.value or "").endswith("AndAssign")):
                target = e.children[0]
                yield from read(e.children[1] if len(e.children) > 1 else None)
                if target.kind != "IdentifierExpression" or e.value != "Assignment":
                    yield from read(target)
                if target.kind == "IdentifierExpression":
                    empty.pop(target.value or "", None)
                    pending.setdefault(target.value or "", []).append((target, False))
            else:
                yield from read(s)
                for x in s.walk():  # a branch may write it
                    if x.kind == "DualOperatorExpression" and x.value == "Assignment" and x.children[0].kind == "IdentifierExpression":
                        empty.pop(x.children[0].value or "", None)
        for name, written in pending.items():
            if name in used:
                for at, seen in written[:-1]:
                    if not seen:
                        yield "GDL231", at.line, at.col, f"Value assigned to '{name}' is never read before being overwritten"


def returns(tree: Syn) -> Iterator[Issue]:
    """Typed functions with an end that gives no value."""
    for m in _methods(tree):
        kind = _type(m)
        if kind is None or kind.value == "void" or "abstract" in m.marks:
            continue
        block = m.child("StatementsList")
        if not _all_return(block.children if block else []):
            yield "GDL235", m.line, m.col, f"'{m.value}' declares return type '{kind.value}' but not all code paths return a value"


def _all_return(statements: list[Syn]) -> bool:
    for s in statements:
        e = s.children[0] if s.kind == "ExpressionStatement" and s.children else None
        if e is not None and e.kind == "ReturnExpression" and e.children:
            return True
    last = statements[-1] if statements else None
    if last is None:
        return False
    body = lambda n: (n.child("StatementsList") or Syn("")).children
    if last.kind == "IfStatement":
        branches = [last.children[0], *(last.child("ElifBranchesList") or Syn("")).children]
        other = last.child("ElseBranch")
        return other is not None and all(_all_return(body(b)) for b in [*branches, other])
    if last.kind == "MatchStatement":
        cases = (last.child("MatchCasesList") or Syn("")).children
        default = any(p.kind == "MatchDefaultOperatorExpression" for c in cases for p in c.children[0].children)
        return default and all(_all_return(body(c)) for c in cases)
    return False


def loops(tree: Syn) -> Iterator[Issue]:
    """Texts put together in loops."""
    for n in tree.walk():
        if n.kind not in ("ForStatement", "WhileStatement"):
            continue
        for x in own_nodes(n):
            if x.kind != "DualOperatorExpression" or x.value != "AddAndAssign" or len(x.children) < 2:
                continue
            right = x.children[1]
            text = right.kind == "StringExpression" or (right.kind == "DualOperatorExpression" and any(y.kind == "StringExpression" for y in right.walk())) or (right.kind == "CallExpression" and right.children[0].value == "str")
            if text:
                yield "GDL242", x.line, x.col, "String concatenation in a loop"


def orphans(tree: Syn) -> Iterator[Issue]:
    """Nodes that a method makes and neither hands on nor frees."""
    for m in _methods(tree):
        made: dict[str, Syn] = {}
        gone: set[str] = set()
        for n in m.walk():
            if n.kind == "VariableDeclarationStatement":
                e = _value(n)
                new = e is not None and e.kind == "CallExpression" and e.children[0].kind == "MemberOperatorExpression"
                if new and (e.children[0].value == "instantiate" or (e.children[0].value == "new" and is_a(e.children[0].children[0].value or "", "Node"))):
                    made[n.value or ""] = n
            elif n.kind == "CallExpression":
                what = n.children[0]
                if (what.value or "") in CONSUMERS:
                    gone |= {a.value or "" for a in n.children[1].children[:1]} if len(n.children) > 1 else set()
                    if what.kind == "MemberOperatorExpression" and what.value in ("free", "queue_free"):
                        gone.add(what.children[0].value or "")
            elif n.kind == "ReturnExpression" and n.children:
                gone.add(n.children[0].value or "")
            elif n.kind == "DualOperatorExpression" and n.value == "Assignment" and len(n.children) > 1 and n.children[1].kind == "IdentifierExpression":
                gone.add(n.children[1].value or "")
        for name, at in made.items():
            if name not in gone:
                yield "GDL245", at.line, at.col, f"Node '{name}' is created but not added to the tree"


def comparisons(tree: Syn) -> Iterator[Issue]:
    for n in tree.walk():
        if n.kind == "DualOperatorExpression" and n.value in ("Equal", "NotEqual", "LessThan", "MoreThan", "LessThanOrEqual", "MoreThanOrEqual") and len(n.children) == 2 and n.children[0].text() == n.children[1].text() and n.children[0].kind not in LITERALS:
            yield "GDL213", n.line, n.col, f"Comparing '{n.children[0].text()}' with itself"


_BEFORE = re.compile(r"(\w)(==|!=|<=|>=|=)(?!=)")
_AFTER = re.compile(r"(==|!=|<=|>=|=)(?!=)(\w)")


def spacing(text: str, tree: Syn, options: StyleOptions) -> Iterator[Issue]:
    """Blanks around comparisons and assignments (GDL510), after commas (GDL511), lines between functions (GDL513)."""
    for k, line in enumerate(text.split("\n"), 1):
        if line.lstrip().startswith("#"):
            continue
        code = re.sub(r"'[^']*'", "''", re.sub(r'"[^"]*"', '""', line)).split("#")[0]
        if m := _BEFORE.search(code):
            yield "GDL510", k, m.start(), f"Missing space before '{m[2]}'"
        if m := _AFTER.search(code):
            yield "GDL510", k, m.start(), f"Missing space after '{m[1]}'"
        if m := re.search(r",(?=[^\s)\]}])", code):
            yield "GDL511", k, m.start(), "Missing space after ','"
    lines = text.split("\n")
    methods = [c for c in (tree.children[0].children if tree.children else []) if c.kind == "MethodDeclaration"]
    for before, now in zip(methods, methods[1:]):
        blank = most = 0
        for line in lines[before.end_line : now.line - 1]:
            blank = blank + 1 if not line.strip() else 0
            most = max(most, blank)
        if most < options.empty_lines:
            yield "GDL513", now.line, now.col, f"Expected {options.empty_lines} empty line(s) before function, found {most}"
        elif most > options.empty_lines + 1:
            yield "GDL513", now.line, now.col, f"Too many empty lines before function ({most}), expected {options.empty_lines}"


def issues(text: str | None, tree: Syn | None = None, options: StyleOptions = StyleOptions()) -> list[Issue]:
    """What all rules of this module find in a script, in order of lines."""
    text = text or ""
    tree = syntax.script(text) if tree is None else tree
    every = [naming(tree), hints(tree), numbers(tree, options), collections(tree, syntax.tokens(text)), unused(tree), sizes(tree, options), assignments(tree), returns(tree), loops(tree), orphans(tree), comparisons(tree), spacing(text, tree, options)]
    return sorted({i for found in every for i in found}, key=lambda i: (i[1], i[2], i[0], i[3]))
