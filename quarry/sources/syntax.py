"""The whole syntax tree of a script: declarations, statements, expressions, types and lists.

``script`` parses a file, ``expression``, ``statements`` and ``type_node`` parse
parts.  Bad syntax never fails: what no rule takes becomes an ``InvalidToken``
leaf.  ``rows`` flattens a tree into interval-encoded rows (``pre``, ``last``),
so a subtree is a range, an ancestor test is two comparisons, a walk is an order
by ``pre``, and the tokens of a node are the leaves in its range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from quarry.sources.script_parser import _Line, Token, logical_lines, tokens

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
# Names of the language's operators by symbol.
DUAL = {
    ">": "MoreThan", "<": "LessThan", "=": "Assignment", "-": "Subtraction", "/": "Division", "*": "Multiply", "+": "Addition", "+=": "AddAndAssign", "!=": "NotEqual", "*=": "MultiplyAndAssign",
    "-=": "SubtractAndAssign", "<=": "LessThanOrEqual", ">=": "MoreThanOrEqual", "==": "Equal", "/=": "DivideAndAssign", "or": "Or", "||": "Or2", "and": "And", "&&": "And2", "is": "Is", "as": "As",
    "%=": "ModAndAssign", "<<": "BitShiftLeft", ">>": "BitShiftRight", "%": "Mod", "^": "Xor", "|": "BitwiseOr", "&": "BitwiseAnd", "in": "In", "&=": "BitwiseAndAndAssign", "|=": "BitwiseOrAndAssign",
    "**": "Power", "**=": "PowerAndAssign", "<<=": "BitShiftLeftAndAssign", ">>=": "BitShiftRightAndAssign", "^=": "XorAndAssign",
}
SINGLE = {"-": "Negate", "not": "Not", "!": "Not2", "~": "BitwiseNegate"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>="}
#: How tightly operators bind; ``as`` least.
BINDS = {"as": 1, "or": 3, "||": 3, "and": 4, "&&": 4, "in": 6, "not in": 6} | dict.fromkeys(["==", "!=", "<", ">", "<=", ">="], 7) | {"|": 8, "^": 9, "&": 10, "<<": 11, ">>": 11, "+": 12, "-": 12, "*": 13, "/": 13, "%": 13, "**": 15, "is": 16, "is not": 16}
TERNARY, NOT, SIGN = 2, 5, 14


@dataclass
class Syn:
    """A node: ``value`` is its name, operator or literal; ``marks`` are annotations and modifiers."""

    kind: str
    value: str | None = None
    children: list["Syn"] = field(default_factory=list)
    line: int = 0
    col: int = 0
    end_line: int = 0
    end_col: int = 0
    marks: list[str] = field(default_factory=list)

    def child(self, kind: str) -> "Syn | None":
        return next((c for c in self.children if c.kind == kind), None)

    def walk(self) -> Iterator["Syn"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def text(self) -> str:
        """The tree written back as code on one line."""
        return written(self)


def _leaf(kind: str, t: Token, value: str | None = None) -> Syn:
    lines = t.text.count("\n")
    return Syn(kind, t.text if value is None else value, [], t.line, t.col, t.line + lines, len(t.text) - t.text.rfind("\n") - 1 if lines else t.col + len(t.text))


def _span(node: Syn, *parts: Syn | Token | None) -> Syn:
    """Stretch a node over parts."""
    for p in parts:
        if p is None:
            continue
        p = _leaf("", p) if isinstance(p, Token) else p
        if not p.line:
            continue
        if not node.line or (p.line, p.col) < (node.line, node.col):
            node.line, node.col = p.line, p.col
        if (p.end_line, p.end_col) > (node.end_line, node.end_col):
            node.end_line, node.end_col = p.end_line, p.end_col
    return node


def _make(kind: str, value: str | None, children: list[Syn | None], *also: Token | None) -> Syn:
    own = [c for c in children if c is not None]
    return _span(Syn(kind, value, own), *own, *also)


def _missing(after: Token) -> Syn:
    """What stands for an operand that isn't there."""
    end = after.col + len(after.text)
    return Syn("InvalidToken", "", [], after.line, end, after.line, end)


class _Expressions:
    """Precedence climbing over the tokens of one logical line."""

    def __init__(self, ts: list[Token], depth: int = 0):
        self.ts, self.at, self.depth = ts, 0, depth

    def peek(self, ahead: int = 0) -> str:
        return self.ts[self.at + ahead].text if self.at + ahead < len(self.ts) else ""

    def next(self) -> Token:
        self.at += 1
        return self.ts[self.at - 1]

    def done(self) -> bool:
        return self.at >= len(self.ts)

    def rest(self, node: Syn | None) -> Syn:
        """The node, with what is left over as invalid tokens."""
        bad = [_leaf("InvalidToken", t) for t in self.ts[self.at :]]
        self.at = len(self.ts)
        if not bad:
            return node or Syn("InvalidToken", "")
        return _make("InvalidExpression", None, [node, *bad])

    def binary(self, least: int = 0) -> Syn | None:
        left = self.unary(least)
        while left is not None and not self.done():
            op, t = self.peek(), self.ts[self.at]
            if t.kind not in ("op", "name"):
                break
            if op == "not" and self.peek(1) == "in":
                op = "not in"
            elif op == "is" and self.peek(1) == "not":
                op = "is not"
            if op == "if" and TERNARY >= least:
                self.next()
                condition = self.binary(TERNARY + 1)
                other = None
                if self.peek() == "else":
                    self.next()
                    other = self.binary(TERNARY)
                left = _make("IfExpression", None, [left, condition, other], t)
                continue
            strength = BINDS.get(op)
            if strength is None or strength < least:
                break
            self.next()
            if " " in op:
                self.next()
            if op in ("is", "is not", "as"):
                right: Syn | None = self.type()
            else:
                right = self.binary(strength if op == "**" else strength + 1)
            name = DUAL[op.replace("is not", "is").replace("not in", "in")]
            left = _make("DualOperatorExpression", name, [left, right or _missing(t)], t)
            if " " in op:
                left.marks.append("not")
        return left

    def unary(self, least: int = 0) -> Syn | None:
        if self.done():
            return None
        t, op = self.ts[self.at], self.peek()
        if op in ("not", "!"):
            self.next()
            return _make("SingleOperatorExpression", SINGLE[op], [self.binary(NOT if op == "not" else SIGN) or _missing(t)], t)
        if op in ("-", "~", "+") and t.kind == "op":
            self.next()
            inner = self.binary(SIGN) or _missing(t)
            return inner if op == "+" else _make("SingleOperatorExpression", SINGLE[op], [inner], t)
        if op in ("await", "yield") and t.kind == "name":
            self.next()
            if op == "yield":
                return _make("YieldExpression", None, [self.arguments() if self.peek() == "(" else None], t)
            return _make("AwaitExpression", None, [self.binary(SIGN)], t)
        return self.postfix(self.primary())

    def postfix(self, node: Syn | None) -> Syn | None:
        while node is not None and not self.done():
            op, t = self.peek(), self.ts[self.at]
            if op == "." and self.at + 1 < len(self.ts) and self.ts[self.at + 1].kind in ("name",):
                self.next()
                member = self.next()
                node = _make("MemberOperatorExpression", member.text, [node, _leaf("Identifier", member)], t)
            elif op == "(":
                node = _make("CallExpression", None, [node, self.arguments()])
            elif op == "[":
                self.next()
                inner = self.binary()
                end = self.next() if self.peek() == "]" else None
                node = _make("IndexerExpression", None, [node, inner], t, end)
            else:
                break
        return node

    def arguments(self) -> Syn:
        opened = self.next()
        items: list[Syn | None] = []
        while not self.done() and self.peek() != ")":
            if self.peek() == ",":
                self.next()
                continue
            before = self.at
            items.append(self.binary())
            if self.at == before:
                items.append(_leaf("InvalidToken", self.next()))
        end = self.next() if self.peek() == ")" else None
        return _make("ExpressionsList", None, items, opened, end)

    def primary(self) -> Syn | None:
        t = self.ts[self.at]
        if t.kind == "number":
            return _leaf("NumberExpression", self.next())
        if t.kind == "string":
            self.next()
            prefix = re.match(r"[&^]?r?", t.text)[0]
            kind = {"&": "StringNameExpression", "^": "NodePathExpression", "r": "RawStringExpression"}.get(prefix, "StringExpression")
            node = _leaf(kind, t)
            if t.text.lstrip("&^r").startswith(('"""', "'''")):
                node.children = [_leaf("TripleDoubleQuotasStringNode", t)]
            else:
                node.children = [_leaf("StringPartsList", t)]
            return node
        if t.kind == "node":
            self.next()
            if t.text.startswith("%"):
                return _leaf("GetUniqueNodeExpression", t)
            node = _leaf("GetNodeExpression", t)
            node.children = [_leaf("PathList", t, t.text[1:].strip('"'))]
            return node
        if t.text == "(":
            self.next()
            inner = self.binary()
            while not self.done() and self.peek() != ")":
                self.next()
            end = self.next() if self.peek() == ")" else None
            return _make("BracketExpression", None, [inner], t, end)
        if t.text == "[":
            self.next()
            items: list[Syn | None] = []
            while not self.done() and self.peek() != "]":
                if self.peek() == ",":
                    self.next()
                    continue
                before = self.at
                items.append(self.rest_part() if self.peek() == ".." else self.binary())
                if self.at == before:
                    items.append(_leaf("InvalidToken", self.next()))
            end = self.next() if self.peek() == "]" else None
            return _make("ArrayInitializerExpression", None, [_make("ExpressionsList", None, items, t, end)], t, end)
        if t.text == "{":
            return self.dictionary()
        if t.kind == "name":
            if t.text == "func":
                return self.lambda_()
            self.next()
            if t.text in ("true", "false"):
                return _leaf("BoolExpression", t)
            if t.text == "pass":
                return _leaf("PassExpression", t)
            if t.text == "var":  # a binding in a match pattern
                return _leaf("MatchCaseVariableExpression", self.next() if not self.done() and self.ts[self.at].kind == "name" else t)
            return _leaf("IdentifierExpression", t)
        if t.text == "..":
            return self.rest_part()
        return None

    def rest_part(self) -> Syn:
        return _leaf("RestExpression", self.next())

    def dictionary(self) -> Syn:
        t = self.next()
        items: list[Syn | None] = []
        while not self.done() and self.peek() != "}":
            if self.peek() == ",":
                self.next()
                continue
            before = self.at
            if self.peek() == "..":
                items.append(self.rest_part())
                continue
            key = self.binary()
            value = None
            if self.peek() in (":", "="):
                mark = self.next()
                value = self.binary()
                items.append(_make("DictionaryKeyValueDeclaration", mark.text, [key, value]))
            elif key is not None:
                items.append(_make("DictionaryKeyValueDeclaration", None, [key]))
            if self.at == before:
                items.append(_leaf("InvalidToken", self.next()))
        end = self.next() if self.peek() == "}" else None
        return _make("DictionaryInitializerExpression", None, [_make("DictionaryKeyValueDeclarationList", None, items, t, end)], t, end)

    def lambda_(self) -> Syn:
        begin = self.next()
        name = self.next() if not self.done() and self.ts[self.at].kind == "name" else None
        params, kind = self.parameters(), None
        if self.peek() == "->":
            self.next()
            kind = self.type()
        body: Syn | None = None
        if self.peek() == ":":
            colon = self.next()
            took, nested = [], 0
            while not self.done():
                x = self.peek()
                if nested == 0 and (x in _CLOSE or x == ","):
                    break
                nested += (x in _OPEN) - (x in _CLOSE)
                took.append(self.next())
            body = Parser.body(took, colon.line, self.depth + 1)
        return _make("MethodExpression", name.text if name else None, [params, kind, body], begin)

    def parameters(self) -> Syn | None:
        if self.peek() != "(":
            return None
        opened = self.next()
        items: list[Syn | None] = []
        while not self.done() and self.peek() != ")":
            t = self.next()
            if t.kind != "name":
                continue
            kind = value = None
            if self.peek() == ":" or self.peek() == ":=":
                mark = self.next()
                if mark.text == ":" and self.peek() != "=":
                    kind = self.type()
            if self.peek() == "=" or (not self.done() and self.ts[self.at - 1].text == ":="):
                if self.peek() == "=":
                    self.next()
                value = self.binary()
            items.append(_make("ParameterDeclaration", t.text, [kind, value], t))
        end = self.next() if self.peek() == ")" else None
        return _make("ParametersList", None, items, opened, end)

    def type(self) -> Syn | None:
        """A type annotation: a name, a path of names, or a container with element types."""
        if self.done():
            return None
        t = self.ts[self.at]
        if t.kind == "string":
            return _leaf("StringTypeNode", self.next())
        if t.kind != "name":
            return None
        self.next()
        node = _leaf("SingleTypeNode", t)
        while self.peek() == "." and self.at + 1 < len(self.ts) and self.ts[self.at + 1].kind == "name":
            self.next()
            part = self.next()
            node = _make("SubTypeNode", f"{node.value}.{part.text}", [node], part)
        if self.peek() == "[":
            self.next()
            inner: list[Syn | None] = []
            while not self.done() and self.peek() != "]":
                if self.peek() == ",":
                    self.next()
                    continue
                before = self.at
                inner.append(self.type())
                if self.at == before:
                    inner.append(_leaf("InvalidToken", self.next()))
            end = self.next() if self.peek() == "]" else None
            kind = "DictionaryTypeNode" if t.text == "Dictionary" else "ArrayTypeNode"
            node = _make(kind, f"{node.value}[{', '.join(x.value or '' for x in inner if x)}]", inner, t, end)
        return node


def _cut(ts: list[Token], at: set[str]) -> int:
    nested = 0
    for i, t in enumerate(ts):
        if nested == 0 and t.text in at and t.kind in ("op", "name"):
            return i
        nested += (t.text in _OPEN) - (t.text in _CLOSE)
    return -1


def _parts(ts: list[Token], at: str) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    nested = 0
    for t in ts:
        nested += (t.text in _OPEN) - (t.text in _CLOSE)
        if nested == 0 and t.text == at:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def parse_tokens(ts: list[Token], depth: int = 0) -> Syn | None:
    if not ts:
        return None
    p = _Expressions(ts, depth)
    return p.rest(p.binary())


class Parser:
    """Statements and members by indentation."""

    #: Blocks nested deeper than this are not followed.
    DEEPEST = 200

    def __init__(self, lines: list[_Line], depth: int = 0):
        self.lines, self.at, self.depth = lines, 0, depth
        if depth > self.DEEPEST:
            raise RecursionError("blocks are nested too deep")

    @classmethod
    def body(cls, ts: list[Token], colon_line: int, depth: int) -> Syn:
        """The body of a lambda: lines indented by their first token's column."""
        lines: list[_Line] = []
        nested = 0
        for t in ts:
            if not lines or (nested == 0 and t.line > last):
                lines.append(_Line(t.col, []))
            lines[-1].tokens.append(t)
            nested += (t.text in _OPEN) - (t.text in _CLOSE)
            last = t.line + t.text.count("\n")
        if len(lines) > 1 and ts[0].line == colon_line:  # begins on the head's line
            lines[0].indent = lines[1].indent
        return cls(lines, depth).statements(-1)

    def statements(self, indent: int, member: bool = False) -> Syn:
        """Statements (or members) deeper than ``indent``."""
        out: list[Syn] = []
        marks: list[tuple[Syn, str]] = []
        while self.at < len(self.lines) and self.lines[self.at].indent > indent:
            line = self.lines[self.at]
            self.at += 1
            ts = line.tokens
            while len(ts) > 1 and ts[0].text == "@":
                mark, ts = self.attribute(ts)
                marks.append((mark, mark.value or ""))
            if not ts:
                continue
            made = self.member(ts, line.indent) if member else None
            if made is None:
                made = self.statement(ts, line.indent, out)
            for node in made:
                node.marks = [m for _, m in marks] + node.marks
                node.children[:0] = [m for m, _ in marks]
            out.extend(made)
            marks = []
        out.extend(m for m, _ in marks)
        return _make("ClassMembersList" if member else "StatementsList", None, out)

    def attribute(self, ts: list[Token]) -> tuple[Syn, list[Token]]:
        name, rest = ts[1], ts[2:]
        kind = "ToolAttribute" if name.text == "tool" else "CustomAttribute"
        arguments = None
        if rest and rest[0].text == "(":
            p = _Expressions(rest, self.depth)
            arguments = p.arguments()
            rest = rest[p.at :]
        return _make(kind, name.text, [arguments], ts[0], name), rest

    def block(self, rest: list[Token], indent: int, member: bool = False) -> Syn:
        """What follows a colon: on the line itself, or indented below."""
        if rest:
            inner = Parser([_Line(indent + 1, p) for p in _parts(rest, ";")], self.depth + 1)
        else:
            end = self.at
            while end < len(self.lines) and self.lines[end].indent > indent:
                end += 1
            inner = Parser(self.lines[self.at : end], self.depth + 1)
            self.at = end
        return inner.statements(indent, member)

    def member(self, ts: list[Token], indent: int) -> list[Syn] | None:
        head = ts[0].text
        marks: list[str] = []
        while head == "static" and len(ts) > 1:
            marks, ts = ["static"], ts[1:]
            head = ts[0].text
        if head == "class_name" and len(ts) > 1:
            out = [_make("ClassNameAttribute", ts[1].text, [_leaf("Identifier", ts[1])], ts[0])]
            if len(ts) > 3 and ts[2].text == "extends":
                out += self.member(ts[2:], indent) or []
            return out
        if head == "extends" and len(ts) > 1:
            p = _Expressions(ts[1:], self.depth)
            kind = p.type()
            return [_make("ExtendsAttribute", kind.value if kind else None, [kind], ts[0])]
        if head == "tool" and len(ts) == 1:
            return [_leaf("ToolAttribute", ts[0])]
        if head == "signal" and len(ts) > 1:
            p = _Expressions(ts[2:], self.depth)
            return [_make("SignalDeclaration", ts[1].text, [_leaf("Identifier", ts[1]), p.parameters()], ts[0])]
        if head == "enum":
            return [self.enum(ts)]
        if head == "class" and len(ts) > 1 and ts[1].kind == "name":
            colon = _cut(ts, {":"})
            stop = colon if colon >= 0 else len(ts)
            base = _cut(ts[:stop], {"extends"})
            kind = _Expressions(ts[base + 1 : stop], self.depth).type() if base >= 0 else None
            body = self.block(ts[stop + 1 :], indent, member=True)
            return [_make("InnerClassDeclaration", ts[1].text, [_leaf("Identifier", ts[1]), kind, body], ts[0])]
        if head == "func" and len(ts) > 1 and ts[1].kind == "name":
            node = self.method(ts, indent)
            node.marks = marks
            return [node]
        if head in ("var", "const") and len(ts) > 1:
            node = self.variable(ts, indent, "VariableDeclaration")
            node.marks += marks
            return [node]
        if head == "pass" and len(ts) == 1:
            return [_leaf("PassDeclaration", ts[0])]
        return None

    def method(self, ts: list[Token], indent: int) -> Syn:
        p = _Expressions(ts[2:], self.depth)
        params, kind = p.parameters(), None
        if p.peek() == "->":
            p.next()
            kind = p.type()
        body = None
        if p.peek() == ":":
            p.next()
            body = self.block(p.ts[p.at :], indent)
        elif not p.done():
            body = p.rest(None)
        return _make("MethodDeclaration", ts[1].text, [_leaf("Identifier", ts[1]), params, kind, body], ts[0])

    def variable(self, ts: list[Token], indent: int, node_kind: str) -> Syn:
        marks = ["const"] if ts[0].text == "const" else []
        p = _Expressions(self.with_lambda(ts, indent)[2:], self.depth)
        kind = value = None
        accessors: list[Syn | None] = []
        if p.peek() in (":", ":="):
            mark = p.next()
            if mark.text == ":=" or p.peek() == "=":
                marks.append("inferred")
            elif not p.done():
                kind = p.type()
        if p.peek() == "=" or "inferred" in marks:
            if p.peek() == "=":
                p.next()
            value = p.binary()
        if p.peek() == ":" or (ts[-1].text == ":" and p.done()):
            rest = p.ts[p.at + 1 :] if p.peek() == ":" else []
            accessors = self.accessors(rest, indent)
        elif not p.done():
            value = p.rest(value)
        return _span(Syn(node_kind, ts[1].text, [c for c in [_leaf("Identifier", ts[1]), kind, value, *accessors] if c is not None], marks=marks), *[c for c in [kind, value, *accessors] if c], ts[0], ts[1])

    def accessors(self, rest: list[Token], indent: int) -> list[Syn | None]:
        lines = [_Line(indent + 1, p) for p in _parts(rest, ",")] if rest else []
        if not rest:
            end = self.at
            while end < len(self.lines) and self.lines[end].indent > indent:
                end += 1
            lines, self.at = self.lines[self.at : end], end
        inner = Parser(lines, self.depth + 1)
        out: list[Syn | None] = []
        while inner.at < len(inner.lines):
            line = inner.lines[inner.at]
            inner.at += 1
            ts = line.tokens
            name = {"get": "Get", "set": "Set"}.get(ts[0].text)
            if name is None:
                out.append(_make("AccessorDeclaration", None, [_leaf("InvalidToken", t) for t in ts]))
                continue
            equal, colon = _cut(ts, {"="}), _cut(ts, {":"})
            if equal >= 0 and (colon < 0 or equal < colon):
                out.append(_make(f"{name}AccessorMethodDeclaration", ts[equal + 1].text if equal + 1 < len(ts) else None, [], *ts))
            else:
                params = _Expressions(ts[1:], self.depth).parameters()
                body = inner.block(ts[colon + 1 :] if colon >= 0 else [], line.indent)
                out.append(_make(f"{name}AccessorBodyDeclaration", None, [params, body], ts[0]))
        return out

    def enum(self, ts: list[Token]) -> Syn:
        name = ts[1] if len(ts) > 1 and ts[1].kind == "name" else None
        begin = next((i for i, t in enumerate(ts) if t.text == "{"), len(ts))
        values = []
        for part in _parts(ts[begin + 1 : -1], ","):
            value = parse_tokens(part[2:], self.depth) if len(part) > 2 else None
            values.append(_make("EnumValueDeclaration", part[0].text, [_leaf("Identifier", part[0]), value], part[0]))
        return _make("EnumDeclaration", name.text if name else None, [_leaf("Identifier", name) if name else None, _make("EnumValuesList", None, values)], ts[0], ts[-1])

    def condition(self, ts: list[Token]) -> tuple[Syn | None, list[Token]]:
        """(expression, what follows the colon)."""
        p = _Expressions(ts, self.depth)
        value = p.binary()
        if p.peek() == ":":
            return value, p.ts[p.at + 1 :]
        cut = _cut(p.ts[p.at :], {":"})
        if cut < 0:
            return p.rest(value), []
        bad = [_leaf("InvalidToken", t) for t in p.ts[p.at : p.at + cut]]
        return _make("InvalidExpression", None, [value, *bad]), p.ts[p.at + cut + 1 :]

    def statement(self, ts: list[Token], indent: int, before: list[Syn]) -> list[Syn]:
        head, t = ts[0].text, ts[0]
        if t.kind == "name":
            if head == "if":
                value, rest = self.condition(ts[1:])
                branch = _make("IfBranch", None, [value, self.block(rest, indent)], t)
                return [_make("IfStatement", None, [branch])]
            if head in ("elif", "else") and before and before[-1].kind == "IfStatement":
                owner = before[-1]
                if head == "elif":
                    value, rest = self.condition(ts[1:])
                    branch = _make("ElifBranch", None, [value, self.block(rest, indent)], t)
                    found = owner.child("ElifBranchesList")
                    if found is None:
                        found = Syn("ElifBranchesList")
                        owner.children.append(found)
                    found.children.append(branch)
                    _span(found, branch)
                else:
                    branch = _make("ElseBranch", None, [self.block(ts[2:] if len(ts) > 1 else [], indent)], t)
                    owner.children.append(branch)
                _span(owner, branch)
                return []
            if head == "while":
                value, rest = self.condition(ts[1:])
                return [_make("WhileStatement", None, [value, self.block(rest, indent)], t)]
            if head == "for" and len(ts) > 1:
                p = _Expressions(ts[2:], self.depth)
                kind = None
                if p.peek() == ":":
                    p.next()
                    kind = p.type()
                rest = p.ts[p.at + 1 :] if p.peek() == "in" else p.ts[p.at :]
                value, rest = self.condition(rest)
                return [_make("ForStatement", ts[1].text, [_leaf("Identifier", ts[1]), kind, value, self.block(rest, indent)], t)]
            if head == "match":
                value, rest = self.condition(ts[1:])
                cases = self.cases(indent)
                return [_make("MatchStatement", None, [value, cases], t)]
            if head in ("var", "const") and len(ts) > 1 and ts[1].kind == "name":
                return [self.variable(ts, indent, "VariableDeclarationStatement")]
        out: list[Syn] = []
        for part in _parts(ts, ";"):
            out.append(self.simple(part, indent))
        return out

    def cases(self, indent: int) -> Syn:
        out: list[Syn] = []
        while self.at < len(self.lines) and self.lines[self.at].indent > indent:
            line = self.lines[self.at]
            self.at += 1
            colon = self.case_colon(line.tokens)
            head, rest = (line.tokens[:colon], line.tokens[colon + 1 :]) if colon >= 0 else (line.tokens, [])
            guard = None
            when = _cut(head, {"when"})
            if when >= 0:
                guard, head = parse_tokens(head[when + 1 :], self.depth), head[:when]
            patterns = []
            for part in _parts(head, ","):
                if len(part) == 1 and part[0].text == "_":
                    patterns.append(_leaf("MatchDefaultOperatorExpression", part[0]))
                else:
                    node = parse_tokens(part, self.depth)
                    for x in node.walk() if node else ():  # default marks within arrays and dictionaries
                        if x.kind == "IdentifierExpression" and x.value == "_":
                            x.kind = "MatchDefaultOperatorExpression"
                    patterns.append(node)
            body = self.block(rest, line.indent)
            out.append(_make("MatchCaseDeclaration", None, [_make("ExpressionsList", None, patterns), guard, body], line.tokens[0]))
        return _make("MatchCasesList", None, out)

    @staticmethod
    def case_colon(ts: list[Token]) -> int:
        return _cut(ts, {":"})

    def simple(self, ts: list[Token], indent: int) -> Syn:
        head, t = ts[0].text, ts[0]
        if t.kind == "name":
            if head == "return":
                return _make("ExpressionStatement", None, [_make("ReturnExpression", None, [parse_tokens(ts[1:], self.depth)], t)])
            word = {"break": "BreakExpression", "continue": "ContinueExpression", "pass": "PassExpression", "breakpoint": "BreakPointExpression"}.get(head)
            if word and len(ts) == 1:
                return _make("ExpressionStatement", None, [_leaf(word, t)])
        equal = _cut(ts, ASSIGN)
        if equal > 0:
            left, right = parse_tokens(ts[:equal], self.depth), self.value(ts[equal + 1 :], indent)
            return _make("ExpressionStatement", None, [_make("DualOperatorExpression", DUAL[ts[equal].text], [left or _missing(ts[equal]), right or _missing(ts[equal])], ts[equal])])
        return _make("ExpressionStatement", None, [self.value(ts, indent)])

    def with_lambda(self, ts: list[Token], indent: int) -> list[Token]:
        """The line's tokens; with those of the lines below if it ends in a lambda's head."""
        if not ts or ts[-1].text != ":" or not any(x.text == "func" for x in ts):
            return ts
        end = self.at
        while end < len(self.lines) and self.lines[end].indent > indent:
            end += 1
        ts = [*ts, *(x for line in self.lines[self.at : end] for x in line.tokens)]
        self.at = end
        return ts

    def value(self, ts: list[Token], indent: int) -> Syn | None:
        return parse_tokens(self.with_lambda(ts, indent), self.depth)


def script(text: str | None) -> Syn:
    """The tree of a whole script."""
    found = tokens((text or "").removeprefix("\ufeff"))
    members = Parser(logical_lines(found)).statements(-1, member=True)
    return _span(Syn("ClassDeclaration", None, [members], 1, 0, 1, 0), members)


def expression(text: str) -> Syn | None:
    """The tree of one expression."""
    lines = logical_lines(tokens(text))
    return parse_tokens([t for line in lines for t in line.tokens])


def statements(text: str) -> Syn:
    """The ``StatementsList`` of a piece of a body."""
    return Parser(logical_lines(tokens(text))).statements(-1)


def statement(text: str) -> Syn | None:
    """The first statement of a piece of a body."""
    return next(iter(statements(text).children), None)


def type_node(text: str) -> Syn | None:
    """The tree of a type annotation."""
    p = _Expressions([t for t in tokens(text) if t.kind not in ("space", "newline", "comment")])
    kind = p.type()
    return p.rest(kind) if not p.done() else kind


def unspecified(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, line, col) of every token, white space and comments included."""
    return [(t.kind, t.text, t.line, t.col) for t in tokens(text)]


_SYMBOL = {v: k for k, v in DUAL.items()}
_SIGN = {v: k for k, v in SINGLE.items()}


def written(node: Syn) -> str:
    """An expression or type as code, in one spelling for equal trees."""
    parts = [written(c) for c in node.children if c.kind not in ("Identifier", "StringPartsList", "PathList", "TripleDoubleQuotasStringNode")]
    kind = node.kind
    if kind == "DualOperatorExpression":
        op = _SYMBOL[node.value or ""]
        if node.marks:
            op = {"is": "is not", "in": "not in"}.get(op, op)
        return f" {op} ".join(parts)
    if kind == "SingleOperatorExpression":
        sign = _SIGN[node.value or ""]
        return (sign + " " if sign == "not" else sign) + "".join(parts)
    if kind == "BracketExpression":
        return f"({''.join(parts)})"
    if kind == "CallExpression":
        return "".join(parts)
    if kind == "ExpressionsList":
        return f"({', '.join(parts)})"
    if kind == "ArrayInitializerExpression":
        return f"[{parts[0][1:-1]}]" if parts else "[]"
    if kind == "DictionaryInitializerExpression":
        return "{" + (parts[0] if parts else "") + "}"
    if kind == "DictionaryKeyValueDeclarationList":
        return ", ".join(parts)
    if kind == "DictionaryKeyValueDeclaration":
        return f"{parts[0]}{': ' if node.value == ':' else ' = '}{parts[1]}" if len(parts) > 1 else parts[0]
    if kind == "MemberOperatorExpression":
        return f"{''.join(parts)}.{node.value}"
    if kind == "IndexerExpression":
        return f"{parts[0]}[{parts[1] if len(parts) > 1 else ''}]"
    if kind == "IfExpression":
        return f"{parts[0]} if {parts[1] if len(parts) > 1 else ''} else {parts[2] if len(parts) > 2 else ''}"
    if kind == "YieldExpression":
        return f"yield{''.join(parts)}"
    if kind == "AwaitExpression":
        return f"await {''.join(parts)}"
    if kind == "ReturnExpression":
        return f"return {''.join(parts)}".rstrip()
    if kind == "MethodExpression":
        return _lambda(node, 0)
    if kind == "MatchCaseVariableExpression":
        return f"var {node.value}"
    return node.value or " ".join(parts)


# --- writing whole trees ---------------------------------------------------------------------


def _head(node: Syn) -> str:
    """Parameters and result type of a method or lambda."""
    params = node.child("ParametersList")
    kind = next((c.value for c in node.children if c.kind.endswith("TypeNode")), None)
    return f"({', '.join(_parameter(p) for p in params.children) if params else ''})" + (f" -> {kind}" if kind else "")


def _typed(node: Syn) -> str:
    """``: type = value`` of a variable or parameter."""
    kind = next((c.value for c in node.children if c.kind.endswith("TypeNode")), None)
    value = next((c for c in node.children if c.kind.endswith("Expression")), None)
    mark = f": {kind}" if kind else ""
    return mark + ("" if value is None else f" {':=' if 'inferred' in node.marks else '='} {written(value)}")


def _parameter(node: Syn) -> str:
    return f"{node.value}{_typed(node)}"


def _simple(body: Syn | None) -> bool:
    return body is None or all(c.kind in ("ExpressionStatement", "VariableDeclarationStatement") and not any(x.kind == "MethodExpression" for x in c.walk()) for c in body.children)


def _lambda(node: Syn, depth: int) -> str:
    body = node.child("StatementsList")
    head = f"func{' ' + node.value if node.value else ''}{_head(node)}:"
    if _simple(body):
        return f"{head} " + ("; ".join(source(c) for c in body.children) if body and body.children else "pass")
    inner = "\n".join(source(c, depth + 1) for c in body.children)
    return f"{head}\n{inner}\n" + "\t" * depth


def _block(node: Syn | None, depth: int) -> str:
    return "\n".join(source(c, depth) for c in node.children) if node is not None and node.children else "\t" * depth + "pass"


def source(node: Syn, depth: int = 0) -> str:
    """A member, statement or whole script as code, indented by tabs."""
    pad, kind = "\t" * depth, node.kind
    marks = [c for c in node.children if c.kind in ("CustomAttribute", "ToolAttribute")]
    lead = "".join(f"@{m.value}{written(m.children[0]) if m.children else ''} " for m in marks)
    if kind == "ClassDeclaration":
        return source(node.children[0], depth) + "\n" if node.children and node.children[0].children else ""
    if kind == "ClassMembersList":
        out = ""
        for k, c in enumerate(node.children):
            far = c.kind in ("MethodDeclaration", "InnerClassDeclaration") or (k and node.children[k - 1].kind in ("MethodDeclaration", "InnerClassDeclaration"))
            out += ("\n\n\n" if far else "\n") * bool(k) + source(c, depth)
        return out
    if kind == "StatementsList":
        return _block(node, depth)
    words = {"ClassNameAttribute": "class_name", "ExtendsAttribute": "extends", "SignalDeclaration": "signal"}
    if kind in words:
        return f"{pad}{lead}{words[kind]} {node.value}" + (_head(node) if node.child("ParametersList") else "")
    if kind in ("ToolAttribute", "CustomAttribute"):
        return f"{pad}@{node.value}{written(node.children[0]) if node.children else ''}"
    if kind == "EnumDeclaration":
        values = [v.value + (f" = {written(v.children[1])}" if len(v.children) > 1 else "") for v in (node.child("EnumValuesList") or Syn("")).children]
        return f"{pad}{lead}enum {node.value + ' ' if node.value else ''}{{ {', '.join(values)} }}"
    if kind in ("VariableDeclaration", "VariableDeclarationStatement"):
        word = "const" if "const" in node.marks else "static var" if "static" in node.marks else "var"
        own = [c for c in node.children if "Accessor" in c.kind]
        text = f"{pad}{lead}{word} {node.value}"
        value = next((c for c in node.children if c.kind == "MethodExpression"), None)
        text += f" = {_lambda(value, depth)}".rstrip("\t\n") if value is not None and not _simple(value.child("StatementsList")) else _typed(node)
        for k, c in enumerate(own):
            name = "get" if c.kind.startswith("Get") else "set"
            if c.kind.endswith("MethodDeclaration"):
                text += (":" if k == 0 else ",") + f" {name} = {c.value}"
            else:
                params = c.child("ParametersList")
                text += ":" * (k == 0) + f"\n{pad}\t{name}{_head(c) if params is not None else ''}:\n{_block(c.child('StatementsList'), depth + 2)}"
        return text
    if kind == "MethodDeclaration":
        body = node.child("StatementsList")
        static = "static " if "static" in node.marks else ""
        return f"{pad}{lead}{static}func {node.value}{_head(node)}" + (f":\n{_block(body, depth + 1)}" if body is not None or "abstract" not in node.marks else "")
    if kind == "InnerClassDeclaration":
        base = next((c.value for c in node.children if c.kind.endswith("TypeNode")), None)
        return f"{pad}{lead}class {node.value}{' extends ' + base if base else ''}:\n" + (source(node.child("ClassMembersList"), depth + 1) if node.child("ClassMembersList") and node.child("ClassMembersList").children else pad + "\tpass")
    if kind == "IfStatement":
        out = f"{pad}if {written(node.children[0].children[0])}:\n{_block(node.children[0].child('StatementsList'), depth + 1)}"
        for b in (node.child("ElifBranchesList") or Syn("")).children:
            out += f"\n{pad}elif {written(b.children[0])}:\n{_block(b.child('StatementsList'), depth + 1)}"
        last = node.child("ElseBranch")
        return out + (f"\n{pad}else:\n{_block(last.child('StatementsList'), depth + 1)}" if last else "")
    if kind == "WhileStatement":
        return f"{pad}while {written(node.children[0])}:\n{_block(node.child('StatementsList'), depth + 1)}"
    if kind == "ForStatement":
        of = next((f": {c.value}" for c in node.children if c.kind.endswith("TypeNode")), "")
        over = next((written(c) for c in node.children if c.kind.endswith("Expression")), "")
        return f"{pad}for {node.value}{of} in {over}:\n{_block(node.child('StatementsList'), depth + 1)}"
    if kind == "MatchStatement":
        out = f"{pad}match {written(node.children[0])}:"
        for c in (node.child("MatchCasesList") or Syn("")).children:
            patterns = ", ".join(written(x) for x in c.children[0].children)
            guard = next((f" when {written(x)}" for x in c.children[1:] if x.kind.endswith("Expression")), "")
            out += f"\n{pad}\t{patterns}{guard}:\n{_block(c.child('StatementsList'), depth + 2)}"
        return out
    if kind == "ExpressionStatement":
        e = node.children[0] if node.children else None
        if e is not None and any(x.kind == "MethodExpression" and not _simple(x.child("StatementsList")) for x in e.walk()):
            return pad + _deep(e, depth)
        return pad + (written(e) if e is not None else "pass")
    if kind == "PassDeclaration":
        return pad + "pass"
    return pad + written(node)


def _deep(e: Syn, depth: int) -> str:
    """An expression that holds lambdas of several lines."""
    if e.kind == "MethodExpression":
        return _lambda(e, depth)
    if e.kind == "CallExpression":
        return _deep(e.children[0], depth) + f"({', '.join(_deep(c, depth) for c in e.children[1].children)})"
    if e.kind == "DualOperatorExpression" and e.value == "Assignment":
        return f"{written(e.children[0])} = {_deep(e.children[1], depth)}".rstrip("\t\n")
    return written(e)


# --- parsing again -----------------------------------------------------------------------------


def changes(old: str, new: str) -> tuple[int, int, int]:
    """(first line, old lines, new lines) of the one stretch of lines that differs."""
    a, b = old.split("\n"), new.split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head + 1, len(a) - head - tail, len(b) - head - tail


def _shift(node: Syn, by: int) -> Syn:
    moved = Syn(node.kind, node.value, [_shift(c, by) for c in node.children], node.line + by if node.line else 0, node.col, node.end_line + by if node.line else 0, node.end_col, list(node.marks))
    return moved


def reparse(tree: Syn, old: str, new: str, most_changed: float = 0.5, most_members: int = 3) -> tuple[Syn, int]:
    """(tree of the new text, members parsed again): members outside the changed lines are kept, those below move.

    Everything is parsed again (-1) when more than a share of the lines or a
    number of members change, or where that can't be told apart.
    """
    first, gone, come = changes(old, new)
    if not gone and not come:
        return tree, 0
    members = tree.children[0].children if tree.children else []
    last, by = first + gone - 1, come - gone
    before = [m for m in members if m.end_line < first - 1]
    after = [m for m in members if min([m.line, *[c.line for c in m.children if c.line]]) > last + 1]
    touched = len(members) - len(before) - len(after)
    total = max(old.count("\n"), new.count("\n")) + 1
    if not members or max(gone, come) > most_changed * total or touched > most_members or not before:
        return script(new), -1
    lines = new.split("\n")
    start = before[-1].end_line
    stop = (after[0].line + by - 1) if after else len(lines)
    middle = "\n" * start + "\n".join(lines[start:stop])
    if any(q in middle for q in ('\"\"\"', "'''")) or next((x for x in lines[start:stop] if x.strip()), "")[:1] in (" ", "\t"):
        return script(new), -1  # a text over lines, or lines that may belong to the member before
    again = script(middle).children[0].children
    if any(n.kind == "InvalidToken" for m in again for n in m.walk()) or (after and after[0].marks and after[0].kind != "MethodDeclaration"):
        return script(new), -1
    made = _make("ClassMembersList", None, [*before, *again, *(_shift(m, by) for m in after)])
    return _span(Syn("ClassDeclaration", None, [made], 1, 0, 1, 0), made), len(again)


ROW_SCHEMA = "pre int, last int, parent int, depth int, kind string, value string, marks array<string>, line int, col int, end_line int, end_col int, place int"


def rows(root: Syn) -> list[tuple]:
    """Interval-encoded rows of a tree, in the order of a walk."""
    out: list[list] = []
    stack: list[tuple[Syn, int, int, int]] = [(root, -1, 0, 0)]
    while stack:
        node, parent, depth, place = stack.pop()
        pre = len(out)
        out.append([pre, pre, parent, depth, node.kind, node.value, node.marks, node.line, node.col, node.end_line, node.end_col, place])
        stack.extend((c, pre, depth + 1, i) for i, c in reversed(list(enumerate(node.children))))
    for r in reversed(out):
        if r[2] >= 0:
            out[r[2]][1] = max(out[r[2]][1], r[1])
    return [tuple(r) for r in out]
