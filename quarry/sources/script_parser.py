"""A small parser of indentation-based scripts: one text in, flat node and use rows out.

Statements become nodes with a parent, a depth and a line span; names in
expressions become uses with a role.  Bad syntax never fails: what isn't
understood is an ``expr`` node.  One file is one task's row, so files are
parsed in parallel and everything after is relational.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<string>[&^]?r?(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))
    |(?P<node>\$(?:\"[^\"\n]*\"|[\w/%]+)|%[A-Za-z_]\w*(?![\w(]))|(?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?\.?)
    |(?P<name>[^\W\d]\w*)|(?P<join>\\[ \t]*\r?\n)|(?P<newline>\r?\n)|(?P<space>[ \t\r]+)
    |(?P<op>\*\*=|<<=|>>=|->|:=|==|!=|<=|>=|&&|\|\||<<|>>|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.\.?|.)""",
    re.X,
)
# Words of the language that aren't names.
KEYWORDS = set(
    "if elif else for while match when break continue pass return class class_name extends is in as self signal func static const enum var await preload yield assert void PI TAU INF NAN true false null not and or super breakpoint".split()
)
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>="}
_OPEN, _CLOSE = set("([{"), set(")]}")


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int


@dataclass
class Node:
    node_id: int
    parent_id: int
    kind: str
    name: str | None
    start_line: int
    depth: int
    type_name: str | None = None
    value: str | None = None
    modifiers: list[str] = field(default_factory=list)
    params: list[tuple[str, str | None, bool]] = field(default_factory=list)
    end_line: int = 0
    col: int = 0
    method_id: int | None = None
    class_id: int = 0
    last_id: int = 0
    position: int = 0


@dataclass
class Use:
    node_id: int
    name: str
    role: str  # read, write, call, member, member_call
    receiver: str | None
    argument: str | None
    n_args: int
    line: int
    col: int


@dataclass
class _Line:
    indent: int
    tokens: list[Token]


def tokens(text: str) -> list[Token]:
    out, line, start = [], 1, 0
    for m in _TOKEN.finditer(text):
        kind, value = m.lastgroup or "op", m.group()
        out.append(Token(kind, value, line, m.start() - start))
        if breaks := value.count("\n"):
            line += breaks
            start = m.start() + value.rfind("\n") + 1
    return out


def logical_lines(found: list[Token]) -> list[_Line]:
    """Lines with brackets and joins closed, blanks and comments left out; a tab counts as four columns."""
    out: list[_Line] = []
    own: list[Token] = []
    indent, fresh, nested = 0, True, 0
    for t in found:
        if t.kind == "newline":
            if not nested:
                if own:
                    out.append(_Line(indent, own))
                own, indent, fresh = [], 0, True
        elif t.kind == "space":
            if fresh and not own:
                indent = sum(4 if c == "\t" else 1 for c in t.text if c != "\r")
        elif t.kind in ("comment", "join"):
            continue
        else:
            fresh = False
            if t.text in _OPEN:
                nested += 1
            elif t.text in _CLOSE:
                nested = max(0, nested - 1)
            own.append(t)
    if own:
        out.append(_Line(indent, own))
    return out


def _split(ts: list[Token], at: str) -> list[list[Token]]:
    """Parts between separators outside brackets."""
    parts, nested = [[]], 0
    for t in ts:
        nested += (t.text in _OPEN) - (t.text in _CLOSE)
        if t.text == at and nested == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _find(ts: list[Token], values: set[str]) -> int:
    nested = 0
    for i, t in enumerate(ts):
        if nested == 0 and t.text in values and t.kind == "op":
            return i
        nested += (t.text in _OPEN) - (t.text in _CLOSE)
    return -1


def _text(ts: list[Token]) -> str:
    return " ".join(t.text for t in ts)


class ScriptParser:
    def __init__(self, text: str):
        self.tokens = tokens(text)
        self.lines = logical_lines(self.tokens)
        self.nodes: list[Node] = []
        self.uses: list[Use] = []
        root = self._node(-1, "file", None, 1, 0)
        self._block(0, root.node_id, -1, 0, True)
        root.end_line = text.count("\n") + 1
        self._place()

    def _place(self) -> None:
        """Enclosing method and class, last descendant, and place among siblings of every node."""
        children: dict[int, int] = {}
        for n in self.nodes:
            n.last_id = n.node_id
            if n.parent_id >= 0:
                up = self.nodes[n.parent_id]
                n.method_id = up.node_id if up.kind == "func" else up.method_id
                n.class_id = up.node_id if up.kind in ("class", "file") else up.class_id
                n.position = children.get(n.parent_id, 0)
                children[n.parent_id] = n.position + 1
        for n in reversed(self.nodes):
            if n.parent_id >= 0:
                up = self.nodes[n.parent_id]
                up.last_id = max(up.last_id, n.last_id)

    def _node(self, parent: int, kind: str, name: str | None, line: int, depth: int, **more) -> Node:
        node = Node(len(self.nodes), parent, kind, name, line, depth, end_line=line, **more)
        self.nodes.append(node)
        return node

    def _block(self, at: int, parent: int, indent: int, depth: int, in_class: bool) -> int:
        """Statements deeper than ``indent``; returns the next line's index."""
        waiting: list[str] = []
        while at < len(self.lines) and self.lines[at].indent > indent:
            line = self.lines[at]
            at, waiting = self._statement(at, line.tokens, parent, line.indent, depth, in_class, waiting)
        return at

    def _statement(self, at: int, ts: list[Token], parent: int, indent: int, depth: int, in_class: bool, waiting: list[str]) -> tuple[int, list[str]]:
        marks = list(waiting)
        while ts and ts[0].text == "@" and len(ts) > 1:
            mark, ts = ts[1].text, ts[2:]
            if ts and ts[0].text == "(":
                nested = 0
                for i, t in enumerate(ts):
                    nested += (t.text in _OPEN) - (t.text in _CLOSE)
                    if nested == 0:
                        ts = ts[i + 1 :]
                        break
            marks.append(mark)
        if not ts:
            return at + 1, marks
        while ts[0].text == "static" and len(ts) > 1:
            marks.append("static")
            ts = ts[1:]
        head, line, col = ts[0].text, ts[0].line, ts[0].col
        body_kind = {"func": "func", "class": "class", "if": "if", "elif": "elif", "else": "else", "for": "for", "while": "while", "match": "match"}.get(head)
        if body_kind == "func" and len(ts) < 2:
            body_kind = None
        is_case = body_kind is None and self.nodes[parent].kind == "match" and _find(ts, {":"}) >= 0
        if body_kind or is_case:
            colon = self._colon(ts, body_kind)
            node = self._header(body_kind or "case", ts[: colon if colon >= 0 else len(ts)], parent, line, col, depth, marks, in_class)
            rest = ts[colon + 1 :] if colon >= 0 else []
            inner_class = body_kind == "class"
            nested = depth + (body_kind not in ("func", "class", "match"))
            if rest:
                for part in _split(rest, ";"):
                    self._statement(at, part, node.node_id, indent, nested, inner_class, [])
                at += 1
            else:
                at = self._block(at + 1, node.node_id, indent, nested, inner_class)
            node.end_line = max([node.end_line, *(n.end_line for n in self.nodes[node.node_id :])])
            return at, []
        parts = _split(ts, ";")
        for part in parts:
            self._simple(part, parent, part[0].line, depth, marks, in_class)
        # Accessors of a property: an indented block after a variable with a colon at its end.
        if head == "var" and ts[-1].text == ":":
            owner = next(n for n in reversed(self.nodes) if n.kind == "var")
            at = self._block(at + 1, owner.node_id, indent, depth + 1, False)
            owner.end_line = self.nodes[-1].end_line
            return at, []
        return at + 1, []

    @staticmethod
    def _colon(ts: list[Token], kind: str | None) -> int:
        """The colon that opens the body (not that of a loop variable's type or a lambda's)."""
        nested, found, skip = 0, -1, kind == "for"
        for i, t in enumerate(ts):
            if t.text == "in" and t.kind == "name":
                skip = False
            if nested == 0 and t.text == ":" and not skip:
                found = i
                break
            nested += (t.text in _OPEN) - (t.text in _CLOSE)
        return found

    def _header(self, kind: str, ts: list[Token], parent: int, line: int, col: int, depth: int, marks: list[str], in_class: bool) -> Node:
        name = ts[1].text if kind in ("func", "class") and len(ts) > 1 and ts[1].kind == "name" else None
        node = self._node(parent, kind, name, line, depth, modifiers=marks, col=ts[1].col if name else col)
        node.end_line = ts[-1].line if ts else line
        if kind == "func":
            begin = next((i for i, t in enumerate(ts) if t.text == "("), len(ts))
            nested, end = 0, len(ts)
            for i in range(begin, len(ts)):
                nested += (ts[i].text in _OPEN) - (ts[i].text in _CLOSE)
                if nested == 0:
                    end = i
                    break
            node.params = self._params(ts[begin + 1 : end], node)
            arrow = _find(ts, {"->"})
            node.type_name = _text(ts[arrow + 1 :]) if arrow >= 0 else None
        elif kind == "class":
            node.type_name = next((_text(ts[i + 1 :]) for i, t in enumerate(ts) if t.text == "extends"), None)
        elif kind == "for":
            where = next((i for i, t in enumerate(ts) if t.text == "in"), len(ts))
            colon = next((i for i, t in enumerate(ts[:where]) if t.text == ":"), where)
            node.name = ts[1].text if len(ts) > 1 else None
            node.type_name = _text(ts[colon + 1 : where]) or None
            self._expression(ts[where + 1 :], node.node_id)
        else:
            node.value = _text(ts[1:]) or None
            self._expression(ts if kind == "case" else ts[1:], node.node_id)
        return node

    def _params(self, ts: list[Token], node: Node) -> list[tuple[str, str | None, bool]]:
        out = []
        for part in _split(ts, ","):
            name = next((t.text for t in part if t.kind == "name"), None)
            if name is None:
                continue
            equal = _find(part, {"=", ":="})
            colon = _find(part[: equal if equal >= 0 else len(part)], {":"})
            kind = _text(part[colon + 1 : equal if equal >= 0 else len(part)]) if colon >= 0 else None
            if equal >= 0:
                self._expression(part[equal + 1 :], node.node_id)
            out.append((name, kind or None, equal >= 0))
        return out

    def _simple(self, ts: list[Token], parent: int, line: int, depth: int, marks: list[str], in_class: bool) -> None:
        head = ts[0].text
        if head in ("extends", "class_name"):
            self._node(parent, head, ts[1].text.strip("\"'") if len(ts) > 1 else None, line, depth, modifiers=marks, col=ts[0].col, value=_text(ts[1:]))
            if head == "class_name" and len(ts) > 3 and ts[2].text == "extends":
                self._node(parent, "extends", ts[3].text.strip("\"'"), line, depth, value=_text(ts[3:]))
        elif head == "signal" and len(ts) > 1:
            node = self._node(parent, "signal", ts[1].text, line, depth, modifiers=marks, col=ts[1].col)
            node.params = self._params(ts[3:-1], node) if len(ts) > 3 else []
        elif head == "enum":
            name = ts[1].text if len(ts) > 1 and ts[1].kind == "name" else None
            node = self._node(parent, "enum", name, line, depth, modifiers=marks, col=ts[0].col)
            begin = next((i for i, t in enumerate(ts) if t.text == "{"), len(ts))
            for part in _split(ts[begin + 1 : -1], ","):
                self._node(node.node_id, "enum_value", part[0].text, part[0].line, depth + 1, value=_text(part[2:]) or None, col=part[0].col)
                self._expression(part[2:], node.node_id)
            node.end_line = ts[-1].line
        elif head in ("var", "const") and len(ts) > 1:
            equal = _find(ts, {"=", ":="})
            stop = equal if equal >= 0 else len(ts)
            colon = _find(ts[:stop], {":"})
            kind = _text([t for t in ts[colon + 1 : stop] if t.text != ":"]) if colon >= 0 else ""
            own = [*marks, *(["inferred"] if equal >= 0 and ts[equal].text == ":=" else []), *([] if in_class else ["local"])]
            value = [t for t in ts[equal + 1 :]] if equal >= 0 else []
            if value and value[-1].text == ":":
                value = value[:-1]
            node = self._node(parent, head, ts[1].text, line, depth, type_name=kind or None, value=_text(value) or None, modifiers=own, col=ts[1].col)
            node.end_line = ts[-1].line
            self._expression(value, node.node_id)
        else:
            kind = head if head in ("return", "break", "continue", "pass", "breakpoint", "assert") else "expr"
            node = self._node(parent, kind, None, line, depth, modifiers=marks, value=_text(ts[1:] if kind == "return" else ts) or None, col=ts[0].col)
            node.end_line = ts[-1].line
            equal = _find(ts, _ASSIGN) if kind == "expr" else -1
            if equal > 0:
                node.kind, node.name = "assign", _text(ts[:equal])
                node.value, node.type_name = _text(ts[equal + 1 :]), ts[equal].text
                self._expression(ts[:equal], node.node_id, target=True, compound=ts[equal].text != "=")
                self._expression(ts[equal + 1 :], node.node_id)
            else:
                self._expression(ts[1:] if kind in ("return", "assert") else ts, node.node_id)

    def _expression(self, ts: list[Token], node_id: int, target: bool = False, compound: bool = False) -> None:
        last = max((i for i, t in enumerate(ts) if t.kind == "name"), default=-1)
        nested = 0
        for i, t in enumerate(ts):
            nested += (t.text in _OPEN) - (t.text in _CLOSE)
            if t.kind in ("node", "string", "number"):
                self.uses.append(Use(node_id, t.text, {"node": "node_path", "string": "string", "number": "number"}[t.kind], None, None, 0, t.line, t.col))
                continue
            if t.kind != "name":
                if t.kind == "op" and t.text in ("&&", "||"):
                    self.uses.append(Use(node_id, t.text, "operator", None, None, 0, t.line, t.col))
                continue
            if t.text in ("and", "or", "if", "await", "func"):
                self.uses.append(Use(node_id, t.text, "operator", None, None, 0, t.line, t.col))
                continue
            if t.text in KEYWORDS and t.text not in ("preload", "super"):
                continue
            member = i > 0 and ts[i - 1].text == "."
            receiver = (ts[i - 2].text if i > 1 and (ts[i - 2].kind == "name" or ts[i - 2].text in (")", "]")) else "") if member else None
            call = i + 1 < len(ts) and ts[i + 1].text == "("
            argument, n_args = None, 0
            if call:
                depth, inner = 0, []
                for u in ts[i + 1 :]:
                    depth += (u.text in _OPEN) - (u.text in _CLOSE)
                    if depth == 0:
                        break
                    inner.append(u)
                args = _split(inner[1:], ",")
                n_args = len(args)
                argument = _text(args[0]) if args else None
            key = i + 1 < len(ts) and ts[i + 1].text == "=" and nested > 0
            written = target and i == last and nested == 0 and not call
            role = ("member_call" if member else "call") if call else "member" if member and not written else "write" if written else "key" if key else "read"
            self.uses.append(Use(node_id, t.text, role, receiver, argument, n_args, t.line, t.col))
            if written and compound:
                self.uses.append(Use(node_id, t.text, "read", receiver, None, 0, t.line, t.col))


NODE_SCHEMA = "node_id int, parent_id int, kind string, name string, type_name string, value string, modifiers array<string>, params array<struct<name:string,type:string,has_default:boolean>>, start_line int, end_line int, col int, depth int, method_id int, class_id int, last_id int, position int"
USE_SCHEMA = "node_id int, name string, role string, receiver string, argument string, n_args int, line int, col int"


def parse(text: str | None) -> tuple[list[dict], list[dict]]:
    """(node rows, use rows) of one script."""
    p = ScriptParser(text or "")
    fields = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    nodes = [{f: getattr(n, f) for f in fields} | {"params": [{"name": a, "type": b, "has_default": c} for a, b, c in n.params]} for n in p.nodes]
    return nodes, [vars(u) for u in p.uses]
