"""Expressions of the analysed language over the rows of a DataFrame.

``evaluate(df, total="l_quantity * l_extendedprice", name="p_name.to_upper()")``
compiles each text through the syntax tree into one Spark expression, so it
stays in generated code.  The language's rules hold: int by int divides and
powers as int, truth is what isn't zero or empty, ``is`` asks for a type,
``as`` gives null where a cast fails.  A zero divisor gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import catalogue
from quarry.sources import syntax
from quarry.sources.syntax import Syn

# Constants of the language.
CONSTANTS = {"PI": 3.141592653589793, "TAU": 6.283185307179586, "INF": float("inf"), "NAN": float("nan")}
#: Functions that tell something else in the language, but over data give the changed value.
CHANGING = {("Array", "resize"), ("Array", "insert"), ("Dictionary", "erase")}
_CASTS = {"int": "bigint", "float": "double", "String": "string", "StringName": "string", "bool": "boolean"}


@dataclass(frozen=True)
class Typed:
    """A column and the language's type of it; a lambda has no column but a Python function."""

    column: Column | None
    type: str
    function: Callable[..., Column] | None = None


def type_name(kind: T.DataType) -> str:
    """The language's type of a Spark type."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.StringType):
        return "String"
    if isinstance(kind, T.ArrayType):
        return f"Array[{type_name(kind.elementType)}]"
    if isinstance(kind, T.MapType):
        return f"Dictionary[{type_name(kind.keyType)}, {type_name(kind.valueType)}]"
    return "Variant"


def element_type(kind: str) -> str:
    """What an array or dictionary type holds."""
    if "[" not in kind:
        return "String" if kind in ("String", "PackedStringArray") else "float" if kind == "PackedFloat64Array" else "Variant"
    return kind[kind.index("[") + 1 : -1].split(", ")[-1]


def truth(x: Typed) -> Column:
    c = x.column
    if x.type == "bool":
        return F.coalesce(c, F.lit(False))
    if x.type in ("int", "float"):
        return F.coalesce(c != 0, F.lit(False))
    if x.type == "String":
        return F.coalesce(c != "", F.lit(False))
    if x.type.startswith(("Array", "Dictionary", "Packed")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def result_type(operator: str, left: str, right: str) -> str:
    """The type of a dual operator's result by the types of its sides."""
    name = operator.removesuffix("AndAssign")
    if name in ("Equal", "NotEqual", "LessThan", "MoreThan", "LessThanOrEqual", "MoreThanOrEqual", "And", "And2", "Or", "Or2", "In", "Is"):
        return "bool"
    if name in ("BitShiftLeft", "BitShiftRight", "BitwiseAnd", "BitwiseOr", "Xor"):
        return "int"
    if name == "Add":
        name = "Addition"
    numbers = {"int", "float"}
    if left == "String" and (name == "Mod" or (name == "Addition" and right in ("String", "StringName"))):
        return "String"
    if name in ("Addition", "Subtraction", "Subtract", "Multiply", "Division", "Divide", "Mod", "Power"):
        if {left, right} <= numbers:
            return "float" if "float" in (left, right) else "int"
        if name == "Addition" and left.startswith("Array") and right.startswith("Array"):
            return left if left == right else "Array"
    return "Variant"


class Compiler:
    def __init__(self, scope: dict[str, Typed]):
        self.scope = scope

    def of(self, node: Syn | None) -> Typed:
        if node is None:
            raise ValueError("an expression is missing")
        method = getattr(self, f"_{node.kind}", None)
        if method is None:
            raise ValueError(f"{node.kind} has no meaning over data: {node.text()!r}")
        return method(node)

    def _IdentifierExpression(self, node: Syn) -> Typed:
        if node.value in self.scope:
            return self.scope[node.value]
        if node.value in CONSTANTS:
            return Typed(F.lit(CONSTANTS[node.value]), "float")
        if node.value == "null":
            return Typed(F.lit(None), "null")
        raise ValueError(f"unknown name: {node.value}")

    def _NumberExpression(self, node: Syn) -> Typed:
        text = (node.value or "").replace("_", "").lower()
        if text.startswith(("0x", "0b")):
            return Typed(F.lit(int(text, 0)).cast("bigint"), "int")
        if any(c in text for c in ".e"):
            return Typed(F.lit(float(text)), "float")
        return Typed(F.lit(int(text)).cast("bigint"), "int")

    def _StringExpression(self, node: Syn) -> Typed:
        text = (node.value or "").lstrip("&^")
        raw = text.startswith("r")
        text = text.removeprefix("r")
        quote = text[:3] if text[:3] in ('"""', "'''") else text[:1]
        body = text[len(quote) :].removesuffix(quote)
        if not raw:
            for mark, plain in (("\\\\", "\0"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'"), ("\0", "\\")):
                body = body.replace(mark, plain)
        return Typed(F.lit(body), "String")

    _StringNameExpression = _RawStringExpression = _NodePathExpression = _StringExpression

    def _BoolExpression(self, node: Syn) -> Typed:
        return Typed(F.lit(node.value == "true"), "bool")

    def _BracketExpression(self, node: Syn) -> Typed:
        return self.of(node.children[0])

    def _ArrayInitializerExpression(self, node: Syn) -> Typed:
        items = [self.of(c) for c in node.children[0].children]
        kinds = {x.type for x in items}
        kind = kinds.pop() if len(kinds) == 1 else "float" if kinds == {"int", "float"} else "Variant"
        return Typed(F.array(*[x.column for x in items]), f"Array[{kind}]")

    def _DictionaryInitializerExpression(self, node: Syn) -> Typed:
        parts: list[Column] = []
        kinds: list[tuple[str, str]] = []
        for pair in node.children[0].children:
            named = pair.value == "=" and pair.children[0].kind == "IdentifierExpression"
            key = Typed(F.lit(pair.children[0].value), "String") if named else self.of(pair.children[0])
            value = self.of(pair.children[1])
            parts += [key.column, value.column]
            kinds.append((key.type, value.type))
        same = kinds[0] if kinds and len(set(kinds)) == 1 else ("Variant", "Variant")
        return Typed(F.create_map(*parts), f"Dictionary[{same[0]}, {same[1]}]")

    def _IfExpression(self, node: Syn) -> Typed:
        yes, condition, no = (self.of(c) for c in node.children)
        kind = yes.type if yes.type == no.type else "float" if {yes.type, no.type} == {"int", "float"} else "Variant"
        return Typed(F.when(truth(condition), yes.column).otherwise(no.column), kind)

    def _SingleOperatorExpression(self, node: Syn) -> Typed:
        inner = self.of(node.children[0])
        if node.value in ("Not", "Not2"):
            return Typed(~truth(inner), "bool")
        return Typed(-inner.column, inner.type) if node.value == "Negate" else Typed(F.bitwise_not(inner.column), "int")

    def dual(self, name: str, a: Typed, b: Typed) -> Typed:
        """A dual operator over two values."""
        x, y = a.column, b.column
        kind = result_type(name, a.type, b.type)
        both_int = a.type == b.type == "int"
        if name in ("And", "And2"):
            return Typed(truth(a) & truth(b), kind)
        if name in ("Or", "Or2"):
            return Typed(truth(a) | truth(b), kind)
        if name == "In":
            if b.type.startswith("Dictionary"):
                return Typed(F.map_contains_key(y, x), kind)
            return Typed(F.contains(y, x) if b.type == "String" else F.array_contains(y, x), kind)
        if name in ("Equal", "NotEqual"):
            same = x.eqNullSafe(y)
            return Typed(same if name == "Equal" else ~same, kind)
        build: dict[str, Callable[[], Column]] = {
            "LessThan": lambda: x < y, "MoreThan": lambda: x > y, "LessThanOrEqual": lambda: x <= y, "MoreThanOrEqual": lambda: x >= y,
            "Addition": lambda: F.concat(x, y) if kind == "String" or kind.startswith("Array") else x + y,
            "Subtraction": lambda: x - y, "Multiply": lambda: x * y,
            "Division": lambda: F.when(y != 0, F.call_function("div", x, F.when(y != 0, y))) if both_int else F.try_divide(x.cast("double"), y.cast("double")),
            "Mod": lambda: F.call_function("format_string", x, y) if a.type == "String" else F.try_mod(x, y),
            "Power": lambda: F.pow(x, y).cast("bigint") if both_int else F.pow(x, y),
            "BitShiftLeft": lambda: F.call_function("shiftleft", x.cast("bigint"), y.cast("int")), "BitShiftRight": lambda: F.call_function("shiftright", x.cast("bigint"), y.cast("int")),
            "BitwiseAnd": lambda: x.bitwiseAND(y), "BitwiseOr": lambda: x.bitwiseOR(y), "Xor": lambda: x.bitwiseXOR(y),
        }
        return Typed(build[name](), kind)

    def _DualOperatorExpression(self, node: Syn) -> Typed:
        name = node.value or ""
        if name in ("Is", "As"):
            value, wanted = self.of(node.children[0]), node.children[1].value or ""
            if name == "As":
                return Typed(value.column.try_cast(_CASTS[wanted]) if wanted in _CASTS else value.column, wanted)
            same = value.type == wanted or (value.type.startswith(f"{wanted}[") and wanted in ("Array", "Dictionary"))
            return Typed((F.lit(same) & value.column.isNotNull()) if "not" not in node.marks else ~(F.lit(same) & value.column.isNotNull()), "bool")
        out = self.dual(name, self.of(node.children[0]), self.of(node.children[1]))
        return Typed(~out.column, "bool") if "not" in node.marks else out

    def _IndexerExpression(self, node: Syn) -> Typed:
        value, key = self.of(node.children[0]), self.of(node.children[1])
        if value.type.startswith("Dictionary"):
            return Typed(F.try_element_at(value.column, key.column), element_type(value.type))
        if value.type == "String":
            return Typed(catalogue.apply("String", "substr", value.column, key.column, F.lit(1)), "String")
        place = F.when(key.column < 0, key.column + F.size(value.column)).otherwise(key.column)
        return Typed(F.get(value.column, place.cast("int")), element_type(value.type))

    def _MemberOperatorExpression(self, node: Syn) -> Typed:
        value = self.of(node.children[0])
        if value.type.startswith("Dictionary"):
            return Typed(F.try_element_at(value.column, F.lit(node.value)), element_type(value.type))
        return Typed(value.column[node.value or ""], "Variant")

    def _MethodExpression(self, node: Syn) -> Typed:
        params = [p.value or "" for p in (node.child("ParametersList") or Syn("")).children]
        kinds = [next((c.value or "Variant" for c in p.children if c.kind.endswith("TypeNode")), "Variant") for p in (node.child("ParametersList") or Syn("")).children]
        body = node.child("StatementsList")
        last = body.children[0].children[0] if body and len(body.children) == 1 and body.children[0].children else None
        if last is None or last.kind != "ReturnExpression" or not last.children:
            raise ValueError("a lambda over data is one return")

        def call(*columns: Column) -> Column:
            inner = Compiler(self.scope | {n: Typed(c, k) for n, k, c in zip(params, kinds, columns, strict=True)})
            out = inner.of(last.children[0])
            return out.column

        return Typed(None, "Callable", call)

    def _CallExpression(self, node: Syn) -> Typed:
        what, given = node.children[0], [self.of(c) for c in node.children[1].children]
        args = [x.function or x.column for x in given]
        if what.kind == "IdentifierExpression":
            if what.value in _CASTS:  # a conversion: int("3"), str(...)
                return self.convert(what.value or "", given[0])
            f = catalogue.FUNCTIONS.get(("global", what.value or ""))
            if f is None:
                raise ValueError(f"unknown function: {what.value}")
            kind = f.type
            if kind == "Variant" and given:
                kind = "float" if any(x.type == "float" for x in given) else given[0].type
                if what.value in ("floor", "ceil", "round", "sign") and kind == "float":
                    return Typed(catalogue.apply("global", what.value, *args).cast("double"), "float")
            return Typed(catalogue.apply("global", what.value or "", *args), "Array[int]" if what.value == "range" else kind)
        if what.kind != "MemberOperatorExpression":
            raise ValueError(f"not a function: {what.text()!r}")
        value = self.of(what.children[0])
        owner = "Array" if value.type.startswith(("Array", "Packed")) else "Dictionary" if value.type.startswith("Dictionary") else "String"
        if (owner, what.value) not in catalogue.FUNCTIONS:
            raise ValueError(f"{owner} has no function {what.value}")
        kind = catalogue.FUNCTIONS[owner, what.value or ""].type
        if owner != "String" and (kind in ("void", "Array", "Dictionary") or (owner, what.value) in CHANGING):
            kind = value.type  # the changed value
            if (owner, what.value) in (("Dictionary", "keys"), ("Dictionary", "values")):
                inner = kind[kind.index("[") + 1 : -1].split(", ") if "[" in kind else ["Variant"]
                kind = f"Array[{inner[0 if what.value == 'keys' else -1]}]"
        elif kind == "Variant":
            kind = element_type(value.type)
        return Typed(catalogue.apply(owner, what.value or "", value.column, *args), kind)

    @staticmethod
    def convert(kind: str, value: Typed) -> Typed:
        if kind == "int" and value.type == "String":
            return Typed(catalogue.apply("String", "to_int", value.column), "int")
        if kind == "float" and value.type == "String":
            return Typed(catalogue.apply("String", "to_float", value.column), "float")
        return Typed(truth(value) if kind == "bool" else value.column.cast(_CASTS[kind]), "String" if kind == "StringName" else kind)


def scope_of(df: DataFrame) -> dict[str, Typed]:
    wide = {"int": "bigint", "float": "double"}
    return {f.name: Typed(F.col(f.name).cast(wide[k]) if (k := type_name(f.dataType)) in wide else F.col(f.name), k) for f in df.schema.fields}


def column(text: str, scope: dict[str, Typed]) -> Typed:
    """One expression as a typed column."""
    return Compiler(scope).of(syntax.expression(text))


def evaluate(df: DataFrame, **expressions: str) -> DataFrame:
    """One column for every expression over the columns of ``df``."""
    scope = scope_of(df)
    return df.select(*[column(text, scope).column.alias(name) for name, text in expressions.items()])


def assigned(text: str, scope: dict[str, Typed]) -> tuple[str, Typed]:
    """The variable of an assignment and its new value."""
    tree = syntax.statement(text)
    node = tree.children[0] if tree and tree.children else None
    if node is None or node.kind != "DualOperatorExpression" or not (node.value == "Assignment" or (node.value or "").endswith("AndAssign")):
        raise ValueError(f"not an assignment: {text!r}")
    compiler = Compiler(scope)
    value = compiler.of(node.children[1])
    if node.value != "Assignment":
        stem = (node.value or "").removesuffix("AndAssign")
        name = {"Add": "Addition", "Subtract": "Subtraction", "Divide": "Division"}.get(stem, stem)
        value = compiler.dual(name, compiler.of(node.children[0]), value)
    return node.children[0].value or "", value


def assign(df: DataFrame, *statements: str) -> DataFrame:
    """``df`` after assignments, plain and compound, one after another."""
    for text in statements:
        name, value = assigned(text, scope_of(df))
        df = df.withColumn(name, value.column)
    return df
