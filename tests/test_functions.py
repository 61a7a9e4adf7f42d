"""The function catalogue and expressions over rows."""

from __future__ import annotations

import pytest

from quarry.functions import catalogue
from quarry.functions.evaluate import assign, column, evaluate, scope_of
from quarry.plans import function_queries
from quarry.sources import syntax


def value(spark, text, **scope):
    df = spark.createDataFrame([tuple(scope.values())], list(scope)) if scope else spark.range(1)
    return evaluate(df, v=text).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5), ("7 / 0", None), ("2 ** 3 ** 2", 512), ("-2 ** 2", -4), ("7 % 3", 1), ("-7 % 3", -1), ("1 + 2 * 3 - 4", 3), ("1 << 4 | 1", 17),
        ("1 if [] else 2", 2), ("not 0", True), ("\"\" or 1", True), ("3 in [1, 3]", True), ("3 not in [1, 3]", False), ("\"b\" in \"abc\"", True), ("\"k\" in {\"k\": 1}", True), ("{a = 1, b = 2}.b", 2),
        ("\"a\\n\" + r\"\\n\"", "a\n\\n"), ("[1, 2, 3][-1]", 3), ("\"abc\"[-1]", "c"), ("\"%s-%s\" % \"x\"", None), ("\"12ab3.9\".to_int()", 123), ("\"x\" as int", None), ("int(\"41\") + 1", 42), ("1 is int", True), ("1 is not int", False), ("0x1F + 0b11", 34),
        ("[3, 1, 2].sort_custom(func(a, b): return a > b)", [3, 2, 1]), ("[1, 2, 3].reduce(func(a, x): return a + x, 10)", 16), ("[1, 2, 3].map(func(x): return x * x).filter(func(x): return x > 1)", [4, 9]),
        ("[1, 2, 3, 4].slice(-1, 0, -2)", [4, 2]), ("range(5, 0, -2)", [5, 3, 1]), ("range(0)", []), ("\"a,b,c\".split(\",\", true, 1)", ["a", "b,c"]), ("\"a,b,c\".rsplit(\",\", true, 1)", ["a,b", "c"]), ("[1, 2, 1].erase(1)", [2, 1]),
        ("\"../a/../../b\".simplify_path()", "../../b"), ("\"res://a/./b/../c\".simplify_path()", "res://a/c"), ("\"abc\".similarity(\"abd\")", 0.5), ("wrapi(-1, 0, 5)", 4), ("fposmod(-1.5, 1.0)", 0.5), ("snappedf(7.3, 0.5)", 7.5), ("\"-5.7\".pad_zeros(3)", "-005.7"),
        ("\"moveLocal_x\".capitalize()", "Move Local X"), ("\"::1\".is_valid_ip_address()", True), ("\"256.1.1.1\".is_valid_ip_address()", False), ("\"{0} {1} {2}\".format([1, 2])", "1 2 {2}"), ("clamp(5, 1, 3)", 3),
    ],
)
def test_expressions(spark, text, want):
    if text.startswith("\"%s-%s"):
        with pytest.raises(Exception):
            value(spark, text)
    else:
        assert value(spark, text) == want


def test_nulls_give_null(spark):
    df = spark.createDataFrame([(None, None, None, None)], "s string, n bigint, a array<bigint>, m map<string,bigint>")
    texts = ["s.to_upper()", "s.find(\"a\")", "s.similarity(\"ab\")", "s + \"a\"", "n + 1", "n / 2", "a.size()", "a.map(func(x): return x)", "m.size()", "clamp(n, 1, 2)", "s.hash()", "s.simplify_path()"]
    for text in texts:
        assert evaluate(df, v=text).first().v is None, text


def test_assignments(spark):
    df = spark.createDataFrame([(7, "a")], "n bigint, s string")
    row = assign(df, "n += 3", "n /= 4", "s += \"b\"", "t = n * 10").first()
    assert (row.n, row.s, row.t) == (2, "ab", 20)
    with pytest.raises(ValueError):
        assign(df, "n + 1")


@pytest.mark.parametrize("text", ["nothing", "f(1)", "$Node", "s.nothing()", "x.y()", "print(1)", "\"a\".left()", "\"a\".left(1, 2)", "func(): pass", "1 +"])
def test_what_has_no_meaning_is_an_error(spark, text):
    with pytest.raises(ValueError):
        column(text, scope_of(spark.range(1)))


def test_catalogue(spark):
    rows = {(r.owner, r.name): r for r in catalogue.table(spark).collect()}
    assert len(rows) == len(catalogue.FUNCTIONS)
    assert (rows["String", "substr"].least, rows["String", "substr"].most, rows["String", "substr"].type) == (1, 2, "String")
    assert rows["global", "print"].most is None and not rows["global", "print"].over_data
    queried = {("String", n) for n in function_queries.STRING} | {("Array", n) for n in function_queries.ARRAY} | {("Dictionary", n) for n in function_queries.DICTIONARY} | {("global", n) for n in function_queries.MATH}
    over_data = {k for k, f in catalogue.FUNCTIONS.items() if f.build is not None}
    assert over_data - queried <= {("global", "str_to_var"), ("global", "bytes_to_var"), ("global", "assert")}


def test_every_operator_is_queried():
    asked = {n for entries in (function_queries.OPERATORS, function_queries.ASSIGNMENTS) for n in entries}
    assert set(syntax.DUAL.values()) | set(syntax.SINGLE.values()) <= asked
    for name, (text, _) in (function_queries.OPERATORS | function_queries.ASSIGNMENTS).items():
        tree = syntax.statement(text)
        assert name in ("IfExpression", "Indexer", "Null") or any(n.value == name for n in tree.walk())
