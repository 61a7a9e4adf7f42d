"""The language's built-in functions: names, arities, result types, and what they are as Spark expressions.

``table`` gives the catalogue as rows to join call sites with.  Functions that
have a meaning over data have a builder from columns to a column; those that
change a value in place give the changed value.  Defined results: a null
value (first argument) gives null, but for those that ask about null; positions out of range give the empty text, null or -1,
as the function says; texts are counted in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANY = 99


@dataclass(frozen=True)
class Function:
    owner: str
    name: str
    least: int
    most: int
    type: str
    build: Callable[..., Column] | None = None


def _call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def _text(c: Column) -> Column:
    return c.cast("string")


def _literal(pattern: Column) -> Column:
    """A text as a pattern that matches it alone."""
    return F.regexp_replace(pattern, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def _glob(pattern: Column, fold: bool) -> Column:
    body = F.replace(F.replace(_literal(pattern), F.lit(r"\*"), F.lit(".*")), F.lit(r"\?"), F.lit("."))
    return F.concat(F.lit("(?is)^" if fold else "(?s)^"), body, F.lit("$"))


def _find(s: Column, what: Column, start: Column | None = None) -> Column:
    return _call("locate", what, s, F.coalesce(start, F.lit(0)) + 1 if start is not None else F.lit(1)) - 1


def _rfind(s: Column, what: Column) -> Column:
    back = _call("locate", F.reverse(what), F.reverse(s))
    return F.when(back == 0, -1).otherwise(F.length(s) - back - F.length(what) + 1)


def _count(s: Column, what: Column) -> Column:
    size = F.length(what)
    return F.when(size == 0, 0).otherwise(_call("div", F.length(s) - F.length(F.replace(s, what, F.lit(""))), F.greatest(size, F.lit(1))))


def _words(s: Column) -> Column:
    """Words by capitals, underscores, dashes and blanks, in lower case."""
    cut = F.regexp_replace(F.regexp_replace(s, r"(\p{Ll}|\d)(\p{Lu})", "$1 $2"), r"[_\-\s]+", " ")
    return F.filter(F.split(F.lower(F.trim(cut)), " "), lambda w: w != "")


def _titled(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))


def _pascal(s: Column) -> Column:
    return F.array_join(F.transform(_words(s), _titled), "")


def _substr(s: Column, start: Column, length: Column | None = None) -> Column:
    begin = F.when(start < 0, start + F.length(s)).otherwise(start)
    size = F.length(s) if length is None else F.when(length < 0, F.length(s)).otherwise(length)
    return F.when(begin >= F.length(s), F.lit("")).otherwise(s.substr(begin.cast("int") + 1, size.cast("int")))


def _left(s: Column, n: Column) -> Column:
    return s.substr(F.lit(1), F.greatest(F.when(n < 0, F.length(s) + n).otherwise(n), F.lit(0)).cast("int"))


def _right(s: Column, n: Column) -> Column:
    size = F.least(F.greatest(F.when(n < 0, F.length(s) + n).otherwise(n), F.lit(0)), F.length(s)).cast("int")
    return s.substr(F.length(s) - size + 1, size)


def _strip(s: Column, left: Column | None = None, right: Column | None = None) -> Column:
    """White space and control characters off the ends that are asked for."""
    on = lambda c: F.lit(True) if c is None else c
    s = F.when(on(left), F.regexp_replace(s, r"^[\x00-\x20]+", "")).otherwise(s)
    return F.when(on(right), F.regexp_replace(s, r"[\x00-\x20]+$", "")).otherwise(s)


def _pieces(s: Column, by: Column, empty: Column | None = None) -> Column:
    parts = F.when(by == "", F.split(s, "")).otherwise(_call("split", s, _literal(by)))
    return parts if empty is None else F.when(empty, parts).otherwise(F.filter(parts, lambda x: x != ""))


def _limited(s: Column, by: Column, empty: Column | None = None, most: Column | None = None) -> Column:
    if most is None:
        return _pieces(s, by, empty)
    return F.when(most > 0, _call("split", s, _literal(by), most.cast("int") + 1)).otherwise(_pieces(s, by, empty))


def _rlimited(s: Column, by: Column, empty: Column | None = None, most: Column | None = None) -> Column:
    parts = _pieces(s, by, empty)
    if most is None:
        return parts
    head = F.size(parts) - most.cast("int")
    first = F.array_join(F.slice(parts, F.lit(1), F.greatest(head, F.lit(1))), " ").substr(F.lit(1), F.lit(0))
    joined = F.aggregate(F.slice(parts, F.lit(1), F.greatest(head, F.lit(1))), first.cast("string"), lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, by, x)))
    return F.when((most > 0) & (head > 1), F.concat(F.array(joined), F.slice(parts, F.greatest(head, F.lit(1)) + 1, most.cast("int")))).otherwise(parts)


def _format(s: Column, values: Column) -> Column:
    """{0}, {1}, ... replaced by the values of an array."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0))), s, lambda acc, i: F.replace(acc, F.concat(F.lit("{"), i.cast("string"), F.lit("}")), F.coalesce(F.get(values, i).cast("string"), F.concat(F.lit("{"), i.cast("string"), F.lit("}")))))


def _pad_zeros(s: Column, n: Column) -> Column:
    """Zeros before the whole part of a number's text."""
    sign, digits = F.regexp_extract(s, r"^(-?)", 1), F.regexp_extract(s, r"^-?(\d*)", 1)
    rest = F.regexp_replace(s, r"^-?\d*", "")
    return F.concat(sign, F.repeat(F.lit("0"), F.greatest(n.cast("int") - F.length(digits), F.lit(0))), digits, rest)


def _pad_decimals(s: Column, n: Column) -> Column:
    whole, part = F.regexp_extract(s, r"^([^.]*)", 1), F.regexp_extract(s, r"\.(.*)$", 1)
    size = n.cast("int")
    return F.when(size <= 0, whole).otherwise(F.concat(whole, F.lit("."), F.rpad(part, size, F.lit("0"))))


def _pad(s: Column, n: Column, fill: Column, left: bool) -> Column:
    more = F.repeat(fill, F.greatest(n.cast("int") - F.length(s), F.lit(0)))
    return F.concat(more, s) if left else F.concat(s, more)


def _number_prefix(s: Column) -> Column:
    return F.regexp_extract(F.trim(s), r"^([+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)", 1)


def _to_int(s: Column) -> Column:
    """The digits before the first dot, whatever stands between them."""
    whole = F.regexp_extract(s, r"^([^.]*)", 1)
    digits = F.regexp_replace(whole, r"\D", "")
    signed = F.concat(F.when(F.regexp_extract(whole, r"^\D*?(-)\d", 1) == "-", "-").otherwise(""), digits)
    return F.coalesce(signed.try_cast("bigint"), F.lit(0))


def _from_base(s: Column, base: int, prefix: str) -> Column:
    body = F.regexp_replace(s, f"^(-?)(?:{prefix})", "$1")
    return F.coalesce(F.conv(F.regexp_replace(body, "^-", ""), base, 10).try_cast("bigint"), F.lit(0)) * F.when(body.startswith("-"), -1).otherwise(1)


def _hash(s: Column) -> Column:
    """The times-33 hash of code points, from 5381 on, in 32 bits."""
    points = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(points, F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def _bigrams(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: s.substr(i, F.lit(2)))


def _similarity(a: Column, b: Column) -> Column:
    """Twice the shared bigrams by all bigrams, each of the first text's counted if the second has it."""
    x, y = _bigrams(a), _bigrams(b)
    shared = F.size(F.filter(x, lambda g: F.array_contains(y, g))).cast("double")
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(shared * 2.0 / (F.size(x) + F.size(y)))


def _subsequence(a: Column, b: Column) -> Column:
    """Whether b holds a's characters in order: one walk over b with what is left of a."""
    left = F.aggregate(F.split(b, ""), a, lambda rest, c: F.when((rest != "") & (F.substring(rest, 1, 1) == c), rest.substr(F.lit(2), F.greatest(F.length(rest), F.lit(1)))).otherwise(rest))
    return left == ""


def _chain(s: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, s)


_C = [("\\", "\\\\"), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v"), ("'", "\\'"), ('"', '\\"')]
_XML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
_MARK = ""


def _c_unescape(s: Column) -> Column:
    held = F.replace(s, F.lit("\\\\"), F.lit(_MARK))
    return F.replace(_chain(held, [(b, a) for a, b in _C[1:]]), F.lit(_MARK), F.lit("\\"))


def _xml_escape(s: Column, quotes: Column | None = None) -> Column:
    plain = _chain(s, _XML)
    return plain if quotes is None else F.when(quotes, _chain(plain, [("'", "&apos;"), ('"', "&quot;")])).otherwise(plain)


def _json_escape(s: Column) -> Column:
    return _chain(s, [("\\", "\\\\"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v"), ('"', '\\"')])


def _base_dir(s: Column) -> Column:
    return F.when(s.rlike(r"^\w+://[^/]*$"), F.regexp_extract(s, r"^(\w+://)", 1)).when(s.rlike("^/[^/]*$"), "/").otherwise(F.regexp_extract(s, r"^(.*)/[^/]*$", 1))


def _simplify(s: Column) -> Column:
    """Without empty parts, ``.`` and ``..`` that has a part before it."""
    head = F.regexp_extract(s, r"^(\w+://|/)", 1)
    parts = F.filter(F.split(F.replace(F.regexp_replace(s, r"^(\w+://|/)", ""), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(head, F.array_join(kept, "/"))


def _insert(s: Column, at: Column, what: Column) -> Column:
    return F.concat(_left(s, at), what, _substr(s, at))


def _erase(s: Column, at: Column, n: Column) -> Column:
    return F.concat(_left(s, at), _substr(s, at + n))


_IP4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"
_IP6 = r"(?i)^(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=.*::)(?!.*::.*::)([0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4})$"
_BAD_FILE = r'[:/\\?*"|%<>]'


def _encoded(name: str) -> Callable[[Column], Column]:
    return lambda s: F.encode(s, name)


# Arity, result type and meaning of the functions of a text.
STRING: dict[str, tuple[str, str, Callable[..., Column] | None]] = {
    "to_upper": ("0", "String", F.upper),
    "to_lower": ("0", "String", F.lower),
    "capitalize": ("0", "String", lambda s: F.array_join(F.transform(_words(s), _titled), " ")),
    "to_camel_case": ("0", "String", lambda s: F.concat(F.lower(F.substring(_pascal(s), 1, 1)), _pascal(s).substr(F.lit(2), F.length(s)))),
    "to_pascal_case": ("0", "String", _pascal),
    "to_snake_case": ("0", "String", lambda s: F.array_join(_words(s), "_")),
    "strip_edges": ("0..2", "String", _strip),
    "strip_escapes": ("0", "String", lambda s: F.regexp_replace(s, r"[\x00-\x1f]", "")),
    "lstrip": ("1", "String", lambda s, c: F.ltrim(s, c)),
    "rstrip": ("1", "String", lambda s, c: F.rtrim(s, c)),
    "dedent": ("0", "String", lambda s: F.regexp_replace(s, r"(?m)^[ \t]+", "")),
    "indent": ("1", "String", lambda s, p: F.regexp_replace(s, F.lit(r"(?m)^(?=.)"), p)),
    "substr": ("1..2", "String", _substr),
    "left": ("1", "String", _left),
    "right": ("1", "String", _right),
    "get_slice": ("2", "String", lambda s, by, n: F.coalesce(F.get(_pieces(s, by), n.cast("int")), F.lit(""))),
    "get_slice_count": ("1", "int", lambda s, by: F.size(_pieces(s, by)).cast("bigint")),
    "find": ("1..2", "int", _find),
    "findn": ("1..2", "int", lambda s, w, at=None: _find(F.lower(s), F.lower(w), at)),
    "rfind": ("1..2", "int", lambda s, w, at=None: _rfind(s if at is None else _left(s, at + F.length(w)), w)),
    "rfindn": ("1..2", "int", lambda s, w, at=None: _rfind(F.lower(s if at is None else _left(s, at + F.length(w))), F.lower(w))),
    "count": ("1..3", "int", lambda s, w, a=None, b=None: _count(_substr(s, a or F.lit(0), None if b is None else b - (a or F.lit(0))), w)),
    "countn": ("1..3", "int", lambda s, w, a=None, b=None: _count(F.lower(_substr(s, a or F.lit(0), None if b is None else b - (a or F.lit(0)))), F.lower(w))),
    "contains": ("1", "bool", lambda s, w: F.contains(s, w)),
    "containsn": ("1", "bool", lambda s, w: F.contains(F.lower(s), F.lower(w))),
    "begins_with": ("1", "bool", lambda s, w: F.startswith(s, w)),
    "ends_with": ("1", "bool", lambda s, w: F.endswith(s, w)),
    "match": ("1", "bool", lambda s, p: F.rlike(s, _glob(p, False))),
    "matchn": ("1", "bool", lambda s, p: F.rlike(s, _glob(p, True))),
    "is_subsequence_of": ("1", "bool", _subsequence),
    "is_subsequence_ofn": ("1", "bool", lambda a, b: _subsequence(F.lower(a), F.lower(b))),
    "similarity": ("1", "float", _similarity),
    "replace": ("2", "String", lambda s, a, b: F.replace(s, a, b)),
    "replacen": ("2", "String", lambda s, a, b: F.regexp_replace(s, F.concat(F.lit("(?i)"), _literal(a)), b)),
    "erase": ("2", "String", _erase),
    "insert": ("2", "String", _insert),
    "split": ("1..3", "PackedStringArray", _limited),
    "rsplit": ("1..3", "PackedStringArray", _rlimited),
    "split_floats": ("1..2", "PackedFloat64Array", lambda s, by, e=None: F.transform(_pieces(s, by, e), lambda x: F.coalesce(_number_prefix(x).try_cast("double"), F.lit(0.0)))),
    "join": ("1", "String", lambda s, parts: F.aggregate(parts, F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), lambda acc, x: F.struct(F.when(acc["n"] == 0, x).otherwise(F.concat(acc["t"], s, x)).alias("t"), (acc["n"] + 1).alias("n")), lambda acc: acc["t"])),
    "format": ("1..2", "String", _format),
    "sprintf": ("1", "String", lambda s, x: F.call_function("format_string", s, x)),
    "pad_zeros": ("1", "String", _pad_zeros),
    "pad_decimals": ("1", "String", _pad_decimals),
    "lpad": ("2", "String", lambda s, n, fill: _pad(s, n, fill, True)),
    "rpad": ("2", "String", lambda s, n, fill: _pad(s, n, fill, False)),
    "repeat": ("1", "String", lambda s, n: F.repeat(s, n.cast("int"))),
    "reverse": ("0", "String", F.reverse),
    "is_empty": ("0", "bool", lambda s: s == ""),
    "is_valid_float": ("0", "bool", lambda s: s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")),
    "is_valid_hex_number": ("0..1", "bool", lambda s, p=None: s.rlike(r"^[+-]?[0-9a-fA-F]+$") if p is None else F.when(p, s.rlike(r"^[+-]?0x[0-9a-fA-F]+$")).otherwise(s.rlike(r"^[+-]?[0-9a-fA-F]+$"))),
    "is_valid_html_color": ("0", "bool", lambda s: s.rlike(r"^#?([0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")),
    "is_valid_identifier": ("0", "bool", lambda s: s.rlike(r"^[A-Za-z_]\w*$")),
    "is_valid_int": ("0", "bool", lambda s: s.rlike(r"^[+-]?\d+$")),
    "is_valid_ip_address": ("0", "bool", lambda s: s.rlike(_IP4) | s.rlike(_IP6)),
    "is_valid_filename": ("0", "bool", lambda s: (F.trim(s) == s) & (s != "") & ~s.rlike(_BAD_FILE)),
    "to_int": ("0", "int", _to_int),
    "to_float": ("0", "float", lambda s: F.coalesce(_number_prefix(s).try_cast("double"), F.lit(0.0))),
    "hex_to_int": ("0", "int", lambda s: _from_base(s, 16, "0x")),
    "bin_to_int": ("0", "int", lambda s: _from_base(s, 2, "0b")),
    "to_ascii_buffer": ("0", "PackedByteArray", lambda s: F.encode(F.regexp_replace(s, r"[^\x00-\x7f]", "?"), "US-ASCII")),
    "to_utf8_buffer": ("0", "PackedByteArray", _encoded("UTF-8")),
    "to_utf16_buffer": ("0", "PackedByteArray", _encoded("UTF-16LE")),
    "to_utf32_buffer": ("0", "PackedByteArray", lambda s: F.unhex(F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.regexp_replace(F.lpad(F.hex(F.ascii(c)), 8, "0"), "^(..)(..)(..)(..)$", "$4$3$2$1")), ""))),
    "to_wchar_buffer": ("0", "PackedByteArray", _encoded("UTF-16LE")),
    "hash": ("0", "int", _hash),
    "md5_buffer": ("0", "PackedByteArray", lambda s: F.unhex(F.md5(s))),
    "md5_text": ("0", "String", F.md5),
    "sha1_buffer": ("0", "PackedByteArray", lambda s: F.unhex(F.sha1(s))),
    "sha1_text": ("0", "String", F.sha1),
    "sha256_buffer": ("0", "PackedByteArray", lambda s: F.unhex(F.sha2(s, 256))),
    "sha256_text": ("0", "String", lambda s: F.sha2(s, 256)),
    "c_escape": ("0", "String", lambda s: _chain(s, _C)),
    "c_unescape": ("0", "String", _c_unescape),
    "json_escape": ("0", "String", _json_escape),
    "xml_escape": ("0..1", "String", _xml_escape),
    "xml_unescape": ("0", "String", lambda s: _chain(s, [("&apos;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")])),
    "uri_encode": ("0", "String", lambda s: _chain(F.url_encode(s), [("+", "%20"), ("*", "%2A"), ("%7E", "~")])),
    "uri_decode": ("0", "String", lambda s: F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))),
    "validate_node_name": ("0", "String", lambda s: F.regexp_replace(s, r'[.:@/"%]', "_")),
    "validate_filename": ("0", "String", lambda s: F.regexp_replace(s, _BAD_FILE, "_")),
    "get_base_dir": ("0", "String", _base_dir),
    "get_basename": ("0", "String", lambda s: F.regexp_replace(s, r"\.[^./]*$", "")),
    "get_extension": ("0", "String", lambda s: F.regexp_extract(s, r"\.([^./]*)$", 1)),
    "get_file": ("0", "String", lambda s: F.regexp_extract(s, r"([^/]*)$", 1)),
    "path_join": ("1", "String", lambda s, p: F.when(s == "", p).when(F.endswith(s, F.lit("/")) | F.startswith(p, F.lit("/")), F.concat(s, p)).otherwise(F.concat(s, F.lit("/"), p))),
    "simplify_path": ("0", "String", _simplify),
    "is_absolute_path": ("0", "bool", lambda s: s.rlike(r"^(/|\\|\w+:[/\\])")),
    "is_relative_path": ("0", "bool", lambda s: ~s.rlike(r"^(/|\\|\w+:[/\\])")),
    "unicode_at": ("1", "int", lambda s, n: F.ascii(_substr(s, n, F.lit(1))).cast("bigint")),
    "length": ("0", "int", lambda s: F.length(s).cast("bigint")),
}


def _without(a: Column, at: Column) -> Column:
    """An array without the element at a position (from the end if negative; out of range: as it was)."""
    n = F.size(a)
    place = F.when(at < 0, at + n).otherwise(at).cast("int")
    fine = F.when((place >= 0) & (place < n), place)
    return F.when(fine.isNull(), a).otherwise(F.concat(F.slice(a, F.lit(1), F.coalesce(fine, F.lit(0))), F.slice(a, F.coalesce(fine, F.lit(0)) + 2, n + 1)))


def _position(a: Column, what: Column, start: Column | None = None) -> Column:
    if start is None:
        return F.coalesce(F.array_position(a, what), F.lit(0)) - 1
    rest = F.array_position(F.slice(a, start.cast("int") + 1, F.size(a) + 1), what)
    return F.when(rest > 0, rest - 1 + start).otherwise(F.lit(-1))


def _slice(a: Column, begin: Column, end: Column | None = None, step: Column | None = None, deep: Column | None = None) -> Column:
    """Elements from ``begin`` up to ``end`` (from the end if negative), every ``step``-th, backwards if negative."""
    n = F.size(a)
    by = F.lit(1) if step is None else step.cast("int")
    near = lambda c: F.when(c < 0, c + n).otherwise(c)
    first = F.least(F.greatest(near(begin.cast("int")), F.when(by < 0, -1).otherwise(0)), F.when(by < 0, n - 1).otherwise(n))
    last = F.when(by < 0, -1).otherwise(n) if end is None else F.least(F.greatest(near(end.cast("int")), F.when(by < 0, -1).otherwise(0)), n)
    some = F.when(by > 0, first < last).otherwise(first > last)
    stop = last - F.when(by < 0, -1).otherwise(1)
    places = F.when(some, F.sequence(F.when(some, first).otherwise(0), F.when(some, stop).otherwise(0), F.when(some, by).otherwise(1)))
    return F.when(some, F.transform(places, lambda i: F.get(a, i))).otherwise(F.slice(a, 1, 0))


# Arity, result type and meaning of the functions of an array.
ARRAY: dict[str, tuple[str, str, Callable[..., Column] | None]] = {
    "size": ("0", "int", lambda a: F.size(a).cast("bigint")),
    "is_empty": ("0", "bool", lambda a: F.size(a) == 0),
    "is_read_only": ("0", "bool", lambda a: F.when(a.isNotNull(), False)),
    "resize": ("1", "int", lambda a, n: F.concat(F.slice(a, F.lit(1), F.least(n.cast("int"), F.size(a))), F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(0))), F.lit(1), F.greatest(n.cast("int") - F.size(a), F.lit(0))), lambda i: F.get(a, F.size(a) + i)))),
    "clear": ("0", "void", lambda a: F.slice(a, 1, 0)),
    "front": ("0", "Variant", lambda a: F.get(a, F.lit(0))),
    "back": ("0", "Variant", lambda a: F.try_element_at(a, F.lit(-1))),
    "pick_random": ("0", "Variant", lambda a: F.get(F.shuffle(a), F.lit(0))),
    "append": ("1", "void", lambda a, x: F.array_append(a, x)),
    "append_array": ("1", "void", lambda a, b: F.concat(a, b)),
    "push_back": ("1", "void", lambda a, x: F.array_append(a, x)),
    "push_front": ("1", "void", lambda a, x: F.array_prepend(a, x)),
    "pop_back": ("0", "Variant", lambda a: F.try_element_at(a, F.lit(-1))),
    "pop_front": ("0", "Variant", lambda a: F.get(a, F.lit(0))),
    "pop_at": ("1", "Variant", lambda a, at: F.get(a, F.when(at < 0, at + F.size(a)).otherwise(at).cast("int"))),
    "insert": ("2", "int", lambda a, at, x: F.concat(F.slice(a, F.lit(1), at.cast("int")), F.array(x), F.slice(a, at.cast("int") + 1, F.size(a) + 1))),
    "remove_at": ("1", "void", _without),
    "fill": ("1", "void", lambda a, x: F.transform(a, lambda _: x)),
    "erase": ("1", "void", lambda a, x: F.when(F.array_contains(a, x), _without(a, F.array_position(a, x) - 1)).otherwise(a)),
    "reverse": ("0", "void", F.reverse),
    "shuffle": ("0", "void", lambda a: F.shuffle(a)),
    "find": ("1..2", "int", _position),
    "rfind": ("1..2", "int", lambda a, x, at=None: F.when(F.array_contains(a, x), F.size(a) - F.array_position(F.reverse(a), x)).otherwise(F.lit(-1).cast("bigint"))),
    "count": ("1", "int", lambda a, x: F.size(F.filter(a, lambda y: y.eqNullSafe(x))).cast("bigint")),
    "has": ("1", "bool", lambda a, x: F.array_contains(a, x)),
    "hash": ("0", "int", lambda a: F.xxhash64(a)),
    "slice": ("1..4", "Array", _slice),
    "duplicate": ("0..1", "Array", lambda a, deep=None: a),
    "sort": ("0", "void", lambda a: F.array_sort(a)),
    "sort_custom": ("1", "void", lambda a, f: F.array_sort(a, lambda x, y: F.when(f(x, y), -1).when(f(y, x), 1).otherwise(0))),
    "bsearch": ("1..2", "int", lambda a, x, before=None: F.size(F.filter(a, lambda y: y < x)).cast("bigint") if before is None else F.when(before, F.size(F.filter(a, lambda y: y < x))).otherwise(F.size(F.filter(a, lambda y: y <= x))).cast("bigint")),
    "bsearch_custom": ("2..3", "int", lambda a, x, f, before=None: F.size(F.filter(a, lambda y: f(y, x))).cast("bigint")),
    "map": ("1", "Array", lambda a, f: F.transform(a, lambda x: f(x))),
    "filter": ("1", "Array", lambda a, f: F.filter(a, lambda x: f(x))),
    "reduce": ("1..2", "Variant", lambda a, f, start=None: F.aggregate(a if start is not None else F.slice(a, F.lit(2), F.size(a) + 1), start if start is not None else F.get(a, F.lit(0)), lambda acc, x: f(acc, x))),
    "any": ("1", "bool", lambda a, f: F.exists(a, lambda x: f(x))),
    "all": ("1", "bool", lambda a, f: F.forall(a, lambda x: f(x))),
    "min": ("0", "Variant", F.array_min),
    "max": ("0", "Variant", F.array_max),
    "assign": ("1", "void", lambda a, b: b),
    "make_read_only": ("0", "void", lambda a: a),
}

# The same for dictionaries.
DICTIONARY: dict[str, tuple[str, str, Callable[..., Column] | None]] = {
    "size": ("0", "int", lambda m: F.size(m).cast("bigint")),
    "is_empty": ("0", "bool", lambda m: F.size(m) == 0),
    "is_read_only": ("0", "bool", lambda m: F.when(m.isNotNull(), False)),
    "clear": ("0", "void", lambda m: F.map_filter(m, lambda k, v: F.lit(False))),
    "get": ("1..2", "Variant", lambda m, k, d=None: F.try_element_at(m, k) if d is None else F.when(F.map_contains_key(m, k), F.try_element_at(m, k)).otherwise(d)),
    "has": ("1", "bool", lambda m, k: F.map_contains_key(m, k)),
    "has_all": ("1", "bool", lambda m, ks: F.size(F.array_except(ks, F.map_keys(m))) == 0),
    "keys": ("0", "Array", F.map_keys),
    "values": ("0", "Array", F.map_values),
    "erase": ("1", "bool", lambda m, k: F.map_filter(m, lambda x, _: x != k)),
    "merge": ("1..2", "void", lambda m, o, over=None: F.map_concat(m, F.map_filter(o, lambda k, _: ~F.map_contains_key(m, k))) if over is None else F.when(over, F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(o, k)), o)).otherwise(F.map_concat(m, F.map_filter(o, lambda k, _: ~F.map_contains_key(m, k))))),
    "hash": ("0", "int", lambda m: F.xxhash64(F.array_sort(F.map_entries(m)))),
    "duplicate": ("0..1", "Dictionary", lambda m, deep=None: m),
    "make_read_only": ("0", "void", lambda m: m),
}

# Functions of callables and signals, which have no meaning over data.
CALLABLE: dict[str, tuple[str, str]] = {
    "call": ("0..n", "Variant"), "callv": ("1", "Variant"), "call_deferred": ("0..n", "void"), "bind": ("0..n", "Callable"), "bindv": ("1", "Callable"), "unbind": ("1", "Callable"),
    "get_bound_arguments": ("0", "Array"), "get_bound_arguments_count": ("0", "int"), "is_valid": ("0", "bool"), "is_null": ("0", "bool"), "is_standard": ("0", "bool"), "is_custom": ("0", "bool"),
    "get_method": ("0", "StringName"), "get_object": ("0", "Object"), "get_object_id": ("0", "int"), "get_argument_count": ("0", "int"), "hash": ("0", "int"), "rpc": ("0..n", "void"), "rpc_id": ("1..n", "void"),
}
SIGNAL: dict[str, tuple[str, str]] = {
    "connect": ("1..2", "int"), "disconnect": ("1", "void"), "is_connected": ("1", "bool"), "get_connections": ("0", "Array"), "emit": ("0..n", "void"), "get_name": ("0", "StringName"),
    "get_object": ("0", "Object"), "get_object_id": ("0", "int"), "is_null": ("0", "bool"),
}

_EPSILON = 1e-5
_PI = 3.141592653589793


def _round(x: Column) -> Column:
    """Half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def _near(a: Column, b: Column) -> Column:
    return (a == b) | (F.abs(a - b) < F.greatest(F.abs(a) * _EPSILON, F.lit(_EPSILON)))


def _posmod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null where it is zero."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _wrap(x: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, low).otherwise(_posmod(x - low, high - low) + low)


def _snap(x: Column, step: Column) -> Column:
    return F.when(step == 0, x).otherwise(F.floor(F.try_divide(x, step) + 0.5) * step)


def _towards(a: Column, b: Column, delta: Column) -> Column:
    return F.when(F.abs(b - a) <= delta, b).otherwise(a + F.signum(b - a) * delta)


def _turn(a: Column, b: Column) -> Column:
    """The shortest way from angle a to angle b."""
    apart = F.try_mod(b - a, F.lit(2 * _PI))
    return F.try_mod(apart * 2.0, F.lit(2 * _PI)) - apart


def _step(a: Column, b: Column, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - a, b - a)))
    return F.when(_near(a, b), F.when(x <= a, 0.0).otherwise(1.0)).otherwise(t * t * (F.lit(3.0) - t * 2.0))


def _cubic(a: Column, b: Column, pre: Column, post: Column, t: Column) -> Column:
    return ((a * 2.0) + (b - pre) * t + (pre * 2.0 - a * 5.0 + b * 4.0 - post) * (t * t) + (a * 3.0 - pre - b * 3.0 + post) * (t * t * t)) * 0.5


def _bezier(a: Column, p: Column, q: Column, b: Column, t: Column) -> Column:
    o = F.lit(1.0) - t
    return a * o * o * o + p * o * o * t * 3.0 + q * o * t * t * 3.0 + b * t * t * t


def _range(a: Column, b: Column | None = None, step: Column | None = None) -> Column:
    begin, end = (F.lit(0).cast("bigint"), a.cast("bigint")) if b is None else (a.cast("bigint"), b.cast("bigint"))
    by = F.lit(1).cast("bigint") if step is None else step.cast("bigint")
    some = F.when(by > 0, begin < end).otherwise((by < 0) & (begin > end))
    stop = F.when(by > 0, end - 1).otherwise(end + 1)
    return F.when(some, F.sequence(begin, F.when(some, stop).otherwise(begin), F.when(some, by).otherwise(F.lit(1).cast("bigint")))).otherwise(F.array().cast("array<bigint>"))


def _one(f: Callable[[Column], Column], kind: str | None = None) -> Callable[[Column], Column]:
    return (lambda x: f(x).cast(kind)) if kind else f


def _real(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(x.cast("double"))


# Arity, result type and meaning of the global functions; those with n arguments take columns one by one.
GLOBAL: dict[str, tuple[str, str, Callable[..., Column] | None]] = {
    "print": ("0..n", "void", None), "prints": ("0..n", "void", None), "printt": ("0..n", "void", None), "printraw": ("0..n", "void", None), "print_rich": ("0..n", "void", None), "print_debug": ("0..n", "void", None),
    "printerr": ("1..n", "void", None), "push_error": ("1..n", "void", None), "push_warning": ("1..n", "void", None),
    "str": ("1..n", "String", lambda *xs: F.concat(*[_text(x) for x in xs])),
    "min": ("1..n", "Variant", lambda *xs: F.least(*xs) if len(xs) > 1 else xs[0]),
    "max": ("1..n", "Variant", lambda *xs: F.greatest(*xs) if len(xs) > 1 else xs[0]),
    "randomize": ("0", "void", None),
    "randi": ("0", "int", lambda: F.floor(F.rand() * 4294967296.0).cast("bigint")),
    "randf": ("0", "float", lambda: F.rand()),
    "load": ("1", "Resource", None), "preload": ("1", "Resource", None),
    "abs": ("1", "Variant", F.abs), "absf": ("1", "float", _real(F.abs)), "absi": ("1", "int", lambda x: F.abs(x.cast("bigint"))),
    "ceil": ("1", "Variant", F.ceil), "ceilf": ("1", "float", _one(F.ceil, "double")), "ceili": ("1", "int", _one(F.ceil, "bigint")),
    "floor": ("1", "Variant", F.floor), "floorf": ("1", "float", _one(F.floor, "double")), "floori": ("1", "int", _one(F.floor, "bigint")),
    "round": ("1", "Variant", _round), "roundf": ("1", "float", _one(_round, "double")), "roundi": ("1", "int", _one(_round, "bigint")),
    "sign": ("1", "Variant", F.signum), "signf": ("1", "float", _real(F.signum)), "signi": ("1", "int", lambda x: F.signum(x).cast("bigint")),
    "sqrt": ("1", "float", F.sqrt), "log": ("1", "float", F.ln), "exp": ("1", "float", F.exp),
    "sin": ("1", "float", F.sin), "cos": ("1", "float", F.cos), "tan": ("1", "float", F.tan), "sinh": ("1", "float", F.sinh), "cosh": ("1", "float", F.cosh), "tanh": ("1", "float", F.tanh),
    "asin": ("1", "float", F.asin), "acos": ("1", "float", F.acos), "atan": ("1", "float", F.atan), "asinh": ("1", "float", F.asinh), "acosh": ("1", "float", F.acosh), "atanh": ("1", "float", F.atanh),
    "typeof": ("1", "int", lambda x: F.typeof(x)),
    "weakref": ("1", "Variant", None),
    "hash": ("1", "int", lambda x: F.xxhash64(x)),
    "len": ("1", "int", lambda x: F.length(x).cast("bigint")),
    "deg_to_rad": ("1", "float", F.radians), "rad_to_deg": ("1", "float", F.degrees),
    "is_nan": ("1", "bool", lambda x: F.isnan(x.cast("double"))),
    "is_inf": ("1", "bool", lambda x: F.abs(x.cast("double")) == F.lit(float("inf"))),
    "is_finite": ("1", "bool", lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))),
    "is_zero_approx": ("1", "bool", lambda x: F.abs(x) < _EPSILON),
    "instance_from_id": ("1", "Object", None),
    "is_instance_valid": ("1", "bool", lambda x: x.isNotNull()),
    "is_instance_id_valid": ("1", "bool", None),
    "type_string": ("1", "String", lambda x: F.typeof(x)),
    "var_to_str": ("1", "String", lambda x: F.to_json(F.struct(x.alias("v")))),
    "str_to_var": ("1", "Variant", lambda s: F.try_parse_json(s)),
    "get_stack": ("0", "Array", None),
    "is_instance_of": ("2", "bool", None),
    "atan2": ("2", "float", F.atan2),
    "pow": ("2", "float", F.pow),
    "fmod": ("2", "float", lambda a, b: F.try_mod(a.cast("double"), b.cast("double"))),
    "fposmod": ("2", "float", lambda a, b: _posmod(a.cast("double"), b.cast("double"))),
    "posmod": ("2", "int", lambda a, b: _posmod(a.cast("bigint"), b.cast("bigint"))),
    "is_equal_approx": ("2", "bool", _near),
    "snappedf": ("2", "float", _snap), "snappedi": ("2", "int", lambda x, s: _snap(x, s).cast("bigint")),
    "wrapf": ("3", "float", _wrap), "wrapi": ("3", "int", lambda x, a, b: _wrap(x.cast("bigint"), a.cast("bigint"), b.cast("bigint"))),
    "randi_range": ("2", "int", lambda a, b: (F.floor(F.rand() * (b - a + 1)) + a).cast("bigint")),
    "randf_range": ("2", "float", lambda a, b: F.rand() * (b - a) + a),
    "seed": ("1", "void", None),
    "var_to_bytes": ("1", "PackedByteArray", lambda x: F.encode(F.to_json(F.struct(x.alias("v"))), "UTF-8")),
    "bytes_to_var": ("1", "Variant", lambda b: F.try_parse_json(F.decode(b, "UTF-8"))),
    "clamp": ("3", "Variant", lambda x, a, b: F.greatest(a, F.least(x, b))), "clampf": ("3", "float", lambda x, a, b: F.greatest(a, F.least(x, b))), "clampi": ("3", "int", lambda x, a, b: F.greatest(a, F.least(x, b)).cast("bigint")),
    "lerp": ("3", "Variant", lambda a, b, t: a + (b - a) * t), "lerpf": ("3", "float", lambda a, b, t: a + (b - a) * t),
    "lerp_angle": ("3", "float", lambda a, b, t: a + _turn(a, b) * t),
    "inverse_lerp": ("3", "float", lambda a, b, x: F.try_divide(x - a, b - a)),
    "smoothstep": ("3", "float", _step),
    "move_toward": ("3", "float", _towards),
    "rotate_toward": ("3", "float", lambda a, b, d: F.when(F.abs(_turn(a, b)) <= d, a + _turn(a, b)).otherwise(a + F.signum(_turn(a, b)) * d)),
    "remap": ("5", "float", lambda x, a, b, c, d: c + (d - c) * F.try_divide(x - a, b - a)),
    "bezier_interpolate": ("5", "float", _bezier),
    "cubic_interpolate": ("5", "float", _cubic),
    "assert": ("1..2", "void", lambda c, m=None: F.assert_true(c) if m is None else F.assert_true(c, m)),
    "range": ("1..3", "Array", _range),
}

#: The catalogue's arities where they differ from the language's (which the builders take).
STATED = {"wrapf": "2", "wrapi": "2", "seed": "2", "var_to_bytes": "2", "bytes_to_var": "2", "remap": "4", "bezier_interpolate": "4", "cubic_interpolate": "4"}


def _arity(text: str) -> tuple[int, int]:
    least, _, most = text.partition("..")
    return int(least), MANY if most == "n" else int(most or least)


FUNCTIONS: dict[tuple[str, str], Function] = {
    (owner, name): Function(owner, name, *_arity(spec[0]), spec[1], spec[2] if len(spec) > 2 else None)
    for owner, own in (("String", STRING), ("Array", ARRAY), ("Dictionary", DICTIONARY), ("Callable", CALLABLE), ("Signal", SIGNAL), ("global", GLOBAL))
    for name, spec in own.items()
}


def apply(owner: str, name: str, *args: Column | Callable) -> Column:
    """A built-in function over columns; array functions that take one get a Python function of columns."""
    f = FUNCTIONS[owner, name]
    if f.build is None:
        raise ValueError(f"{owner}.{name} has no meaning over data")
    n = len(args) - (owner != "global")
    if not f.least <= n <= f.most:
        raise ValueError(f"{owner}.{name} takes {f.least} to {f.most} arguments, not {n}")
    built = f.build(*args)
    return F.when(args[0].isNotNull(), built) if owner != "global" or name in ("clamp", "clampf", "clampi") else built


def table(spark: SparkSession, stated: bool = True) -> DataFrame:
    """(owner, name, least, most, type, over_data): one row a function; ``most`` is null where there is no end.

    ``stated`` gives the arities that call checks go by; else those that ``apply`` takes.
    """
    rows = []
    for f in FUNCTIONS.values():
        least, most = _arity(STATED[f.name]) if stated and f.owner == "global" and f.name in STATED else (f.least, f.most)
        rows.append((f.owner, f.name, least, None if most == MANY else most, f.type, f.build is not None))
    return spark.createDataFrame(rows, "owner string, name string, least int, most int, type string, over_data boolean")
