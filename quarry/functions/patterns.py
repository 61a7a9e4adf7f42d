"""Globs, paths and fixed regular expressions as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_glob_regex(glob: str) -> str:
    """``*`` is any text, ``?`` one character; anchored, case-insensitive."""
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def path_glob_regex(glob: str) -> str:
    """Segments match ``*`` and ``?`` within themselves, ``**`` any number of them; no wildcard means a folder prefix."""
    glob = glob.strip("/")
    if not re.search(r"[*?]", glob):
        return f"(?i)^{re.escape(glob)}(/.*)?$"
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[at], re.escape(glob[at]))
            at += 1
    return f"(?i)^{out}$"


def matches_any(column: Column, globs: list[str]) -> Column:
    """True where any path glob matches (false without globs)."""
    return column.rlike("|".join(path_glob_regex(g) for g in globs)) if globs else F.lit(False)


def directory(column: Column, depth: int) -> Column:
    """The first ``depth`` segments of a path."""
    return F.array_join(F.slice(F.split(column, "/"), 1, depth), "/")


def url_path(column: Column) -> Column:
    return F.regexp_extract(column, r"^[a-z]+://[^/]+/([^?#]*)", 1)
