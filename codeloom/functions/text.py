"""Scalar functions with the index's string semantics, all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Folds A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def sqlite_like(c: Column, pattern: str) -> Column:
    """``LIKE`` without escape: ASCII-case-insensitive, ``%`` and ``_`` live.

    A pattern that is plain text between ``%`` becomes a substring, prefix or
    equality test, which Parquet statistics and codegen like better than a
    regular expression.
    """
    folded = "".join(x.lower() if x in _UPPER else x for x in pattern)
    inner = folded.strip("%")
    if "%" not in inner and "_" not in inner:
        lead, tail = folded.startswith("%"), folded.endswith("%")
        low = ascii_lower(c)
        if not inner:
            return c.isNotNull() if folded else c == ""
        if lead and tail:
            return low.contains(inner)
        if lead:
            return low.endswith(inner)
        return low.startswith(inner) if tail else low == inner
    body = "".join(".*" if x == "%" else "." if x == "_" else re.escape(x) for x in folded)
    return ascii_lower(c).rlike(f"(?s)^{body}$")


def java_regex(pattern: str) -> str:
    """Named groups as the JVM spells them; a pattern that it can't compile raises ValueError."""
    made = pattern.replace("(?P<", "(?<")
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(made)
    except IllegalArgumentException as e:
        raise ValueError(f"invalid regex: {e}") from None
    return made


def grep(c: Column, pattern: str) -> Column:
    """Unanchored match."""
    return c.rlike(java_regex(pattern))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def elide(c: Column, width: int = 60) -> Column:
    """At most ``width`` characters, cut at the right."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c)


def elide_left(c: Column, width: int = 60) -> Column:
    """At most ``width`` characters, cut at the left."""
    return F.when(F.length(c) > width, F.concat(F.lit("…"), F.right(c, F.lit(width - 1)))).otherwise(c)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def display_name(scope: Column, name: Column) -> Column:
    return F.when(F.coalesce(scope, F.lit("")) != "", F.concat_ws(".", scope, name)).otherwise(name)


def rel_path(path: Column, root: str) -> Column:
    """Root-relative, ``/``-separated."""
    return F.translate(F.substring(path, len(root.rstrip("/")) + 2, 1 << 20), "\\", "/")


def short_commit(c: Column) -> Column:
    return F.substring(c, 1, 7)


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\"'`]+|[\"'`]+$", "")


def mermaid_escape(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit("#quot;"))


def target(c: Column, extensions: Iterable[str]) -> Column:
    """``name, scope, file`` that an argument names: ``path:name``, a path, ``Scope.name`` or a name.

    A last colon splits file and name; what has a slash or ends in a known
    extension is a path; of two parts around one dot the first is the scope.
    """
    head, tail = F.regexp_extract(c, r"(?s)^(.+):([^:]+)$", 1), F.regexp_extract(c, r"(?s)^(.+):([^:]+)$", 2)
    ext = F.regexp_extract(c, r"\.([^.]*)$", 1)
    dotted = r"(?s)^([^.]+)\.([^.]+)$"
    none = F.lit(None).cast("string")
    made = lambda n, s, f: F.struct(n.alias("name"), s.alias("scope"), f.alias("file"))
    return (
        F.when(c.isNull(), F.lit(None).cast("struct<name:string,scope:string,file:string>"))
        .when(tail != "", made(tail, none, head))
        .when(c.contains("/") | ext.isin(list(extensions)), made(none, none, c))
        .when(c.rlike(dotted), made(F.regexp_extract(c, dotted, 2), F.regexp_extract(c, dotted, 1), none))
        .otherwise(made(c, none, none))
    )


def content_hash(c: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2(c, 256)


def body_slice(content: Column, line: Column, end_line: Column) -> Column:
    """Lines ``line..end_line`` of a text (end 0: that one line); null past its end."""
    return line_slice(F.split(content, "\r?\n"), line, end_line)


def line_slice(lines: Column, line: Column, end_line: Column) -> Column:
    """``body_slice`` of a text already split."""
    upto = F.when(end_line > 0, end_line).otherwise(line)
    return F.when(
        (line >= 1) & (line <= F.size(lines)), F.array_join(F.slice(lines, line.cast("int"), F.greatest(upto - line + 1, F.lit(0)).cast("int")), "\n")
    )
