"""Source files that do not parse (problem 5).

Every file is parsed by the grammar of its language and must be consumed whole.
The check is one narrow pass over the texts; only the narrow verdicts are ever
joined or grouped.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.grammars import TEXTS, grammar
from codeloom.llm.peg import Grammar
from codeloom.session import materialize, spread
from codeloom.sources.tree import language_column

_MARKER = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$")
_FIELDS = "valid boolean, line long, column long, cause string"


def verdict(text: str | None, language: str | None, explain: bool = True, elements: bool = False) -> tuple[bool | None, int | None, int | None, str | None]:
    """(valid, line, column, cause) of one text.

    Line is 1-based, column 0-based, both of the furthest failure.  Causes:
    ``unreadable`` (null text), ``merge_conflict``, ``wrong_language`` (more
    than 20 tokens, and another grammar takes it), ``truncated`` (the failure is the end of the
    input), ``unbalanced`` (a bracket without its partner), ``syntax``.  A
    language without grammar gives nulls.  An empty text is valid except in Go,
    which needs a package clause.  Without ``explain`` invalid texts get no
    place and no cause.  With ``elements`` JSX is allowed, as in ``.jsx`` and
    ``.tsx`` files.
    """
    if language not in TEXTS:
        return None, None, None, None
    if text is None:
        return False, None, None, "unreadable"
    sys.setrecursionlimit(1_000_000)  # calls between Python functions take no C stack
    g = grammar(language)
    ok, kinds = _parse(g, text)
    if not ok and elements and (again := g.scanner.rescan_elements(text)) is not None:
        ok, kinds = g.accepts(again), again
    if ok:
        return True, None, None, None
    if not explain:
        return False, None, None, None
    at = g.furthest(kinds)
    line, column, token = g.scanner.place(text, at)
    return False, line, column, _cause(text, language, kinds, at, line, token)


def _parse(g: Grammar, text: str) -> tuple[bool, str]:
    """Whether the grammar takes the text, and its kinds; what fails is scanned once more, exactly."""
    kinds = g.scanner.scan(text)
    if g.accepts(kinds):
        return True, kinds
    again = g.scanner.rescan(text)
    return (False, kinds) if again is None else (g.accepts(again), again)


def _cause(text: str, language: str, kinds: str, at: int, line: int, token: str) -> str:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    marks = [k for k, s in enumerate(lines, 1) if _MARKER.match(s)]
    if marks and marks[0] - 1 <= line <= marks[-1] + 1:
        return "merge_conflict"
    for other in TEXTS if len(kinds) > 20 else ():
        if {other, language} <= {"javascript", "typescript"} and other == "javascript":
            continue
        if other != language and _parse(grammar(other), text)[0]:
            return "wrong_language"
    if not token.strip() or at >= len(kinds) - 1:
        return "truncated"
    return "unbalanced" if token in (")", "]", "}") else "syntax"


def judge(df: DataFrame, keep: list[str], language: str = "language", text: str = "content", explain: bool = True) -> DataFrame:
    """``keep`` columns plus ``valid, line, column, cause``, row by row, no shuffle.

    Where there is a ``path``, ``.jsx`` and ``.tsx`` files may hold JSX.
    """

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [verdict(t, lang, explain, x) for t, lang, x in zip(*(b.column(c).to_pylist() for c in ("_text", "_lang", "_elements")), strict=True)]
            cols = list(zip(*got, strict=True)) or [[]] * 4
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*keep, "valid", "line", "column", "cause"])

    cols = [F.col(f"`{c}`") for c in keep]
    lead = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    elements = F.coalesce(F.col("path").rlike(r"\.[jt]sx$"), F.lit(False)) if "path" in df.columns else F.lit(False)
    return spread(df.select(*cols, F.col(f"`{language}`").alias("_lang"), F.col(f"`{text}`").alias("_text"), elements.alias("_elements"))).mapInArrow(go, f"{lead}, {_FIELDS}")


def check_files(tree: DataFrame, files: DataFrame, explain: bool = True) -> DataFrame:
    """``file_id, repo, language, valid, line, column, cause`` of every text.

    ``language`` is the one in ``files``.  It follows the extension, so texts
    are parsed by the path's extension where they lie and only verdicts meet
    ``files``; rows whose recorded language is another are parsed again.  Texts
    without a row in ``files`` keep the extension's language.  Without
    ``explain`` only ``valid`` is found out.
    """
    lang = files.groupBy(F.col("id").alias("file_id")).agg(F.max("language").alias("_recorded"))
    first = materialize(judge(tree.withColumn("language", language_column()), ["file_id", "repo", "language"], explain=explain), "verdicts")
    both = first.join(lang, "file_id", "left").withColumn("_language", F.coalesce("_recorded", "language"))
    out = ["file_id", "repo", "language", "valid", "line", "column", "cause"]
    other = both.where(~F.col("_language").eqNullSafe(F.col("language"))).select("file_id", F.col("_language").alias("language"))
    agreed = both.where(F.col("_language").eqNullSafe(F.col("language"))).select(*out)
    if other.isEmpty():
        return agreed
    again = judge(tree.select("file_id", "repo", "path", "content").join(other.distinct(), "file_id"), ["file_id", "repo", "language"], explain=explain)
    return agreed.unionByName(again.select(*out))


def rates(verdicts: DataFrame) -> DataFrame:
    """``repo, language, files, files_errored, share`` (files without a grammar left out)."""
    return (
        verdicts.where("valid is not null")
        .groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("files_errored"))
        .withColumn("share", F.col("files_errored") / F.col("files"))
    )
