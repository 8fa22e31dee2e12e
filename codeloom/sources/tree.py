"""Source trees: walk, ignore rules, reading."""

from __future__ import annotations

import fnmatch
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import ship
from codeloom.sources import vcs

# fixed values: extensions of the indexed languages
LANGUAGES = {"rs": "rust", "go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "swift": "swift", "cs": "csharp"}


def language_column(path: str = "path"):
    """Language by the text after the last dot; null drops the file."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(known, F.element_at(F.split(F.col(path), r"\."), -1))


class Ignore:
    """Ignore patterns of one folder, last match wins."""

    def __init__(self, lines: list[str], base: str = ""):
        self.rules = []
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            body = line[keep:].lstrip("\\")
            only_dir = body.endswith("/")
            body = body.rstrip("/")
            anchored = "/" in body
            self.rules.append((keep, only_dir, self._pattern(body.lstrip("/"), anchored, base)))

    @staticmethod
    def _pattern(body: str, anchored: bool, base: str):
        out = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or (fnmatch.translate(p)[4:-3] if p.startswith("[") else re.escape(p)) for p in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|[^*?\[]+|.", body))
        lead = re.escape(base + "/") if base else ""
        return re.compile(lead + ("" if anchored else "(?:.*/)?") + out + r"\Z")

    def match(self, path: str, is_dir: bool) -> bool | None:
        found = None
        for keep, only_dir, pattern in self.rules:
            if (is_dir or not only_dir) and pattern.match(path):
                found = not keep
        return found


def walk(root: str) -> list[str]:
    """Root-relative paths of visible files that no ignore file excludes, sorted.

    Hidden entries and the index folder are skipped.  ``.ignore`` and
    ``.gitignore`` of every folder, ``.git/info/exclude`` and the user's own
    ignore file count, the first most.  Runs on the driver: a checkout is
    one machine's folder.  Collections on a cluster are read with
    ``read_collection``.
    """
    rules: list[Ignore] = []
    for exclude in (vcs.excludes_file(root), Path(root, ".git/info/exclude")):
        if exclude and exclude.is_file():
            rules.append(Ignore(exclude.read_text(errors="replace").splitlines()))
    found: list[str] = []

    def visit(rel: str, rules: list[Ignore]) -> None:
        here = Path(root, rel) if rel else Path(root)
        for own in (here / ".gitignore", here / ".ignore"):
            if own.is_file():
                rules = [*rules, Ignore(own.read_text(errors="replace").splitlines(), rel)]
        for entry in sorted(os.scandir(here), key=lambda e: e.name):
            if entry.name.startswith("."):
                continue
            path = f"{rel}/{entry.name}" if rel else entry.name
            verdict = None
            for r in rules:
                v = r.match(path, entry.is_dir(follow_symlinks=False))
                verdict = verdict if v is None else v
            if verdict:
                continue
            if entry.is_dir(follow_symlinks=False):
                visit(path, rules)
            elif entry.is_file():
                found.append(path)

    visit("", rules)
    return found


def read_tree(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    """``path, language, content, content_hash, error`` of a checkout's source files.

    Content is decoded on the executors; a text that is not UTF-8 has null
    content and an error.
    """
    ship(spark)
    paths = [p for p in walk(root) if p.rsplit(".", 1)[-1] in LANGUAGES and (language is None or LANGUAGES[p.rsplit(".", 1)[-1]] == language)]
    if not paths:
        return spark.createDataFrame([], "path string, language string, content string, content_hash string, error string")
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 200, 10_000)))

    def load(batches):
        import pyarrow as pa

        for b in batches:
            texts, errors = [], []
            for p in b.column("path").to_pylist():
                try:
                    texts.append(Path(root, p).read_bytes().decode("utf-8"))
                    errors.append(None)
                except (OSError, UnicodeDecodeError) as e:
                    texts.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    got = listed.mapInArrow(load, "path string, content string, error string")
    return got.select("path", language_column().alias("language"), "content", F.sha2("content", 256).alias("content_hash"), "error")


def read_collection(spark: SparkSession, root: str) -> DataFrame:
    """The same columns from a folder on any file system, read by the executors.

    Hidden paths are skipped; ignore files don't apply to collections.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", r"^.*?" + re.escape(re.sub(r"^\w+:/*", "/", base)) + "/", "")
    df = raw.select(rel.alias("path"), "content").withColumn("language", language_column())
    df = df.where(F.col("language").isNotNull() & ~F.col("path").rlike(r"(^|/)\."))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return df.select("path", "language", text.alias("content"), F.sha2("content", 256).alias("content_hash"), F.when(text.isNull(), "invalid UTF-8").alias("error"))
