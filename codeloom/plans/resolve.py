"""Import specifiers to indexed files.

Candidates per import come in priority order from a function of the paths; the
first that is indexed wins (one join and a minimum).  Where the answer depends
on the tree (package roots, crate roots), each directory's root is found by
joining its ancestors once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import parent_dir

# fixed values: extensions a script import may stand for, in order
SCRIPT = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def normalize(base: str, rel: str) -> str | None:
    """``base/rel`` without ``.`` and ``..``; None where it climbs above the root."""
    out = [p for p in base.split("/") if p]
    for p in rel.split("/"):
        if p == "..":
            if not out:
                return None
            out.pop()
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def _join(*parts: str) -> str:
    return "/".join(p for p in parts if p)


def _split(path: str) -> tuple[str, str]:
    head, _, name = path.rpartition("/")
    return head, name


def candidates(source: str, language: str, specifier: str, package_root: str | None, crate_root: str | None) -> list[str]:
    """Paths a specifier may name, best first.

    ``package_root``: nearest directory at or above the importer's that is no
    package; ``crate_root``: nearest one with a crate's main file, or None.
    Only scripts, Python and Rust resolve.
    """
    if not source or not specifier:
        return []
    here, name = _split(source)
    if language in ("typescript", "javascript"):
        if specifier not in (".", "..") and not specifier.startswith(("./", "../")):
            return []
        base = normalize(here, specifier)
        if not base:
            return []
        stem, dot, ext = base.rpartition(".")
        bare = stem if dot and ext in SCRIPT and "/" not in ext else base
        return [base, *(f"{bare}.{e}" for e in SCRIPT), *(f"{bare}/index.{e}" for e in SCRIPT)]
    if language == "python":
        rest = specifier.lstrip(".")
        dots = len(specifier) - len(rest)
        rest = rest.replace(".", "/")
        if dots:
            bases = [normalize(here, "../" * (dots - 1) + rest)]
        else:
            ups = (package_root or "").split("/") if package_root else []
            bases = [_join(*ups[:k], rest) for k in range(len(ups), -1, -1)]
        return [c for b in bases if b for c in (f"{b}.py", f"{b}/__init__.py")]
    if language == "rust":
        root, *rest = specifier.split("::")
        own = here if name.rpartition(".")[0] in ("mod", "lib", "main") else _join(here, name.rpartition(".")[0])
        if root == "crate" and crate_root is not None:
            at = crate_root
        elif root == "self":
            at = own
        elif root == "super" and crate_root is not None:
            climbs = 1
            while rest and rest[0] == "super":
                climbs, rest = climbs + 1, rest[1:]
            depth = [p for p in own.split("/") if p]
            if len(depth) - len([p for p in crate_root.split("/") if p]) < climbs:
                return []
            at = "/".join(depth[:-climbs])
        else:
            return []
        return [c for take in range(len(rest), 0, -1) for c in (_join(at, *rest[:take]) + ".rs", _join(at, *rest[:take]) + "/mod.rs")]
    return []


def _roots(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``dir, package_root, crate_root`` of every importing directory."""
    dirs = imports.select(parent_dir(F.col("source_path")).alias("dir")).distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    up = dirs.withColumn("_p", parts).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("_p"))))
    up = up.select("dir", "depth", F.array_join(F.slice("_p", F.lit(1), F.col("depth")), "/").alias("anc"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    at = files.select(parent_dir(F.col("path")).alias("anc"), name.alias("n")).where(F.col("n").isin("__init__.py", "main.rs", "lib.rs"))
    marks = at.groupBy("anc").agg(F.max(F.col("n") == "__init__.py").alias("package"), F.max(F.col("n") != "__init__.py").alias("crate"))
    both = up.join(marks, "anc", "left")
    # the root of the index is a search root even where it is a package itself
    free = (F.col("depth") == 0) | ~F.coalesce("package", F.lit(False))
    return both.groupBy("dir").agg(
        F.max_by("anc", F.when(free, F.col("depth"))).alias("package_root"), F.max_by("anc", F.when(F.coalesce("crate", F.lit(False)), F.col("depth"))).alias("crate_root")
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (``id, source_file_id, import_path``, any more) with ``resolved_file_id``.

    Every row is resolved anew; a file never resolves to itself.  Rows whose
    source is not indexed, and languages that name packages, get null.
    """
    src = files.select(F.col("id").alias("source_file_id"), F.col("path").alias("source_path"), "language")
    work = imports.select("id", "source_file_id", "import_path").join(src, "source_file_id").where(F.col("language").isin("typescript", "javascript", "python", "rust"))
    work = work.withColumn("dir", parent_dir(F.col("source_path"))).join(_roots(work, files), "dir", "left")

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("source_path", "language", "import_path", "package_root", "crate_root")]
            made = [candidates(*row) for row in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source_file_id"), pa.array(made, pa.list_(pa.string()))], names=["id", "source_file_id", "found"])

    listed = work.select("id", "source_file_id", "source_path", "language", "import_path", "package_root", "crate_root").mapInArrow(go, "id long, source_file_id long, found array<string>")
    ranked = listed.select("id", "source_file_id", F.posexplode("found").alias("rank", "path"))
    hits = ranked.join(files.select("path", F.col("id").alias("to")), "path").groupBy("id", "source_file_id").agg(F.min_by("to", "rank").alias("to"))
    hits = hits.select(F.col("id"), F.when(F.col("to") != F.col("source_file_id"), F.col("to")).alias("resolved_file_id"))
    return imports.drop("resolved_file_id").join(hits, "id", "left")
