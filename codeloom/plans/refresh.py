"""Building an index and bringing it up to date.

Raw usages are kept, and references are derived from them by joining names, so
a refresh gives what a rebuild would give: usages in unchanged files find the
new symbols again.  A usage depends on the symbols of its name alone, so only
usages in changed files and those of names that changed files declare, before
or after, are bound anew.  Imports depend on the paths that are there, so where
no path comes or goes only those of changed files are resolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract.tables import relations
from codeloom.operators.maintenance import Relations, changed_resolutions, clear_files, delete_files, ingest_semantic, upsert_metadata
from codeloom.plans.index import bind_references
from codeloom.plans.resolve import resolve_imports
from codeloom.session import materialize


def file_rows(texts: DataFrame) -> DataFrame:
    """``files`` rows of readable texts; the id is a hash of the path."""
    ok = texts.where("content is not null and language is not null")
    return ok.select(F.xxhash64("path").alias("id"), "path", "content_hash", "language", F.current_timestamp().alias("last_indexed_at"))


def _bound(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    cols = ["symbol_id", "file_id", "line", "column"]
    return bind_references(raw, symbols).select(F.xxhash64(*cols).alias("id"), *cols, "qualified")


def _parsed(texts: DataFrame) -> Relations:
    return relations(texts.where("content is not null").select(F.xxhash64("path").alias("file_id"), "path", "language", "content"))


def build(texts: DataFrame, metadata: DataFrame | None = None) -> Relations:
    """A whole index of ``path, language, content, content_hash``."""
    spark = texts.sparkSession
    rel = _parsed(texts)
    rel.pop("errors")
    rel["files"] = file_rows(texts)
    rel["metadata"] = metadata if metadata is not None else spark.createDataFrame([], "key string, value string")
    imports = materialize(resolve_imports(rel["imports"], rel["files"]), "imports")
    return {**rel, "imports": imports, "references": _bound(rel["raw_references"], rel["symbols"])}


def refresh(rel: Relations, texts: DataFrame, deleted: DataFrame | None = None) -> Relations:
    """The index after ``texts`` (changed or new files) and ``deleted`` paths.

    Only files whose hash differs from the stored one are parsed.  References
    of usages that are not bound anew stay as they are.
    """
    spark = texts.sparkSession
    before = rel
    stored = rel["files"].select("path", F.col("content_hash").alias("_old"))
    changed = materialize(
        texts.join(stored, "path", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("content_hash"))).select("path", "language", "content", "content_hash", F.col("_old").isNull().alias("added")), "changed"
    )
    gone = None
    if deleted is not None:
        gone = materialize(rel["files"].join(deleted.select("path").distinct(), "path", "left_semi").select("id"), "gone")
        rel = delete_files(rel, gone)
    ids = changed.select(F.xxhash64("path").alias("id"))
    rel = clear_files(rel, ids)
    new = _parsed(changed)
    out = {k: rel[k].unionByName(new[k].select(*rel[k].columns)) for k in ("symbols", "imports", "raw_references")}
    kept = rel["files"].join(ids, "id", "left_anti").select(*rel["files"].columns)
    out["files"] = kept.unionByName(file_rows(changed))
    out["metadata"] = rel.get("metadata", spark.createDataFrame([], "key string, value string"))
    moved = not changed.where("added").isEmpty() or gone is not None and not gone.isEmpty()
    fresh = resolve_imports(out["imports"] if moved else new["imports"].select(*rel["imports"].columns), out["files"])
    out["imports"] = materialize(fresh if moved else rel["imports"].unionByName(fresh), "imports")
    touched = ids if gone is None else ids.unionByName(gone)
    declared = before["symbols"].join(touched.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("name").unionByName(new["symbols"].select("name"))
    names = materialize(declared.where("name is not null").distinct(), "names")
    again = rel["raw_references"].join(names.select(F.col("name").alias("symbol_name")), "symbol_name", "left_semi")
    raw = again.select(*rel["raw_references"].columns).unionByName(new["raw_references"].select(*rel["raw_references"].columns))
    # what is left are usages of names that nothing touched has declared
    hit = out["symbols"].join(names, "name", "left_semi").select(F.col("id").alias("symbol_id"))
    stay = rel["references"].join(hit, "symbol_id", "left_anti")
    made = _bound(raw, out["symbols"])
    out["references"] = stay.select(*made.columns).unionByName(made)
    return out


def with_semantic(rel: Relations, definitions: DataFrame, references: DataFrame) -> Relations:
    """The index after exact records of a helper, with its provenance noted."""
    spark = definitions.sparkSession
    out = ingest_semantic(rel, definitions, references)
    note = spark.createDataFrame([("csharp_resolver", "roslyn")], "key string, value string")
    return {**out, "metadata": upsert_metadata(out["metadata"], note)}


def statistics(texts: DataFrame, before: DataFrame, after: Relations, deleted: int = 0) -> DataFrame:
    """Counters of a run: one row."""
    old = before.select("path", F.col("content_hash").alias("_old"))
    seen = texts.join(old, "path", "left")
    base = seen.agg(
        F.count_if(F.col("content").isNotNull()).alias("files_indexed"),
        F.count_if(F.col("content").isNull()).alias("files_errored"),
        F.count_if(F.col("_old") == F.col("content_hash")).alias("files_unchanged"),
    )
    counts = after["symbols"].agg(F.count(F.lit(1)).alias("symbols_found")).withColumn("k", F.lit(1))
    imps = after["imports"].agg(F.count(F.lit(1)).alias("imports_found")).withColumn("k", F.lit(1))
    return base.withColumn("k", F.lit(1)).join(counts, "k").join(imps, "k").drop("k").withColumn("files_deleted", F.lit(deleted).cast("long"))


def run_totals(runs: DataFrame) -> DataFrame:
    """``run_no, runs`` and sums of the counters of a run log; null counters are 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return runs.groupBy("run_no").agg(F.count(F.lit(1)).alias("runs"), *[total(c) for c in ("files_indexed", "files_errored", "files_deleted", "symbols_found", "imports_found")])


def resolution_changes(before: DataFrame, rel: Relations) -> DataFrame:
    return changed_resolutions(before, rel["imports"])


def read_tree_index(spark: SparkSession, root: str) -> Relations:
    from codeloom.sources.tree import read_tree

    return build(read_tree(spark, root))
