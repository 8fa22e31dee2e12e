"""Changes to the index's relations, as functions from relations to relations.

Nothing is changed in place: each gives the tables of the next snapshot.  All
removals are anti-joins on keys, so they cost one shuffle of the narrow side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Relations = dict[str, DataFrame]


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files by path: a known path keeps its id and takes the new hash, language
    and time; an unknown one is added with the id it brings.  Of several new
    rows of a path the latest stands."""
    top = F.max(F.struct("last_indexed_at", "content_hash", "language", "id")).alias("r")
    last = new.groupBy("path").agg(top).select("path", "r.id", "r.content_hash", "r.language", "r.last_indexed_at")
    old = files.select(F.col("path"), F.col("id").alias("_old"))
    changed = last.join(old, "path", "left").select(F.coalesce("_old", "id").alias("id"), "path", "content_hash", "language", "last_indexed_at")
    return files.join(last.select("path"), "path", "left_anti").select("id", "path", "content_hash", "language", "last_indexed_at").unionByName(changed)


def upsert_metadata(metadata: DataFrame, new: DataFrame) -> DataFrame:
    one = new.groupBy("key").agg(F.max("value").alias("value"))
    return metadata.join(one.select("key"), "key", "left_anti").select("key", "value").unionByName(one)


def _without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*df.columns)


def clear_files(rel: Relations, ids: DataFrame) -> Relations:
    """Drop what was parsed from the files ``ids`` (column ``id``): their usages,
    symbols, the usages of those symbols, and imports."""
    gone = rel["symbols"].join(ids.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    out = dict(rel)
    out["references"] = _without(_without(rel["references"], "file_id", ids), "symbol_id", gone)
    out["symbols"] = _without(rel["symbols"], "file_id", ids)
    out["imports"] = _without(rel["imports"], "source_file_id", ids)
    if "raw_references" in rel:
        out["raw_references"] = _without(rel["raw_references"], "file_id", ids)
    return out


def delete_files(rel: Relations, ids: DataFrame) -> Relations:
    """Drop files with all that hangs on them; imports that pointed at them stay, unresolved."""
    out = clear_files(rel, ids)
    out["files"] = _without(rel["files"], "id", ids)
    cut = ids.select(F.col("id").alias("resolved_file_id"), F.lit(True).alias("_cut")).distinct()
    imports = out["imports"]
    joined = imports.join(cut, "resolved_file_id", "left")
    out["imports"] = joined.withColumn("resolved_file_id", F.when(F.col("_cut").isNull(), F.col("resolved_file_id"))).select(*imports.columns)
    return out


def delete_references_by_language(rel: Relations, language: str) -> Relations:
    ids = rel["files"].where(F.col("language") == language).select("id")
    return {**rel, "references": _without(rel["references"], "file_id", ids)}


def changed_resolutions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, resolved_file_id`` of the imports whose target moved."""
    o = old.select("id", F.col("resolved_file_id").alias("_old"))
    return new.select("id", "resolved_file_id").join(o, "id").where(~F.col("resolved_file_id").eqNullSafe(F.col("_old"))).drop("_old")


def apply_resolutions(imports: DataFrame, moved: DataFrame) -> DataFrame:
    m = moved.select("id", F.col("resolved_file_id").alias("_new"), F.lit(True).alias("_hit"))
    return imports.join(m, "id", "left").withColumn("resolved_file_id", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("resolved_file_id"))).select(*imports.columns)


def stale_files(files: DataFrame, changes: DataFrame, current: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """(modified, deleted) paths of a change feed ``status, path``.

    Modified: languages we parse, whose current hash (``current``: ``path,
    content_hash``) is not the stored one.  Deleted: only what is indexed.
    Renames come as a delete of the old and a change of the new path.
    """
    ext = F.element_at(F.split("path", r"\."), -1)
    touched = changes.where((F.col("status") != "D") & ext.isin(known)).select("path").distinct()
    now = touched.join(current.select("path", F.col("content_hash").alias("_now")), "path")
    modified = now.join(files.select("path", "content_hash"), "path", "left").where(F.col("content_hash").isNull() | (F.col("content_hash") != F.col("_now"))).select("path")
    deleted = changes.where(F.col("status") == "D").select("path").distinct().join(files.select("path"), "path", "left_semi")
    return modified, deleted


def ingest_semantic(rel: Relations, definitions: DataFrame, references: DataFrame, language: str = "csharp") -> Relations:
    """Exact definitions and usages replace the language's name-matched ones.

    Definitions (``docid, name, file, start_line``) stamp their docid on the
    symbol at the same file, line and name (of several, the last by docid);
    usages (``docid, file, line, col, is_definition``, places 1-based) become
    references of every symbol with the docid; unknown docids and files drop out.
    """
    f = rel["files"].select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    d = definitions.join(f, "file").groupBy("file_id", F.col("start_line").alias("line"), "name").agg(F.max("docid").alias("_doc"))
    sym = rel["symbols"].join(d, ["file_id", "line", "name"], "left")
    sym = sym.withColumn("docid", F.coalesce("_doc", "docid")).select(*rel["symbols"].columns)
    by = sym.where("docid is not null").select(F.col("id").alias("symbol_id"), "docid")
    use = references.where(~F.coalesce("is_definition", F.lit(False))).join(f, "file").join(by, "docid")
    cols = ["symbol_id", "file_id", "line", "column", "qualified"]
    # an exact usage is never narrowed by imports again
    use = use.select("symbol_id", "file_id", "line", (F.col("col") - 1).alias("column"), F.lit(True).alias("qualified")).distinct()
    use = use.select(F.xxhash64(*cols[:4]).alias("id"), *cols)
    kept = delete_references_by_language({**rel, "symbols": sym}, language)
    return {**kept, "references": kept["references"].select("id", *cols).unionByName(use)}
