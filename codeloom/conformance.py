"""Queries of the index's operators over the driver's tables, with SQL.

The import relation, which the tables lack, is derived from references: a file
imports every file whose symbols it uses unqualified; the shared library stays
an unresolved specifier.  Both sides derive it the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract.tables import relations
from codeloom.functions import text as T
from codeloom.operators import maintenance as M
from codeloom.operators.snapshots import snapshot_diff
from codeloom.plans.index import Index, bind_references
from codeloom.plans.refresh import build, refresh, run_totals, statistics
from codeloom.plans.resolve import resolve_imports
from codeloom.session import materialize, table
from codeloom.sources.tree import LANGUAGES, language_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SYM = "allsym AS (SELECT * FROM symbols UNION ALL SELECT * FROM std_symbols)"
_IMP = f"""{_SYM},
used AS (SELECT DISTINCT r.file_id AS source_file_id, s.file_id AS target_id, coalesce(f.path, 'std') AS import_path, f.id AS resolved_file_id, s.name
  FROM references_ r JOIN allsym s ON s.id = r.symbol_id LEFT JOIN files f ON f.id = s.file_id WHERE NOT r.qualified AND s.file_id <> r.file_id),
imports AS (SELECT DISTINCT source_file_id, import_path, resolved_file_id FROM used),
import_names AS (SELECT DISTINCT source_file_id, import_path, resolved_file_id, name FROM used)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def all_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").unionByName(table(spark, d, "std_symbols"))


def imports(spark: SparkSession, d: str) -> DataFrame:
    s = all_symbols(spark, d).select(F.col("id").alias("symbol_id"), "name", F.col("file_id").alias("target_id"))
    f = table(spark, d, "files").select(F.col("id").alias("target_id"), F.col("id").alias("resolved_file_id"), F.col("path").alias("_p"))
    r = table(spark, d, "references_").where("not qualified").select("symbol_id", F.col("file_id").alias("source_file_id")).distinct().join(s, "symbol_id")
    used = r.where("target_id <> source_file_id").join(f, "target_id", "left").withColumn("import_path", F.coalesce("_p", F.lit("std")))
    one = used.groupBy("source_file_id", "import_path", "resolved_file_id").agg(F.collect_set("name").alias("names"))
    return one.select(F.xxhash64("source_file_id", "import_path").alias("id"), "source_file_id", "import_path", F.lit(None).cast("string").alias("alias"), "names", "resolved_file_id")


def index(spark: SparkSession, d: str, written: bool = False) -> Index:
    """The index over the tables; ``written`` for queries that use the derived imports more than once."""
    i = imports(spark, d)
    return Index(table(spark, d, "files"), all_symbols(spark, d), materialize(i, "imports") if written else i, table(spark, d, "references_"))


_LOC = f"WITH {_SYM}, located AS (SELECT s.*, f.path, f.language FROM allsym s JOIN files f ON f.id = s.file_id)"
_PAGE = 'id, name, kind, path, line, "column", end_line, visibility, scope'
_PAGE_COLS = ("id", "name", "kind", "path", "line", "column", "end_line", "visibility", "scope")
_ORD = 'ORDER BY path, line, "column", name, id'


# -- scans and lookups --------------------------------------------------------
@query("SELECT id, path, language FROM files WHERE path NOT LIKE '.%'")
def s04_visible_files(spark, d):
    return index(spark, d).visible_files().select("id", "path", "language")


@query("""SELECT file_id, path, CASE regexp_extract(path, '[^.]*$') WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript'
  WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'swift' THEN 'swift' WHEN 'cs' THEN 'csharp' END AS language FROM source_tree""")
def s03_detect_language(spark, d):
    return table(spark, d, "source_tree").select("file_id", "path", language_column().alias("language"))


@query("SELECT id, path, content_hash, language FROM files WHERE language = 'csharp'")
def s05_csharp_files(spark, d):
    return table(spark, d, "files").where("language = 'csharp'").select("id", "path", "content_hash", "language")


@query("SELECT id, path, language FROM files ORDER BY path")
def s07_all_files(spark, d):
    return index(spark, d).all_files().select("id", "path", "language")


@query("SELECT id, path, language FROM files WHERE path = (SELECT min(path) FROM files)")
def s08_file_by_path(spark, d):
    first = table(spark, d, "files").agg(F.min("path")).first()[0]
    return index(spark, d).file_by_path(first).select("id", "path", "language")


@query(f"WITH {_IMP} SELECT i.source_file_id, f.path AS source_path, f.language AS source_language, i.import_path, i.resolved_file_id FROM imports i JOIN files f ON f.id = i.source_file_id")
def s09_imports_with_source(spark, d):
    return index(spark, d).imports_with_source().select("source_file_id", "source_path", "source_language", "import_path", "resolved_file_id")


@query(f"WITH {_IMP} SELECT import_path FROM imports WHERE source_file_id = (SELECT min(source_file_id) FROM imports) ORDER BY import_path")
def s10_imports_of_file(spark, d):
    i = index(spark, d)
    return i.imports_of(i.imports.agg(F.min("source_file_id")).first()[0]).select("import_path")


@query("""SELECT s.id, CASE WHEN s.line >= 1 AND s.line <= len(l) THEN array_to_string(list_slice(l, s.line, CASE WHEN s.end_line > 0 THEN s.end_line ELSE s.line END), chr(10)) END AS body
FROM symbols s JOIN (SELECT file_id, regexp_split_to_array(content, '\\r?\\n') AS l FROM source_tree) t ON t.file_id = s.file_id""")
def s15_symbol_bodies(spark, d):
    return Index(table(spark, d, "files"), table(spark, d, "symbols")).symbol_bodies(table(spark, d, "source_tree"))


# -- listings -----------------------------------------------------------------
@query(f"{_LOC} SELECT {_PAGE} FROM located WHERE kind = 'fn' AND visibility = 'pub' AND language = 'python' {_ORD}")
def q01_list_symbols(spark, d):
    return index(spark, d).list_symbols(kind="fn", visibility="pub", language="python").select(*_PAGE_COLS)


@query(f"{_LOC} SELECT {_PAGE} FROM located WHERE lower(path) LIKE '%/lib/%' {_ORD} LIMIT 50 OFFSET 20")
def l03_symbols_page(spark, d):
    return index(spark, d).list_symbols(file="/LIB/", limit=50, offset=20).select(*_PAGE_COLS)


@query(f"{_LOC} SELECT {_PAGE} FROM located WHERE regexp_matches(name, '^(get|set|load)_?[A-Za-z]') {_ORD}")
def predicate_p04_grep(spark, d):
    return index(spark, d).list_symbols(pattern="^(?P<verb>get|set|load)_?[A-Za-z]").select(*_PAGE_COLS)


@query(f"{_LOC} SELECT {_PAGE} FROM located WHERE regexp_matches(name, 'e.*r$') {_ORD} LIMIT 25 OFFSET 10")
def l04_grep_page(spark, d):
    return index(spark, d).list_symbols(pattern="e.*r$", limit=25, offset=10).select(*_PAGE_COLS)


@query(f"{_LOC} SELECT count(*) AS total_count FROM located WHERE kind = 'class' AND lower(path) LIKE '%core%'")
def a02_count_symbols(spark, d):
    return index(spark, d).count_symbols(kind="class", file="core")


@query(f"{_LOC} SELECT count(*) AS total_count FROM located WHERE regexp_matches(name, '^(get|set|load)_?[A-Za-z]') AND kind = 'fn'")
def a11_count_grep(spark, d):
    return index(spark, d).count_symbols(pattern="^(get|set|load)_?[A-Za-z]", kind="fn")


@query(f"""{_LOC}, page AS (SELECT * FROM located {_ORD} LIMIT 40 OFFSET 25), lists AS (SELECT file_id, string_agg(line || ' ' || name, ',' ORDER BY line, "column", name, kind, end_line, visibility, scope) AS t FROM page GROUP BY file_id)
SELECT f.path, f.language, t AS symbols FROM files f JOIN lists l ON l.file_id = f.id ORDER BY path""")
def l06_export_page(spark, d):
    e = index(spark, d).export(limit=40, offset=25)
    return e.select("path", "language", F.array_join(F.transform("symbols", lambda s: F.concat_ws(" ", s["line"], s["name"])), ",").alias("symbols"))


@query(f"{_LOC} SELECT {_PAGE} FROM located WHERE name = (SELECT max(name) FROM located)")
def q02_symbols_named(spark, d):
    i = index(spark, d)
    return i.symbols_named(i.located().agg(F.max("name")).first()[0]).select(*_PAGE_COLS)


@query(f"{_LOC} SELECT id, path, line, scope FROM located WHERE name = (SELECT max(name) FROM located WHERE scope IS NOT NULL) AND scope IS NOT NULL ORDER BY path, line, id")
def q03_definitions(spark, d):
    i = index(spark, d)
    name = i.located().where("scope is not null").agg(F.max("name")).first()[0]
    return i.definitions(name).where("scope is not null")


@query(f"{_LOC} SELECT {_PAGE} FROM located WHERE lower(path) LIKE 'amber%' {_ORD}")
def q13_directory_symbols(spark, d):
    return index(spark, d).symbols_in_dir("Amber").select(*_PAGE_COLS)


@query(f"{_LOC} SELECT {_PAGE} FROM located WHERE path = (SELECT min(path) FROM located) {_ORD}")
def q17_symbols_of_file(spark, d):
    i = index(spark, d)
    return i.symbols_of_file(i.located().agg(F.min("path")).first()[0]).select(*_PAGE_COLS)


@query(f"{_LOC} SELECT {_PAGE} FROM located WHERE kind = 'fn' AND name = (SELECT min(name) FROM located WHERE kind = 'fn') {_ORD}")
def q18_function_targets(spark, d):
    i = index(spark, d)
    return i.functions(i.located().where("kind = 'fn'").agg(F.min("name")).first()[0]).select(*_PAGE_COLS)


@query(f"""{_LOC} SELECT printf('%s:%d:%d %s %s %s', path, line, "column", kind, visibility, CASE WHEN coalesce(scope, '') <> '' THEN scope || '.' || name ELSE name END) AS text FROM located {_ORD}""")
def k01_text_listing(spark, d):
    return index(spark, d).listing()


# -- aggregates ---------------------------------------------------------------
@query(f"WITH {_IMP} SELECT 'files' AS relation, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM allsym UNION ALL SELECT 'imports', count(*) FROM imports")
def a01_totals(spark, d):
    return index(spark, d).totals()


@query("SELECT kind, count(*) AS n FROM symbols GROUP BY kind ORDER BY kind")
def a03_symbols_by_kind(spark, d):
    return Index(table(spark, d, "files"), table(spark, d, "symbols")).symbols_by_kind()


@query("SELECT language, count(*) AS n FROM files GROUP BY language ORDER BY language")
def a04_files_by_language(spark, d):
    return index(spark, d).files_by_language()


@query(f"""WITH {_IMP} SELECT f.path, f.language, coalesce(s.n, 0) AS symbol_count, coalesce(i.n, 0) AS import_count, epoch_us(f.last_indexed_at) AS last_indexed_us FROM files f
LEFT JOIN (SELECT file_id, count(*) AS n FROM allsym GROUP BY file_id) s ON s.file_id = f.id
LEFT JOIN (SELECT source_file_id, count(*) AS n FROM imports GROUP BY source_file_id) i ON i.source_file_id = f.id ORDER BY f.path""")
def q12_files_with_counts(spark, d):
    counts = index(spark, d).files_with_counts()
    return counts.select("path", "language", "symbol_count", "import_count", F.unix_micros("last_indexed_at").alias("last_indexed_us"))


@query(f"{_LOC} SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, count(DISTINCT path) AS n_files, count(*) AS n_symbols FROM located GROUP BY 1 ORDER BY 1")
def a08_directories(spark, d):
    return index(spark, d).directories()


@query(f"""WITH {_IMP} SELECT 'totals' AS section, 'files' AS key, count(*) AS n FROM files UNION ALL SELECT 'totals', 'symbols', count(*) FROM allsym UNION ALL SELECT 'totals', 'imports', count(*) FROM imports
UNION ALL SELECT 'kinds', kind, count(*) FROM allsym GROUP BY kind UNION ALL SELECT 'languages', language, count(*) FROM files GROUP BY language""")
def q14_summary(spark, d):
    return index(spark, d).summary()


@query("""SELECT docid, count(*) AS n, min(id) AS first_id FROM symbols WHERE docid IS NOT NULL GROUP BY docid""")
def a10_docid_ids(spark, d):
    return Index(table(spark, d, "files"), table(spark, d, "symbols")).docid_ids()


@query(f"""{_LOC}, lists AS (SELECT file_id, string_agg(line || ' ' || name, ',' ORDER BY line, "column", name, kind, end_line, visibility, scope) AS t FROM located GROUP BY file_id)
SELECT f.path, f.language, coalesce(t, '') AS symbols FROM files f LEFT JOIN lists l ON l.file_id = f.id""")
def k05_export(spark, d):
    e = index(spark, d).export()
    return e.select("path", "language", F.array_join(F.transform("symbols", lambda s: F.concat_ws(" ", s["line"], s["name"])), ",").alias("symbols"))


# -- dependencies -------------------------------------------------------------
_EDGES = f"WITH RECURSIVE {_IMP}, edges AS (SELECT DISTINCT f.path AS source, coalesce(t.path, i.import_path) AS target FROM imports i JOIN files f ON f.id = i.source_file_id LEFT JOIN files t ON t.id = i.resolved_file_id)"


@query(f"{_EDGES} SELECT source, target FROM edges")
def q04_file_edges(spark, d):
    return index(spark, d).file_edges()


@query(f"{_EDGES} SELECT DISTINCT source AS path FROM edges WHERE target = (SELECT max(target) FROM edges WHERE target <> 'std') ORDER BY path")
def q05_dependents(spark, d):
    i = index(spark, d, written=True)
    return i.dependents(i.file_edges().where("target <> 'std'").agg(F.max("target")).first()[0])


@query(f"WITH {_IMP} SELECT DISTINCT f.path FROM imports i JOIN files f ON f.id = i.source_file_id WHERE i.import_path LIKE '%std%' ORDER BY path")
def q05_dependents_of_a_name(spark, d):
    """Dependents of what is no indexed file, by the text of the specifier."""
    return index(spark, d).dependents("std")


@query(f"{_EDGES}, walk AS (SELECT (SELECT min(source) FROM edges) AS path, 0 AS depth UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.path WHERE w.depth < 3) SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE path <> (SELECT min(source) FROM edges) GROUP BY path")
def q06_transitive(spark, d):
    i = index(spark, d, written=True)
    return i.transitive(i.file_edges().agg(F.min("source")).first()[0], 3).select("path", "depth")


@query(f"WITH {_IMP} SELECT DISTINCT s.id AS symbol_id, i.import_path FROM allsym s JOIN imports i ON i.source_file_id = s.file_id")
def q07_symbol_dependencies(spark, d):
    return index(spark, d).symbol_dependencies()


@query(f"""WITH {_IMP} SELECT DISTINCT r.symbol_id, f.path, r.line, r."column" FROM references_ r JOIN files f ON f.id = r.file_id JOIN allsym s ON s.id = r.symbol_id
WHERE r.qualified OR s.file_id = r.file_id
  OR EXISTS (SELECT 1 FROM import_names n WHERE n.source_file_id = r.file_id AND n.name = s.name AND n.resolved_file_id = s.file_id)
  OR NOT EXISTS (SELECT 1 FROM import_names n JOIN (SELECT DISTINCT file_id, name FROM allsym) x ON x.file_id = n.resolved_file_id AND x.name = n.name
    WHERE n.source_file_id = r.file_id AND n.name = s.name AND n.resolved_file_id <> s.file_id)""")
def q08_symbol_references(spark, d):
    return index(spark, d).attributed()


@query(f"""WITH {_SYM}, u AS (SELECT DISTINCT * FROM raw_references), c AS (
  SELECT s.id AS symbol_id, u.file_id, u.line, u."column", u.qualified, coalesce(s.scope = u.from_scope, false) AS hit,
    bool_or(coalesce(s.scope = u.from_scope, false)) OVER (PARTITION BY u.file_id, u.symbol_name, u.line, u."column", u.from_scope, u.qualified) AS any_hit
  FROM u JOIN allsym s ON s.name = u.symbol_name)
SELECT symbol_id, file_id, line, "column", qualified FROM c WHERE hit OR NOT any_hit""")
def q09_bind_references(spark, d):
    return bind_references(table(spark, d, "raw_references"), all_symbols(spark, d))


# -- text functions -----------------------------------------------------------
@query("SELECT file_id, sha256(content) AS content_hash FROM source_tree")
def f05_content_hash(spark, d):
    return table(spark, d, "source_tree").select("file_id", T.content_hash(F.col("content")).alias("content_hash"))


@query("SELECT id, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS base FROM files")
def f07_path_parts(spark, d):
    return table(spark, d, "files").select("id", T.parent_dir(F.col("path")).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("base"))


@query("SELECT id, CASE WHEN length(path) > 30 THEN substr(path, 1, 29) || '…' ELSE path END AS short, CASE WHEN length(path) > 30 THEN '…' || right(path, 29) ELSE path END AS tail FROM files")
def f09_elide(spark, d):
    return table(spark, d, "files").select("id", T.elide(F.col("path"), 30).alias("short"), T.elide_left(F.col("path"), 30).alias("tail"))


@query(f"""{_LOC} SELECT id FROM located WHERE translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%a_e%/c%'""")
def f01_like_wildcards(spark, d):
    return index(spark, d).located().where(T.sqlite_like(F.col("path"), "%A_e%/C%")).select("id")


# -- maintenance --------------------------------------------------------------
_LATEST = """latest AS (SELECT path, id, content_hash, language, last_indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_indexed_at DESC, content_hash DESC, language DESC, id DESC) AS k
  FROM file_feed WHERE content_hash IS NOT NULL AND last_indexed_at IS NOT NULL) WHERE k = 1)"""


def _feed(spark, d):
    return table(spark, d, "file_feed").where("content_hash is not null and last_indexed_at is not null")


@query(f"""WITH {_LATEST} SELECT f.id, f.path, f.content_hash, f.language FROM files f WHERE path NOT IN (SELECT path FROM latest)
UNION ALL SELECT coalesce(f.id, l.id), l.path, l.content_hash, l.language FROM latest l LEFT JOIN files f ON f.path = l.path""")
def m01_upsert_files(spark, d):
    return M.upsert_files(table(spark, d, "files"), _feed(spark, d)).select("id", "path", "content_hash", "language")


def _rel(spark, d):
    return {"files": table(spark, d, "files"), "symbols": all_symbols(spark, d), "imports": imports(spark, d), "references": table(spark, d, "references_")}


@query(f"""WITH {_IMP}, gone AS (SELECT id FROM files WHERE language = 'go'), gs AS (SELECT id FROM allsym WHERE file_id IN (SELECT id FROM gone))
SELECT 'files' AS relation, count(*) AS n FROM files WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'symbols', count(*) FROM allsym WHERE file_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'imports', count(*) FROM imports WHERE source_file_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'resolved', count(*) FROM imports WHERE source_file_id NOT IN (SELECT id FROM gone) AND resolved_file_id IS NOT NULL AND resolved_file_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'references', count(*) FROM references_ WHERE file_id NOT IN (SELECT id FROM gone) AND symbol_id NOT IN (SELECT id FROM gs)""")
def m03_delete_cascade(spark, d):
    rel = _rel(spark, d)
    out = M.delete_files(rel, rel["files"].where("language = 'go'").select("id"))
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("relation"), "n")
    parts = [n(out["files"], "files"), n(out["symbols"], "symbols"), n(out["imports"], "imports"), n(out["imports"].where("resolved_file_id is not null"), "resolved"), n(out["references"], "references")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query(f"""WITH {_SYM}, gone AS (SELECT id FROM files WHERE language = 'rust'), gs AS (SELECT id FROM allsym WHERE file_id IN (SELECT id FROM gone))
SELECT id, symbol_id, file_id, line, "column", qualified FROM references_ WHERE file_id NOT IN (SELECT id FROM gone) AND symbol_id NOT IN (SELECT id FROM gs)""")
def m04_clear_files(spark, d):
    rel = _rel(spark, d)
    return M.clear_files(rel, rel["files"].where("language = 'rust'").select("id"))["references"]


@query("""SELECT id, symbol_id, file_id, line, "column", qualified FROM references_ WHERE file_id NOT IN (SELECT id FROM files WHERE language = 'csharp')""")
def m05_drop_language_references(spark, d):
    return M.delete_references_by_language(_rel(spark, d), "csharp")["references"]


@query(f"""WITH {_LATEST} SELECT 'modified' AS state, l.path FROM latest l LEFT JOIN files f ON f.path = l.path
WHERE regexp_extract(l.path, '[^.]*$') IN ('rs', 'go', 'py', 'ts', 'tsx', 'js', 'jsx', 'swift', 'cs') AND (f.content_hash IS NULL OR f.content_hash <> l.content_hash)
UNION ALL SELECT DISTINCT 'deleted', f.path FROM files f JOIN symbol_snapshots s ON s.path = f.path""")
def o63_stale_files(spark, d):
    now = _feed(spark, d).groupBy("path").agg(F.max(F.struct("last_indexed_at", "content_hash", "language", "id")).alias("r")).select("path", "r.content_hash")
    # as if the files of the snapshots were deleted, with paths that are not indexed besides
    gone = table(spark, d, "symbol_snapshots").select(F.lit("D").alias("status"), "path")
    stray = table(spark, d, "package_files").select(F.lit("D").alias("status"), F.col("file_name").alias("path"))
    changes = now.select(F.lit("M").alias("status"), "path").unionByName(gone).unionByName(stray)
    modified, deleted = M.stale_files(table(spark, d, "files"), changes, now, list(LANGUAGES))
    return modified.select(F.lit("modified").alias("state"), "path").unionByName(deleted.select(F.lit("deleted").alias("state"), "path"))


_SNAP = "n AS (SELECT DISTINCT snapshot_no AS s FROM symbol_snapshots), b AS (SELECT max(s) AS hi, (SELECT max(s) FROM n WHERE s < (SELECT max(s) FROM n)) AS lo FROM n)"


@query(f"""WITH {_SNAP}, side AS (SELECT *, row_number() OVER (PARTITION BY snapshot_no, path, name ORDER BY line DESC, end_line DESC, kind DESC, visibility DESC NULLS LAST) AS k FROM symbol_snapshots),
o AS (SELECT side.* FROM side, b WHERE snapshot_no = lo AND k = 1), w AS (SELECT side.* FROM side, b WHERE snapshot_no = hi AND k = 1)
SELECT path, name, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'modified' END AS change_kind, o.line AS old_line, w.line AS new_line
FROM o FULL JOIN w USING (path, name) WHERE o.id IS NULL OR w.id IS NULL OR o.line <> w.line OR o.end_line <> w.end_line OR o.kind <> w.kind OR o.visibility IS DISTINCT FROM w.visibility""")
def o65_symbol_diff(spark, d):
    s = table(spark, d, "symbol_snapshots")
    hi = s.agg(F.max("snapshot_no")).first()[0]
    lo = s.where(F.col("snapshot_no") < hi).agg(F.max("snapshot_no")).first()[0]
    at = lambda n: s.where(F.col("snapshot_no") == n)
    found = snapshot_diff(at(lo), at(hi), ["path", "name"], ["line", "end_line", "kind", "visibility"], ["line"])
    return found.select("path", "name", "change_kind", "old_line", "new_line")


@query("""SELECT run_no, CAST(count(*) AS BIGINT) AS runs, CAST(sum(coalesce(files_indexed, 0)) AS BIGINT) AS files_indexed, CAST(sum(coalesce(files_errored, 0)) AS BIGINT) AS files_errored,
CAST(sum(coalesce(files_deleted, 0)) AS BIGINT) AS files_deleted, CAST(sum(coalesce(symbols_found, 0)) AS BIGINT) AS symbols_found, CAST(sum(coalesce(imports_found, 0)) AS BIGINT) AS imports_found FROM index_runs GROUP BY run_no""")
def a12_run_statistics(spark, d):
    return run_totals(table(spark, d, "index_runs"))


@query(f"""WITH {_LATEST} SELECT (SELECT count(*) FROM latest) AS files_indexed, 0 AS files_errored, (SELECT count(*) FROM latest l JOIN files f ON f.path = l.path AND f.content_hash = l.content_hash) AS files_unchanged,
(SELECT count(*) FROM symbols) AS symbols_found, (SELECT count(*) FROM references_) AS imports_found, 0 AS files_deleted""")
def a12_statistics(spark, d):
    """Counters of a run over the newest rows of the feed (here references stand for imports)."""
    now = _feed(spark, d).groupBy("path").agg(F.max(F.struct("last_indexed_at", "content_hash", "language", "id")).alias("r"))
    texts = now.select("path", "r.content_hash", F.lit("").alias("content"))
    return statistics(texts, table(spark, d, "files"), {"symbols": table(spark, d, "symbols"), "imports": table(spark, d, "references_")})


@query("SELECT DISTINCT file_id FROM raw_references WHERE file_id IN (SELECT id FROM files)")
def u02_indexed_members(spark, d):
    return index(spark, d).indexed(table(spark, d, "raw_references"))


@query("SELECT DISTINCT path FROM file_feed WHERE path NOT IN (SELECT path FROM files) AND path IS NOT NULL")
def u03_paths_not_indexed(spark, d):
    return index(spark, d).not_indexed(table(spark, d, "file_feed"))


@query(f"WITH {_SYM} SELECT s.id AS symbol_id, f.path FROM allsym s JOIN files f ON f.id = s.file_id WHERE s.docid IS NOT NULL")
def predicate_p07_not_null(spark, d):
    return index(spark, d).located().where("docid is not null").select(F.col("id").alias("symbol_id"), "path")


# -- extraction over whole texts (no SQL; tested on fixtures) ------------------
def _texts(spark, d):
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "language")
    return table(spark, d, "source_tree").select("file_id", "path", "content").withColumn("language", language_column()).join(f.select("file_id"), "file_id", "left_semi")


@query("SELECT 0 AS missing, 0 AS extra, (SELECT count(*) FROM source_tree JOIN files ON id = file_id) AS files")
def o62_refresh_is_a_rebuild(spark, d):
    """An index of the texts as they were, refreshed with the texts as they are, against a new one.

    Before, every Python and Rust text had one more function and every package
    copy was still there; the copies are deleted and the others change.
    """
    now = _texts(spark, d).select("path", "language", "content").withColumn("content_hash", T.content_hash(F.col("content")))
    more = F.when(F.col("language") == "python", F.lit("\ndef gone_by_now():\n    pass\n")).when(F.col("language") == "rust", F.lit("\nfn gone_by_now() {}\n")).otherwise(F.lit(""))
    was = now.withColumn("content", F.concat("content", more)).withColumn("content_hash", T.content_hash(F.col("content")))
    stray = was.limit(0).unionByName(spark.createDataFrame([("gone/away.py", "python", "def away(): pass\n", "x")], was.schema))
    old = {k: materialize(v, k) for k, v in build(was.unionByName(stray)).items()}
    fresh = refresh(old, now, stray.select("path"))
    whole = build(now)
    cols = {"symbols": ["id", "name", "kind", "line", "end_line"], "imports": ["id", "resolved_file_id"], "references": ["id", "symbol_id"], "files": ["id", "path", "content_hash"]}

    def rows(rel, name):
        return materialize(rel[name].select(F.lit(name).alias("relation"), F.xxhash64(*cols[name]).alias("row")), f"rows-{name}")

    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    parts = [count(whole["files"], "files")]
    for name in cols:
        a, b = rows(fresh, name), rows(whole, name)
        parts += [count(b.exceptAll(a), "missing"), count(a.exceptAll(b), "extra")]
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    return one.agg(*[F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("missing", "extra", "files")])


@query()
def x01_extract_symbols(spark, d):
    return relations(_texts(spark, d))["symbols"]


@query("""SELECT language, count(*) AS listed, count(*) AS found FROM symbols JOIN files f ON f.id = file_id GROUP BY language""")
def x01_listed_symbols(spark, d):
    """Symbols of the table that extraction finds in the texts, by name, kind and lines
    (a listed place may be that of a decorator; end 0 is one line)."""
    x = relations(_texts(spark, d))["symbols"].select("file_id", "name", "kind", F.col("line").alias("at"))
    s = table(spark, d, "symbols").withColumn("upto", F.greatest(F.col("end_line"), F.col("line") + 1))
    hit = s.join(x, ["file_id", "name", "kind"]).where("at between line and upto").select("id").distinct().withColumn("hit", F.lit(1))
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "language")
    return s.join(f, "file_id").join(hit, "id", "left").groupBy("language").agg(F.count(F.lit(1)).alias("listed"), F.count("hit").alias("found"))


@query(r"""WITH t AS (SELECT file_id, regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '\A\x{FEFF}', '') AS c, language FROM source_tree JOIN files f ON f.id = file_id WHERE file_id IN (SELECT file_id FROM symbols)),
i AS (
  SELECT file_id, language, unnest(regexp_extract_all(c, '(?m)^import ([\w.]+)$', 1)) AS p FROM t WHERE language = 'python'
  UNION ALL SELECT file_id, language, unnest(regexp_extract_all(c, '(?m)^from ([\w.]+) import ', 1)) FROM t WHERE language = 'python'
  UNION ALL SELECT file_id, language, unnest(regexp_extract_all(c, '(?m)^import (\w+)$', 1)) FROM t WHERE language = 'swift'
  UNION ALL SELECT file_id, language, unnest(regexp_extract_all(c, '(?m)^using ([\w.]+);', 1)) FROM t WHERE language = 'csharp'
  UNION ALL SELECT file_id, language, unnest(regexp_extract_all(c, '(?m)^import [^;]*?[''"]([^''"]+)[''"]', 1)) FROM t WHERE language IN ('javascript', 'typescript'))
SELECT file_id, p AS import_path, count(*) AS n FROM i GROUP BY file_id, p""")
def x02_imports_by_pattern(spark, d):
    """Imports of the hand-written files in the languages where a line pattern tells them."""
    listed = table(spark, d, "symbols").select("file_id").distinct()
    texts = _texts(spark, d).where("language in ('python', 'swift', 'csharp', 'javascript', 'typescript')")
    i = relations(texts)["imports"].join(listed, F.col("source_file_id") == F.col("file_id"), "left_semi")
    return i.groupBy(F.col("source_file_id").alias("file_id"), "import_path").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT language, count(*) AS functions, count(*) AS graphs FROM symbols JOIN files f ON f.id = file_id WHERE kind = 'fn' AND language IN ('rust', 'csharp') GROUP BY language""")
def g01_listed_functions(spark, d):
    """Functions of the table that have a flow graph with one entry and one exit."""
    from codeloom.flow.tables import file_graphs

    ends = lambda k: F.size(F.filter("nodes", lambda n: n["kind"] == k)) == 1
    g = file_graphs(_texts(spark, d)).where("error is null").where(ends("entry") & ends("exit")).select("file_id", "name", F.col("line").alias("at"))
    s = table(spark, d, "symbols").where("kind = 'fn'").withColumn("upto", F.greatest("end_line", "line"))
    f = table(spark, d, "files").where("language in ('rust', 'csharp')").select(F.col("id").alias("file_id"), "language")
    hit = s.join(g, ["file_id", "name"]).where("at between line and upto").select("id").distinct().withColumn("hit", F.lit(1))
    return s.join(f, "file_id").join(hit, "id", "left").groupBy("language").agg(F.count(F.lit(1)).alias("functions"), F.count("hit").alias("graphs"))


@query()
def x02_extract_imports(spark, d):
    return relations(_texts(spark, d))["imports"]


@query()
def x03_extract_references(spark, d):
    return relations(_texts(spark, d))["raw_references"]


@query(r"""WITH f AS (SELECT id, path, language = 'python' AS py, regexp_replace(path, '\.[^./]*$', '') AS stem FROM files WHERE language IN ('typescript', 'javascript', 'python')),
asked AS (SELECT a.id AS source_file_id, b.stem, a.py FROM f a JOIN f b ON b.id = a.id + 1 AND b.py = a.py WHERE NOT a.py OR b.stem NOT LIKE '%.%'),
ends AS (SELECT * FROM (VALUES (false, '', 0), (false, '.ts', 1), (false, '.tsx', 2), (false, '.js', 3), (false, '.jsx', 4), (false, '.mjs', 5), (false, '.cjs', 6), (false, '/index.ts', 7), (false, '/index.tsx', 8), (false, '/index.js', 9), (true, '.py', 0), (true, '/__init__.py', 1)) AS e(py, tail, k)),
hit AS (SELECT source_file_id, arg_min(g.id, k) AS hit FROM asked JOIN ends USING (py) JOIN files g ON g.path = stem || tail GROUP BY source_file_id)
SELECT source_file_id, CASE WHEN hit <> source_file_id THEN hit END AS resolved_file_id FROM asked LEFT JOIN hit USING (source_file_id)""")
def r08_resolve_paths(spark, d):
    """Imports of the file with the next id by its path from the root: climbs and
    names in scripts, dots in Python (where no part of the path has a dot)."""
    f = table(spark, d, "files").where("language in ('typescript', 'javascript', 'python')")
    f = f.select("id", (F.col("language") == "python").alias("py"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), (F.size(F.split("path", "/")) - 1).alias("depth"))
    b = f.select((F.col("id") - 1).alias("id"), "py", F.col("stem").alias("to"))
    pairs = f.join(b, ["id", "py"]).where(~F.col("py") | ~F.col("to").contains("."))
    dots = F.concat(F.repeat(F.lit("."), F.col("depth") + 1), F.replace("to", F.lit("/"), F.lit(".")))
    climb = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.col("depth")), F.col("to"))
    asked = pairs.select("id", F.col("id").alias("source_file_id"), F.when(F.col("py"), dots).otherwise(climb).alias("import_path"))
    return resolve_imports(asked, table(spark, d, "files")).select("source_file_id", "resolved_file_id")


@query()
def r08_resolve_imports(spark, d):
    rel = relations(_texts(spark, d))
    return resolve_imports(rel["imports"], table(spark, d, "files"))


@query()
def g01_flow_nodes(spark, d):
    from codeloom.flow.tables import file_graphs

    return file_graphs(_texts(spark, d)).select("file_id", "line", "name", F.inline_outer("nodes").alias("node", "kind", "label", "node_line"), "error").where("node is not null or error is not null")


@query()
def g02_flow_edges(spark, d):
    from codeloom.flow.tables import file_graphs

    return file_graphs(_texts(spark, d)).select("file_id", "line", "name", F.inline_outer("edges").alias("source", "target", "label"), "error").where("source is not null or error is not null")
