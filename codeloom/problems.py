"""Queries of the general problems 1, 3 and 4 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.incremental import replay_runs
from codeloom.operators.skew import heavy_keys, per_key_sites
from codeloom.operators.snapshots import symbol_changes
from codeloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return replay_runs(table(spark, d, "file_feed"), table(spark, d, "index_runs")).select("run_no", "feed_id")


def p1_run_report(spark: SparkSession, d: str) -> DataFrame:
    """Records and distinct files each successful run had to process."""
    done = replay_runs(table(spark, d, "file_feed"), table(spark, d, "index_runs"))
    return done.groupBy("run_no").agg(F.count(F.lit(1)).alias("n_records"), F.min("feed_id").alias("first_feed_id"), F.max("feed_id").alias("last_feed_id"))


_P1 = """
WITH ok AS (SELECT run_no, started_at FROM index_runs WHERE status = 'ok'),
seen AS (
  SELECT o.run_no, f.id, f.feed_id, lower(regexp_replace(f.content_hash, '^\\s+|\\s+$', '', 'g')) AS h,
         row_number() OVER (PARTITION BY o.run_no, f.id ORDER BY f.last_indexed_at DESC, f.feed_id) AS k
  FROM file_feed f JOIN ok o ON f.arrived_at <= o.started_at
  WHERE f.content_hash IS NOT NULL AND f.last_indexed_at IS NOT NULL),
force AS (
  SELECT run_no, id, feed_id, h, lag(h) OVER (PARTITION BY id ORDER BY run_no) AS before FROM seen WHERE k = 1),
found AS (SELECT run_no, feed_id FROM force WHERE before IS NULL OR before <> h)
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    names = heavy_keys(table(spark, d, "raw_references"), "symbol_name").select(F.lit("raw_references").alias("table_name"), F.col("key").alias("heavy_key"))
    ids = heavy_keys(table(spark, d, "references_"), "symbol_id").select(F.lit("references_").alias("table_name"), F.col("key").cast("string").alias("heavy_key"))
    return names.unionByName(ids)


def _flat(df: DataFrame, key: str) -> DataFrame:
    out = [F.col("key").alias(key), "n_rows", "sites", "files"]
    for e in ("first", "last"):
        out += [F.col(f"{e}_site.{c}").alias(f"{e}_{a}") for c, a in (("file_id", "file"), ("line", "line"), ("column", "column"))]
    return df.select(*out)


def p3_name_sites(spark: SparkSession, d: str) -> DataFrame:
    return _flat(per_key_sites(table(spark, d, "raw_references"), "symbol_name"), "symbol_name")


def p3_symbol_sites(spark: SparkSession, d: str) -> DataFrame:
    return _flat(per_key_sites(table(spark, d, "references_"), "symbol_id"), "symbol_id")


def _sites_sql(table_name: str, key: str) -> str:
    return f"""
WITH g AS (SELECT {key}, count(*) AS n_rows, count(DISTINCT (file_id, line, "column")) AS sites, count(DISTINCT file_id) AS files,
  min((file_id, line, "column")) AS lo, max((file_id, line, "column")) AS hi FROM {table_name} GROUP BY {key})
SELECT {key}, n_rows, sites, files, lo[1] AS first_file, lo[2] AS first_line, lo[3] AS first_column,
  hi[1] AS last_file, hi[2] AS last_line, hi[3] AS last_column FROM g"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return symbol_changes(table(spark, d, "symbol_snapshots")).select("snapshot_no", "path", "name", "change_kind")


def p4_symbol_changes(spark: SparkSession, d: str) -> DataFrame:
    return symbol_changes(table(spark, d, "symbol_snapshots"))


_P4 = """
WITH latest AS (
  SELECT * FROM (SELECT *, max(delivery_no) OVER (PARTITION BY snapshot_no, path) AS top FROM symbol_snapshots) WHERE delivery_no = top),
stands AS (
  SELECT DISTINCT snapshot_no, path, name, line, end_line, kind, visibility FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, path, name
      ORDER BY line DESC NULLS LAST, end_line DESC NULLS LAST, kind DESC NULLS LAST, visibility DESC NULLS LAST) AS k FROM latest) WHERE k = 1),
steps AS (SELECT s AS snapshot_no, lag(s) OVER (ORDER BY s) AS before FROM (SELECT DISTINCT snapshot_no AS s FROM symbol_snapshots)),
o AS (SELECT t.snapshot_no, s.path, s.name, s.line, s.end_line, s.kind, s.visibility FROM steps t JOIN stands s ON s.snapshot_no = t.before),
n AS (SELECT t.snapshot_no, s.path, s.name, s.line, s.end_line, s.kind, s.visibility FROM steps t JOIN stands s ON s.snapshot_no = t.snapshot_no WHERE t.before IS NOT NULL),
found AS (
  SELECT snapshot_no, path, name, CASE WHEN o.line IS NULL AND o.kind IS NULL THEN 'added' WHEN n.line IS NULL AND n.kind IS NULL THEN 'removed' ELSE 'modified' END AS change_kind,
    o.line AS old_line, n.line AS new_line
  FROM o FULL JOIN n USING (snapshot_no, path, name)
  WHERE o.line IS DISTINCT FROM n.line OR o.end_line IS DISTINCT FROM n.end_line OR o.kind IS DISTINCT FROM n.kind OR o.visibility IS DISTINCT FROM n.visibility)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_run_report, p3_found, p3_name_sites, p3_symbol_sites, p4_found, p4_symbol_changes)}

SQL = {
    "p1_found": _P1 + "SELECT run_no, feed_id FROM found",
    "p1_run_report": _P1 + "SELECT run_no, count(*) AS n_records, min(feed_id) AS first_feed_id, max(feed_id) AS last_feed_id FROM found GROUP BY run_no",
    "p3_found": """
SELECT 'raw_references' AS table_name, symbol_name AS heavy_key FROM raw_references WHERE symbol_name IS NOT NULL
  GROUP BY symbol_name HAVING count(*) * 50 >= (SELECT count(*) FROM raw_references)
UNION ALL
SELECT 'references_', CAST(symbol_id AS VARCHAR) FROM references_ WHERE symbol_id IS NOT NULL
  GROUP BY symbol_id HAVING count(*) * 50 >= (SELECT count(*) FROM references_)""",
    "p3_name_sites": _sites_sql("raw_references", "symbol_name"),
    "p3_symbol_sites": _sites_sql("references_", "symbol_id"),
    "p4_found": _P4 + "SELECT snapshot_no, path, name, change_kind FROM found",
    "p4_symbol_changes": _P4 + "SELECT snapshot_no, path, name, change_kind, old_line, new_line FROM found",
}
