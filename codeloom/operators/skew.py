"""Per-key results when a few keys hold most records (problem 3).

A multi-level tree instead of one reducer per key.  Every input chunk (a scan
partition, of fixed size by ``spark.sql.files.maxPartitionBytes``) is combined
on its own, giving one state per key and chunk; rounds then merge the states of
``fan_in`` neighbouring chunks, until one chunk is left.  No task ever receives
more than ``fan_in`` states of one key, however many rows the key has and
however many partitions there were.  Only the states move, never the rows; distinct
counts (``per_key_sites``) move each row once before.
"""

from __future__ import annotations

import math
from fractions import Fraction

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a state column is merged.
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(df: DataFrame, keys: list[str], states: dict[str, tuple[str, Column]], fan_in: int = 8, chunks: int | None = None) -> DataFrame:
    """``keys`` plus one column per state; ``states`` maps a name to (merge, input).

    ``merge`` is ``sum``, ``min`` or ``max``.  The result has one row per
    distinct key (null keys included, as one group).  An empty table gives no
    rows.  Columns of ``df`` that are neither keys nor inputs are not read, so
    clashing extra names do no harm.  ``chunks`` is the number of partitions of
    ``df``; where it is not given, the plan is asked (cheap for a scan; pass it
    where ``df`` ends in a shuffle).
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    bad = set(keys) & set(states) | {k for k, (m, _) in states.items() if m not in _MERGE}
    if bad:
        raise ValueError(f"bad state: {sorted(bad)}")
    key_cols = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    work = df.select(*key_cols, *[c.alias(f"_s{i}") for i, (_, c) in enumerate(states.values())], F.spark_partition_id().alias("_chunk"))
    names = [f"_k{i}" for i in range(len(keys))]
    merges = [_MERGE[m](f"_s{i}").alias(f"_s{i}") for i, (m, _) in enumerate(states.values())]
    if chunks is None:
        chunks = df._jdf.queryExecution().toRdd().getNumPartitions()
    rounds, left = 1, fan_in
    while left < chunks:
        rounds, left = rounds + 1, left * fan_in
    # map-side combine makes one state per key and chunk, so the first exchange already carries states
    for r in range(rounds):
        bucket = F.lit(0) if r == rounds - 1 else F.floor(F.col("_chunk") / fan_in)
        work = work.withColumn("_chunk", bucket.cast("int")).groupBy(*names, "_chunk").agg(*merges)
    return work.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        *[F.col(f"_s{i}").alias(s) for i, s in enumerate(states)],
    )


#: Buckets of files by hash; a bucket with more than this share and number of rows is hot.
FILE_BUCKETS, HOT_SHARE, HOT_ROWS = 16_384, 1 / 4_096, 200_000


def per_key_sites(df: DataFrame, key: str, fan_in: int = 8, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Usage figures per key: ``key, n_rows, sites, files, first_site, last_site``.

    ``n_rows`` counts all rows, ``sites`` distinct (file, line, column) and
    ``files`` distinct files; the first and last site are ordered by file, line
    and column (nulls first).  Null keys form a group of their own, and so do
    null files.

    Each row moves once, to the place of its (key, file), which serves both
    distinct counts; a hot key is spread over its files.  Files that hold many
    rows, found by a count per hash bucket, are counted by site first, which
    combines repeats where they lie and spreads the rest.  The tree does all
    that remains on states.
    """
    base = df.select(F.col(f"`{key}`").alias("key"), "file_id", "line", "column")
    bucket = F.pmod(F.xxhash64("file_id"), F.lit(FILE_BUCKETS))
    total = df.count()
    least = max(hot_rows, int(total * HOT_SHARE))
    # below 1 / HOT_SHARE rows, as each stands for more than that share of the table
    hot = [r[0] for r in base.groupBy(bucket.alias("b")).count().where(F.col("count") > least).select("b").collect()] if total > least else []

    def by_file(rows: DataFrame) -> DataFrame:
        by_site = rows.groupBy("key", "file_id", "line", "column").agg(F.count(F.lit(1)).alias("n"))
        return by_site.groupBy("key", "file_id").agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("sites"),
            F.min(F.struct("line", "column")).alias("lo"),
            F.max(F.struct("line", "column")).alias("hi"),
        )

    parts = [by_file((base.where(~bucket.isin(hot)) if hot else base).repartition("key", "file_id"))]
    if hot:
        parts.append(by_file(base.where(bucket.isin(hot))))
    at = lambda e: F.struct("file_id", F.col(f"{e}.line").alias("line"), F.col(f"{e}.column").alias("column"))
    return tree_aggregate(
        reduce(DataFrame.unionByName, parts),
        ["key"],
        {
            "n_rows": ("sum", F.col("n")),
            "sites": ("sum", F.col("sites")),
            "files": ("sum", F.lit(1).cast("long")),
            "first_site": ("min", at("lo")),
            "last_site": ("max", at("hi")),
        },
        fan_in,
        len(parts) * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, fan_in: int = 8) -> DataFrame:
    """Non-null keys holding at least ``share`` of all rows: ``key, n_rows``.

    The total is a count of the table, which Parquet answers from its footers.
    An empty table has no heavy keys.
    """
    least = math.ceil(Fraction(str(share)) * df.count())
    counts = tree_aggregate(df, [key], {"n_rows": ("sum", F.lit(1).cast("long"))}, fan_in)
    return counts.select(F.col(f"`{key}`").alias("key"), "n_rows").where(F.col("key").isNotNull() & (F.col("n_rows") >= max(1, least)))
