"""What changed between full snapshots (problem 4).

Rows of both snapshots of a step, tagged by side, meet in ONE aggregation
shuffle on (step, key); the maximum per side picks the row that stands, and the
two row hashes give the class.  A row is the new side of its own step and the
old side of the next, so all steps of a series go through the same shuffle.
Aggregation is map-side combined, so repeats and hot keys shrink before they
move; in a series its states are of fixed width, so it hashes and never sorts.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize

#: Redelivered (snapshot, path) pairs up to which they are sent to the rows; beyond, both are shuffled.
BROADCAST_PAIRS = 200_000
#: Bits of the row hash below the line in the rank of a row; with it, a rank stays below 38 digits.
_RANK_BITS = 61


def _classify(tagged: DataFrame, by: list[str], values: list[str], order: list[str]) -> DataFrame:
    """``tagged``: ``by``, ``values``, ``order``, ``_new`` (side)."""
    lead = list(dict.fromkeys([*order, *values]))
    # nulls are part of the hash as a mark of their own, so null equals null only
    row_hash = F.xxhash64(*[x for v in values for x in (F.col(v), F.col(v).isNull())])
    row = F.struct(*[F.col(c) for c in lead], row_hash.alias("_hash"))
    side = lambda new: F.max(F.when(F.col("_new") == F.lit(new), row))
    both = tagged.groupBy(*by).agg(side(False).alias("_old"), side(True).alias("_now"))
    # equal hashes are confirmed on the values, so a collision can't hide a change
    same = (F.col("_old._hash") == F.col("_now._hash"))
    for v in values:
        same = same & F.col(f"_old.{v}").eqNullSafe(F.col(f"_now.{v}"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_now").isNull(), "removed").when(~same, "modified")
    return both.withColumn("change_kind", kind).where("change_kind is not null")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Changes between two full snapshots.

    Result: ``keys``, ``change_kind`` (added, removed, modified) and per value
    ``old_<v>`` and ``new_<v>``.  Keys are matched null-safely; among several
    rows of one key the greatest by ``order``, then by ``values``, stands.
    Unchanged keys give no row; two empty snapshots give none.
    """
    use = [F.col(f"`{c}`") for c in dict.fromkeys([*keys, *values, *order])]
    both = old.select(*use).withColumn("_new", F.lit(False)).unionByName(new.select(*use).withColumn("_new", F.lit(True)))
    found = _classify(both, keys, values, order)
    return found.select(
        *keys, "change_kind",
        *[F.col(f"_old.{v}").alias(f"old_{v}") for v in values],
        *[F.col(f"_now.{v}").alias(f"new_{v}") for v in values],
    )


def latest_delivery(df: DataFrame) -> DataFrame:
    """Rows of the highest ``delivery_no`` of each snapshot and path.

    Only paths delivered more than once matter.  Their maxima come from a
    map-side combined aggregation of two numbers per pair, are written, and go
    to the rows where they lie; the rows don't move for it unless the pairs are
    more than ``BROADCAST_PAIRS``.  Null numbers are below all others.
    """
    again = (
        df.groupBy("snapshot_no", "path")
        .agg(F.min(F.coalesce("delivery_no", F.lit(-(2**31)))).alias("_lo"), F.max("delivery_no").alias("_top"))
        .where("_lo < _top")
        .select(F.col("snapshot_no").alias("_s"), F.col("path").alias("_p"), "_top")
    )
    again = materialize(again, "redelivered")
    if again.count() <= BROADCAST_PAIRS:
        again = F.broadcast(again)
    joined = df.join(again, df.snapshot_no.eqNullSafe(F.col("_s")) & df.path.eqNullSafe(F.col("_p")), "left")
    return joined.where("_top is null or delivery_no = _top").drop("_s", "_p", "_top")


def symbol_changes(snapshots: DataFrame) -> DataFrame:
    """All steps of a snapshot series: ``snapshot_no, path, name, change_kind,
    old_line, new_line``.

    A step runs from the delivered snapshot before to ``snapshot_no`` (gaps in
    the numbers are no snapshots); the first yields none.  Rows of superseded
    deliveries don't count; of several symbols of one name in a file the one
    with the greatest line stands (nulls lowest; at one line any, but the same
    in every snapshot).  ``modified`` compares line, end_line, kind and
    visibility, null equal to null only, by 125 bits of two hashes beside the
    line itself.  Rows without snapshot_no take no part; null paths and names
    are ordinary values.
    """
    cols = ["snapshot_no", "delivery_no", "path", "name", "kind", "line", "end_line", "visibility"]
    rows = snapshots.where("snapshot_no is not null").select(*cols)
    # one number per snapshot, not per row
    numbers = sorted(r[0] for r in rows.select("snapshot_no").distinct().collect())
    spark = snapshots.sparkSession
    result = "snapshot_no int, path string, name string, change_kind string, old_line long, new_line long"
    if len(numbers) < 2:
        return spark.createDataFrame([], result)

    def steps() -> Column:
        entry = lambda step, new: F.struct(F.lit(step).cast("int").alias("step"), F.lit(new).alias("new"))
        by_snapshot = []
        for i, n in enumerate(numbers):
            tags = [entry(n, True)] if i else []
            if i + 1 < len(numbers):
                tags.append(entry(numbers[i + 1], False))
            by_snapshot += [F.lit(n).cast("int"), F.array(*tags)]
        return F.element_at(F.create_map(*by_snapshot), F.col("snapshot_no"))

    values = ["line", "end_line", "kind", "visibility"]
    marked = [x for v in values for x in (F.col(v), F.col(v).isNull())]
    low, high = F.xxhash64(*marked), F.xxhash64(F.lit(1), *marked)
    # line first, then part of the hash: a number of fixed width that orders the rows of a key
    place = F.coalesce(F.col("line").cast("decimal(19,0)"), F.lit(Decimal(-(2**63)) - 1).cast("decimal(19,0)"))
    rank = (place * F.lit(Decimal(2**_RANK_BITS)) + F.shiftrightunsigned(low, 64 - _RANK_BITS).cast("decimal(19,0)")).cast("decimal(38,0)")
    tagged = latest_delivery(rows).select("snapshot_no", "path", "name", "line", rank.alias("_rank"), high.alias("_hash")).withColumn("_tag", F.explode(steps()))
    side = lambda new, c: F.when(F.col("_tag.new") == F.lit(new), F.col(c))
    both = tagged.groupBy(F.col("_tag.step").alias("snapshot_no"), "path", "name").agg(
        *[f.alias(f"_{k}_{e}") for e, new in (("old", False), ("now", True)) for k, f in (
            ("rank", F.max(side(new, "_rank"))), ("hash", F.max_by(side(new, "_hash"), side(new, "_rank"))), ("line", F.max(side(new, "line"))),
        )]
    )
    same = (F.col("_rank_old") == F.col("_rank_now")) & (F.col("_hash_old") == F.col("_hash_now"))
    kind = F.when(F.col("_rank_old").isNull(), "added").when(F.col("_rank_now").isNull(), "removed").when(~same, "modified")
    found = both.withColumn("change_kind", kind).where("change_kind is not null")
    return found.select("snapshot_no", "path", "name", "change_kind", F.col("_line_old").alias("old_line"), F.col("_line_now").alias("new_line"))
