"""Filling fixed-capacity containers with items (problem 6).

The plan is made on the histogram of lengths, never on documents: at most
``capacity`` distinct lengths reach the driver whatever the data's size.
Best-fit decreasing runs over counts; a set of equal containers is one range of
container numbers with one residual, and placing ``n`` items of a length moves
or splits a range.  Documents then take the planned slots by joining on their
rank within their length.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize

CAPACITY = 4096


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts.

    ``histogram`` maps a length (1..capacity) to its number of items.  Returns
    segments ``(length, first_rank, count, first_container)``: the items of
    that length with ranks first_rank.. go to containers first_container..,
    one each.  Segments number a few per length, not per item.
    """
    residuals: dict[int, list[tuple[int, int]]] = {}  # residual -> ranges (first container, count)
    order: list[int] = []  # sorted residuals in use
    import bisect

    def put(res: int, first: int, count: int) -> None:
        if res <= 0 or count <= 0:
            return
        if res not in residuals:
            residuals[res] = []
            bisect.insort(order, res)
        heapq.heappush(residuals[res], (first, count))

    segments, containers = [], 0
    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):  # nothing fits: open containers, filled with as many of this length as they hold
                each = capacity // length
                full, rest = divmod(left, each)
                for k in range(each if full else 0):
                    segments.append((length, rank + k * full, full, containers))
                if full:
                    put(capacity - each * length, containers, full)
                    containers += full
                    rank += each * full
                for k in range(rest):
                    segments.append((length, rank + k, 1, containers))
                if rest:
                    put(capacity - rest * length, containers, 1)
                    containers += 1
                break
            res = order[at]
            first, count = heapq.heappop(residuals[res])
            if not residuals[res]:
                del residuals[res]
                order.pop(at)
            use = min(count, left)
            segments.append((length, rank, use, first))
            rank, left = rank + use, left - use
            put(res - length, first, use)
            put(res, first + use, count - use)
    return segments


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, n_tokens, piece, piece_tokens``: a document larger than a
    container becomes full pieces and a rest; every other is one piece."""
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    cut = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.withColumn("piece_tokens", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece").cast("long") * capacity))


def pack(sizes: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 200_000) -> DataFrame:
    """Container of every piece.

    ``sizes``: ``doc_id`` (unique), ``n_tokens``.  Result: ``doc_id, piece,
    first_token, piece_tokens, container, split``; empty documents (0 tokens or
    null) get container -1, as they take no space.  ``split`` is true for
    documents that alone exceed the capacity, the only ones ever cut.

    ``sizes`` is read three times, so pass a written table.  Ranks within a
    length are counted per (length, bucket of doc_id) and shifted by the counts
    of the buckets before, so no length, however common, meets in one task.
    """
    spark = sizes.sparkSession
    base = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    buckets = max(1, -(-base.count() // rows_per_bucket))
    cut = pieces(base, capacity).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    filled = cut.where("piece_tokens > 0")
    by_bucket = filled.groupBy("piece_tokens", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows
    histogram = {int(r[0]): int(r[1]) for r in by_bucket.groupBy("piece_tokens").agg(F.sum("n")).collect()}
    segments = plan_containers(histogram, capacity)
    from pyspark.sql import Window

    before = Window.partitionBy("piece_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # capacity x buckets rows, joined on both columns; small beside the documents
    offsets = by_bucket.withColumn("_shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("piece_tokens", "_bucket").orderBy("doc_id", "piece")
    ranked = filled.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["piece_tokens", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_shift"))
    # the plan as one array per length: bounded by the capacity, so its broadcast is too
    per_length: dict[int, list] = {}
    for length, first, count, container in segments:
        per_length.setdefault(length, []).append((first, count, container))
    plan = spark.createDataFrame(
        [(k, [tuple(map(int, x)) for x in sorted(v)]) for k, v in per_length.items()],
        "piece_tokens long, slots array<struct<first:long,count:long,container:long>>",
    )
    placed = ranked.join(F.broadcast(plan), "piece_tokens")
    slot = F.filter("slots", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["first"] + s["count"]))[0]
    placed = placed.withColumn("container", slot["container"] + F.col("_rank") - slot["first"])
    nothing = cut.where("piece_tokens <= 0").withColumn("container", F.lit(-1).cast("long"))
    out = lambda df: df.select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "piece_tokens", "container", (F.col("n_tokens") > capacity).alias("split")
    )
    return out(placed).unionByName(out(nothing))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, **tokens) -> DataFrame:
    """``pack`` over texts: counts tokens once, writes the sizes, packs."""
    from codeloom.llm.tokens import token_counts

    return pack(materialize(token_counts(docs, ["doc_id"], **tokens), "sizes"), capacity)


def over_several(packed: DataFrame) -> DataFrame:
    """``doc_id`` of the documents whose pieces lie in more than one container."""
    per = packed.where("container >= 0").groupBy("doc_id").agg(F.min("container").alias("_lo"), F.max("container").alias("_hi"))
    return per.where("_lo < _hi").select("doc_id")


def placement_report(packed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of counts: ``documents``; ``misplaced``, whose pieces don't add up to
    the document in order; ``cut_needlessly``, in pieces though they fit;
    ``overfull`` containers and ``idle`` ones, which could go into another."""
    whole = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("_n"))
    per = packed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_pieces"), F.max("piece").alias("_last"), F.count_distinct("piece").alias("_kinds"),
        F.sum("piece_tokens").alias("_t"), F.max(F.col("first_token") + F.col("piece_tokens")).alias("_end"),
    )
    both = whole.join(per, "doc_id", "full")
    right = (F.col("_t") == F.col("_n")) & (F.col("_end") == F.col("_n")) & (F.col("_kinds") == F.col("_pieces")) & (F.col("_last") == F.col("_pieces") - 1)
    docs = both.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.coalesce(right, F.lit(False))).alias("misplaced"),
        F.count_if((F.col("_n") <= capacity) & (F.col("_pieces") > 1)).alias("cut_needlessly"),
    )
    used = packed.where("container >= 0").groupBy("container").agg(F.sum("piece_tokens").alias("t"))
    least = used.agg(F.count_if(F.col("t") > capacity).alias("overfull"), F.greatest(F.count_if(F.col("t") <= capacity // 2) - 1, F.lit(0)).alias("idle"))
    both = docs.unionByName(least, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, fill (used share of the containers' space)."""
    per = packed.where("container >= 0").groupBy("container").agg(F.sum("piece_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        F.round(F.coalesce(F.sum("t") / (F.count(F.lit(1)) * capacity), F.lit(0.0)), 6).alias("fill"),
    )
