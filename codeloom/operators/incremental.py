"""Processing only new or changed records (problem 1).

A job keeps one folder per batch, ``batches/batch=B``, with

* ``files``  the manifest: path, size, modification time and SHA-256 of the
  input files batch B has consumed,
* ``rows``   what batch B emitted,
* ``state``  in some batches, the folded state of all batches up to B.

The folder is written elsewhere and appears by one rename, so its existence
*is* the commit of input and output together.  A run that dies before leaves
nothing a later run sees: its files are still absent from the manifest.  Of two
runs of one batch the second to rename fails.  Nothing is skipped and nothing
is repeated.

A run lists the landing folder, anti-joins the listing with the manifest,
hashes only files that are new or touched and folds their rows into the state.
The state is the log of emitted rows itself; it is folded again when the log
has grown by as much as its last fold, so folding costs a constant share of all
that is ever written.  Only state rows of ids that occur among the new rows are
ever shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import fs, publish, work_dir

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("checksum", T.StringType()),
    ]
)
#: Bytes of a file held at a time while it is hashed.
HASH_BLOCK = 8 << 20
#: New rows up to which their ids are sent to the state instead of both being shuffled.
BROADCAST_IDS = 1_000_000


def _open(path: str):
    """File system and path within it, for Python."""
    from pyarrow import fs as afs

    if path.startswith("file:"):
        return afs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return afs.FileSystem.from_uri(path)


def with_checksums(listing: DataFrame, root: str) -> DataFrame:
    """``listing`` (path, size, modified) with the SHA-256 of each file, read in blocks of fixed size.

    Where Python can't reach the file system of ``root``, the JVM reads the
    files instead, each of which must then be below 2 GB.
    """
    try:
        _open(root)
    except Exception:  # noqa: BLE001
        names = [r[0] for r in listing.select("path").collect()]
        if not names:
            return listing.withColumn("checksum", F.lit(None).cast("string"))
        whole = listing.sparkSession.read.format("binaryFile").load(names).select("path", F.sha2("content", 256).alias("checksum"))
        return listing.join(whole, "path")

    def go(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for b in batches:
            sums = []
            for path in b.column("path").to_pylist():
                files, at = _open(path)
                made = hashlib.sha256()
                with files.open_input_stream(at) as f:
                    while block := f.read(HASH_BLOCK):
                        made.update(block)
                sums.append(made.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.string())], names=[*b.schema.names, "checksum"])

    return listing.mapInArrow(go, T.StructType([*listing.schema, MANIFEST["checksum"]]))


@dataclass
class BatchStore:
    """Manifest, outputs and folded states of one incremental job."""

    spark: SparkSession
    root: str
    #: of the emitted rows; read once from the newest batch where not given
    schema: T.StructType | None = None

    def _at(self, batch: int, part: str) -> str:
        return f"{self.root}/batches/batch={batch}/{part}"

    def committed(self) -> list[int]:
        f, P = fs(self.spark, self.root)
        at = P(f"{self.root}/batches")
        if not f.exists(at):
            return []
        return sorted(int(s.getPath().getName()[6:]) for s in f.listStatus(at))

    def manifest(self) -> DataFrame:
        done = [self._at(b, "files") for b in self.committed()]
        return self.spark.read.schema(MANIFEST).parquet(*done) if done else self.spark.createDataFrame([], MANIFEST)

    def new_files(self, landing: list[str]) -> DataFrame:
        """Listing of ``landing`` minus the manifest, with checksums.

        The listing is compared by path, size and modification time; only what
        survives is read and hashed, and a touched file whose bytes are those
        already processed drops out by its checksum.
        """
        listing = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(landing)
        )
        seen = self.manifest()
        fresh = listing.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).join(
            seen.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti"
        )
        hashed = with_checksums(fresh.select("path", "size", "modified"), self.root)
        return hashed.join(seen.select("path", "checksum"), ["path", "checksum"], "left_anti").select(*MANIFEST.names)

    def outputs(self, batches: list[int] | None = None) -> DataFrame | None:
        """Rows of the committed batches only, with the column ``batch``."""
        done = self.committed() if batches is None else batches
        if not done:
            return None
        paths = [self._at(b, "rows") for b in done]
        if self.schema is None:
            self.schema = self.spark.read.parquet(paths[-1]).schema
        whole = T.StructType([*self.schema, T.StructField("batch", T.IntegerType())])
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/batches").parquet(*paths)

    def run(
        self,
        batch: int,
        landing: list[str],
        process: Callable[[DataFrame, DataFrame | None], DataFrame],
        compact: Callable[[DataFrame], DataFrame] | None = None,
        growth: float = 1.0,
        read: Callable[[list[str]], DataFrame] | None = None,
        fail_at: str | None = None,
    ) -> bool:
        """One run.  ``process(new rows, state or None)`` gives the batch's rows.

        Returns False if batch was committed before (a repeated call does
        nothing).  ``growth``: the log is folded when it has grown by so many
        times its last fold (at first, its first batch).  ``fail_at`` ("output"
        or "manifest") raises before that step is finished and exists for crash
        tests.
        """
        if batch in self.committed():
            return False
        stage = f"{self.root}/_writing/{uuid.uuid4().hex}"
        self.new_files(landing).write.parquet(f"{stage}/files")
        # file names only, as many as the run has new files; Spark's own file index holds the same list
        names = [r[0] for r in self.spark.read.schema(MANIFEST).parquet(f"{stage}/files").select("path").collect()]
        if names:
            emitted = process(read(names) if read else self.spark.read.parquet(*names), self.state())
        elif (prior := self.outputs()) is not None:
            emitted = prior.drop("batch").limit(0)
        else:
            self._drop(stage)
            return False  # nothing has ever arrived; there is no schema to write
        self.commit(batch, stage, emitted, compact, growth, fail_at)
        return True

    def commit(self, batch: int, stage: str, emitted: DataFrame, compact: Callable[[DataFrame], DataFrame] | None = None, growth: float = 1.0, fail_at: str | None = None) -> None:
        """Write the batch's rows, fold the log where it is due, and publish all of it at once."""
        self.schema = self.schema or emitted.schema
        emitted.write.parquet(f"{stage}/rows")
        if fail_at == "output":
            raise RuntimeError("stopped after the output, before the manifest")
        if compact and self._due(stage, growth):
            self.state(f"{stage}/rows").transform(compact).write.parquet(f"{stage}/state")
        if fail_at == "manifest":
            raise RuntimeError("stopped before the manifest was committed")
        publish(self.spark, stage, f"{self.root}/batches/batch={batch}")

    def _drop(self, path: str) -> None:
        f, P = fs(self.spark, path)
        f.delete(P(path), True)

    def _log(self) -> tuple[int | None, list[int]]:
        """The batch of the last fold, and the batches after it."""
        f, P = fs(self.spark, self.root)
        done = self.committed()
        folded = next((b for b in reversed(done) if f.exists(P(self._at(b, "state")))), None)
        return folded, [b for b in done if folded is None or b > folded]

    def _due(self, stage: str, growth: float) -> bool:
        f, P = fs(self.spark, self.root)
        size = lambda at: f.getContentSummary(P(at)).getLength()
        folded, later = self._log()
        sizes = [size(self._at(b, "rows")) for b in later] + [size(f"{stage}/rows")]
        base = size(self._at(folded, "state")) if folded is not None else sizes.pop(0)
        return bool(sizes) and sum(sizes) >= growth * base

    def state(self, own: str | None = None) -> DataFrame | None:
        """The last fold and all rows committed after it (and those at ``own``)."""
        folded, later = self._log()
        if self.schema is None and folded is not None:
            self.outputs([folded])  # reads the schema
        parts = [self._at(folded, "state")] if folded is not None else []
        parts += [self._at(b, "rows") for b in later] + ([own] if own else [])
        if not parts:
            return None
        if self.schema is None:
            self.outputs(later[-1:])
        return self.spark.read.schema(self.schema).parquet(*parts)


def _norm(hash_col: Column) -> Column:
    return F.lower(F.regexp_replace(hash_col, r"^\s+|\s+$", ""))


def changed_files(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """Fold feed rows into the state and emit every file whose row in force moved.

    Result: ``id, feed_id, content_hash, last_indexed_at, is_change``.  The row
    in force of a file is the one with the greatest ``last_indexed_at``, among
    equals the smallest ``feed_id``; ``is_change`` tells whether its normalised
    hash differs from the one in force before.  Void rows (no hash or no time)
    and rows without ``id`` or ``feed_id`` take no part; exact repeats fold
    away; extra columns are ignored.

    One shuffle, with map-side combine, of the new rows and the state rows of
    their ids: the maximum is associative, so the row in force over everything
    seen is the maximum of the old one and the new rows, and an id without new
    rows can't move.
    """
    rank = lambda: F.struct("last_indexed_at", F.negative("feed_id").alias("back"), "content_hash")
    new = rows.where(
        "content_hash is not null and last_indexed_at is not null and id is not null and feed_id is not null"
    ).select("id", F.struct(F.col("last_indexed_at"), F.negative("feed_id").alias("back"), _norm(F.col("content_hash")).alias("content_hash")).alias("row"), F.lit(False).alias("old"))
    both = new
    if state is not None:
        ids = new.select("id")
        # one long per new row, counted before it is sent; beyond that both sides are shuffled by id
        ids = F.broadcast(ids) if rows.count() <= BROADCAST_IDS else ids.distinct()
        both = new.unionByName(state.join(ids, "id", "left_semi").select("id", rank().alias("row"), F.lit(True).alias("old")))
    folded = both.groupBy("id").agg(
        F.max("row").alias("now"),
        F.max(F.when(F.col("old"), F.col("row"))).alias("before"),
    )
    moved = folded.where(F.col("before").isNull() | (F.col("now.back") != F.col("before.back")))
    return moved.select(
        "id",
        F.negative("now.back").alias("feed_id"),
        F.col("now.content_hash").alias("content_hash"),
        F.col("now.last_indexed_at").alias("last_indexed_at"),
        (F.col("before").isNull() | (F.col("now.content_hash") != F.col("before.content_hash"))).alias("is_change"),
    )


def fold_state(state: DataFrame) -> DataFrame:
    """Keep only the row in force of each file (same columns)."""
    top = state.groupBy("id").agg(F.max(F.struct("last_indexed_at", F.negative("feed_id").alias("back"), "content_hash")).alias("r"))
    return top.select(
        "id",
        F.negative("r.back").alias("feed_id"),
        F.col("r.content_hash").alias("content_hash"),
        F.col("r.last_indexed_at").alias("last_indexed_at"),
        F.lit(False).alias("is_change"),
    )


LANDED = "feed_id long, id long, content_hash string, last_indexed_at timestamp"


def land_feed(feed: DataFrame, starts: list, to: str) -> None:
    """Write the feed as the landing files that each run would find.

    ``slot=k`` holds what arrived after run k-1 began and no later than run k
    began.  The rebalance hint splits a slot that holds most rows.
    """
    at = F.array(*[F.lit(s) for s in starts])
    slot = F.size(F.filter(at, lambda s: s < F.col("arrived_at")))
    keep = feed.where("arrived_at is not null").select("feed_id", "id", "content_hash", "last_indexed_at", slot.alias("slot"))
    keep.hint("rebalance", "slot").write.partitionBy("slot").option("maxRecordsPerFile", 2_000_000).parquet(to)


def replay_runs(feed: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """Every successful run of the run log over the feed; ``run_no, feed_id, id``.

    Runs that failed, were killed or have no status commit nothing, so what
    they saw is still new to the next successful run.  Empty feed or no
    successful run: no rows.
    """
    spark = feed.sparkSession
    root = root or work_dir(spark, "incremental")
    # the run log holds one row per run: small by nature
    log = [tuple(r) for r in runs.where("started_at is not null").orderBy("started_at", "run_no").select("run_no", "started_at", "status").collect()]
    empty = "run_no int, feed_id long, id long"
    if not log:
        return spark.createDataFrame([], empty)
    # kept as numbers: timestamps collected in one zone and sent back in another would shift
    starts = [r[0] for r in runs.where("started_at is not null").orderBy("started_at", "run_no").select(F.unix_micros("started_at")).collect()]
    land_feed(feed.withColumn("arrived_at", F.unix_micros("arrived_at")), starts, f"{root}/landing")
    f, P = fs(spark, root)
    store = BatchStore(spark, root)
    for k, (run_no, _, status) in enumerate(log):
        if status != "ok":
            continue
        landing = [p for s in range(k + 1) if f.exists(P(p := f"{root}/landing/slot={s}"))]
        if landing:
            store.run(run_no, landing, changed_files, fold_state, read=lambda names: spark.read.schema(LANDED).parquet(*names))
    out = store.outputs()
    if out is None:
        return spark.createDataFrame([], empty)
    return out.where("is_change").select(F.col("batch").cast("int").alias("run_no"), "feed_id", "id")
