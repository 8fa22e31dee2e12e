"""The incremental job as a stream of landing files.

The file source keeps track of what it has read in the checkpoint; each micro
batch is folded by the same function as a batch run and committed under its
batch number by one rename, so a batch that is run again after a failure either
finds itself committed or starts afresh.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.incremental import LANDED, BatchStore, changed_files, fold_state


class StreamStore(BatchStore):
    """A store whose input is tracked by the stream's own checkpoint."""

    def fold(self, rows: DataFrame, batch: int, process: Callable[[DataFrame, DataFrame | None], DataFrame]) -> None:
        if batch not in self.committed():
            self.commit(batch, f"{self.root}/_writing/{uuid.uuid4().hex}", process(rows, self.state()), fold_state)


def stream_changes(spark: SparkSession, landing: str, root: str, schema: str = LANDED, per_trigger: int = 1000) -> StreamingQuery:
    """Process every landing file that is there, then stop (``availableNow``).

    Call it again for what has landed since.  ``StreamStore(spark,
    root).outputs()`` holds the emitted rows.
    """
    store = StreamStore(spark, root)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(landing)
    writer = source.writeStream.foreachBatch(lambda df, batch: store.fold(df, batch, changed_files))
    return writer.option("checkpointLocation", f"{root}/_stream").trigger(availableNow=True).start()


__all__ = ["StreamStore", "fold_state", "stream_changes"]
