from datetime import datetime, timedelta

from codeloom.session import work_dir
from codeloom.streaming.ingest import StreamStore, stream_changes

T0 = datetime(2025, 1, 1)


def test_stream_equals_batches(spark):
    root = work_dir(spark, "stream")
    land = lambda name, rows: spark.createDataFrame(rows, "feed_id long, id long, content_hash string, last_indexed_at timestamp").coalesce(1).write.parquet(f"{root}/landing/{name}")
    land("a", [(1, 1, "x", T0), (2, 2, None, T0)])
    stream_changes(spark, f"{root}/landing", root).awaitTermination()
    land("b", [(3, 1, " X", T0 + timedelta(1)), (4, 2, "y", T0), (5, 1, "old", T0 - timedelta(1))])
    stream_changes(spark, f"{root}/landing", root).awaitTermination()
    stream_changes(spark, f"{root}/landing", root).awaitTermination()  # nothing new
    out = StreamStore(spark, root).outputs()
    assert {(r.batch, r.feed_id, r.is_change) for r in out.collect()} == {(0, 1, True), (1, 3, False), (1, 4, True)}
