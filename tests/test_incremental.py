import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.operators.incremental import LANDED, BatchStore, changed_files, fold_state, replay_runs
from codeloom.session import work_dir

T0 = datetime(2025, 1, 1)
FEED = "feed_id long, id long, path string, content_hash string, language string, last_indexed_at timestamp, arrived_at timestamp"
RUNS = "run_no int, started_at timestamp, status string"


def brute(feed, runs):
    """Every ok run looks at all it can see."""
    out, before = set(), {}
    for run_no, started, status in sorted(runs, key=lambda r: r[1]):
        if status != "ok":
            continue
        force = {}
        for feed_id, i, _, h, _, at, arrived in feed:
            if h is not None and at is not None and arrived is not None and arrived <= started:
                if i not in force or (at, -feed_id) > (force[i][0], -force[i][1]):
                    force[i] = (at, feed_id, h.strip().lower())
        for i, (_, feed_id, h) in force.items():
            if before.get(i) != h:
                out.add((run_no, feed_id))
        before = {i: v[2] for i, v in force.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    feed = []
    for k in range(120):
        feed.append((k, rng.randrange(9), "p", rng.choice([None, "aa", " AA", "bb\t", "cc"]), "go", rng.choice([None, T0 + timedelta(hours=rng.randrange(30))]), T0 + timedelta(hours=rng.randrange(40))))
    runs = [(n, T0 + timedelta(hours=6 * n), s) for n, s in enumerate(["ok", "failed", "ok", None, "killed", "ok"], 1)]
    got = replay_runs(spark.createDataFrame(feed, FEED).withColumn("slot", F.lit("clash")), spark.createDataFrame(runs, RUNS))
    assert {(r.run_no, r.feed_id) for r in got.collect()} == brute(feed, runs)


def test_empty_feed_and_no_runs(spark):
    empty = spark.createDataFrame([], FEED)
    runs = spark.createDataFrame([(1, T0, "ok")], RUNS)
    assert replay_runs(empty, runs).count() == 0
    assert replay_runs(empty, runs.limit(0)).count() == 0


def _land(spark, at, name, rows):
    spark.createDataFrame(rows, "feed_id long, id long, content_hash string, last_indexed_at timestamp").coalesce(1).write.parquet(f"{at}/{name}")


@pytest.mark.parametrize("where", ["output", "manifest"])
def test_crash_neither_skips_nor_repeats(spark, where):
    root = work_dir(spark, "crash")
    store = BatchStore(spark, root)
    land = f"{root}/landing"
    _land(spark, land, "a", [(1, 1, "x", T0), (2, 2, "x", T0)])
    assert store.run(1, [land], changed_files, fold_state)
    _land(spark, land, "b", [(3, 1, "y", T0 + timedelta(1))])
    with pytest.raises(RuntimeError):
        store.run(2, [land], changed_files, fold_state, fail_at=where)
    assert store.committed() == [1]
    assert store.outputs().count() == 2  # the dead run left nothing in sight
    _land(spark, land, "c", [(4, 2, "z", T0 + timedelta(2))])
    assert store.run(2, [land], changed_files, fold_state)
    assert {(r.batch, r.feed_id) for r in store.outputs().where("is_change").collect()} == {(1, 1), (1, 2), (2, 3), (2, 4)}
    assert not store.run(2, [land], changed_files, fold_state)  # a repeated call does nothing
    assert store.run(3, [land], changed_files, fold_state)  # nothing new
    assert store.outputs([3]).count() == 0
    # the compacted state stands for all batches
    assert {r.feed_id for r in fold_state(store.state()).collect()} == {3, 4}


def test_the_log_is_folded_as_it_grows(spark):
    root = work_dir(spark, "grow")
    store = BatchStore(spark, root)
    seen = {}
    for k in range(1, 8):
        rows = [(100 * k + i, i, f"h{k}", T0 + timedelta(k)) for i in range(k % 3, 40, 3)]
        seen |= {r[1]: r[0] for r in rows}
        _land(spark, f"{root}/landing", f"b{k}", rows)
        assert store.run(k, [f"{root}/landing"], changed_files, fold_state)
    folded, later = store._log()
    assert folded is not None and len(later) < 6
    assert {r.id: r.feed_id for r in fold_state(store.state()).collect()} == seen
    assert store.outputs().where("is_change").count() == sum(len(range(k % 3, 40, 3)) for k in range(1, 8))
    # a store opened anew sees the same
    assert BatchStore(spark, root).state().count() == store.state().count()


def test_ids_beyond_the_broadcast_bound(spark, monkeypatch):
    from codeloom.operators import incremental

    monkeypatch.setattr(incremental, "BROADCAST_IDS", 0)
    rows = [(1, 1, "x", T0), (2, 2, "y", T0), (3, 1, "X ", T0 + timedelta(1)), (4, 3, "z", T0)]
    state = changed_files(spark.createDataFrame(rows[:2], LANDED), None)
    got = changed_files(spark.createDataFrame(rows[2:] * 2, LANDED), state)
    assert {(r.id, r.feed_id, r.is_change) for r in got.collect()} == {(1, 3, False), (3, 4, True)}


def test_two_runs_of_one_batch(spark):
    root = work_dir(spark, "race")
    one, two = BatchStore(spark, root), BatchStore(spark, root)
    _land(spark, f"{root}/landing", "a", [(1, 1, "x", T0)])

    def slow(rows, state):
        two.run(1, [f"{root}/landing"], changed_files)  # the other run is done first
        return changed_files(rows, state)

    with pytest.raises(FileExistsError):
        one.run(1, [f"{root}/landing"], slow)
    assert one.outputs().count() == 1 and one.committed() == [1]


def test_touched_file_with_old_bytes_is_not_new(spark):
    import os

    root = work_dir(spark, "touch")
    store = BatchStore(spark, root)
    land = f"{root}/landing"
    _land(spark, land, "a", [(1, 1, "x", T0)])
    store.run(1, [land], changed_files)
    part = [f for f in os.listdir(land.removeprefix("file://") + "/a") if f.endswith(".parquet")][0]
    os.utime(f"{land.removeprefix('file://')}/a/{part}", (10**9, 10**9))
    assert store.new_files([land]).count() == 0
