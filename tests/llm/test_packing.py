import random

import pytest
from pyspark.sql import functions as F

from codeloom.llm.packing import fill_report, over_several, pack, packed_documents, placement_report, plan_containers
from codeloom.llm.tokens import VOCABULARY, encoding, token_counts


def unfold(segments):
    """Every planned item as (length, rank, container)."""
    return [(length, first + k, container + k) for length, first, n, container in segments for k in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once_and_never_overfills(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 4096])
    hist = {}
    for _ in range(rng.randrange(1, 400)):
        n = rng.randrange(1, cap + 1) if rng.random() < 0.5 else rng.randrange(1, max(2, cap // 8))
        hist[n] = hist.get(n, 0) + rng.choice([1, 1, 7])
    items = unfold(plan_containers(hist, cap))
    by, used = {}, {}
    for length, rank, container in items:
        by.setdefault(length, []).append(rank)
        used[container] = used.get(container, 0) + length
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(n)) for k, n in hist.items()}
    assert max(used.values()) <= cap and sorted(used) == list(range(len(used)))
    # no worse than best-fit decreasing over items
    bins = []
    for length in sorted((k for k, n in hist.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= length]
        if fits:
            best = min(fits, key=lambda i: bins[i])
            bins[best] -= length
        else:
            bins.append(cap - length)
    assert len(used) == len(bins)


def test_a_third_of_all_items_of_one_length():
    segments = plan_containers({100: 10**9, 50: 10**8, 3996: 10**6}, 4096)
    assert len(segments) < 200  # counts, not items
    with pytest.raises(ValueError):
        plan_containers({5: 1}, 4)


def test_pack_ranks_across_buckets(spark):
    rows = [(i, 7 if i % 3 else 1 + i % 9) for i in range(300)] + [(1000, 25), (1001, 20), (1002, 0), (1003, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("piece", F.lit("clash"))
    got = pack(df, capacity=10, rows_per_bucket=40).collect()
    used, pieces = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        if r.container >= 0:
            used[r.container] = used.get(r.container, 0) + r.piece_tokens
    assert set(pieces) == {r[0] for r in rows} and max(used.values()) <= 10
    assert {d: sum(p.piece_tokens for p in v) for d, v in pieces.items()} == {d: n or 0 for d, n in rows}
    assert [(p.piece, p.first_token, p.piece_tokens) for p in sorted(pieces[1000], key=lambda p: p.piece)] == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert {d for d, v in pieces.items() if v[0].split} == {1000, 1001}
    assert pieces[1002][0].container == pieces[1003][0].container == -1
    assert fill_report(spark.createDataFrame(got), 10).first().fill > 0.7


def test_empty_table_and_texts(spark):
    schema = "doc_id long, text string"
    assert packed_documents(spark.createDataFrame([], schema)).count() == 0
    assert fill_report(packed_documents(spark.createDataFrame([], schema))).first().containers == 0
    one = packed_documents(spark.createDataFrame([(1, None), (2, ""), (3, "a b c")], schema)).collect()
    assert {r.doc_id: r.container for r in one} == {1: -1, 2: -1, 3: 0}


def test_token_counts_are_the_tokenizers(spark):
    texts = [None, "", "Hello world", "<|endoftext|>", "naïve  日本語\n\n", "x" * 5000, "A1 b2" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    enc = encoding(VOCABULARY)
    assert {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"]).collect()} == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_over_several_and_the_report(spark):
    rows = [(1, 25), (2, 10), (3, 3), (4, 0), (5, None), (6, 11)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    packed = pack(df, capacity=10)
    assert {r[0] for r in over_several(packed).collect()} == {1, 6}
    assert placement_report(packed, df, 10).first().asDict() == {"documents": 6, "misplaced": 0, "cut_needlessly": 0, "overfull": 0, "idle": 0}
    # what it must notice
    lost = packed.where("not (doc_id = 1 and piece = 1)")
    assert placement_report(lost, df, 10).first().misplaced == 1
    assert placement_report(packed.withColumn("container", F.lit(0)), df, 10).first().overfull == 1


def test_found_through_the_slots(spark, sf):
    from codeloom.llm import entry

    plan = entry.p6_found(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "slots" in plan
