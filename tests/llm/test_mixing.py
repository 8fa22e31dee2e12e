import random

import pytest

from codeloom.llm.mixing import flight, land, mix, plan_copies, settle, shares


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_both_totals_and_leaves_two(seed):
    rng = random.Random(seed)
    size = [float(rng.choice([1, 5, 5, 300, rng.randrange(1, 90)])) for _ in range(500)]
    p = [rng.choice([0.3, 0.3, rng.random()]) for _ in size]
    q = flight(p, size, random.Random(1))
    assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
    assert abs(sum(p) - sum(q)) < 1e-6 and abs(sum(a * s for a, s in zip(p, size)) - sum(a * s for a, s in zip(q, size))) < 1e-3
    done = settle(p, size, random.Random(2))
    assert set(done) <= {0.0, 1.0}
    assert abs(sum(a * s for a, s in zip(done, size)) - sum(a * s for a, s in zip(p, size))) <= 1


def test_land_is_the_best_choice():
    size = [3.0, 7.0, 7.0, 20.0]
    assert land(14.2, 2, size) == [0, 1, 1, 0] and land(0, 0, size) == [0] * 4 and land(1e9, 4, size) == [1] * 4 and land(0, 0, []) == []


def test_settle_makes_good_for_large_documents():
    rng = random.Random(1)
    size = [float(rng.randrange(20, 400)) for _ in range(600)] + [20_000.0]
    want = 0.3 * sum(size)
    taken = 0
    for seed in range(60):
        q = settle([0.3] * len(size), size, random.Random(seed))
        assert abs(sum(a * s for a, s in zip(q, size)) - want) <= 1
        taken += q[-1]
    assert 8 <= taken <= 30  # as often as its probability says
    # too large to be made good: left out; nothing to decide; ties
    assert settle([0.2] * 3, [1000.0, 1.0, 1.0], rng)[0] == 0
    assert settle([], [], rng) == [] and settle([0.5], [0.0], rng)[0] in (0, 1)
    assert sum(settle([0.25] * 8, [5.0] * 8, rng)) == 2
    # what others can add and take away bounds the draw
    assert settle([0.1], [100.0], rng, room=(50.0, 0.0)) == [0] and settle([0.9], [100.0], rng, room=(0.0, 50.0)) == [1]


def test_settle_goes_on_after_an_excess():
    """A document that nothing makes good takes too much: the classes after it are left out, none fails."""
    rng = random.Random(2)
    size = [float(rng.randrange(1, 400)) for _ in range(60)] + [100_000.0]
    assert 0.8 * sum(size) < size[-1]  # and all others together are far less
    q = settle([0.8] * 61, size, rng)
    assert q[-1] == 1 and sum(q) == 1
    # with further copies the others make it good, from none to the cap
    rng = random.Random(4)
    size = [float(rng.randrange(20, 400)) for _ in range(200)]
    for large, p, spread in ((60_000.0, 0.51, (-1, 3)), (60_000.0, 0.45, (-2, 1)), (70_000.0, 0.5, (0, 3))):
        want = p * (sum(size) + large)
        for seed in range(10):
            q = settle([p] * 201, [*size, large], random.Random(seed), spread=spread)
            assert all(x == int(x) and spread[0] <= x <= spread[1] for x in q)
            assert abs(sum(a * s for a, s in zip(q, [*size, large])) - want) <= 1, (large, seed)


def test_settle_tries_all_copies_of_documents_that_outweigh_the_others():
    rng = random.Random(8)
    size = [float(rng.randrange(20, 1500)) for _ in range(25)] + [93_343.0, 124_442.0, 199_997.0]
    want = 2 * 93_343 + 199_997 + 0.5 * sum(size[:25])
    for seed in range(10):
        q = settle([want / sum(size)] * 28, size, random.Random(seed), spread=(0, 2))
        assert set(q) <= {0.0, 1.0, 2.0} and abs(sum(a * s for a, s in zip(q, size)) - want) <= 1


def test_flight_is_unbiased():
    """Each item is drawn as often as its probability says."""
    size, p = [3.0, 8.0, 2.0, 5.0, 9.0, 4.0], [0.5, 0.2, 0.7, 0.4, 0.6, 0.1]
    n, hits = 3000, [0.0] * 6
    for s in range(n):
        for i, x in enumerate(flight(p, size, random.Random(s))):
            hits[i] += x
    assert all(abs(h / n - q) < 0.04 for h, q in zip(hits, p))


def test_plan():
    totals = {"a": (10, 1000), "b": (10, 100), "none": (5, 0)}
    plan = plan_copies(totals, [("a", 1.0, 1), ("b", 1.0, 3), ("none", 5.0, 1), ("absent", 1.0, 1), ("c", None, 1)])
    assert set(plan) == {"a", "b"} and plan["b"]["expected"] == 3 and abs(plan["a"]["expected"] - 0.3) < 1e-12
    assert plan_copies(totals, [("a", 1.0, 1), ("b", 1.0, 3)], 10_000)["b"]["expected"] == 3.0
    assert plan_copies({}, [("a", 1.0, 1)]) == {}


def test_mix_reaches_shares_within_the_caps(spark):
    rng = random.Random(3)
    # one source holds most documents and is split into blocks
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "small", "untargeted", None]), rng.choice([None, 0, 20, 150, rng.randrange(1, 400)])) for i in range(3000)] + [(9001, "mid", 60_000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("nowhere", 0.4, 2), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    mixed, plan = mix(sizes, targets, block_rows=250)
    got = mixed.collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} == {"big", "mid", "small"}
    report = {r.source: r for r in shares(mixed, plan).collect()}
    for s, r in report.items():
        assert abs(r.share - r.target_share) < 0.01 and r.most_copies <= plan[s]["max_repeats"]
    again, _ = mix(sizes.repartition(3), targets, block_rows=250)
    assert {(r.doc_id, r.copies) for r in again.collect()} == {(r.doc_id, r.copies) for r in got}


def test_a_document_larger_than_its_sources_share(spark):
    rng = random.Random(5)
    rows = [(i, s, rng.randrange(20, 400)) for i, s in enumerate(["a"] * 900 + ["b"] * 700 + ["few"] * 40)] + [(5000, "a", 400_000), (5001, "few", 90_000), (5002, "only", 500_000), (5003, "b", 30_000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 1), ("few", 0.1, 4), ("only", 0.0, 1)], "source string, weight double, max_repeats int")
    for block_rows in (20_000, 100):
        mixed, plan = mix(sizes, targets, block_rows=block_rows)
        assert not {5000, 5001, 5002} & {r.doc_id for r in mixed.collect()}
        for r in shares(mixed, plan).collect():
            assert abs(r.share / r.target_share - 1) < 0.005 and r.most_copies <= r.max_repeats, (block_rows, r)
    # a source of nothing but a document too large for it falls short, and the report says so
    lone = spark.createDataFrame([("a", 0.9, 1), ("only", 0.1, 1)], "source string, weight double, max_repeats int")
    report = {r.source: r for r in shares(*mix(sizes, lone)).collect()}
    assert report["only"].docs == 0 and report["a"].tokens > 0


def test_a_document_that_one_copy_of_the_others_does_not_make_good(spark):
    rng = random.Random(6)
    rows = [(i, s, rng.randrange(2, 120)) for i, s in enumerate(["all"] * 3000 + ["few"] * 2000)] + [(5000, "few", 155_000)]
    tokens = {s: sum(n for _, x, n in rows if x == s) for s in ("all", "few")}
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    # 1.509 copies of few are wanted: with one or two copies of its large document, the others must give less than one or more than two
    targets = spark.createDataFrame([("all", 1.0, 1), ("few", 1.509 * tokens["few"] / tokens["all"], 4)], "source string, weight double, max_repeats int")
    for block_rows in (20_000, 100):
        mixed, plan = mix(sizes, targets, block_rows=block_rows)
        got = mixed.collect()
        assert len({r.doc_id for r in got}) == len(got)
        for r in shares(mixed, plan).collect():
            assert abs(r.share / r.target_share - 1) < 0.005 and r.most_copies <= r.max_repeats, (block_rows, r)


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_shares_of_the_tables(spark, name):
    import os

    d = f"/root/testdata/{name}"
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    from codeloom.llm import entry

    for r in entry.p7_balance(spark, d).collect():
        assert r.share_met and r.cap_met and r.stray == 0 and r.repeated == 0, r


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    mixed, plan = mix(sizes, targets)
    assert mixed.count() == 0 and plan == {} and shares(mixed, plan).count() == 0
