import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from codeloom.operators.skew import heavy_keys, per_key_sites, tree_aggregate

SCHEMA = "file_id long, symbol_name string, line long, column long, from_scope string, qualified boolean"


def rows(n, seed=3):
    rng = random.Random(seed)
    return [(rng.randrange(6) if rng.random() > 0.05 else None, rng.choice(["hot"] * 6 + ["Hot", "cold", "", None]), rng.randrange(5), rng.choice([None, 1, 2]), None, None) for _ in range(n)]


@pytest.mark.parametrize("parts,fan_in", [(1, 2), (5, 2), (9, 3), (40, 8)])
def test_tree_equals_plain_grouping(spark, parts, fan_in):
    data = rows(400)
    df = spark.createDataFrame(data, SCHEMA).repartition(parts).withColumn("_chunk", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r[0]: (r[1], r[2], r[3]) for r in tree_aggregate(df, ["symbol_name"], {"n": ("sum", F.lit(1)), "lo": ("min", F.col("line")), "hi": ("max", F.col("line"))}, fan_in).collect()}
    want = defaultdict(list)
    for r in data:
        want[r[1]].append(r[2])
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()}


@pytest.mark.parametrize("hot_rows", [10**6, 90, 0])
def test_sites_equal_brute_force(spark, hot_rows):
    data = rows(500) + rows(100)  # exact repeats
    got = {r.key: r for r in per_key_sites(spark.createDataFrame(data, SCHEMA).repartition(7), "symbol_name", 2, hot_rows).collect()}
    by = defaultdict(list)
    for r in data:
        by[r[1]].append((r[0], r[2], r[3]))
    key = lambda s: tuple((x is not None, x or 0) for x in s)
    assert set(got) == set(by)
    for k, sites in by.items():
        r = got[k]
        assert (r.n_rows, r.sites, r.files) == (len(sites), len(set(sites)), len({s[0] for s in sites}))
        assert tuple(r.first_site) == min(sites, key=key)
        assert tuple(r.last_site) == max(sites, key=key)


@pytest.mark.parametrize("n", [50, 100, 101])
def test_heavy_keys_at_the_boundary(spark, n):
    data = [(1, "a" if i < 2 else f"k{i}", 1, 1, None, True) for i in range(n)]
    got = {r.key: r.n_rows for r in heavy_keys(spark.createDataFrame(data, SCHEMA), "symbol_name").collect()}
    counts = defaultdict(int)
    for r in data:
        counts[r[1]] += 1
    assert got == {k: c for k, c in counts.items() if c >= Fraction("0.02") * n}


def test_empty_null_only_and_bad_arguments(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(empty, "symbol_name").count() == 0
    assert per_key_sites(empty, "symbol_name").count() == 0
    nulls = spark.createDataFrame([(None,) * 6] * 3, SCHEMA)
    assert heavy_keys(nulls, "symbol_name").count() == 0
    assert per_key_sites(nulls, "symbol_name").first().n_rows == 3
    with pytest.raises(ValueError):
        tree_aggregate(empty, ["symbol_name"], {"n": ("avg", F.lit(1))})
