import random
from datetime import datetime, timedelta
from decimal import Decimal
from math import ceil

import pytest
from pyspark.sql import functions as F

from vigil.operators.ranks import counted_values, disc_percentiles, ranked
from vigil.operators.ticks import tick_rollup

SHARES = {"least": 0, "low": "0.05", "half": 0.5, "most": 0.95, "all": 1}


def plain_percentile(values, share):
    ordered = sorted(values)
    return ordered[max(1, ceil(Decimal(str(share)) * len(ordered))) - 1]


def percentiles_of(spark, rows, kind="bigint", ranges=None):
    table = spark.createDataFrame(rows, f"a string, b int, v {kind}")
    counted = counted_values(table, ["a", "b"], "v", ranges=ranges)
    return {(r.a, r.b): tuple(r[s] for s in SHARES) for r in disc_percentiles(counted, ["a", "b"], "v", SHARES).collect()}


@pytest.mark.parametrize("ranges", [1, 2, 17])
def test_percentiles_equal_sorting(spark, ranges):
    pick = random.Random(5)
    rows = [("hot", 1, pick.randrange(-400, 400)) for _ in range(900)]
    rows += [(pick.choice(["x", "y", None]), pick.choice([1, 2, None]), pick.randrange(4)) for _ in range(300)]
    rows += [("twenty", 0, i) for i in range(20)] + [("one", 0, 7), ("none", 0, None), ("some", 0, None), ("some", 0, 3)]
    groups = {}
    for a, b, v in rows:
        if v is not None:
            groups.setdefault((a, b), []).append(v)
    want = {g: tuple(plain_percentile(v, s) for s in SHARES.values()) for g, v in groups.items()}
    assert percentiles_of(spark, rows, ranges=ranges) == want
    assert want["twenty", 0][3] == 18  # row 19 of 20, not 20


def test_percentiles_of_texts_and_of_nothing(spark):
    rows = [("t", 1, w) for w in "pear apple fig apple".split()]
    assert percentiles_of(spark, rows, "string") == {("t", 1): ("apple", "apple", "apple", "pear", "pear")}
    assert percentiles_of(spark, []) == {}


def test_share_out_of_range(spark):
    counted = counted_values(spark.createDataFrame([(1, 2)], "a int, v int"), ["a"], "v")
    with pytest.raises(ValueError):
        disc_percentiles(counted, ["a"], "v", {"p": 1.5})


def test_hot_group_is_cut_into_ranges(spark):
    table = spark.range(5000).selectExpr("'hot' AS a", "id AS v")
    counted = counted_values(table, ["a"], "v", ranges=10)
    held = [r["count"] for r in counted.groupBy("_range").count().collect()]
    assert len(held) == 10 and max(held) < 1500


def test_rollup_of_awkward_ticks(spark):
    day = datetime(2026, 1, 1)
    rows = [("n", day + timedelta(hours=h), ms, 5 * h, ms is not None and ms > 30) for h, ms in enumerate([10, None, 40, 20])]
    rows += [("idle", day, None, 1, None), (None, day, 8, None, False), ("n", None, 99, 1, True)]
    table = spark.createDataFrame(rows, "node_id string, tick_start timestamp, tick_elapsed_ms bigint, sleep_drift_ms bigint, overrun boolean")
    got = {
        r.node_id: (r.ticks, r.overruns, r.mean_tick_ms, r.p50_tick_ms, r.p95_tick_ms, r.max_tick_ms, r.max_drift_ms)
        for r in tick_rollup(table).collect()
    }
    assert got == {
        "n": (4, 1, 70 / 3, 20, 40, 40, 15),
        "idle": (1, 0, None, None, None, None, 1),
        None: (1, 0, 8.0, 8, 8, 8, None),
    }


@pytest.mark.parametrize("ranges", [1, 9])
@pytest.mark.parametrize("keys", [["g"], []])
def test_numbers_equal_sorting(spark, keys, ranges):
    pick = random.Random(2)
    rows = [(pick.choice(["a", "a", "b", None]), pick.randrange(5), f"w{i:03}") for i in range(400)]
    table = spark.createDataFrame(rows, "g string, n int, w string")
    got = {(r.g, r.n, r.w): r.place for r in ranked(table, keys, [F.col("n").desc(), F.col("w")], ranges=ranges).collect()}
    want, seen = {}, {}
    for row in sorted(rows, key=lambda r: (-r[1], r[2])):
        group = row[0] if keys else 0
        seen[group] = seen.get(group, 0) + 1
        want[row] = seen[group]
    assert got == want
    assert ranked(table.limit(0), keys, [F.col("n").desc()]).collect() == []
