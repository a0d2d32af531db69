"""Mergeable quantile states against exact ranks."""

import numpy as np
import pytest

from siftwell.operators import sketches

NAMED = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "most": 1.0}
LOG = "mode string, ts timestamp, latency_ms double"


@pytest.fixture(scope="module")
def log(spark):
    draw = np.random.default_rng(5)
    values = spark.createDataFrame(
        [(m, int(s), float(x)) for m in ("dense", "sparse", None) for s, x in zip(draw.integers(0, 40_000, 6000), draw.lognormal(2, 1, 6000))]
        + [("dense", 7, None), ("dense", 7, float("nan"))],
        "mode string, s bigint, latency_ms double",
    )
    return values.selectExpr("mode", "timestamp_seconds(s) AS ts", "latency_ms").repartition(4).cache()


def test_merged_states_keep_the_rank(spark, log, tmp_path):
    path = str(tmp_path / "states")
    for part in log.randomSplit([0.5, 0.3, 0.2], seed=1):
        sketches.append_states(part, path)
    states = sketches.read_states(spark, path)
    assert {r["hour"] % 3600 for r in states.select("hour").collect()} == {0}
    quantiles = sketches.merged_quantiles(states, NAMED).cache()
    assert {r["mode"]: r["n"] for r in quantiles.collect()} == {"dense": 6000, "sparse": 6000, None: 6000}
    errors = sketches.rank_errors(log, quantiles, NAMED).collect()
    assert len(errors) == 3 and all(r[name] <= 0.01 for r in errors for name in NAMED)


def test_a_span_of_hours_reads_its_own_states(spark, log, tmp_path):
    sketches.append_states(log, str(tmp_path))
    states = sketches.read_states(spark, str(tmp_path), 3600, 7200)
    inside = log.where("unix_timestamp(ts) BETWEEN 3600 AND 10799 AND latency_ms = latency_ms")
    counted = {r["mode"]: r["count"] for r in inside.groupBy("mode").count().collect()}
    assert {r["mode"]: r["n"] for r in sketches.merged_quantiles(states, NAMED).collect()} == counted
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_states_of_nothing(spark, tmp_path):
    nothing = spark.createDataFrame([], LOG)
    assert sketches.latency_states(nothing).collect() == []
    assert sketches.merged_quantiles(sketches.latency_states(nothing), NAMED).collect() == []
    with pytest.raises(ValueError):
        sketches.merged_quantiles(sketches.latency_states(nothing), {"p": 2.0})
