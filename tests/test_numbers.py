import random

from pyspark.sql import functions as F

from siftwell.functions.numbers import fixed, round_exact


def test_decimals_match_printf(spark):
    rng = random.Random(1)
    values = [0.0, 0.5, 1.5, 2.5, 0.8125, 0.0125, 36.035, 33.395, 1e-9, 99.995, 0.99995, -1.005, -2.5]
    values += [round(rng.uniform(-50, 500), d) for d in (1, 2, 3, 4, 5, 9) for _ in range(300)]
    values += [(rng.randrange(10**5) * 2 + 1) / 200 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    rows = df.select("v", *[fixed(v, d) for d in range(5)], *[round_exact(v, d) for d in range(5)])
    for r in rows.collect():
        for d in range(5):
            assert r[1 + d] == f"{r.v:.{d}f}"
            assert r[6 + d] == round(r.v, d)
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v double")
    assert [r[0] for r in odd.select(fixed(v, 3)).collect()] == ["n/a", "n/a"]
