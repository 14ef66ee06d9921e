import random

from astroloom.operators.skew import first_reaching, heavy_keys, running_sums, skew_aggregate, skew_join
from pyspark.sql import functions as F


def data(spark, n=3000):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, 2, 3, 4 + rng.randrange(40)]), rng.choice([None, -1.0, 0.0, 2.0, rng.random()]), i, rng.choice([None, float("nan"), 0.5, 0.25, 1.0])) for i in range(n)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "k long, p double, i long, m double, block string").repartition(7)


def order(r):
    return (r[1] is not None, r[1] or 0.0, r[2])


def test_first_reaching_on_heavy_and_light_keys(spark):
    rows, df = data(spark)
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k and r[3] is not None and r[3] == r[3]), key=order)
        total, run = sum(r[3] for r in own), 0.0
        for r in own:
            run += r[3]
            if run >= total / 2:
                want[k] = r[2]
                break
    for share in (0.001, 0.05, 1.0):
        got = {r["k"]: r["i"] for r in first_reaching(df, ["k"], ["p", "i"], "m", 0.5, share=share).collect()}
        assert got == want


def test_running_sums(spark):
    rows, df = data(spark, 1500)
    got = {r["i"]: r["run"] for r in running_sums(df.select("k", "p", "i", F.coalesce(F.nanvl("m", F.lit(0.0)), F.lit(0.0)).alias("m")), ["k"], ["p", "i"], {"run": F.col("m")}, share=0.02).collect()}
    for k in {r[0] for r in rows}:
        run = 0.0
        for r in sorted((r for r in rows if r[0] == k), key=order):
            run += r[3] if r[3] is not None and r[3] == r[3] else 0.0
            assert abs(got[r[2]] - run) < 1e-9


def test_heavy_keys_are_few_and_joins_complete(spark):
    rows, df = data(spark)
    heavy = heavy_keys(df, ["k"], "i", 0.05, 2)
    assert heavy.count() <= 20 and 1 in {r["k"] for r in heavy.collect()}
    small = spark.createDataFrame([(k, k * 10) for k in range(1, 30)], "k long, v long")
    joined = skew_join(df, small, ["k"], "i", 0.05)
    assert joined.count() == sum(1 for r in rows if 1 <= r[0] < 30)
    sums = {r["k"]: r["n"] for r in skew_aggregate(df, ["k"], F.count(F.lit(1)).alias("n"), salt_on="i").collect()}
    assert sums[1] == sum(r[0] == 1 for r in rows)


def test_empty(spark):
    _, df = data(spark, 10)
    assert first_reaching(df.limit(0), ["k"], ["p", "i"], "m").count() == 0
    assert running_sums(df.limit(0), ["k"], ["p", "i"], {"run": F.col("m")}).count() == 0
