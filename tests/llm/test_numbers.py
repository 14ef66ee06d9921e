import math
import pickle
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from astroloom.llm import knn, percentiles, topn


def test_order_code_is_monotone(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, 2.0, math.nextafter(1, 2), math.nextafter(1, 0), 5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.7976931348623157e308, float("inf"), 1e10, 1e-10, 1e-300]
    values += [rng.uniform(-1, 1) * 10 ** rng.uniform(-300, 300) for _ in range(2000)] + [2.0**k for k in range(-1070, 1023, 7)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", topn.order_code(F.col("v")).alias("c"))
    rows = sorted((r["v"], r["c"]) for r in df.collect())
    for (a, x), (b, y) in zip(rows, rows[1:]):
        assert (x < y) if a < b else (x == y)


@pytest.mark.parametrize("share", [0.01, 1.0])
def test_top_n(spark, share):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None, *range(10, 30)]), i, rng.choice([None, float("nan"), 0.0, -0.0, 5.0, 5.0, 5.0, rng.uniform(-10, 10), float("inf"), -1e300, 1e-320])) for i in range(2500)]
    rows += [(50, i, 1.0) for i in range(5000, 5100)] + [(51, 7000, 2.0)] * 9 + [(51, 7001, 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g long, i long, s double, rank string").repartition(5)
    got = sorted((r["g"], r["rank"], r["i"], r["s"]) for r in topn.top_n(df, ["g"], "i", "s", 4, share=share).collect())
    want = []
    for g in {r[0] for r in rows} - {None}:
        own = sorted(((-r[2] + 0.0, r[1], r[2]) for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]))[:4]
        want += [(g, k + 1, i, s) for k, (_, i, s) in enumerate(own)]
    assert got == sorted(want)
    assert topn.top_n(df.limit(0), ["g"], "i", "s").count() == 0


def test_sketches_merge_and_bound(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "b"]), rng.randrange(5), i, rng.choice([None, float("nan"), float("inf"), 0.0, rng.lognormvariate(0, 3), -rng.lognormvariate(0, 3)])) for i in range(4000)]
    rows += [("c", 0, 5000 + i, 7.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, part int, i long, v double").repartition(4)
    alpha = 0.01
    parts = percentiles.sketch(df, ["k", "part"], "v", alpha)
    merged = percentiles.merge(parts, ["k"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, percentiles.sketch(df, ["k"], "v", alpha).select(*merged.columns).collect()))
    qs = [0, 1, 10, 50, 90, 100]
    table = percentiles.percentiles(merged, ["k"], qs)
    wanted = table.select("k", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"p{q}_bucket").alias("bucket"), F.col(f"p{q}_at").alias("at"), F.col(f"p{q}_low").alias("least"), F.col(f"p{q}_high").alias("most")) for q in qs])).alias("w")).select("k", "w.*")
    exact = {(r["k"], r["q"]): r["exact"] for r in percentiles.exact(df, ["k"], "v", wanted, "i", alpha).collect()}
    for r in table.collect():
        own = sorted(v for k, _, _, v in rows if k == r["k"] and v is not None and math.isfinite(v))
        assert r["n"] == len(own)
        for q in qs:
            true = own[max(1, math.ceil(q * len(own) / 100)) - 1]
            assert r[f"p{q}_low"] <= true <= r[f"p{q}_high"] and abs(r[f"p{q}"] - true) <= alpha * abs(true) * 1.0001 and exact[(r["k"], q)] == true
    assert percentiles.percentiles(percentiles.sketch(df.limit(0), ["k"], "v"), ["k"], [50]).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 200), st.integers(1, 8), st.integers(0, 10**6))
def test_parts_are_balanced(n, parts, seed):
    points = np.random.default_rng(seed).normal(size=(n, 3))
    label = knn.balanced_parts(points, knn.neighbour_graph(points, 4), parts)
    sizes = np.bincount(label)
    assert len(label) == n and sizes.max() - sizes.min() <= max(4, 0.15 * n)


def brute(rows, wanted, k):
    out = {}
    for i in wanted:
        own = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(rows[i][1], rows[j][1]))), j) for j in rows if j != i and rows[j][0] == rows[i][0])
        out[i] = [j for _, j in own[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    n = 3000
    centres = rng.normal(0, 20, (12, 4))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, rng.choice([0.1, 1, 5], n)[:, None], (n, 4))
    x[100:120] = x[100]  # coinciding points
    rows = {i: (int(i % 5 == 0), tuple(map(float, v))) for i, v in enumerate(x)}
    rows |= {9000 + i: (7, (float(i), 0.0, 0.0, 0.0)) for i in range(4)}  # fewer than k
    data = [(i, s, *v, "x") for i, (s, v) in rows.items()]
    data += [(9500, 0, None, 0.0, 0.0, 0.0, "x"), (9501, 0, float("nan"), 0.0, 0.0, 0.0, "x"), (9502, 0, float("inf"), 0.0, 0.0, 0.0, "x"), (None, 0, 1.0, 0.0, 0.0, 0.0, "x"), (9503, None, 1.0, 0.0, 0.0, 0.0, "x")]
    df = spark.createDataFrame(data, "i long, s long, a double, b double, c double, d double, part string").repartition(4)
    return rows, df


def run(df, **settings):
    found = knn.nearest(df, "i", ["s"], [F.col(c) for c in "abcd"], (F.col("i") % 20 == 0) | (F.col("i") >= 9000), 5, fit_rows=1000, part_rows=200, **settings)
    out = {}
    for r in found.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["near"])
    return out


def test_nearest_is_exact(vectors, monkeypatch):
    rows, df = vectors
    want = {i: w for i, w in brute(rows, [i for i in rows if i % 20 == 0 or i >= 9000], 5).items() if w}
    assert run(df) == want
    monkeypatch.setattr(knn, "BLOCK_ROWS", 64)
    assert run(df) == want
    assert run(df, split_rows=150) == want  # parts that are divided again
    monkeypatch.setattr(knn, "BROADCAST_BOXES", 0)
    assert run(df, split_rows=150) == want


def test_divided_parts_keep_their_rows(spark):
    net = pickle.dumps(knn.fit_router(np.random.default_rng(1).random((500, 2)), 8, hidden=8))
    rows = spark.range(5000).selectExpr("1L s0", "cast(id % 9 as int) part", "id", "rand(1) v0", "rand(2) v1")
    routers = spark.createDataFrame([(1, p, net, p + 1) for p in range(8)], "s0 long, part int, net binary, salts int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions, as with large tables
    try:
        got = knn._divide(rows, routers, ["s0", "part"], ["v0", "v1"]).select("part", "id", F.size("subs").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["id"] for r in got) == list(range(5000))
    assert all(r["n"] == (1 if r["part"] == 8 else knn.SUB_PROBES) for r in got)


def test_equal_distances_of_unequal_squares():
    a, b = [1.524560164915884, 0.004212106702221385, 0.8907743881096029], [1.524560164915884, 0.004212106702221385, 0.8907743881096026]
    square = lambda p: (p[0] * p[0] + p[1] * p[1]) + p[2] * p[2]
    assert square(b) < square(a) and math.sqrt(square(b)) == math.sqrt(square(a))
    queries = pd.DataFrame([[0, 0.0, 0.0, 0.0]], columns=["id", "v0", "v1", "v2"])
    points = pd.DataFrame([[2, *b], [1, *a], *([10 + i, 9.0, 9.0, 9.0] for i in range(9))], columns=["id", "v0", "v1", "v2"])
    for own in (points, points.head(2)):
        assert list(knn._nearest(1, ["v0", "v1", "v2"])((), queries, own)["near"]) == [1]


def test_probable_parts_have_recall(vectors):
    rows, df = vectors
    want = brute(rows, [i for i in rows if i % 20 == 0], 5)
    got = run(df, complete=False, probes=4)
    hits = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    got = run(df, complete=False, probes=4, split_rows=300)
    assert sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_small_spaces_have_recall(spark, monkeypatch):
    rng = np.random.default_rng(5)
    spread = {0: 3000, 1: 15, 2: 25, 3: 60, 4: 104}  # rows of each space, all over the same region
    rows = {i: (s, tuple(map(float, v))) for i, (s, v) in enumerate((s, v) for s, n in spread.items() for v in rng.normal(0, 10, (n, 4)))}
    df = spark.createDataFrame([(i, s, *v) for i, (s, v) in rows.items()], "i long, s long, a double, b double, c double, d double").repartition(4)
    wanted = [i for i, (s, _) in rows.items() if s or i % 20 == 0]
    want = brute(rows, wanted, 10)
    for most in (knn.BROADCAST_BOXES, 0):
        monkeypatch.setattr(knn, "BROADCAST_BOXES", most)
        got = {}
        for r in knn.nearest(df, "i", ["s"], [F.col(c) for c in "abcd"], F.col("i").isin(wanted), 10, complete=False).collect():
            got.setdefault(r["id"], set()).add(r["near"])
        for s in spread:
            own = [i for i in wanted if rows[i][0] == s]
            assert sum(len(got.get(i, set()) & set(want[i])) for i in own) >= 0.9 * sum(len(want[i]) for i in own), s


def test_no_vectors(vectors):
    _, df = vectors
    assert run(df.limit(0)) == {}
