import random

import pytest

from astroloom.operators.hierarchy import descendants, paths, resolve_forest
from pyspark.sql import functions as F


def brute(parents):
    out = {}
    for node in parents:
        path, seen, at, kind = [node], {node}, node, "tree"
        while True:
            up = parents[at]
            if up is None:
                break
            if up not in parents:
                kind = "orphan"
                break
            if up in seen:
                kind = "cycle" if up == node else "below_cycle"
                break
            path.append(up)
            seen.add(up)
            at = up
        out[node] = (kind, path[::-1])
    return out


def check(spark, parents, top=-1):
    df = spark.createDataFrame([(k, top if v is None else v, "x") for k, v in parents.items()], "id long, parent long, path string")
    forest = resolve_forest(df, "id", "parent", top)
    listed = {r["id"]: r["path"] for r in paths(forest).collect()}
    got = {r["id"]: r | {"path": listed.get(r["id"])} for r in (x.asDict() for x in forest.nodes.collect())}
    want = brute(parents)
    assert set(got) == set(want)
    below = {}
    for node, (kind, path) in want.items():
        row = got[node]
        assert row["kind"] == kind, (node, kind, row)
        if kind in ("tree", "orphan"):
            assert row["path"] == path and row["root"] == path[0] and row["depth"] == len(path)
            for up in path:
                below.setdefault(up, set()).add(node)
        else:
            assert row["path"] is None and row["size"] is None
    places = [(r["root"], r["position"]) for r in got.values() if r["root"] is not None]
    assert len(set(places)) == len(places)
    for node, nodes in below.items():
        row = got[node]
        assert row["size"] == len(nodes)
        inside = {r["id"] for r in got.values() if r["root"] == row["root"] and row["position"] <= r["position"] < row["position"] + row["size"]}
        assert inside == nodes
    pairs = {tuple(r) for r in descendants(forest, F.lit(True), 4).collect()}
    assert pairs == {(a, b) for a, s in below.items() for b in s if a != b}


def test_mixed_forest(spark):
    rng = random.Random(5)
    parents = {i: None if i < 3 else rng.randrange(i) for i in range(60)}
    parents |= {100: 101, 101: 102, 102: 100, 103: 100, 104: 103, 105: 105, 200: 999, 201: 200}  # circles, a loop, an orphan
    check(spark, parents)


def test_rounds_and_the_last_task_agree(spark, monkeypatch):
    from astroloom.operators import hierarchy

    rng = random.Random(8)
    parents = {i: None if i < 2 else rng.randrange(max(0, i - 3), i) for i in range(50)}
    parents |= {100: 101, 101: 102, 102: 100, 103: 100, 104: 103, 105: 105, 106: 105, 200: 999, 201: 200}
    for rows in (0, 12):
        monkeypatch.setattr(hierarchy, "TASK_ROWS", rows)
        check(spark, parents)


def test_deep_chain_and_star(spark):
    parents = {i: i - 1 if i else None for i in range(150)}
    parents |= {1000 + i: 75 for i in range(300)}
    check(spark, parents)


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "id long, parent long")
    assert resolve_forest(empty, "id", "parent").nodes.count() == 0
    rows = spark.createDataFrame([(1, None), (1, None), (2, 1), (None, 1), (0, None), (3, 0)], "id long, parent long")
    got = {r["id"]: r["root"] for r in resolve_forest(rows, "id", "parent").nodes.collect()}
    assert got == {1: 1, 2: 1, 0: 0, 3: 0}


@pytest.mark.parametrize("n", [1, 2])
def test_tiny(spark, n):
    check(spark, {i: None for i in range(n)})


def test_query_lists_descendants_of_all_subhaloes(spark):
    from astroloom.queries import core

    folder = "/root/testdata/sf0.001"
    want = {r["sub_id"]: r["n_descendants"] for r in core.p4_tree(spark, folder).where("n_descendants > 0").collect()}
    pairs = [tuple(r) for r in core.p4_all_descendants(spark, folder).collect()]
    got = {}
    for node, _ in pairs:
        got[node] = got.get(node, 0) + 1
    assert len(set(pairs)) == len(pairs) and got == want and any(node % 20 for node in got)
    assert {p for p in pairs if p[0] % 20 == 0} == {tuple(r) for r in core.p4_descendants(spark, folder).collect()}
