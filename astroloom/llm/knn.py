"""Most similar vectors by learned partitions (problem 2).

A bounded sample gives a neighbour graph; the graph is cut into balanced parts; a small network learns to name the
part of a vector. Parts that hold many rows are divided again in the same way, each by a network of its own. Every row
is stored in its most probable part, a query is sent to several probable parts and reranked there. Boxes around the
stored parts then tell which further parts could hold a nearer row; those are visited too, so the result is exact, and
the networks decide only how little has to be visited.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astroloom.tables import cut

#: Rows on which the index is fitted at most (it indexes every row).
FIT_ROWS = 16384
#: Rows that a part should hold, and the least and largest number of parts of one network (fewer only for less than 16 rows a part).
PART_ROWS = 2000
MIN_PARTS = 8
MAX_PARTS = 256
#: A part of more rows is divided again, by a network fitted on about so many of its rows.
SPLIT_ROWS = 8000
SUB_ROWS = 4096
#: Probable parts that a query is sent to at first, and probable divisions in each of them.
PROBES = 4
SUB_PROBES = 2
#: In approximate mode a query goes on to less probable parts until those visited hold so many rows of its own space for each wanted neighbour.
SEEN_ROWS = 32
#: Rows of a part, and queries of a part, that meet in one task at most.
BLOCK_ROWS = 8192
#: Boxes (a few hundred bytes each) that are broadcast at most.
BROADCAST_BOXES = 100_000


def neighbour_graph(points: np.ndarray, degree: int = 10) -> np.ndarray:
    """(n, degree) indices of the nearest other points, by blocks of rows."""
    n = len(points)
    degree = min(degree, n - 1)
    out = np.empty((n, degree), dtype=np.int64)
    square = (points**2).sum(1)
    for at in range(0, n, 1024):
        block = points[at : at + 1024]
        d = square[None, :] - 2 * block @ points.T
        d[np.arange(len(block)), np.arange(at, at + len(block))] = np.inf
        out[at : at + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(points: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Balanced cuts of the graph by recursive halving.

    Each half starts from the median along the main axis; then nodes with most neighbours on the other side change
    places in equal numbers while that lowers the number of cut edges.
    """
    label = np.zeros(len(points), dtype=np.int64)
    levels = max(0, int(np.ceil(np.log2(max(1, parts)))))
    for _ in range(levels):
        following = label.copy()
        for part in np.unique(label):
            own = np.flatnonzero(label == part)
            if len(own) < 4:
                following[own] = 2 * part
                continue
            centred = points[own] - points[own].mean(0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            side = np.zeros(len(own), dtype=np.int8)
            side[np.argsort(centred @ axis, kind="stable")[len(own) // 2 :]] = 1
            place = np.full(len(points), -1)
            place[own] = np.arange(len(own))
            near = place[graph[own]]
            inside = near >= 0
            for _ in range(rounds):
                other = (side[np.where(inside, near, 0)] != side[:, None]) & inside
                gain = 2 * other.sum(1) - inside.sum(1)
                left, right = (np.flatnonzero(side == s) for s in (0, 1))
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                k = min(len(left), len(right), max(1, len(own) // 20))
                swap = np.flatnonzero(gain[left[:k]] + gain[right[:k]] > 2)
                if not len(swap):
                    break
                side[left[swap]], side[right[swap]] = 1, 0
            following[own] = 2 * part + side
        label = following
    return np.unique(label, return_inverse=True)[1]


@dataclass
class Router:
    """A network of one hidden layer that gives the parts of a vector in order of probability."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, x: np.ndarray, top: int) -> np.ndarray:
        out = np.empty((len(x), min(top, self.parts)), dtype=np.int32)
        for at in range(0, len(x), 8192):
            out[at : at + 8192] = np.argsort(-self.logits(x[at : at + 8192]), axis=1, kind="stable")[:, : out.shape[1]]
        return out


def fit_router(points: np.ndarray, parts: int, hidden: int = 64, epochs: int = 12, seed: int = 17) -> Router:
    """Neighbour graph, balanced parts and the network trained on them; the same for the same sample."""
    mean, scale = points.mean(0), points.std(0) + 1e-12
    if parts < 2 or len(points) < 32:
        width = points.shape[1]
        return Router(mean, scale, np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    label = balanced_parts(points, neighbour_graph(points), parts)
    many = int(label.max()) + 1
    rng = np.random.default_rng(seed)
    x = (points - mean) / scale
    shapes = [(x.shape[1], hidden), (hidden,), (hidden, many), (many,)]
    weights = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    step = 0
    for epoch in range(epochs):
        rate = 1e-2 if epoch < epochs // 2 else 2e-3
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[at] @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), label[at]] -= 1
            p /= len(at)
            back = (p @ weights[2].T) * (h > 0)
            grads = [x[at].T @ back, back.sum(0), h.T @ p, p.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *weights)


def _nearest(k: int, dims: list[str]):
    """Per block: the k nearest points of each query, itself excepted, ties by the smaller key.

    Ties are those of the distance: unequal squares may have equal roots, so squares within rounding of the k-th stay too.
    """

    def rank(key: tuple, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(points):
            p, ids = points[dims].to_numpy(), points["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            p, ids = p[order], ids[order]
            q, own = queries[dims].to_numpy(), queries["id"].to_numpy()
            chunk = max(1, 2_000_000 // len(p))
            for at in range(0, len(q), chunk):
                d = np.zeros((len(q[at : at + chunk]), len(p)))
                for j in range(len(dims)):
                    d += (q[at : at + chunk, j, None] - p[None, :, j]) ** 2
                d[own[at : at + chunk, None] == ids[None, :]] = np.inf
                if len(p) > 4 * k:  # all that tie with the k-th stay for the stable order by key
                    limit = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-15)
                else:
                    limit = np.full(len(d), np.finfo(float).max)
                for i in range(len(d)):
                    near = np.flatnonzero((d[i] <= limit[i]) & np.isfinite(d[i]))
                    root = np.sqrt(d[i, near])
                    first = np.argsort(root, kind="stable")[:k]
                    out.append((np.full(len(first), own[at + i]), ids[near[first]], root[first]))
        if not out:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("id", "near", "distance"))})

    return rank


def _in_parts(visits: DataFrame, points: DataFrame, space: list[str], dims: list[str], k: int, blocks: DataFrame) -> DataFrame:
    """Candidates of ``visits`` (queries with a part each) from the points of their parts, block by block.

    A part of any size is cut into blocks of points and its queries into chunks; a query goes to all blocks of
    its part, a point to all chunks, and each pair of block and chunk is one bounded group.
    """
    key = [*space, "part", "sub"]
    asked = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("chunks"))
    plan = blocks.join(asked, key)
    chunk = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    q = visits.join(plan, key).withColumns({"chunk": chunk("chunks"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    p = points.join(plan, key).withColumns({"block": chunk("blocks"), "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    group = [*key, "block", "chunk"]
    q, p = (side.select(*[F.col(c).alias(c) for c in (*group, "id", *dims)]) for side in (q, p))  # two identities of one table
    return q.groupBy(*group).cogroup(p.groupBy(*group)).applyInPandas(_nearest(k, dims), "id long, near long, distance double")


def _divide(rows: DataFrame, routers: DataFrame, key: list[str], dims: list[str]) -> DataFrame:
    """``rows`` (key, id, dims) with ``subs``, their probable divisions of the part ``key`` names; [0] for parts of one piece.

    A part's network (one row of ``routers``) meets its rows in salted groups of about BLOCK_ROWS, so no part gathers in a task.
    The salt has one type on both sides: equal numbers of different types hash to different partitions, where rows miss their network.
    """
    salted = rows.join(routers.select(*key, "salts"), key, "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")))
    plain = salted.where("salt is null").drop("salts", "salt").withColumn("subs", F.array(F.lit(0)))
    spread = routers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    columns = [*key, "id", *dims]
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields), "subs array<int>"])

    def order(pdf: pd.DataFrame, net: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) and not len(net):
            raise ValueError(f"{len(pdf)} rows of a divided part have no network")
        if not len(pdf):
            return pd.DataFrame({**{c: pd.Series(dtype=net[c].dtype if c in net else "int64" if c == "id" else "float64") for c in columns}, "subs": pd.Series(dtype=object)})
        return pdf[columns].assign(subs=list(pickle.loads(net["net"].iloc[0]).order(pdf[dims].to_numpy(), SUB_PROBES)))

    group = [*key, "salt"]
    left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (salted.where("salt is not null").drop("salts"), spread))
    return plain.select(*columns, "subs").unionByName(left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(order, fields))


def _further(queries: DataFrame, sizes: DataFrame, spaces: list[str], dims: list[str], router: Broadcast, least: int) -> DataFrame:
    """``queries`` with more ``parts``, in order of probability, where the first hold less than ``least`` rows of the query's space.

    ``sizes`` counts the rows of each space and part. Parts without rows of the space are passed over, and each further
    part holds some, so no query gets more than ``least`` of them.
    """
    held = sizes.groupBy(*spaces).agg(F.collect_list(F.struct("part", "n")).alias("h")).select(*spaces, F.col("h.part").alias("at"), F.col("h.n").alias("rows"))
    known = queries.join(_small(held, sizes), spaces).withColumn("held", F.map_from_arrays("at", "rows"))
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, n: a + n)
    seen = add(F.transform("parts", lambda p: F.coalesce(F.try_element_at("held", p), F.lit(0).cast("long"))))
    known = known.withColumn("few", (seen < least) & (seen < add(F.col("rows"))))
    columns = queries.columns

    def extend(batches):
        for pdf in batches:
            if len(pdf):
                net, parts = router.value, []
                for order, first, at, rows in zip(net.order(pdf[dims].to_numpy(), net.parts), pdf["parts"], pdf["at"], pdf["rows"]):
                    own = np.zeros(net.parts, dtype=np.int64)
                    own[at] = rows
                    own = own[order]
                    parts.append(order[(np.arange(len(order)) < len(first)) | ((np.cumsum(own) - own < least) & (own > 0))])
                yield pdf[columns].assign(parts=parts)

    extended = cut(known.where("few").mapInPandas(extend, queries.schema), "further")
    return known.where("not few").select(*columns).unionByName(extended)


def nearest(rows: DataFrame, ident: str, space: list[str], vector: list[Column], wanted: Column, k: int = 10, probes: int = PROBES, complete: bool = True, fit_rows: int = FIT_ROWS, part_rows: int = PART_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(``id``, ``near``, ``distance``, ``rank``): the ``k`` nearest other rows of every row that meets ``wanted``.

    ``rows`` holds one row per ``ident``; rows of different ``space`` columns never meet; ``vector`` lists the scaled
    components, the distance is Euclidean over them, equal distances go by the smaller identifier. Rows with a
    null identifier, a null space column or a null or non-finite component are neither queries nor answers. A
    space of k rows or fewer gives all that there are; an empty table gives none. Without ``complete`` only the
    probable parts are visited and a neighbour may be missed (approximate mode). The parts are those of all spaces
    together, so a small space has few rows in each; its queries then go on to further parts until these hold
    SEEN_ROWS rows of the space for each of the ``k``, or all of it.

    The index is fitted on at most ``fit_rows`` rows (hash sample, collected to the driver: the bound is this
    parameter) and stores every row. Parts of more than ``split_rows`` rows are divided by networks that are fitted where the
    rows are, on about SUB_ROWS of each part; so the rows that a query meets do not grow with the table.
    """
    dims = [f"v{i}" for i in range(len(vector))]
    spaces = [f"s{i}" for i in range(len(space))]
    points = rows.select(F.col(ident).cast("long").alias("id"), *[F.col(c).alias(s) for c, s in zip(space, spaces)], *[v.cast("double").alias(d) for v, d in zip(vector, dims)], F.coalesce(wanted, F.lit(False)).alias("wanted")).dropna()
    for d in dims:
        points = points.where(~F.isnan(d) & (F.abs(d) < float("inf")))
    points = cut(points, "vectors")
    total = points.count()
    classes = max(1, -(-total // fit_rows))
    sample = points.where(F.pmod(F.xxhash64("id"), F.lit(classes)) == 0).orderBy(F.xxhash64("id")).limit(fit_rows).select("id", *dims).toPandas().sort_values("id")
    parts = max(1, min(max(MIN_PARTS, min(MAX_PARTS, -(-total // part_rows))), len(sample) // 16))
    router = fit_router(sample[dims].to_numpy(dtype=float).reshape(-1, len(dims)), parts) if len(sample) else fit_router(np.zeros((1, len(dims))), 1)
    shared = points.sparkSession.sparkContext.broadcast(router)

    def route(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(parts=list(shared.value.order(pdf[dims].to_numpy(), probes)))

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields), "parts array<int>"])
    routed = cut(points.mapInPandas(route, fields), "routed")
    stored = routed.select("id", *spaces, F.element_at("parts", 1).alias("part"), *dims)
    key = [*spaces, "part"]
    sizes = cut(stored.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "sizes")
    queries = routed.where("wanted")
    if not complete:  # else the boxes name all further parts
        queries = _further(queries, sizes, spaces, dims, shared, SEEN_ROWS * k)
    first = queries.select("id", *spaces, F.explode("parts").alias("part"), *dims)
    large = sizes.where(F.col("n") > split_rows)
    if large.isEmpty():
        stored, first = (side.withColumn("sub", F.lit(0)) for side in (stored, first))
        visited = queries.withColumn("visited", F.transform("parts", lambda p: F.struct(p.alias("part"), F.lit(0).alias("sub"))))
    else:

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", kind="stable")
            many = int(pdf["n"].iloc[0])
            net = fit_router(pdf[dims].to_numpy(dtype=float), max(1, min(MAX_PARTS, -(-many // part_rows), len(pdf) // 16)), hidden=32)
            return pdf[key].iloc[:1].assign(net=[pickle.dumps(net)], salts=[-(-many // BLOCK_ROWS)])

        picked = stored.join(large, key).where(F.pmod(F.xxhash64(F.lit(3), "id"), F.ceil(F.col("n") / SUB_ROWS)) == 0)
        fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in stored.select(*key).schema.fields), "net binary", "salts int"])
        routers = cut(picked.groupBy(*key).applyInPandas(fit, fields), "routers")
        stored = cut(_divide(stored, routers, key, dims).withColumn("sub", F.element_at("subs", 1)).drop("subs"), "stored")
        first = cut(_divide(first, routers, key, dims).withColumn("sub", F.explode("subs")).drop("subs"), "first")
        seen = first.groupBy("id").agg(F.collect_list(F.struct("part", "sub")).alias("visited"))
        visited = queries.join(seen, "id")
    key = [*key, "sub"]
    boxes = cut(stored.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), *[f(d).alias(f"{n}{d}") for d in dims for f, n in ((F.min, "l"), (F.max, "h"))]), "boxes")
    blocks = boxes.select(*key, "blocks")
    found = _in_parts(first, stored, spaces, dims, k, blocks)
    best = Window.partitionBy("id").orderBy("distance", "near")
    found = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")
    if complete:
        reach = found.groupBy("id").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("n"))
        asked = visited.join(reach, "id", "left").select("id", *spaces, *dims, "visited", F.when(F.col("n") >= k, F.col("reach") * (1 + 1e-9)).alias("reach"))
        gap = lambda d: F.greatest(F.col(f"l{d}") - F.col(d), F.col(d) - F.col(f"h{d}"), F.lit(0.0))
        square = sum((gap(d) * gap(d) for d in dims), F.lit(0.0))
        near = F.col("reach").isNull() | (F.sqrt(square) <= F.col("reach"))
        sides = [f"{n}{d}" for d in dims for n in "lh"]
        # first the boxes of whole parts, at most MAX_PARTS per space, then those of the divisions of the parts within reach
        whole = boxes.groupBy(*spaces, "part").agg(*[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in sides])
        more = asked.join(_small(whole), spaces).where(near).drop(*sides).join(_small(boxes), [*spaces, "part"])
        more = more.where(near & ~F.array_contains("visited", F.struct(F.col("part").alias("part"), F.col("sub").alias("sub"))))
        more = cut(more.select("id", *spaces, "part", "sub", *dims), "visits")
        found = found.drop("rank").unionByName(_in_parts(more, stored, spaces, dims, k, blocks)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found


def _small(boxes: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``boxes`` to be broadcast if they (or the rows ``counted`` that they gather) are few, so a space with most queries needs no exchange; else as they are."""
    return F.broadcast(boxes) if (boxes if counted is None else counted).count() <= BROADCAST_BOXES else boxes
