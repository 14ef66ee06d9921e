"""Spatial joins and friends-of-friends clustering on grid cells.

Range joins are equi-joins on cell numbers: one side is repeated for the neighbouring cells, the residual tests the
distance. Cells are at least as wide as the radius.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astroloom.functions.physics import cubic_spline_weight, min_image
from astroloom.operators.membership import number_rows, size_labels
from astroloom.tables import cut, drop_cut

AXES = ("x", "y", "z")
#: Up to so many edges are resolved in one task; more take distributed rounds.
SMALL_EDGES = 200_000
#: Cell pairs of up to so many point pairs are compared by a join, larger ones block by block with an early end.
SMALL_PAIRS = 4096
#: Points of one cell that meet the points of another in one task at most.
CELL_BLOCK = 8192


def distance2(a: str, b: str, box: float | None) -> Column:
    parts = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in AXES]
    if box is not None:
        parts = [min_image(p, box) for p in parts]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def _cells(df: DataFrame, side: float, box: float | None, prefix: str = "") -> DataFrame:
    """``df`` with cell numbers ix, iy, iz; coordinates are wrapped first if periodic."""
    n = None if box is None else max(1, int(box / side))
    for c in AXES:
        x = F.col(f"{prefix}{c}")
        cell = F.floor(x / side) if n is None else F.least(F.lit(n - 1), F.floor(F.pmod(x, F.lit(float(box))) * n / box))
        df = df.withColumn(f"i{c}", cell.cast("long"))
    return df


def _around(df: DataFrame, side: float, box: float | None, reach: int = 1) -> DataFrame:
    """``df`` repeated for the cells around its own, each once, even in boxes of few cells."""
    n = None if box is None else max(1, int(box / side))
    for c in AXES:
        steps, own = F.sequence(F.lit(-reach), F.lit(reach)), F.col(f"i{c}")
        if n is not None:
            cells = F.array_distinct(F.transform(steps, lambda d: F.pmod(own + d, F.lit(n))))  # noqa: B023
        else:
            cells = F.transform(steps, lambda d: own + d)  # noqa: B023
        df = df.withColumn(f"i{c}", F.explode(cells))
    return df


def within(left: DataFrame, right: DataFrame, radius: float, box: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a left row (columns a*) and a right row (columns b*) of the same ``by`` within ``radius``, with ``d2``.

    Inputs have x, y, z; every other column keeps its name behind the prefix. Null coordinates meet nothing. A
    radius that is not positive meets equal places only.
    """
    side = max(radius, 1e-12) if box is None else max(radius, box / 1024, 1e-12)
    a = left.select(*by, *[F.col(c).alias(f"a{c}") for c in left.columns if c not in by]).dropna(subset=[f"a{c}" for c in AXES])
    b = right.select(*by, *[F.col(c).alias(f"b{c}") for c in right.columns if c not in by]).dropna(subset=[f"b{c}" for c in AXES])
    a, b = _around(_cells(a, side, box, "a"), side, box), _cells(b, side, box, "b")
    keys = [*by, *[f"i{c}" for c in AXES]]
    return a.join(b, keys).drop(*[f"i{c}" for c in AXES]).withColumn("d2", distance2("a", "b", box)).where(F.col("d2") <= radius * radius)


def pairs(points: DataFrame, radius: float, box: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Each pair of different points within ``radius`` once, the smaller ``pidx`` first."""
    return within(points, points, radius, box, by).where("apidx < bpidx")


def nearest_label(points: DataFrame, labelled: DataFrame, radius: float, box: float | None, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pidx, label) of the nearest labelled point of the same ``by`` within ``radius``, ties by its smaller pidx; -1 where there is none."""
    near = within(points.select(*by, "pidx", *AXES), labelled.select(*by, "pidx", *AXES, label), radius, box, by)
    best = near.groupBy(*by, "apidx").agg(F.min(F.struct("d2", "bpidx", f"b{label}")).alias("best"))
    best = best.select(*by, F.col("apidx").alias("pidx"), F.col(f"best.b{label}").alias(label))
    return points.select(*by, "pidx").join(best, [*by, "pidx"], "left").withColumn(label, F.coalesce(label, F.lit(-1)))


def _union(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest end of each component for all ends of the edges."""
    ends, flat = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    a, b = flat[0::2], flat[1::2]
    low = np.arange(len(ends))
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return pd.DataFrame({"id": ends, "up": ends[low]})


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each node's component.

    ``edges`` (a, b) in any direction, repeated or reflexive; ends without a node join others but get no row. Rounds of hooking to
    the smallest neighbour's root and pointer jumping; the number of rounds grows with the logarithm of the
    size. Edges whose ends share a root leave the table, so later rounds touch only what is still open. A node of
    many edges is no problem: neighbours' minima are taken with map-side sums.
    """
    state = cut(nodes.select(F.col("id").cast("long")).distinct().withColumn("root", F.col("id")), "components")
    open_ = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    while count := open_.count():
        if count <= SMALL_EDGES:
            jump = open_.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_union, "id long, up long")
            up = jump.select(F.col("id").alias("root"), "up")
            return cut(state.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "components")
        # contract to roots: parallel edges merge, inner edges vanish
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a"), "hooks")
        jump = low.withColumnsRenamed({"a": "id", "b": "up"})
        while True:
            further = jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("up2")), "up", "left")
            moved = further.where("up2 is not null").limit(1).count()
            if not moved:
                break
            before, jump = jump, cut(further.select("id", F.coalesce("up2", "up").alias("up")), "jumps")
            drop_cut(before)
        up = jump.select(F.col("id").alias("root"), F.col("up").alias("up"))
        before, state = state, cut(state.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "components")
        ends = open_.join(jump.select(F.col("id").alias("a"), F.col("up").alias("ua")), "a", "left").join(jump.select(F.col("id").alias("b"), F.col("up").alias("ub")), "b", "left")
        after = ends.select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b")).where("a <> b")
        gone, open_ = open_, cut(after.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop_cut(before)
        drop_cut(gone)
    return state


def linking_length(n_points: int, box: float, b: float = 0.2) -> float:
    """``b`` times the mean separation of the points."""
    return b * box / max(1, n_points) ** (1 / 3)


def _touch(length: float, box: float | None):
    """Whether any point of one block lies within the linking length of any point of the other."""

    def test(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        hit = False
        if len(a) and len(b):
            p, q = a[list(AXES)].to_numpy(), b[list(AXES)].to_numpy()
            for at in range(0, len(p), 512):
                d = p[at : at + 512, None, :] - q[None, :, :]
                if box is not None:
                    d -= box * np.rint(d / box)
                if ((d**2).sum(-1) <= length**2).any():
                    hit = True
                    break
        return pd.DataFrame({"a": [key[0]], "b": [key[1]]} if hit else {"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    return test


def friends_of_friends(points: DataFrame, length: float, box: float, least: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pidx, root, label): components of points of the same ``by`` linked by at most ``length`` in a periodic box.

    Labels count from 0 in every ``by`` by size descending, then smallest member; -1 below ``least`` members. Rows with
    null coordinates or ``by`` get no row; an empty table gives an empty one. ``pidx`` is unique over all ``by``.

    Cells are so small that all their points are linked, so cells are the nodes. Two occupied cells near each other
    are linked at once if their bounding boxes are wholly within reach, and never if the boxes are out of reach; only the
    remaining cell pairs compare points, in blocks of bounded size with an early end. So a cell with a third of
    all points costs its blocks, not its pairs.
    """
    n = max(1, math.ceil(box * math.sqrt(3) / length))
    if n < 5:
        raise ValueError("the linking length is too large for the box")
    good = points.select(*by, "pidx", *AXES).dropna()
    cell = [F.least(F.lit(n - 1), F.floor(F.pmod(F.col(c), F.lit(float(box))) * n / box)).cast("long") for c in AXES]
    good = cut(good.withColumns({c: F.pmod(F.col(c), F.lit(float(box))) for c in AXES}).withColumn("cell", (cell[0] * n + cell[1]) * n + cell[2]), "cells")
    # a cell goes by its smallest point from here on, so the cells of all groups are nodes of one graph
    cells = cut(good.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("pidx").alias("first"), *[f(c).alias(f"{k}{c}") for c in AXES for f, k in ((F.min, "l"), (F.max, "h"))]), "cells")
    reach = [s for s in itertools.product(range(-2, 3), repeat=3) if s > (0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, AXES)]) for s in reach])
    good = cut(good.join(cells.select(*by, "cell", F.col("first").alias("node")), [*by, "cell"]).drop("cell"), "nodes")
    ix, iy, iz = F.floor(F.col("cell") / (n * n)), F.pmod(F.floor(F.col("cell") / n), F.lit(n)), F.pmod(F.col("cell"), F.lit(n))
    beside = cells.withColumn("s", F.explode(offsets)).withColumn("other", (F.pmod(ix + F.col("s.x"), F.lit(n)) * n + F.pmod(iy + F.col("s.y"), F.lit(n))) * n + F.pmod(iz + F.col("s.z"), F.lit(n)))
    right = cells.select(*by, F.col("cell").alias("other"), F.col("n").alias("n2"), F.col("first").alias("b"), *[F.col(f"{k}{c}").alias(f"{k}{c}2") for c in AXES for k in "lh"])
    near = beside.drop("s").join(right, [*by, "other"]).where("cell <> other")
    gaps, spans = [], []
    for c in AXES:
        middle = (F.col(f"l{c}") + F.col(f"h{c}") - F.col(f"l{c}2") - F.col(f"h{c}2")) / 2
        apart = F.abs(min_image(middle, box))
        half = (F.col(f"h{c}") - F.col(f"l{c}") + F.col(f"h{c}2") - F.col(f"l{c}2")) / 2
        gaps.append(F.greatest(F.lit(0.0), apart - half))
        spans.append(apart + half)
    square = lambda p: p[0] * p[0] + p[1] * p[1] + p[2] * p[2]
    slack = 1e-9
    near = near.where(square(gaps) <= length * length * (1 + slack)).withColumn("sure", square(spans) <= length * length * (1 - slack))
    near = cut(near.select(F.col("first").alias("a"), "b", "n", "n2", "sure"), "near")
    sure = near.where("sure").select("a", "b")
    few = near.where(f"not sure and n * n2 <= {SMALL_PAIRS}").select("a", "b")
    point = lambda p: good.select(F.col("node").alias(p), *[F.col(c).alias(f"{p}{c}") for c in AXES])
    few = few.join(point("a"), "a").join(point("b"), "b").where(distance2("a", "b", box) <= length * length).select("a", "b").distinct()
    asked = near.where(f"not sure and n * n2 > {SMALL_PAIRS}").withColumns({"ba": F.explode(F.expr(f"sequence(0, cast(ceil(n / {CELL_BLOCK}) as int) - 1)")), "na": F.ceil(F.col("n") / CELL_BLOCK).cast("int"), "nb": F.ceil(F.col("n2") / CELL_BLOCK).cast("int")})
    asked = asked.withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("a", "b", "ba", "bb", "na", "nb")
    block = lambda k: F.pmod(F.xxhash64("pidx"), F.col(k)).cast("int")
    side_a = asked.join(good.select(F.col("node").alias("a"), "pidx", *AXES), "a").where(F.col("ba") == block("na"))
    side_b = asked.join(good.select(F.col("node").alias("b"), "pidx", *AXES), "b").where(F.col("bb") == block("nb"))
    key = ["a", "b", "ba", "bb"]
    side_a, side_b = (s.select(*[F.col(c).alias(c) for c in (*key, *AXES)]) for s in (side_a, side_b))
    tested = side_a.groupBy(*key).cogroup(side_b.groupBy(*key)).applyInPandas(_touch(length, box), "a long, b long")
    roots = connected_components(cells.select(F.col("first").alias("id")), sure.unionByName(few).unionByName(tested))
    joined = cut(good.select(*by, "pidx", "node").join(roots.withColumnRenamed("id", "node"), "node"), "rooted")
    labels = size_labels(joined, "root", "pidx", least, by)
    return joined.join(labels.select("root", "first", "label"), "root").select(*by, "pidx", F.col("first").alias("root"), "label")


def local_dispersions(points: DataFrame, length: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pidx, sigma): spline-weighted velocity dispersion of the neighbours within ``length``; 0 without any."""
    near = within(points.select(*by, "pidx", *AXES, "vx", "vy", "vz"), points.select(*by, "pidx", *AXES, "vx", "vy", "vz"), length, None, by).where("apidx <> bpidx")
    w = cubic_spline_weight(2 * F.sqrt("d2") / length)
    dv2 = sum(((F.col(f"av{c}") - F.col(f"bv{c}")) * (F.col(f"av{c}") - F.col(f"bv{c}")) for c in AXES), F.lit(0.0))
    sums = near.groupBy(*by, "apidx").agg(F.sum(w).alias("w"), F.sum(w * dv2).alias("s")).select(*by, F.col("apidx").alias("pidx"), F.when(F.col("w") > 0, F.sqrt(F.col("s") / F.col("w"))).alias("sigma"))
    return points.select(*by, "pidx").join(sums, [*by, "pidx"], "left").withColumn("sigma", F.coalesce("sigma", F.lit(0.0)))


def phase_links(points: DataFrame, length: float, factor: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b): pairs within ``length`` whose velocities differ by at most ``factor`` times the larger local dispersion."""
    sigma = local_dispersions(points, length, by)
    full = cut(points.select(*by, "pidx", *AXES, "vx", "vy", "vz").join(sigma, [*by, "pidx"]), "phase")
    near = pairs(full, length, None, by)
    dv2 = sum(((F.col(f"av{c}") - F.col(f"bv{c}")) * (F.col(f"av{c}") - F.col(f"bv{c}")) for c in AXES), F.lit(0.0))
    limit = F.greatest(F.col("asigma"), F.col("bsigma")) * factor
    return near.where(dv2 <= limit * limit).select(*by, F.col("apidx").alias("a"), F.col("bpidx").alias("b"))


def find_galaxies(points: DataFrame, halo: str, length: float, factor: float = 1.0, min_stars: int = 16, min_gas: int = 0) -> DataFrame:
    """(pidx, root, galaxy): phase-space friends-of-friends inside each halo.

    ``points`` (halo, ptype, pidx unique, unwrapped x, y, z, vx, vy, vz). Only halos with ``min_stars`` stars are searched. A
    component is a galaxy if it has ``min_stars`` stars and ``min_gas`` gas particles; galaxies are numbered from 0 by
    halo (most members first), then smallest member. Other points have galaxy -1.
    """
    halos = points.groupBy(halo).agg(F.count(F.when(F.col("ptype") == "star", 1)).alias("stars"), F.count(F.lit(1)).alias("halo_n"))
    halos = halos.where(F.col("stars") >= min_stars)
    searched = cut(points.join(halos.select(halo, "halo_n"), halo), "searched")
    links = phase_links(searched, length, factor, (halo,))
    roots = connected_components(searched.select(F.col("pidx").alias("id")), links.select("a", "b")).withColumnRenamed("id", "pidx")
    rooted = cut(searched.select("pidx", "ptype", halo, "halo_n").join(roots, "pidx"), "rooted")
    groups = rooted.groupBy("root").agg(F.count(F.when(F.col("ptype") == "star", 1)).alias("stars"), F.count(F.when(F.col("ptype") == "gas", 1)).alias("gas"), F.first("halo_n").alias("halo_n"), F.first(halo).alias(halo))
    good = number_rows(groups.where((F.col("stars") >= min_stars) & (F.col("gas") >= min_gas)), [F.desc("halo_n"), F.asc(halo), F.asc("root")], "galaxy")
    out = rooted.join(good.select("root", "galaxy"), "root", "left")
    return points.select("pidx").join(out.select("pidx", "root", "galaxy"), "pidx", "left").withColumn("galaxy", F.coalesce("galaxy", F.lit(-1)))


def aperture_masses(galaxies: DataFrame, members: DataFrame, by: tuple[str, ...], galaxy: str, radii: dict[str, float], box: float, phases: tuple[str, ...] = ()) -> DataFrame:
    """Mass per type and in all within each radius of every galaxy, from particles of the same ``by``; 0 where empty.

    ``phases`` ('HI', 'H2') are parts of the gas with a column mass_{phase}; they get apertures of their own.
    """
    largest = max(radii.values())
    parts = [f"mass_{p}" for p in phases]
    near = within(galaxies.select(*by, galaxy, *AXES), members.select(*by, "ptype", "mass", *parts, *AXES), largest, box, by)
    columns = []
    for name, r in radii.items():
        inside = F.col("d2") <= r * r
        for kind in ("gas", "star", "dm", "bh"):
            columns.append(F.sum(F.when(inside & (F.col("bptype") == kind), F.col("bmass"))).alias(f"mass_{kind}_{name}"))
        for phase, part in zip(phases, parts):
            columns.append(F.sum(F.when(inside & (F.col("bptype") == "gas"), F.col(f"b{part}"))).alias(f"mass_{phase}_{name}"))
        columns.append(F.sum(F.when(inside, F.col("bmass"))).alias(f"mass_total_{name}"))
    sums = near.groupBy(*by, F.col(f"a{galaxy}").alias(galaxy)).agg(*columns)
    names = [c for c in sums.columns if c not in (*by, galaxy)]
    return galaxies.select(*by, galaxy).join(sums, [*by, galaxy], "left").select(*by, galaxy, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def share_hydrogen(gas: DataFrame, galaxies: DataFrame, by: tuple[str, ...], galaxy: str, box: float) -> DataFrame:
    """(by, galaxy, mass_HI_diffuse, mass_H2_diffuse): free gas goes to the galaxy of its halo with the largest mass / distance^2.

    A galaxy at the gas's own place wins at once; ties go to the smaller galaxy number. Galaxies of a halo are few
    against its gas, so the join is by halo with the galaxies as the small side.
    """
    a = gas.select(*by, F.col("pidx").alias("apidx"), *[F.col(c).alias(f"a{c}") for c in AXES], "mass_HI", "mass_H2")
    b = galaxies.select(*by, F.col(galaxy).alias("g"), F.col("mass").alias("m"), *[F.col(c).alias(f"b{c}") for c in AXES])
    near = a.join(b, list(by)).withColumn("d2", distance2("a", "b", box))
    weight = F.when(F.col("d2") == 0, F.lit(float("inf"))).otherwise(F.col("m") / F.col("d2"))
    best = near.groupBy(*by, "apidx").agg(F.max(F.struct(weight.alias("w"), (-F.col("g")).alias("g"))).alias("best"), F.first("mass_HI").alias("hi"), F.first("mass_H2").alias("h2"))
    sums = best.groupBy(*by, (-F.col("best.g")).alias(galaxy)).agg(F.sum("hi").alias("mass_HI_diffuse"), F.sum("h2").alias("mass_H2_diffuse"))
    out = galaxies.select(*by, galaxy).join(sums, [*by, galaxy], "left")
    return out.select(*by, galaxy, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mass_HI_diffuse", "mass_H2_diffuse")])


def local_densities(groups: DataFrame, radii: dict[str, float], box: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Mass and number density of groups within each radius of every group, itself included."""
    largest = max(radii.values())
    near = within(groups.select(*by, "pidx", *AXES), groups.select(*by, "pidx", "mass", *AXES), largest, box, by)
    columns = []
    for name, r in radii.items():
        inside, volume = F.col("d2") <= r * r, 4 / 3 * math.pi * r**3
        columns += [(F.sum(F.when(inside, F.col("bmass")).otherwise(0.0)) / volume).alias(f"mass_density_{name}"), (F.count(F.when(inside, 1)) / volume).alias(f"number_density_{name}")]
    return near.groupBy(*by, F.col("apidx").alias("pidx")).agg(*columns)


def metal_columns(stars: DataFrame, gas: DataFrame, by: tuple[str, ...], kernel: list[float], box: float | None, axis: str = "z") -> DataFrame:
    """(by, pidx, column): metal column in front of every star along ``axis``, from gas of the same group.

    Gas counts if it lies on the observer's side (smaller or equal coordinate) and its smoothing length exceeds
    the projected distance b; it adds mass · metallicity · K[int(n b / h)] / h^2 with the tabulated kernel. With a ``box``
    all differences are those of the nearest images, so a group may lie across the box edge as long as it is
    smaller than half the box; without one, places are taken as they are. Cells on the sky are as wide as the power of two
    above each gas particle's own smoothing length, so few large particles do not widen the cells of all others.
    """
    u, v = [c for c in AXES if c != axis]
    n = len(kernel) - 1
    gas = gas.where((F.col("h") > 0) & F.col("mass").isNotNull() & F.col("metallicity").isNotNull())
    level = F.ceil(F.log2("h"))
    g = gas.select(*by, *[F.col(c).alias(f"g{c}") for c in AXES], "h", (F.col("mass") * F.col("metallicity")).alias("zm"), level.cast("int").alias("level"))
    width = F.pow(F.lit(2.0), F.col("level"))
    if box is not None:  # whole cells around the box, each at least as wide
        around = F.greatest(F.lit(1.0), F.floor(F.lit(float(box)) / width))
        cell = lambda c: F.pmod(F.floor(F.col(c) / (F.lit(float(box)) / around)), around).cast("long")
        near_cells = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(cell(c) + d, around).cast("long")))
    else:
        cell = lambda c: F.floor(F.col(c) / width)
        near_cells = lambda c: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: cell(c) + d)
    g = g.withColumns({"cu": cell(f"g{u}"), "cv": cell(f"g{v}")})
    levels = g.select(*by, "level").distinct()
    s = stars.select(*by, F.col("pidx"), *[F.col(c).alias(f"s{c}") for c in AXES]).join(levels, list(by))
    s = s.withColumn("cu", F.explode(near_cells(f"s{u}"))).withColumn("cv", F.explode(near_cells(f"s{v}")))
    near = s.join(g, [*by, "level", "cu", "cv"])

    def apart(c: str) -> Column:
        d = F.col(f"g{c}") - F.col(f"s{c}")
        return d if box is None else d - F.lit(float(box)) * F.rint(d / float(box))

    b2 = apart(u) * apart(u) + apart(v) * apart(v)
    near = near.where((apart(axis) <= 0) & (b2 < F.col("h") * F.col("h")))
    table = F.array(*[F.lit(float(k)) for k in kernel])
    weight = F.element_at(table, F.floor(F.sqrt(b2) / F.col("h") * n).cast("int") + 1)
    sums = near.groupBy(*by, "pidx").agg(F.sum(F.col("zm") / (F.col("h") * F.col("h")) * weight).alias("column"))
    return stars.select(*by, "pidx").join(sums, [*by, "pidx"], "left").withColumn("column", F.coalesce("column", F.lit(0.0)))
