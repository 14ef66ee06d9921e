"""Parent-child rows to full hierarchies (problem 4).

Subtree sizes come from pointer doubling, which also separates the circles; heavy children link nodes to chains; chains
give root, depth, place in the tour, and paths. All steps are DataFrame joins on keys and the number of rounds grows
with the logarithm of the depth. A round reads only the nodes that are not finished, is written to the shared
folder, so a lost executor costs at most one round, and the last TASK_ROWS unfinished nodes are finished in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astroloom.tables import cut

#: Siblings of one parent are summed in so many blocks, so a parent of any size is spread over tasks.
BLOCKS = 256
#: Tour positions per block in the descendant join.
TOUR_BLOCK = 1024
#: Unfinished nodes that one task finishes at most (a few numbers each); more take further distributed rounds, with equal results.
TASK_ROWS = 1_000_000


@dataclass
class Forest:
    """``nodes``: one row per id with kind, root, depth, size, chain, place and, with a tour, position; see :func:`resolve_forest`."""

    nodes: DataFrame
    chains: DataFrame | None = None


def _edges(rows: DataFrame, id_column: str, parent_column: str, top: int | None) -> DataFrame:
    parent = F.col(parent_column).cast("long")
    if top is not None:
        parent = F.when(parent != top, parent)
    rows = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), parent.alias("parent")).groupBy("id").agg(F.max("parent").alias("parent"))
    known = rows.select(F.col("id").alias("known"))
    return rows.join(known, rows.parent == known.known, "left").select("id", "parent", F.col("known").alias("up"))


def _gather(batches, columns: list[str]) -> pd.DataFrame:
    frames = [b for b in batches if len(b)]
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the ``wanted`` ids stand in the ascending ``ids``; -1 if nowhere."""
    if not len(ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


def _count_below(batches):
    """The rounds of :func:`_sizes` for unfinished nodes (id, up, size): (id, added, kind), kind set for the rest in circles."""
    frame = _gather(batches, ["id", "up", "size"])
    universe = np.unique(np.concatenate([frame["id"], frame["up"]]).astype(np.int64))
    up = np.full(len(universe), -1)
    size = np.zeros(len(universe))
    at = _places(universe, frame["id"].to_numpy(np.int64))
    up[at] = _places(universe, frame["up"].to_numpy(np.int64))
    size[at] = frame["size"].to_numpy(float)
    added = np.zeros(len(universe))
    while True:
        active = np.flatnonzero(up >= 0)
        more = np.bincount(up[active], size[active], len(universe)) if len(active) else np.zeros(len(universe))
        added += more
        size += more
        moved = np.full(len(universe), -1)
        moved[active] = up[up[active]]
        if (moved >= 0).sum() == len(active):
            break
        up = moved
    kind = np.full(len(universe), None, dtype=object)
    if len(active):
        kind[active] = "below_cycle"
        image = active
        while True:  # the images under ever more links shrink to the circles
            smaller = np.unique(up[image])
            if len(smaller) == len(image):
                break
            image = smaller
            up[active] = up[up[active]]
        kind[image] = "cycle"
    keep = (added > 0) | (up >= 0)
    yield pd.DataFrame({"id": universe[keep], "added": added[keep].astype(np.int64), "kind": kind[keep]})


def _circles(rest: DataFrame) -> DataFrame:
    """Ids that lie on a circle, of nodes whose links never end; ``up`` points 2^k links up.

    The images of all nodes under ever more links shrink to the circles themselves; two equal counts in a row mean
    that the last map is one-to-one on its image, which only nodes on circles can form.
    """
    links = cut(rest.select("id", "up"), "circle")
    before = -1
    while True:
        image = links.select(F.col("up").alias("id")).distinct()
        size = image.count()
        if size == before:
            return image
        before = size
        target = links.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        links = cut(links.join(target, "up").select("id", F.col("up2").alias("up")), "circle")


def _sizes(edges: DataFrame) -> DataFrame:
    """(id, added, kind): the nodes below each node, and 'cycle' or 'below_cycle' for those whose links never end.

    State: ``up`` is the ancestor 2^k links above, ``size`` the descendants nearer than 2^k links, the node itself
    included; nodes without such an ancestor have left. A round adds to every node the counts of the nodes that
    point to it and moves each pointer to its target's pointer; an inner join drops the nodes whose target has left. Counts for
    nodes that have left are summed at the end, over the states of all rounds. If a round leaves the number of
    nodes as it was, none has a depth in (2^k, 2^(k+1)], so none is deeper, and all that remain run in circles.
    A parent of very many nodes is one key of the joins, whose side with many rows adaptive execution splits.
    """
    state = edges.where("up is not null").select("id", "up", F.lit(1).cast("long").alias("size"))
    active, states = state.count(), []
    while active > TASK_ROWS:
        added = state.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("added"))
        target = state.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        moved = state.join(target, "up").join(added, "id", "left").select("id", F.col("up2").alias("up"), (F.col("size") + F.coalesce("added", F.lit(0))).alias("size"))
        states.append(state)
        state = cut(moved, "climb")
        left, active = active, state.count()
        if left == active:
            break
    earlier = [s.select(F.col("up").alias("id"), F.col("size").alias("added"), F.lit(None).cast("string").alias("kind")) for s in states]
    if active > TASK_ROWS:
        on = _circles(state).withColumn("on", F.lit(True))
        last = state.join(on, "id", "left").select("id", F.lit(0).cast("long").alias("added"), F.when(F.col("on"), "cycle").otherwise("below_cycle").alias("kind"))
    else:
        last = cut(state.coalesce(1).mapInPandas(_count_below, "id long, added long, kind string"), "below")
    if not earlier:
        return last
    for s in earlier:
        last = last.unionByName(s)
    return last.groupBy("id").agg(F.sum("added").alias("added"), F.max("kind").alias("kind"))


def _to_top(state: DataFrame, sums: list[str], labels: list[str]) -> DataFrame:
    """``state`` (id, up, sums, labels) with ``up`` followed to the row that has none: its labels, and the sums on the way.

    ``sums`` are longs that add up along the links, the top's own included; ``labels`` are taken from the top. Rows that
    have arrived are set aside and only read.
    """
    done, moving = state.where("up is null"), state.where("up is not null")
    active = moving.count()
    while active > TASK_ROWS:
        target = done.unionByName(moving).select(F.col("id").alias("up"), F.col("up").alias("up2"), *[F.col(c).alias(f"{c}2") for c in (*sums, *labels)])
        moved = cut(moving.join(target, "up").select("id", F.col("up2").alias("up"), *[(F.col(c) + F.col(f"{c}2")).alias(c) for c in sums], *[F.col(f"{c}2").alias(c) for c in labels]), "chains")
        done, moving = done.unionByName(moved.where("up is null")), moved.where("up is not null")
        active = moving.count()

    def follow(batches):
        frame = _gather(batches, ["id", "up", *sums]).sort_values("id", kind="stable")
        ids, last = frame["id"].to_numpy(np.int64), frame["up"].to_numpy(np.int64)
        up, total = _places(ids, last), frame[sums].to_numpy(np.int64).reshape(len(ids), len(sums))
        while (going := np.flatnonzero(up >= 0)).size:
            to = up[going]
            total[going] += total[to]
            last[going] = last[to]
            up[going] = up[to]
        yield pd.DataFrame({"id": ids, "up": last, **{c: total[:, i] for i, c in enumerate(sums)}})

    fields = ", ".join(f"{c} long" for c in ("id", "up", *sums))
    ends = moving.select("id", "up", *sums).coalesce(1).mapInPandas(follow, fields)
    target = done.select(F.col("id").alias("up"), *[F.col(c).alias(f"{c}2") for c in sums], *labels)
    return done.drop("up").unionByName(ends.join(target, "up").select("id", *[(F.col(c) + F.col(f"{c}2")).alias(c) for c in sums], *labels))


def _before_siblings(light: DataFrame) -> DataFrame:
    """``light`` (parent, id, size) with ``before``: the sizes of the siblings that come earlier, in a fixed order.

    The order is by a hash block of the id, then by id. Block sums are made first (with map-side sums), so only
    a block of one parent's children is ever sorted in a task, however many children it has.
    """
    blocked = light.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)))
    sums = blocked.groupBy("parent", "block").agg(F.sum("size").alias("of_block"))
    over = Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("of_block").over(over), F.lit(0))).drop("of_block")
    inside = Window.partitionBy("parent", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocked = blocked.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return blocked.join(sums, ["parent", "block"]).select("id", (F.col("ahead") + F.col("inside")).alias("before"))


def resolve_forest(rows: DataFrame, id_column: str, parent_column: str, top: int | None = -1, tour: bool = True) -> Forest:
    """Root, depth, subtree size and descendant interval of every node, by heavy-path decomposition.

    ``rows`` holds one row per id; a null parent or one equal to ``top`` marks a top level. Of several rows with one
    id the largest parent counts; rows with a null id are left out. ``nodes`` has: ``id``; ``parent`` as given;
    ``kind`` 'tree' (reaches a top level), 'orphan' (its chain ends at a parent without a row), 'cycle' (its own
    ancestor) or 'below_cycle'; and for the first two ``root`` (the last ancestor that has a row), ``depth`` (1 at
    the root), ``size`` (nodes in its subtree, itself included), ``chain`` (the head of its heavy chain), ``place`` in that chain and, with
    ``tour``, ``position`` in its tree's tour. A node's descendants are the nodes of the same root with positions in
    [position + 1, position + size - 1]. An empty table gives an empty one; a node that is its own parent is a cycle.
    Paths are made by :func:`paths`, for those who need them.

    Every node passes its chain on to its heaviest child (ties: the smaller id), so any path crosses at most
    log2(nodes) chains. Chains are then the unit of work: a chain's head hangs on a place of the chain above, and
    following chains to the top sums depths and tour offsets in log2(log2(nodes)) rounds.
    """
    edges = cut(_edges(rows, id_column, parent_column, top), "edges")
    sized = edges.join(_sizes(edges), "id", "left").select("id", "parent", "up", (F.coalesce("added", F.lit(0)) + 1).cast("long").alias("size"), "kind")
    sized = cut(sized, "sizes")
    trees = sized.where("kind is null")
    heavy = trees.where("up is not null").groupBy("up").agg(F.max(F.struct("size", (-F.col("id")).alias("id"))).alias("best"))
    heavy = heavy.select((-F.col("best.id")).alias("id"), F.lit(True).alias("heavy"), F.col("best.size").alias("heavy_size"))
    linked = trees.join(heavy.select("id", "heavy"), "id", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    linked = cut(linked.select("id", "parent", F.col("up").alias("above"), "size", F.when(F.col("heavy"), F.col("up")).alias("up"), F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("place")), "linked")
    top_chain = linked.select("id", "up", "place", F.when(F.col("up").isNull(), F.col("id")).alias("chain"))
    placed = cut(_to_top(top_chain, ["place"], ["chain"]), "places")

    heads = linked.where("up is null").select("id", "parent", "above", "size")
    hung = heads.where("above is not null")
    seats = placed.select(F.col("id").alias("above"), F.col("chain").alias("on"), F.col("place").alias("seat"))
    offset = F.lit(0).cast("long")
    if tour:
        heavy_of = linked.where("up is not null").select("above", F.col("size").alias("heavy_size"))
        before = _before_siblings(hung.select(F.col("above").alias("parent"), "id", "size"))
        hung = hung.join(heavy_of, "above").join(before, "id")
        offset = F.col("heavy_size") + F.col("before")
    hung = hung.join(seats, "above").select("id", F.col("on").alias("up"), (F.col("seat") + 1).alias("links"), (F.col("seat") + 1 + offset).alias("offset"), F.lit(None).cast("long").alias("root"), F.lit(None).cast("boolean").alias("orphan"))
    tops = heads.where("above is null").select("id", F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("offset"), F.col("id").alias("root"), F.col("parent").isNotNull().alias("orphan"))
    chains = cut(tops.unionByName(hung), "chains")
    ends = cut(_to_top(chains, ["links", "offset"], ["root", "orphan"]), "ends").withColumnRenamed("id", "chain")
    nodes = sized.where("kind is null").select("id", "parent", "size").join(placed, "id").join(ends, "chain")
    position = [(F.col("offset") + F.col("place")).alias("position")] if tour else []
    nodes = nodes.select("id", "parent", F.when(F.col("orphan"), "orphan").otherwise("tree").alias("kind"), "root", (F.col("links") + F.col("place") + 1).alias("depth"), "size", "chain", "place", *position)
    none = F.lit(None).cast("long")
    circles = sized.where("kind is not null").select("id", "parent", "kind", *[none.alias(c) for c in ("root", "depth", "size", "chain", "place", *(["position"] if tour else []))])
    return Forest(nodes.unionByName(circles), chains.select(F.col("id").alias("chain"), "up", (F.col("links") - 1).alias("seat")))


def paths(forest: Forest) -> DataFrame:
    """(id, ``path``) of every node of a tree: the ids from the root to the node. Nodes on or below circles have no row.

    A node's path is the path down to its chain and the chain's ids up to the node. The ids of a chain are one array,
    which is no longer than the path of the chain's last node; the paths down to chains are joined from their segments in
    log2(log2(nodes)) rounds.
    """
    known = forest.nodes.where("chain is not null")
    members = cut(known.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda m: m["id"]).alias("ids")), "segments")
    none = F.array().cast("array<long>")
    above = members.select(F.col("chain").alias("up"), F.col("ids").alias("upper"))
    rounds = cut(forest.chains.join(above, "up", "left").select("chain", "up", F.when(F.col("up").isNull(), none).otherwise(F.slice("upper", F.lit(1), (F.col("seat") + 1).cast("int"))).alias("prefix")), "prefixes")
    while not rounds.where("up is not null").isEmpty():
        target = rounds.select(F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("prefix").alias("prefix2"))
        rounds = cut(rounds.join(target, "up", "left").select("chain", F.col("up2").alias("up"), F.concat(F.coalesce("prefix2", none), "prefix").alias("prefix")), "prefixes")
    whole = members.join(rounds.select("chain", "prefix"), "chain")
    nodes = whole.select("prefix", "ids", F.posexplode("ids").alias("place", "id"))
    return nodes.select("id", F.concat("prefix", F.slice("ids", F.lit(1), F.col("place") + 1)).alias("path"))


def descendants(forest: Forest, wanted: Column, block: int = TOUR_BLOCK) -> DataFrame:
    """(id, descendant) for every node that meets ``wanted``, from its interval of the tour.

    The interval is cut into blocks of tour positions and joined with all nodes on (root, block), so the join is an
    equi-join whose work is the number of descendants plus two partial blocks per node; a tree that holds most
    nodes is spread over its blocks. Nodes on or below circles have no interval and no row.
    """
    spans = forest.nodes.where(wanted & (F.col("size") > 1)).select("id", "root", (F.col("position") + 1).alias("low"), (F.col("position") + F.col("size") - 1).alias("high"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))))
    tour = forest.nodes.where("root is not null").select(F.col("id").alias("descendant"), "root", "position", F.floor(F.col("position") / block).alias("block"))
    return spans.join(tour, ["root", "block"]).where("position between low and high").select("id", "descendant")
