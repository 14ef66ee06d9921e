"""Filling containers of fixed capacity with token sequences, at target proportions of sources (problem 7)."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections import deque
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astroloom.llm.text import spread
from astroloom.tables import cut

CAPACITY = 2048
#: Where the vocabulary lies unless ``path`` or the environment variable ASTROLOOM_VOCABULARY names another file.
VOCABULARY = os.environ.get("ASTROLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Containers per window, and tokens per shard. A shard is packed by one task; only lengths are shuffled.
WINDOW = 64
SHARD_TOKENS = 4_000_000
#: Containers filled less than this are opened again in the next window.
FULL = 0.985
#: How far a source's share of a window's tokens may lie from its target while no source has run out.
TOLERANCE = 0.06
#: Share of a window by which what earlier shards left may shift a source at most.
SHIFT = 0.02


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of the whole text; 0 for null or empty text."""

    @F.pandas_udf("int")
    def tokens(texts: pd.Series) -> pd.Series:
        encode = tokenizer(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return spread(df).withColumn(name, tokens(text))


def fill(sizes: list[tuple[int, int]], capacity: int) -> list[list[int]]:
    """Best fit, largest first: lists of item numbers whose sizes sum to at most the capacity. ``sizes``: (size, number)."""
    space: list[tuple[int, int]] = []  # (free, container), ascending
    boxes: list[list[int]] = []
    for size, item in sorted(sizes, key=lambda x: (-x[0], x[1])):
        at = bisect_left(space, (size, -1))
        if at < len(space):
            free, box = space.pop(at)
        else:
            free, box = capacity, len(boxes)
            boxes.append([])
        boxes[box].append(item)
        insort(space, (free - size, box))
    return boxes


def pack_shard(docs: list[tuple], targets: dict, carry: dict, capacity: int = CAPACITY, window: int = WINDOW) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(window, sources that have documents left behind it, pieces) of the containers of one shard; a piece is (document, first token, tokens).

    ``docs``: (document, source, tokens) in the order to be read; a document longer than a container queues as whole
    containers and one rest. Per window every source's deficit grows by its target share of the window's tokens, and
    by an equal part of ``carry``, what the shards before have left, but at most SHIFT of the window; pieces leave a source's queue in turns while the
    deficit covers them, and what is left is carried on. No piece exceeds a container, so a window misses a source's
    target by two containers at most, but for those that are carried. A source whose queue is empty gives its share to the
    others. The pieces of a window are packed best fit; containers that are not full are opened again in the next window.
    """
    queues: dict = {}
    total = 0
    for doc, source, n in docs:
        total += n
        queue = queues.setdefault(source, deque())
        for at in range(0, n - capacity, capacity):
            queue.append((doc, at, capacity))
        rest = n % capacity or capacity
        queue.append((doc, n - rest, rest))
    budget = float(capacity * window)
    windows = max(1.0, total / budget)
    deficits = dict.fromkeys(queues, 0.0)
    shift = {s: max(-SHIFT * budget, min(SHIFT * budget, carry.get(s, 0.0) / windows)) for s in queues}
    out: list = []
    carried: list[tuple[int, int, int]] = []
    number = 0
    while any(queues.values()):
        live = [s for s in queues if queues[s]]
        weight = sum(targets.get(s, 0.0) for s in live)
        for s in live:
            deficits[s] += budget * (targets.get(s, 0.0) / weight if weight > 0 else 1.0 / len(live)) + shift[s]
        short = min(queues[s][0][2] - deficits[s] for s in live)
        if short > 0:  # nobody can send: all rise together until one can
            for s in live:
                deficits[s] += short
        pieces = carried
        taken = True
        while taken:  # round robin: one piece per source and turn
            taken = False
            for s in live:
                if queues[s] and queues[s][0][2] <= deficits[s]:
                    piece = queues[s].popleft()
                    deficits[s] -= piece[2]
                    pieces.append(piece)
                    taken = True
        left = sum(map(bool, queues.values()))
        last = not left
        carried = []
        for box in fill([(p[2], i) for i, p in enumerate(pieces)], capacity):
            content = [pieces[i] for i in box]
            if last or sum(p[2] for p in content) >= FULL * capacity:
                out.append((number, left, content))
            else:
                carried += content
        number += 1
    return out


def pack(docs: DataFrame, ident: str, source: str, tokens: str, targets: dict[str, float] | None = None, capacity: int = CAPACITY, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Containers: ``container_id``, ``window``, ``n_live``, ``n_tokens``, ``doc_ids``, ``starts``, ``lengths`` (parallel arrays).

    ``window`` numbers the windows in which containers are filled, ``n_live`` the sources that have documents left behind
    it. While all have, each window holds the target mix within TOLERANCE, and windows may be read in any order.

    Every token of every document is in exactly one container; only documents longer than ``capacity`` are
    divided, and only their rest shares a container. Documents of no tokens, or with a null identifier, are in none.
    A null source is a source of its own. Default targets are the proportions of the whole input; a given target
    mix holds as long as the named sources last, then the remaining documents follow, so none is dropped. Rows
    that repeat an identifier are separate documents.

    Documents are dealt to shards of about ``shard_tokens`` tokens by a hash of the identifier, which spreads any
    source over all shards. A shard makes up for the deficits that the shards before it leave, spread over its windows and within the tolerance:
    the target share of all tokens before, less the source's tokens before, both known from per-shard sums. So the
    mix is controlled across shards while they are packed in parallel.
    """
    rows = docs.where(F.col(ident).isNotNull() & (F.col(tokens) > 0)).select(F.col(ident).cast("long").alias("doc"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(tokens).cast("long").alias("n"))
    rows = cut(rows, "lengths")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int"))
    sums = rows.groupBy("source", "shard").agg(F.sum("n").alias("n"))
    names = sums.groupBy("source").agg((F.sum("n") / float(total or 1)).alias("share"))
    if targets:
        given = F.create_map(*[F.lit(x) for s, t in targets.items() for x in (s, float(t))])
        names = names.withColumn("share", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)))
    grid = names.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    grid = grid.join(sums, ["source", "shard"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = grid.withColumn("sent", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = ahead.groupBy("shard").agg(F.sum("sent").alias("all_sent"))
    start = ahead.join(whole, "shard").select("source", "shard", "share", (F.col("share") * F.col("all_sent") - F.col("sent")).alias("deficit"))
    schema = "container_id long, window long, n_live int, n_tokens int, doc_ids array<long>, starts array<long>, lengths array<int>"

    def run(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "n"], kind="stable")
        mix = dict(zip(state["source"], state["share"]))
        boxes = pack_shard(list(zip(pdf["doc"], pdf["source"], pdf["n"])), mix, dict(zip(state["source"], state["deficit"])), capacity, window)
        return pd.DataFrame({
            "container_id": [(int(key[0]) << 32) + i for i in range(len(boxes))],
            "window": [(int(key[0]) << 32) + w for w, _, _ in boxes],
            "n_live": [n for _, n, _ in boxes],
            "n_tokens": [sum(p[2] for p in b) for _, _, b in boxes],
            "doc_ids": [[int(p[0]) for p in b] for _, _, b in boxes],
            "starts": [[int(p[1]) for p in b] for _, _, b in boxes],
            "lengths": [[int(p[2]) for p in b] for _, _, b in boxes],
        })

    rows, start = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (rows, start))  # two identities of one table
    return rows.groupBy("shard").cogroup(start.groupBy("shard")).applyInPandas(run, schema)
