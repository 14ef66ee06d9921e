"""Held-out passages inside a corpus by greedy string tiling (problem 8)."""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astroloom.llm.text import spread, words
from astroloom.tables import cut

#: Words of a seed.
SEED = 3
#: Least share of an item's own words that a document must hold.
COVER = 0.5
#: A seed that more than this share of all distinct texts hold (and more than COMMON_LEAST) may be shared wording.
COMMON = 0.005
COMMON_LEAST = 10
#: It is, if so many times more texts hold it than hold the item's other seeds (this quantile of the item's seeds).
STANDS_OUT = 4
REST = 0.25
#: Share of an item's own seeds that a document must hold to be tiled, and their least number.
CANDIDATE = 0.08
CANDIDATE_LEAST = 2
#: Words of all items that are searched for at once; more items take more passes over the documents.
ITEM_WORDS = 2_000_000
_MASK = (1 << 61) - 1
_BASE = 1_000_003


def fingerprints(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin values of all runs of ``k`` word numbers, by Horner steps modulo 2^64; -1 where a word is unknown."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.int64)
    known = np.ones(n, dtype=bool)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = ids[j : j + n]
            out = out * np.int64(_BASE) + part + np.int64(1)
            known &= part >= 0
    return np.where(known, out & np.int64(_MASK), np.int64(-1))


class Items:
    """The words of the held-out items as numbers, with an index of their seeds."""

    def __init__(self, idents: list[int], texts: list[str], k: int = SEED):
        self.idents, self.k = idents, k
        listed = [words(t or "") for t in texts]
        self.sizes = sorted({min(k, len(ws)) for ws in listed} - {0})
        self.vocabulary: dict[str, int] = {}
        for ws in listed:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.ids = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for ws in listed]
        marks = [fingerprints(a, min(k, len(a))) if len(a) else np.zeros(0, np.int64) for a in self.ids]
        own = np.concatenate([np.full(len(m), i) for i, m in enumerate(marks)] or [np.zeros(0)]).astype(np.int64)
        self.seeds, inverse = np.unique(np.concatenate(marks or [np.zeros(0, np.int64)]), return_inverse=True)
        self.at = [inverse[own == i] for i in range(len(idents))]
        pairs = np.unique(np.stack([inverse, own], 1), axis=0) if len(own) else np.zeros((0, 2), np.int64)
        self.owner = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.seeds) + 1))

    def number(self, listed: list[str]) -> np.ndarray:
        find = self.vocabulary.get
        return np.array([find(w, -1) for w in listed], dtype=np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seed numbers) of the seeds in a document."""
        if not len(ids) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = []
        for size in self.sizes:
            marks = fingerprints(ids, size)
            if len(marks):
                place = np.minimum(np.searchsorted(self.seeds, marks), len(self.seeds) - 1)
                at = np.flatnonzero(self.seeds[place] == marks)
                found.append(np.stack([at, place[at]]))
        both = np.concatenate(found or [np.zeros((2, 0), np.int64)], axis=1)
        both = both[:, np.argsort(both[0], kind="stable")] if len(self.sizes) > 1 else both
        return both[0], both[1]

    def own_seeds(self, held: np.ndarray, many: float) -> list[np.ndarray]:
        """Per item, its seeds that are not shared wording, from the number of texts that hold each seed.

        Wording that many texts share stands out from the rest of an item. If the whole item is in many texts, all its
        seeds are as frequent, and it is a wide leak; so every item with seeds keeps own ones.
        """
        out = []
        for at in self.at:
            mine = np.unique(at)
            rest = np.quantile(held[at], REST) if len(at) else 0
            out.append(mine[held[mine] <= max(many, STANDS_OUT * rest)])
        return out

    def own_words(self, own: list[np.ndarray]) -> list[np.ndarray]:
        """Per item, which of its words lie in one of its own seeds."""
        out = []
        for ids, at, seeds in zip(self.ids, self.at, own):
            mine = np.zeros(len(ids), dtype=bool)
            for j in np.flatnonzero(np.isin(at, seeds)):
                mine[j : j + self.k] = True
            out.append(mine)
        return out

    def keep(self, own: list[np.ndarray]) -> None:
        """Restricts the index from seeds to items to own seeds."""
        pairs = np.array(sorted((s, i) for i, seeds in enumerate(own) for s in seeds.tolist()), dtype=np.int64).reshape(-1, 2)
        self.owner = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.seeds) + 1))


def _runs(doc: np.ndarray, item: np.ndarray, least: int):
    """Maximal common runs of at least ``least`` words as (length, document place, item place)."""
    marks = defaultdict(list)
    for j, m in enumerate(fingerprints(item, least).tolist()):
        marks[m].append(j)
    diagonals = defaultdict(list)
    for i, m in enumerate(fingerprints(doc, least).tolist()):
        if m >= 0:
            for j in marks.get(m, ()):
                if (doc[i : i + least] == item[j : j + least]).all():
                    diagonals[i - j].append(i)
    for shift, places in diagonals.items():
        start = before = places[0]
        for i in places[1:] + [None]:
            if i is not None and i == before + 1:
                before = i
                continue
            yield before - start + least, start, start - shift
            start = before = i


def tile(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest run of unmarked words is marked, again and again, down to ``least`` words."""
    heap = [(-n, i, j) for n, i, j in _runs(doc, item, least)]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = in_doc[i : i + n] | in_item[j : j + n]
        if not taken.any():
            in_doc[i : i + n] = True
            in_item[j : j + n] = True
            tiles.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= least:
                heapq.heappush(heap, (-(b - a), i + int(a), j + int(a)))
    return tiles


def _distinct_ahead(anchors: np.ndarray, seeds: np.ndarray, span: int) -> np.ndarray:
    """For every anchor, how many different seeds lie within ``span`` words from it on."""
    ends = np.searchsorted(anchors, anchors + span, side="right").tolist()
    numbers = np.unique(seeds, return_inverse=True)[1].tolist()
    held, out, different, to = [0] * len(numbers), [], 0, 0
    for start, end in enumerate(ends):
        while to < end:
            different += not held[numbers[to]]
            held[numbers[to]] += 1
            to += 1
        out.append(different)
        held[numbers[start]] -= 1
        different -= not held[numbers[start]]
    return np.array(out)


def coverage(doc: np.ndarray, item: np.ndarray, own: np.ndarray, anchors: np.ndarray, seeds: np.ndarray, least: int = 1) -> float:
    """Share of an item's own words that tiles cover within the best stretch of the document.

    ``anchors`` are places of the item's own ``seeds`` in the document, ascending. A stretch is two and a half times as long as the
    item; all that hold ``least`` different seeds are tiled, those with most first, but for those within one that
    was. Next to a tile, single words may differ, be missing or be added where at least two equal words follow.
    """
    if not own.any() or not len(anchors):
        return 0.0
    span = int(2.5 * len(item)) + 20
    ahead = _distinct_ahead(anchors, seeds, span)
    left = ahead >= least
    best = 0.0
    for k in np.argsort(-ahead, kind="stable"):
        if left[k] and best < 1:
            at = int(anchors[k])
            left &= np.abs(anchors - at) > len(item) // 2
            best = max(best, _covered(doc[max(0, at - len(item) // 2 - 10) : at + span + len(item) // 2], item, own))
    return best


def _covered(doc: np.ndarray, item: np.ndarray, own: np.ndarray) -> float:
    covered, used = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    tiles = tile(doc, item, min(SEED, len(item)))
    for i, j, n in tiles:
        covered[j : j + n] = True
        used[i : i + n] = True
    for i, j, n in tiles:
        for way, (a, b) in ((1, (i + n, j + n)), (-1, (i - 1, j - 1))):
            while True:
                for da, db in ((1, 1), (0, 1), (1, 0), (2, 2)):
                    x, y, run = a + way * da, b + way * db, 0
                    while 0 <= x + way * run < len(doc) and 0 <= y + way * run < len(item) and doc[x + way * run] == item[y + way * run] and not covered[y + way * run] and not used[x + way * run]:
                        run += 1
                    if run >= 2:
                        ks = way * np.arange(run)
                        covered[y + ks] = True
                        used[x + ks] = True
                        a, b = x + way * run, y + way * run
                        break
                else:
                    break
    return float((covered & own).sum() / own.sum())


def _passes(items: DataFrame, item_id: str, item_text: str) -> Iterator[Items]:
    """The items in groups of at most ITEM_WORDS words (one group for any usual test set), one at a time; rows with nulls are left out."""
    good = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = good.agg(F.coalesce(F.sum(F.length("t") / 4), F.lit(0))).first()[0]
    groups = max(1, int(-(-size // ITEM_WORDS)))
    for g in range(groups):
        part = good.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g).dropDuplicates().orderBy("i").toPandas()
        yield Items(part["i"].tolist(), part["t"].tolist())


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, cover: float = COVER, common: float = COMMON) -> DataFrame:
    """(doc id, item id, ``coverage``): documents that hold at least ``cover`` of an item's own words.

    Words are compared in lower case without accents, markup, digits and punctuation. An item's own words lie in
    seeds of three words that at most ``common`` of all distinct texts hold, or that no more texts hold than hold the
    rest of the item; what stands out from it is shared wording and not counted. Texts of equal words count once, so
    copies of a text that holds an item do not make it shared. An item of one or two words is found
    where exactly these stand together; one without words is never reported. A document is tiled with an item if it holds some of the
    item's own seeds; the tiles must lie close together, in any order, and single words may differ. Null and empty
    texts hold nothing; rows that repeat a document id count as one document each and give one row per item.

    The items are a stated set of bounded size per pass (ITEM_WORDS); they travel to the workers with the task, one pass at a time. The
    documents stay where they are: one pass finds the seeds in all texts and keeps places only; counts over
    all documents tell the shared wording; a second read tiles the few documents that are candidates.
    """
    out = None
    for group in _passes(items, item_id, item_text):
        found = _find(docs, doc_id, text, group, cover, common)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"d": doc_id, "i": item_id})


def _find(docs: DataFrame, doc_id: str, text: str, items: Items, cover: float, common: float) -> DataFrame:
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(items)
    texts = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))

    def scan(batches):
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["d"], pdf["t"]):
                listed = words(t)
                at, seeds = index.value.hits(index.value.number(listed))
                same = hashlib.blake2b(" ".join(listed).encode("utf-8", "ignore"), digest_size=16).digest()
                rows.append((d, same, np.unique(seeds).astype(np.int32)))
            yield pd.DataFrame(rows, columns=["d", "same", "seeds"])

    hits = cut(spread(texts).mapInPandas(scan, "d long, same binary, seeds array<int>"), "hits")
    many = max(COMMON_LEAST, hits.select("same").distinct().count() * common)
    # equal texts count once; they are folded before they travel
    different = hits.where(F.size("seeds") > 0).groupBy("same").agg(F.first("seeds").alias("seeds"))
    counts = different.select(F.explode("seeds").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    # one number per seed of the items of this pass, so bounded by ITEM_WORDS
    counted = counts.toPandas()
    held = np.zeros(len(items.seeds), dtype=np.int64)
    held[counted["s"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    own = items.own_seeds(held, many)
    needed = np.array([min(len(seeds), max(CANDIDATE_LEAST, int(np.ceil(CANDIDATE * len(seeds))))) if len(seeds) else 1 << 30 for seeds in own])
    told = spark.sparkContext.broadcast((own, items.own_words(own), needed))
    items.keep(own)
    shared = spark.sparkContext.broadcast(items)
    index.unpersist()

    def choose(batches):
        items, (_, _, needed) = shared.value, told.value
        for pdf in batches:
            rows = []
            for d, seeds in zip(pdf["d"], pdf["seeds"]):
                if len(seeds):
                    owners = np.concatenate([items.owner[items.starts[s] : items.starts[s + 1]] for s in seeds])
                    which, n = np.unique(owners, return_counts=True)
                    which = which[n >= needed[which]]
                    if len(which):
                        rows.append((d, which.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["d", "which"])

    candidates = cut(hits.mapInPandas(choose, "d long, which array<int>").groupBy("d").agg(F.array_distinct(F.flatten(F.collect_list("which"))).alias("which")), "candidates")

    def check(batches):
        items, (own, own_words, needed) = shared.value, told.value
        for pdf in batches:
            rows = []
            for d, t, which in zip(pdf["d"], pdf["t"], pdf["which"]):
                ids = items.number(words(t))
                at, seeds = items.hits(ids)
                for i in which:
                    mine = np.isin(seeds, own[i])
                    share = coverage(ids, items.ids[i], own_words[i], at[mine], seeds[mine], needed[i])
                    if share >= cover:
                        rows.append((d, items.idents[i], share))
            yield pd.DataFrame(rows, columns=["d", "i", "coverage"])

    tiled = texts.join(candidates, "d").mapInPandas(check, "d long, i long, coverage double")
    found = cut(tiled.groupBy("d", "i").agg(F.max("coverage").alias("coverage")), "leaks")
    # written, so a later pass does not keep the items of this one on the workers
    for sent in (told, shared):
        sent.unpersist()
    return found
