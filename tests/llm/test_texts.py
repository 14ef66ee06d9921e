import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from astroloom.llm import leakage, packing, stuffing
from astroloom.llm.text import repair, words


def test_words_of_damaged_text():
    assert words("Führt — füh-\nrt <b>NOT</b> fü­hrt &amp; 37 cm²") == ["fuhrt", "fuhrt", "not", "fuhrt", "cm"]
    assert words("mоdеl") == ["model"]  # lookalike letters
    assert words("弹簧 a1") == ["弹", "簧", "a"]
    broken = "führt über".encode().decode("cp1252")
    assert repair(broken) == "führt über" and repair("naïve à la") == "naïve à la"
    assert words("") == []


# packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 500)), max_size=120), st.integers(1, 4), st.dictionaries(st.sampled_from("abc"), st.floats(-2000, 2000), max_size=3))
def test_shards_hold_every_token_once(docs, window, deficits):
    rows = [(i, s, n) for i, (s, n) in enumerate(docs)]
    boxes = packing.pack_shard(rows, {"a": 0.5, "b": 0.3, "c": 0.2}, deficits, capacity=100, window=window)
    seen = {}
    for _, _, box in boxes:
        assert 0 < sum(p[2] for p in box) <= 100
        for doc, start, n in box:
            seen.setdefault(doc, []).append((start, n))
    assert set(seen) == {r[0] for r in rows}
    for doc, _, n in rows:
        pieces = sorted(seen[doc])
        assert sum(p[1] for p in pieces) == n and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and pieces[0][0] == 0
        assert len(pieces) == 1 if n <= 100 else all(p[1] == 100 for p in pieces[:-1])


def test_mixture_is_kept_and_little_space_is_left():
    rng = random.Random(4)
    docs = [(i, rng.choice("aaab"), rng.randrange(20, 900)) for i in range(3000)]
    share = {s: sum(n for _, t, n in docs if t == s) for s in "ab"}
    total = sum(share.values())
    boxes = [b for _, _, b in packing.pack_shard(docs, {s: v / total for s, v in share.items()}, {}, 2048, 16)]
    assert sum(p[2] for b in boxes for p in b) / (2048 * len(boxes)) > 0.98
    kind = {i: s for i, s, _ in docs}
    for at in range(0, len(boxes) - 32, 32):
        part = [p for b in boxes[at : at + 32] for p in b]
        b = sum(p[2] for p in part if kind[p[0]] == "b") / sum(p[2] for p in part)
        assert abs(b - share["b"] / total) < 0.05


@pytest.mark.parametrize("longest", [900, 60_000])
def test_every_window_holds_the_given_mix(longest):
    rng = random.Random(6)
    docs = [(i, rng.choice("aaab"), rng.randrange(20, longest)) for i in range(3000 if longest < 2048 else 600)]
    target = {"a": 0.5, "b": 0.5}
    kind = {i: s for i, s, _ in docs}
    windows: dict = {}
    for window, live, box in packing.pack_shard(docs, target, {"a": 20_000.0, "b": -20_000.0}):
        if live == 2:
            sums = windows.setdefault(window, dict.fromkeys("ab", 0))
            for doc, _, n in box:
                sums[kind[doc]] += n
    assert len(windows) >= 3
    for sums in windows.values():
        assert abs(sums["a"] / sum(sums.values()) - 0.5) < packing.TOLERANCE


def test_pack_table(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "x", "x", None, "y"]), rng.choice([0, 1, 30, 700, 2048, 2049, 5000])) for i in range(600)] + [(None, "x", 50), (700, "x", None), (1, "x", 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").repartition(3)
    for targets in (None, {"y": 0.9, "x": 0.1}):
        boxes = packing.pack(df, "doc_id", "source", "n", targets, shard_tokens=200_000).collect()
        tokens = sum(r[2] for r in rows if r[0] is not None and r[2])
        assert sum(b["n_tokens"] for b in boxes) == tokens and all(b["n_tokens"] == sum(b["lengths"]) <= 2048 for b in boxes)
        assert len({b["container_id"] for b in boxes}) == len(boxes)
        got = {}
        for b in boxes:
            for d, n in zip(b["doc_ids"], b["lengths"]):
                got[d] = got.get(d, 0) + n
        assert got[1] == sum(r[2] for r in rows if r[0] == 1) and 700 not in got and None not in got
    assert packing.pack(df.limit(0), "doc_id", "source", "n").count() == 0


def test_token_counts(spark):
    texts = [None, "", "A plain text.", "Unglücklich 弹簧 <|endoftext|>", "x" * 50000]
    df = packing.count_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text")
    got = [r["n_tokens"] for r in df.orderBy("i").collect()]
    assert got[:2] == [0, 0]
    encoder = packing.tokenizer()
    for text, n in list(zip(texts, got))[2:]:
        ids = encoder.encode_ordinary(text)
        assert len(ids) == n and encoder.decode(ids) == text


# leaked passages


def naive_tiles(doc, item, least):
    in_doc, in_item, out = set(), set(), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in in_doc and j + n not in in_item:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        in_doc |= set(range(best[0], best[0] + best[2]))
        in_item |= set(range(best[1], best[1] + best[2]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=25))
def test_tiling_equals_brute_force(doc, item):
    got = leakage.tile(np.array(doc, dtype=np.int64), np.array(item, dtype=np.int64), 3)
    want = naive_tiles(doc, item, 3)
    assert sorted(t[2] for t in got) == sorted(t[2] for t in want)
    for i, j, n in got:
        assert doc[i : i + n] == item[j : j + n]


LEXICON = [a + b for a in "ba de fi go hu ki lo mu na pe".split() for b in "rin sol tak vem wix zor bel cur".split()]


def make(rng, n):
    return [rng.choice(LEXICON) for _ in range(n)]


def sentence(ws, size=9):
    return " ".join(" ".join(ws[i : i + size]).capitalize() + "." for i in range(0, len(ws), size))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    shared = make(rng, 24)
    items = {100 + i: make(rng, 45) for i in range(6)}
    items[200] = shared + make(rng, 40)
    docs, want = {}, set()
    for d in range(80):
        docs[d] = sentence(make(rng, 200) + (shared if d % 2 else []) + make(rng, 100))
    docs[1000] = sentence(make(rng, 80)) + " " + sentence(items[100]).upper().replace(" ", "\n", 3) + " " + sentence(make(rng, 50))
    want.add((1000, 100))
    half = items[101]
    docs[1001] = sentence(make(rng, 60) + half[20:45] + make(rng, 15) + half[0:10] + make(rng, 60))  # reordered pieces
    want.add((1001, 101))
    changed = [w if i % 7 else "xyzzy" for i, w in enumerate(items[102])]
    docs[1002] = "<p>" + sentence(make(rng, 40) + changed + make(rng, 40)).replace("e", "е", 20) + "</p>"
    want.add((1002, 102))
    docs[1003] = sentence(make(rng, 100) + items[103][:8] + make(rng, 100))  # less than a quarter
    docs[1004] = sentence(make(rng, 100) + items[200])
    want.add((1004, 200))
    far = make(rng, 400)
    docs[1005] = sentence(items[104][:12] + far + items[104][12:24] + far + items[104][24:36])  # far apart
    docs[1006] = sentence(items[105]) + " " + sentence(items[100])
    want |= {(1006, 105), (1006, 100)}
    rows = [(d, t, "c") for d, t in docs.items()] + [(1000, docs[1000], "c"), (2000, None, "c"), (2001, "", "c"), (None, docs[1000], "c"), (2002, sentence(make(rng, 60000)), "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, which string").repartition(4)
    held = spark.createDataFrame([(i, sentence(w), "c") for i, w in items.items()] + [(300, None, "c"), (301, "", "c"), (302, "qqq www", "c"), (None, "a b c d", "c")], "item_id long, text string, t string")
    return table, held, want


def test_leaks(corpus):
    docs, items, want = corpus
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text", common=0.2).collect()}
    assert got == want


def test_leaks_in_passes(corpus, monkeypatch):
    docs, items, want = corpus
    monkeypatch.setattr(leakage, "ITEM_WORDS", 200)
    found = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text", common=0.2)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_leaks_of_nothing(corpus):
    docs, items, _ = corpus
    assert leakage.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leakage.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_passage_behind_a_dense_term(spark):
    rng = random.Random(23)
    held = make(rng, 60)
    term = held[:5]
    dense = [w for _ in range(40) for w in term + make(rng, 5)]
    rows = [(1, sentence(dense + make(rng, 400) + held[20:54] + make(rng, 100))), (2, sentence(make(rng, 100) + dense)), (3, sentence(make(rng, 300)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, sentence(held))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(table, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 7)}


def test_distinct_seeds_ahead():
    rng = np.random.default_rng(3)
    anchors = np.unique(rng.integers(0, 300, 120))
    seeds = rng.integers(0, 12, len(anchors))
    want = [len({s for a, s in zip(anchors, seeds) if at <= a <= at + 25}) for at in anchors]
    assert leakage._distinct_ahead(anchors, seeds, 25).tolist() == want


def test_wide_leaks_are_no_shared_wording(spark):
    rng = random.Random(17)
    shared = make(rng, 20)
    wide, copied, plain = shared + make(rng, 40), make(rng, 45), make(rng, 45)
    docs = {d: make(rng, 120) + (shared if d % 2 else []) + make(rng, 60) for d in range(300)}
    want = set()
    for d in range(300, 340):  # one item in many different texts
        docs[d] = make(rng, 80) + wide + make(rng, 40)
        want.add((d, 1))
    rows = [(d, sentence(w)) for d, w in docs.items()]
    text = sentence(make(rng, 80) + copied + make(rng, 40))
    rows += [(d, text if d % 2 else text.upper()) for d in range(400, 600)]  # a third of the rows are copies
    want |= {(d, 2) for d in range(400, 600)}
    rows += [(700, sentence(make(rng, 90) + copied)), (701, sentence(make(rng, 90) + plain))]
    want |= {(700, 2), (701, 3)}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, sentence(wide)), (2, sentence(copied)), (3, sentence(plain))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(table, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == want


@pytest.mark.parametrize("copies", [1, 10, 11, 100, 600])
def test_any_number_of_copies(spark, copies):
    rng = random.Random(31)
    held = make(rng, 45)
    rows = [(d, sentence(make(rng, 150))) for d in range(200)] + [(1000 + d, sentence(make(rng, 60) + held + make(rng, 30))) for d in range(copies)]
    items = spark.createDataFrame([(1, sentence(held))], "item_id long, text string")
    got = leakage.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text", items, "item_id", "text").collect()
    assert {r["doc_id"] for r in got} == {1000 + d for d in range(copies)} and len(got) == copies


def test_items_of_few_words(spark):
    held = {1: "alpha", 2: "beta gamma", 3: "delta epsilon zeta", 4: "eta theta iota kappa", 5: "", 6: "12"}
    rows = [(1, "An Alpha here."), (2, "Beta, gamma and delta."), (3, "gamma beta; delta epsilon zeta"), (4, "so eta theta iota kappa goes"), (5, "delta epsilon"), (6, "12 none")]
    items = spark.createDataFrame(list(held.items()), "item_id long, text string")
    got = leakage.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", items, "item_id", "text").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4)}


# stuffed pages


def test_stuffed_pages(spark):
    rng = random.Random(13)

    def prose(n):
        parts = []
        while n > 0:
            k = rng.randrange(8, 18)
            parts.append("The " + " ".join(make(rng, k - 5)) + " of the " + " and ".join(make(rng, 2)) + ".")
            n -= k
        return " ".join(parts)

    nouns = make(rng, 6)
    tags = " ".join(f"#{rng.choice(nouns)}" for _ in range(150))
    links = "\n".join(f'<a href="http://{rng.choice(LEXICON)}.test/{rng.randrange(9999)}">buy {rng.choice(nouns)}</a>' for _ in range(60))
    prices = "\n".join(f"{rng.choice(nouns)} XR-{rng.randrange(9999)} EUR {rng.randrange(900)}.{rng.randrange(100):02d} sale" for _ in range(60))
    chat = " ".join(f"Our {w} is the best {w} for every {w} user." for w in (rng.choice(nouns) for _ in range(30)))
    table = "\n".join(f"Table {i} | {rng.choice(LEXICON)} | {rng.random():.3f}" for i in range(12))
    docs = {i: prose(rng.randrange(60, 500)) for i in range(60)}
    spam = {100: tags, 101: links, 102: prices, 103: prose(30) + "\n" + tags, 104: chat + " " + tags}
    spam[105] = chat  # keywords in sentences with full stops
    claims = " ".join(f"{i}. The {nouns[0]} {nouns[1]} of claim {rng.randrange(1, i)}, wherein the {rng.choice(LEXICON)} has a width of {i} mm." for i in range(2, 40))
    docs |= spam | {200: prose(400) + "\n" + tags[:300], 201: prose(300) + "\n" + table, 202: prose(60) + "\n" + claims}
    docs |= {210 + k: prose(200) + "\n" + claims.replace(nouns[0], LEXICON[k]) for k in range(12)}
    rows = [(d, t, "z") for d, t in docs.items()] + [(300, None, "z"), (301, "", "z"), (302, "   ", "z"), (None, tags, "z"), (303, "word " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"] for r in stuffing.find_stuffed(df, "doc_id", "text").collect()}
    assert got == set(spam) | {303}
    assert stuffing.find_stuffed(df.limit(0), "doc_id", "text").count() == 0


def test_blocks_cover_the_text():
    text = "One short sentence here. " * 40 + "tag " * 300
    found = stuffing.blocks(text)
    assert 0 <= sum(b[2] for b in found) - len(text.split()) < len(found) and stuffing.blocks("") == []  # a word on a cut counts twice


def test_redundancy_decides(spark):
    """Without sentence ends a text of ever new words is no spam, and without redundancy nothing is."""
    rng = random.Random(29)
    prose = [" ".join(f"The {' '.join(make(rng, 9))} of the {rng.choice(LEXICON)}." for _ in range(20)) for _ in range(40)]
    fresh = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300))
    rows = [*enumerate(prose), (100, fresh), (101, "nozzle valve pump " * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in stuffing.find_stuffed(df, "doc_id", "text").collect()} == {101}
    assert stuffing.find_stuffed(df, "doc_id", "text", redundant=0.0, extreme=0.0).count() == 0


def test_parts_of_mixed_texts_count_in_their_own_way(spark):
    rng = random.Random(19)
    latin = "".join(f"The {' '.join(make(rng, 9))} of the {rng.choice(LEXICON)} is in a {rng.choice(LEXICON)}.\n" for _ in range(32))
    assert len(latin) > 2000
    han = "".join(rng.choice("弹簧轴承齿轮阀门泵管线板孔座盖") for _ in range(40))
    listed = (han[:6] + "，" + han[6:11] + "，") * 500
    found = stuffing.blocks(latin + listed)
    assert {b[0] for b in found} == {"en", "zh"}
    assert sum(b[2] for b in found if b[0] == "zh") >= 0.4 * len(listed)
    behind = stuffing.blocks("弹簧轴承" * 600 + "。" + latin * 4)
    assert {"en", "zh"} == {b[0] for b in behind}
    rows = [(i, "".join(f"The {' '.join(make(rng, 9))} of the {rng.choice(LEXICON)}. " for _ in range(30))) for i in range(60)] + [(100, latin + listed), (101, latin)]
    got = stuffing.find_stuffed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["doc_id"] for r in got} == {100}
