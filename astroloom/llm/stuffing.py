"""Keyword-stuffed and link-list pages by block-wise compression (problem 9)."""

from __future__ import annotations

import html
import re
import zlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astroloom.llm.text import TAG, repair, spread
from astroloom.tables import cut

#: Words of a block.
BLOCK = 100
#: Words without a sentence end, and words with one at their end only, from which a stretch is looked at on its own.
STRETCH = 24
LONG = 45
#: A block is redundant if its compression ratio is below this part of the usual one of its language, length and kind.
REDUNDANT = 0.85
#: Below this part no confirmation by the punctuation is asked for.
EXTREME = 0.82
#: Share of its words that the neighbouring sentences hold from which a sentence is gathered with others that repeat.
REPEATED = 0.85
#: Share of a text's words in stuffed blocks from which the text is reported.
SHARE = 0.5
#: The usual ratio of a class is drawn towards that of all languages as if so many blocks had the latter.
PRIOR_BLOCKS = 50

_LINK = re.compile(r"(?:https?:)?//[^\s<>()\"']+|www\.[^\s<>()\"']+|href=\"[^\"]*\"")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_CODE = re.compile(r"[A-Z]{1,4}-?0")
_STOP = re.compile(r"[.!?。！？；]")
_HAN = re.compile(r"[一-鿿]")
_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+|[^\w\s]|_")
_NUMBERED = re.compile(r"\W*(?:[^\W\d]+\s*)?\W{0,2}0\s*[.):\]、,]")
# How patent claims name other claims.
_CLAIM = ("claim", "anspruch", "ansprüch", "revendication", "权利要求")
# Frequent function words by language.
_FREQUENT = {
    "en": frozenset("the of and a an to in is that by for with as on this each every at from or".split()),
    "de": frozenset("der die das und von mit ist ein eine einer zu den dem des nach bei aus für auf im wird".split()),
    "fr": frozenset("le la les de des du et un une est dans pour par ce cette notre chaque tout sur avec".split()),
}


def chinese(text: str) -> bool:
    return not text.isascii() and len(_HAN.findall(text)) * 5 > len(text)


def language(text: str) -> str:
    """The language of a lower-case text with most function words, else 'xx'; recorded languages may be wrong. Chinese is told by its script."""
    found = text.split()
    score = {k: sum(map(v.__contains__, found)) for k, v in _FREQUENT.items()}
    best = max(score, key=lambda k: (score[k], k))
    return best if score[best] * 10 >= len(found) > 0 else "xx"


def size_in_words(text: str) -> int:
    """Words by blanks; every two Chinese characters count as a word."""
    if not text.isascii() and _HAN.search(text):
        return len(_HAN.findall(text)) // 2 + len(_HAN.sub(" ", text).split())
    return len(text.split())


def packed_size(tokens: list[str]) -> int:
    """Compressed bytes of a block.

    The compressor writes each different word once and the block as the words' numbers, 0 for one that is new, and deflates
    both; so words that are repeated in any order cost little even in a short block.
    """
    seen: dict[str, int] = {}
    codes = [0 if (k := seen.setdefault(w, n := len(seen))) == n else k + 1 for w in tokens]
    numbers = bytes(codes) if len(seen) < 256 else array("H" if len(seen) < 65535 else "L", codes).tobytes()
    press = zlib.compressobj(6, zlib.DEFLATED, -12, 5)
    return len(press.compress(" ".join(seen).encode("utf-8", "ignore") + numbers)) + len(press.flush())


def sentence_ends(text: str) -> list[int]:
    """Places behind sentence ends: a Chinese one anywhere, others behind a word (and a closing mark) and before a blank."""
    out, last = [], len(text) - 1
    for m in _STOP.finditer(text):
        at = m.start()
        if text[at] in "。！？；":
            out.append(at + 1)
        elif at and (at == last or text[at + 1].isspace()):
            before = text[at - 2] if at > 1 and text[at - 1] in ")]%\"'" else text[at - 1]
            if before.isalnum():
                out.append(at + 1)
    return out


def plain(text: str) -> str:
    """Text with links as one mark, without tags, entities and mojibake."""
    if "//" in text or "www." in text or "href=" in text:
        text = _LINK.sub(" uuu ", text)
    if "<" in text:
        text = TAG.sub(lambda m: " uuu " if "uuu" in m[0] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    return repair(text)


def blocks(text: str) -> list[tuple[str, bool, int, int, int, int]]:
    """(language, claims, words, sentence ends, bytes, compressed bytes) of blocks that make up the whole text.

    A stretch without a sentence end forms blocks of its own once it is longer than any usual sentence. Sentences are
    gathered to blocks of about BLOCK words in three streams: claims (numbered, or naming another claim), sentences whose
    words recur in their neighbours, and all others; so a block is of one kind and the streams only sort, the
    compression decides. A Chinese block is told by its own characters, the language of the others from the whole
    text, so the parts of a mixed text count each in its own way.
    """
    text = _CODE.sub("0", _NUMBER.sub("0", plain(text))).lower()
    lang = language(text)
    out: list = []
    short: list = []

    def add(content: str, tokens: list[str], claims: bool, n: int, ends: int) -> None:
        if n:
            out.append(("zh" if chinese(content) else lang, claims, n, ends, len(content.encode("utf-8", "ignore")), packed_size(tokens)))

    at = 0
    for to in [*sentence_ends(text), len(text)]:
        piece, closed = text[at:to], to < len(text)
        at = to
        n = size_in_words(piece)
        claims = any(c in piece for c in _CLAIM) or _NUMBERED.match(piece) is not None
        if n >= STRETCH and (not closed or n >= LONG):
            step = -(-len(piece) // max(1, round(n / BLOCK)))
            for i in range(0, len(piece), step):
                part = piece[i : i + step]
                add(part, _TOKEN.findall(part), claims, size_in_words(part), int(closed and i + step >= len(piece)))
        elif n:
            tokens = _TOKEN.findall(piece)
            if n < 4 and not any(map(str.isalpha, tokens)):
                n = 0  # numbers only
            short.append((piece, tokens, n, int(closed), claims, set(tokens)))
    streams: dict[str, list] = {}
    for i, (piece, tokens, n, ends, claims, own) in enumerate(short):
        near = set().union(*[x[5] for x in short[max(0, i - 2) : i]], *[x[5] for x in short[i + 1 : i + 3]])
        key = "claims" if claims else "repeated" if len(own & near) >= REPEATED * len(own) else "others"
        stream = streams.setdefault(key, [[], [], 0, 0])
        stream[0].append(piece)
        stream[1] += tokens
        stream[2] += n
        stream[3] += ends
        if stream[2] >= BLOCK:
            add("".join(stream[0]), stream[1], claims, *stream[2:])
            del streams[key]
    for key, (pieces, tokens, n, ends) in streams.items():
        add("".join(pieces), tokens, key == "claims", n, ends)
    return out


def find_stuffed(docs: DataFrame, doc_id: str, text: str, redundant: float = REDUNDANT, extreme: float = EXTREME, share: float = SHARE) -> DataFrame:
    """(doc id, ``share``): texts of which more than ``share`` of the words lie in stuffed blocks.

    The text is cut into blocks; a block's compression ratio, with numbers, codes and links as one mark each, is
    divided by the median ratio of all prose blocks of the corpus of the same language, length class and kind
    (claims repeat each other by nature and have a median of their own). A block is stuffed if it is redundant by
    that measure, below ``redundant`` of the usual ratio, and its punctuation confirms it: it has less than one sentence end
    in as many words as a long sentence has. Below ``extreme`` of the usual ratio that confirmation is not asked for but in
    claims, since full stops may stand between keywords for show. Null texts and null ids are left out, empty texts have no
    blocks; rows that repeat an id are judged together as one text. Blocks, not texts, are kept between the two passes.
    """

    def cut_up(batches):
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["d"], pdf["t"]):
                found = blocks(t)
                if found:
                    rows.append((d, *map(list, zip(*found))))
            yield pd.DataFrame(rows, columns=["d", "lang", "claims", "n", "ends", "size", "packed"])

    texts = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    found = cut(spread(texts).mapInPandas(cut_up, "d long, lang array<string>, claims array<boolean>, n array<int>, ends array<int>, size array<int>, packed array<int>"), "blocks")
    rows = found.select("d", F.explode(F.arrays_zip("lang", "claims", "n", "ends", "size", "packed")).alias("b")).select("d", "b.*").where("size > 0")
    rows = rows.withColumns({"ratio": F.col("packed") / F.col("size"), "length": F.least(F.lit(12.0), F.floor(F.log2("size") * 2) / 2)})
    prose = rows.where(F.col("n") < F.col("ends") * LONG)
    median = F.percentile_approx("ratio", 0.5, 1000)
    # one row per language, kind and length class: a few dozen
    usual = prose.groupBy("lang", "claims", "length").agg(median.alias("own"), F.count(F.lit(1)).alias("many"))
    overall = prose.groupBy("claims", "length").agg(median.alias("overall"))
    rows = rows.join(F.broadcast(usual), ["lang", "claims", "length"], "left").join(F.broadcast(overall), ["claims", "length"], "left")
    many, whole = F.coalesce("many", F.lit(0)), F.coalesce("overall", F.lit(0.5))
    relative = F.col("ratio") * (many + PRIOR_BLOCKS) / (F.coalesce("own", F.lit(0.0)) * many + whole * PRIOR_BLOCKS)
    bare = (F.col("ends") * LONG < F.col("n")) & (F.col("n") >= STRETCH // 2)
    stuffed = F.when(bare, relative < redundant).otherwise(~F.col("claims") & (relative < extreme))
    totals = rows.groupBy("d").agg((F.sum(F.when(stuffed, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    return totals.where(F.col("share") > share).select(F.col("d").alias(doc_id), "share")
