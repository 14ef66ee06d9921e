"""Normalised words of damaged, marked-up, multilingual text."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import DataFrame

# Letters of other alphabets that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһԛԝвкмнтαοειυνρτκ", "aeopcyxijsdhqwbkmhtaoeiuvptk")
TAG = re.compile(r"</?[^\W\d][^<>]*>|<[!?][^<>]*>")
_BREAK = re.compile(r"(?<=[^\W\d_])[-­‐‑]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[a-z]+|[^\W\d_a-z]")
_DAMAGE = re.compile("[ÃÂâãäåæçèéêëìíîïð][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")


def repair(text: str) -> str:
    """Undoes UTF-8 that was read as a one-byte code page; other text comes back as it is."""
    if text.isascii() or not _DAMAGE.search(text):
        return text

    def fix(found: re.Match) -> str:
        raw = bytearray()
        for c in found[0]:
            try:
                raw += c.encode("cp1252")
            except UnicodeEncodeError:
                if ord(c) > 255:
                    return found[0]
                raw.append(ord(c))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            fixed = raw.decode("utf-8", "ignore")
            return fixed or found[0]

    return re.sub("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™�]{2,}", lambda m: fix(m) if _DAMAGE.search(m[0]) else m[0], text)


def fold(text: str) -> str:
    """Lower case without markup, accents, soft hyphens and line-break hyphenation."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = repair(text)
        text = _BREAK.sub("", text).replace("­", "").replace("​", "")
        text = unicodedata.normalize("NFKD", text.casefold())
        text = re.sub("[̀-ͯ]", "", text).translate(_LOOKALIKE)
    else:
        if "-\n" in text:
            text = _BREAK.sub("", text)
        text = text.lower()
    return text


def words(text: str) -> list[str]:
    """Words of letters; every letter outside the Latin alphabet counts as a word. Digits are left out."""
    return _WORD.findall(fold(text))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer input splits than there are; large inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
