"""Unit texts: segmentation by dynamic programming over tries of prefixes, roots and exponents.

A unit text is cut at white space, brackets and operators into words and marks. Every word is segmented by a
dynamic program that walks three tries (prefixes, roots, exponents) from each reachable position; each complete
walk adds a piece with a cost. A word may thus have several readings ("cm" is a centimetre or a comoving metre,
"pc" a parsec or, with the prefix alone, nothing). Readings of all words are combined by a second dynamic program
whose state is the product so far (dimensions, powers of a and h); of the complete states the one with the least
cost plus the field's dimension penalty wins. The penalty is the prior: it favours the dimension of the quantity
the text belongs to. A text whose best state has another dimension gives no usable unit.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

# Constants in cgs.
MSUN = 1.98841e33
KPC = 3.08567758e21
YEAR = 3.15576e7
KEV_KELVIN = 1.160452e7
EV_ERG = 1.602176634e-12

# Dimension (length, mass, time, temperature) of every quantity.
DIMENSIONS = {
    "pos": (1, 0, 0, 0),
    "smoothing_length": (1, 0, 0, 0),
    "vel": (1, 0, -1, 0),
    "mass": (0, 1, 0, 0),
    "bhmass": (0, 1, 0, 0),
    "potential": (2, 0, -2, 0),
    "internal_energy": (2, 0, -2, 0),
    "rho": (-3, 1, 0, 0),
    "sfr": (0, 1, -1, 0),
    "bhmdot": (0, 1, -1, 0),
    "temperature": (0, 0, 0, 1),
}

# Prefixes (factor, cost). The frame prefixes stand before all others.
PREFIXES = {
    "n": (1e-9, 1.0), "u": (1e-6, 1.0), "µ": (1e-6, 1.0), "m": (1e-3, 1.0), "c": (1e-2, 0.8), "d": (1e-1, 1.5),
    "h": (1e2, 2.0), "k": (1e3, 0.8), "M": (1e6, 0.8), "G": (1e9, 0.8), "T": (1e12, 1.0),
    "kilo": (1e3, 0.8), "mega": (1e6, 0.8), "giga": (1e9, 0.8), "centi": (1e-2, 0.8), "milli": (1e-3, 0.8),
}
FRAMES = {"c": "comoving", "p": "proper"}

# Roots (cgs factor, dimension, may take a prefix, cost).
_L, _M, _T, _K, _E = (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (2, 1, -2, 0)
ROOTS = {
    "m": (1e2, _L, True, 1.0), "meter": (1e2, _L, True, 0.5), "meters": (1e2, _L, True, 0.5), "metre": (1e2, _L, True, 0.5), "metres": (1e2, _L, True, 0.5),
    "pc": (KPC / 1e3, _L, True, 0.6), "parsec": (KPC / 1e3, _L, True, 0.3), "parsecs": (KPC / 1e3, _L, True, 0.3),
    "AU": (1.495978707e13, _L, False, 0.5), "ly": (2.99792458e10 * YEAR, _L, True, 0.6), "lightyear": (2.99792458e10 * YEAR, _L, True, 0.4), "lightyears": (2.99792458e10 * YEAR, _L, True, 0.4),
    "Å": (1e-8, _L, False, 0.5), "angstrom": (1e-8, _L, False, 0.4), "Angstrom": (1e-8, _L, False, 0.4),
    "g": (1.0, _M, True, 1.0), "gram": (1.0, _M, True, 0.5), "grams": (1.0, _M, True, 0.5),
    "Msun": (MSUN, _M, False, 0.1), "M_sun": (MSUN, _M, False, 0.1), "Msol": (MSUN, _M, False, 0.1), "M_solar": (MSUN, _M, False, 0.1), "Msolar": (MSUN, _M, False, 0.1),
    "M⊙": (MSUN, _M, False, 0.1), "M_⊙": (MSUN, _M, False, 0.1), "M☉": (MSUN, _M, False, 0.1), "solar_mass": (MSUN, _M, False, 0.1), "solar_masses": (MSUN, _M, False, 0.1),
    "s": (1.0, _T, True, 1.0), "sec": (1.0, _T, True, 0.5), "second": (1.0, _T, True, 0.4), "seconds": (1.0, _T, True, 0.4),
    "lb": (453.59237, _M, False, 1.0), "lbs": (453.59237, _M, False, 1.0), "tonne": (1e6, _M, True, 0.5), "tonnes": (1e6, _M, True, 0.5), "t": (1e6, _M, True, 1.5),
    "hr": (3600.0, _T, False, 0.8), "hour": (3600.0, _T, False, 0.5), "hours": (3600.0, _T, False, 0.5), "day": (86400.0, _T, False, 0.5), "days": (86400.0, _T, False, 0.5),
    "yr": (YEAR, _T, True, 0.4), "year": (YEAR, _T, True, 0.3), "years": (YEAR, _T, True, 0.3),
    "K": (1.0, _K, True, 0.5), "kelvin": (1.0, _K, True, 0.3), "Kelvin": (1.0, _K, True, 0.3), "degK": (1.0, _K, False, 0.3),
    "erg": (1.0, _E, True, 0.5), "ergs": (1.0, _E, True, 0.5), "J": (1e7, _E, True, 0.5), "joule": (1e7, _E, True, 0.4), "joules": (1e7, _E, True, 0.4),
    "eV": (EV_ERG, _E, True, 0.4), "N": (1e5, (1, 1, -2, 0), True, 1.0),
    "k_B_T": (1.0, (0, 0, 0, 0), False, 0.2), "kB_T": (1.0, (0, 0, 0, 0), False, 0.2), "k_BT": (1.0, (0, 0, 0, 0), False, 0.2), "kBT": (1.0, (0, 0, 0, 0), False, 0.2),
}
#: Powers of the scale factor and of the Hubble parameter stand as roots of no dimension.
SCALES = {"a": (1, 0), "h": (0, 1)}
EXPONENTS = [*(str(n) for n in range(1, 7)), *(f"-{n}" for n in range(1, 7)), "²", "³", "⁻¹", "⁻²", "⁻³"]
#: Cheapest readings of a word or product that are kept for each dimension; the prior depends on the dimension only.
READINGS = 16
_RAISED = {"²": "2", "³": "3", "⁻¹": "-1", "⁻²": "-2", "⁻³": "-3"}
MISMATCH = 50.0


def trie(words) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = word
    return root


def _walk(node: dict, text: str, start: int):
    """(end, word) of every entry of the trie that begins at ``start``."""
    at = start
    while True:
        if "" in node:
            yield at, node[""]
        if at == len(text) or text[at] not in node:
            return
        node = node[text[at]]
        at += 1


_PREFIX, _ROOT, _SCALE, _FRAME, _EXPONENT = trie(PREFIXES), trie(ROOTS), trie(SCALES), trie(FRAMES), trie(EXPONENTS)


@dataclass(frozen=True)
class Reading:
    """A product of units: cgs factor (as log10), dimension, powers of a and h, frame, cost."""

    log: float = 0.0
    dim: tuple = (0, 0, 0, 0)
    a: float = 0.0
    h: float = 0.0
    frame: str = ""
    cost: float = 0.0

    def power(self, p: float) -> Reading:
        return Reading(self.log * p, tuple(x * p for x in self.dim), self.a * p, self.h * p, self.frame, self.cost)

    def times(self, o: Reading) -> Reading:
        return Reading(self.log + o.log, tuple(x + y for x, y in zip(self.dim, o.dim)), self.a + o.a, self.h + o.h, self.frame or o.frame, self.cost + o.cost)


def _least(readings) -> list[Reading]:
    best: dict = {}
    for r in readings:
        key = (r.dim, r.a, r.h, r.frame, round(r.log, 6))
        if key not in best or r.cost < best[key].cost:
            best[key] = r
    kept: dict = {}
    for r in sorted(best.values(), key=lambda r: r.cost):
        own = kept.setdefault(r.dim, [])
        if len(own) < READINGS:
            own.append(r)
    return [r for own in kept.values() for r in own]


def _pieces(word: str, start: int):
    """(end, reading) of every [frame][prefix]root[exponent] or scale[exponent] that begins at ``start``."""
    fronts = [(start, 1.0, "", 0.0)]
    for end, key in _walk(_FRAME, word, start):
        if end > start:
            fronts.append((end, 1.0, FRAMES[key], 0.5))
    for at, _, frame, cost in list(fronts):
        for end, key in _walk(_PREFIX, word, at):
            if end > at:
                fronts.append((end, PREFIXES[key][0], frame, cost + PREFIXES[key][1]))
    ends = []
    for at, factor, frame, cost in fronts:
        for end, key in _walk(_ROOT, word, at):
            cgs, dim, prefixed, own = ROOTS[key]
            if factor != 1.0 and not prefixed or frame and not dim[0]:
                continue
            if frame and "pc" not in key and "parsec" not in key:
                cost += 3.0  # "cm" is rather a centimetre than a comoving metre
            ends.append((end, Reading(math.log10(cgs * factor), dim, 0.0, 0.0, frame, cost + own)))
    for end, key in _walk(_SCALE, word, start):
        ends.append((end, Reading(0.0, (0, 0, 0, 0), *map(float, SCALES[key]), "", 0.7)))
    for end, reading in ends:
        yield end, reading
        for last, key in _walk(_EXPONENT, word, end):
            if last > end:
                yield last, reading.power(float(_RAISED.get(key, key)))


@lru_cache(maxsize=4096)
def segment(word: str) -> tuple[Reading, ...]:
    """All cheap readings of a word without blanks; empty if no segmentation covers it."""
    at: list[list[Reading]] = [[] for _ in range(len(word) + 1)]
    at[0] = [Reading()]
    for i in range(len(word)):
        if at[i]:
            here = _least(at[i])
            for end, piece in _pieces(word, i):
                joined = 2.0 if i else 0.0  # words written together are less likely
                at[end] += [r.times(Reading(piece.log, piece.dim, piece.a, piece.h, piece.frame, piece.cost + joined)) for r in here]
    return tuple(_least(at[-1]))


_WORDS = {
    "comoving": "comoving", "co-moving": "comoving", "cmv": "comoving",
    "proper": "proper", "physical": "proper", "phys": "proper",
}
_TOKEN = re.compile(r"[\s,;]*(?:(?P<num>\d+(?:\.\d+)?(?:[eEdD][+-]?\d+)?(?![A-Za-z_]))|(?P<pow>\*\*|\^)|(?P<op>[*/·×⋅()\[\]])|(?P<word>[^\W\d]+[^\s*/·×⋅()\[\]^,;]*))")
_SIGNED = re.compile(r"\s*\(?\s*([+-]?\d+(?:\.\d+)?(?:/\d+)?)\s*\)?")


class _Bad(ValueError):
    pass


class _Parser:
    """Products, quotients, brackets and powers over segmented words; every method returns candidate readings."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self):
        m = _TOKEN.match(self.text, self.at)
        if not m and self.text[self.at :].strip(" ,;."):
            raise _Bad(self.text)
        return m

    def product(self, closing: str = "") -> list[Reading]:
        out, invert = [Reading()], False
        while m := self.peek():
            kind = m.lastgroup
            token = m.group(kind)
            if kind == "op" and token in ")]":
                if token != closing:
                    raise _Bad(self.text)
                break
            if kind == "op" and token in "/*·×⋅" or kind == "word" and token in ("per", "x", "times"):
                self.at, invert = m.end(), token in ("/", "per")
                continue
            factor = self.power()
            out = _least(o.times(f.power(-1.0) if invert else f) for o in out for f in factor)
            invert = False
        return out

    def power(self) -> list[Reading]:
        base = self.atom()
        m = _TOKEN.match(self.text, self.at)
        if m and m.lastgroup == "pow":
            e = _SIGNED.match(self.text, m.end())
            if not e:
                raise _Bad(self.text)
            self.at = e.end()
            top, _, low = e.group(1).partition("/")
            return [r.power(float(top) / float(low or 1)) for r in base]
        return base

    def atom(self) -> list[Reading]:
        m = self.peek()
        kind = m.lastgroup
        token = m.group(kind)
        self.at = m.end()
        if kind == "num":
            value = float(re.sub("[dD]", "e", token))
            if value <= 0:
                raise _Bad(self.text)
            return [Reading(math.log10(value))]
        if kind == "op" and token in "([":
            inside = self.product(")" if token == "(" else "]")
            end = self.peek()
            if not end or end.group(end.lastgroup) not in ")]":
                raise _Bad(self.text)
            self.at = end.end()
            return inside
        if kind == "word":
            if token in ("sqrt",):
                return [r.power(0.5) for r in self.atom()]
            if token.lower() in _WORDS:
                return [Reading(frame=_WORDS[token.lower()])]
            following = self.peek()
            if following and following.lastgroup == "word":  # roots of two words
                both = segment(f"{token}_{following['word']}") or segment(f"{token}_{following['word']}".lower())
                if both:
                    self.at = following.end()
                    return list(both)
            readings = segment(token)
            if readings:
                return list(readings)
        raise _Bad(self.text)


@lru_cache(maxsize=65536)
def parse_unit(text: str | None, quantity: str | None) -> tuple[float, float, float] | None:
    """(log10 of the cgs factor, power of a, power of h) of a unit text for a quantity; None if it gives none.

    In a comoving frame every length counts one power of a. A temperature may be given as an energy k_B T.
    """
    want = DIMENSIONS.get(quantity or "")
    if text is None or want is None:
        return None
    text = re.sub(r"(?<=k_B)\s*\*\s*(?=T\b)|(?<=kB)\s*\*\s*(?=T\b)", " ", text.replace("−", "-")).strip()
    while len(text) > 1 and (text[0], text[-1]) in (("[", "]"), ("(", ")")) and _closes_last(text):
        text = text[1:-1].strip()
    if not text:
        return None
    try:
        parser = _Parser(text)
        found = parser.product()
        if parser.text[parser.at :].strip(" ,;."):
            return None
    except (_Bad, RecursionError):
        return None

    def prior(r: Reading) -> float:
        if r.dim == want:
            return 0.0
        return 5.0 if want == (0, 0, 0, 1) and r.dim == _E else MISMATCH

    found = [(r.cost + prior(r), r) for r in found]
    cost, best = min(found, key=lambda x: (x[0], x[1].log), default=(math.inf, None))
    if best is None or prior(best) >= MISMATCH:
        return None
    log = best.log
    if want == (0, 0, 0, 1) and best.dim == _E:
        log += math.log10(KEV_KELVIN / (EV_ERG * 1e3))
    return log, best.a + (best.dim[0] if best.frame == "comoving" else 0), best.h


def _closes_last(text: str) -> bool:
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if depth == 0:
            return i == len(text) - 1
    return False


_NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d*)?(?:[eEdD][+-]?\d+)?(?:\s*[x×*·]\s*10\s*(?:\^|\*\*)\s*[+-]?\d+)?"
_FIRST = re.compile(rf"({_NUMBER})(?=$|[\s\[(;,])")
_LAST = re.compile(rf"(?:^|[\s:=|])({_NUMBER})$")
_SHAPES = (
    re.compile(r"^value\s*=\s*(?P<n>[^;]+);\s*units?\s*=\s*(?P<u>.*)$", re.I),
    re.compile(r"^units?\s*[:=]\s*(?P<u>.*?)\s*\|\s*(?P<n>.*)$", re.I),
    re.compile(r"^(?P<u>.*\S)\s*:\s*(?P<n>[^:]*)$"),
)


def parse_number(text: str) -> float | None:
    """A number in the formats 1.5, -1,234.5, 1.5e3, 1.5d-03 and 1.5 x 10^3; None for anything else."""
    text = text.replace("−", "-").strip()
    if not re.fullmatch(_NUMBER, text) or not re.search(r"\d", text):
        return None
    head, *tail = re.split(r"\s*[x×*·]\s*10\s*(?:\^|\*\*)\s*", text)
    try:
        value = float(re.sub("[dD]", "e", head.replace(",", "")) + (f"e{tail[0]}" if tail and not re.search("[eEdD]", head) else ""))
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def _without_remarks(text: str) -> str:
    """A text without the clauses at its end that consist of words of which none can belong to a unit."""
    while m := re.search(r"[,;]\s+([^\W\d_]+(?:\s+[^\W\d_]+)*)\s*$", text):
        if any(w.lower() in _WORDS or segment(w) for w in m[1].split()):
            break
        text = text[: m.start()]
    return text.strip()


def split_raw(text: str | None) -> tuple[float | None, str | None]:
    """(number, unit text) of a free text that holds both."""
    if text is None:
        return None, None
    text = re.sub(r"(?i)^\s*(?:approx\.?|about|ca\.?|~)\s*", "", text.replace("−", "-")).strip()
    text = _without_remarks(text)
    for shape in _SHAPES:
        if m := shape.match(text):
            if (n := parse_number(m["n"])) is not None:
                return n, m["u"].strip()
    if (m := _FIRST.match(text)) and (n := parse_number(m[1])) is not None:
        return n, text[m.end() :].strip()
    if (m := _LAST.search(text)) and (n := parse_number(m[1])) is not None:
        return n, text[: m.start()].strip()
    return None, None
