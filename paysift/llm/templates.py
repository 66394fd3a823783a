"""Template canonicalisation of texts, over Arrow string columns.

A text is cut at ASCII white space; of a word only letters, digits and non-ASCII bytes count,
in lower case (ASCII and Latin-1), and words without any are passed over. Typed placeholders
replace

- numbers: words with a digit; their letters stay part of the template (``5km`` is a number
  with ``km``),
- names: words with a first capital, not all in capitals, that don't begin a sentence (a text,
  a line, or what follows a word ending in ``. ! ? :``),
- units: words of ``UNITS`` behind a number.

The replaced word's hash is the slot's value. ``readings`` also tells which words are names when
a capital at the beginning of a sentence counts, and ``named`` takes all of these as names, a
run of them as one. All words of a chunk are hashed at once (see
``words``). Chunks end between texts or behind a line feed, so the cut changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import _BASE, _INVERSE, _SPACE, _TABLE, CHUNK, _power, mix, utf8

# Units that are slots behind a number.
UNITS = """mm cm m km in inch inches ft feet yd yards mi mile miles mg g kg lb lbs oz pound pounds ton tons
ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days
week weeks month months year years usd eur gbp dollar dollars cent cents euro euros percent degrees mph kmh""".split()

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA5A5A5A5DEADBEEF, 0x0F1E2D3C4B5A6978, 0x5851F42D4C957F2D))
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_KEPT = _DIGIT.copy()
_KEPT[ord("A"):ord("Z") + 1] = _KEPT[ord("a"):ord("z") + 1] = True
_KEPT[0x80:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def fold(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``raw`` in lower case (ASCII and Latin-1), and where a capital begins."""
    upper = (raw >= 65) & (raw <= 90)
    latin = np.zeros(len(raw), dtype=bool)
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low = raw.copy()
    low[upper | latin] += 32
    capital = upper.copy()
    capital[:-1] |= latin[1:]
    return low, capital


def _hash(low: np.ndarray, take: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of the bytes in ``take`` of every word."""
    rank = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum(take, out=rank[1:])
    at = np.flatnonzero(take)
    total = np.zeros(len(at) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[low[at]] * _power(_BASE, len(at)), out=total[1:])
    a, b = rank[begin], rank[end]
    return (total[b] - total[a]) * _power(_INVERSE, len(at) + 1)[a], b - a


NONE, INSIDE, FIRST = range(3)  # no capital, a name within a sentence, a capital that begins one


def _chunk(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, slot value or 0, capital, place) of the words of ``raw``; ``edges``: where
    texts begin."""
    n = len(raw)
    low, capital = fold(raw)
    space, kept = _SPACE[raw], _KEPT[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[edges] = True
    edge[0] = edge[n] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), begin
    whole, size = _hash(low, kept, begin, end)
    bare, letters = _hash(low, kept & ~_DIGIT[raw], begin, end)
    rank = np.cumsum(kept) - kept
    first = np.r_[np.flatnonzero(kept), n - 1][np.minimum(rank[begin], int(kept.sum()))]
    capitals = np.r_[0, np.cumsum(capital)]
    lines = np.r_[0, np.cumsum((raw == 10) | edge[:-1])]
    fresh = np.r_[True, _STOP[raw[end[:-1] - 1]] | (lines[begin[1:] + 1] > lines[end[:-1]])]
    number = size > letters
    large = capital[first] & ~number & (capitals[end] - capitals[begin] < _characters(raw, begin, end))
    name = large & ~fresh
    unit = ~number & np.r_[False, number[:-1]]
    unit[unit] = np.isin(bare[unit], unit_hashes())
    template = np.where(number, mix(bare + NUMBER), np.where(unit, UNIT, np.where(name, NAME, mix(whole))))
    slot = np.where(number | name | unit, mix(whole) | np.uint64(1), np.uint64(0))
    mark = np.where(large & ~unit, np.where(fresh, FIRST, INSIDE), NONE).astype(np.int8)
    some = size > 0
    return template[some], slot[some], mark[some], begin[some]


def _characters(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Letters of each word: ASCII letters and the lead bytes of longer characters."""
    lead = np.r_[0, np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 0x80) | (raw >= 0xC0))]
    return lead[end] - lead[begin]


_units: list[np.ndarray] = []


def unit_hashes() -> np.ndarray:
    if not _units:
        raw = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
        space = _SPACE[raw]
        begin, end = np.flatnonzero(~space & np.r_[True, space[:-1]]), np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        _units.append(_hash(raw, ~space, begin, end)[0])
    return _units[0]


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes and slot values of all words of all rows, and each row's offsets."""
    words, slots, _, off = readings(texts)
    return words, slots, off


def named(words: np.ndarray, slots: np.ndarray, marks: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of ``readings`` with every capital as a name and a run of names as one slot (one
    that begins a sentence begins a run): words, slots, offsets, and the word that each comes from."""
    name = marks != NONE
    follows = np.zeros(len(words), dtype=bool)
    follows[1:] = name[:-1] & (marks[1:] == INSIDE)
    follows[off[:-1][off[:-1] < len(words)]] = False
    begin = np.flatnonzero(~follows)
    if not len(begin):
        return words, slots, off, begin
    value = np.where(name & (slots == 0), words | np.uint64(1), slots)
    nth = np.arange(len(words)) - np.repeat(begin, np.diff(np.r_[begin, len(words)]))
    value = np.add.reduceat(value * (2 * nth + 1).astype(np.uint64), begin)
    return np.where(name[begin], NAME, words[begin]), np.where(name[begin], value | np.uint64(1), value), np.searchsorted(begin, off), begin


def readings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, slot values and capitals of all words of all rows, and each row's offsets."""
    raw, off = utf8(texts)
    found, at, n = [], 0, len(raw)
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            row = int(off[np.searchsorted(off, to, side="right") - 1])
            if row <= at:
                row = int(off[np.searchsorted(off, to, side="left")])
                line = np.flatnonzero(raw[to:row] == 10)
                row = to + int(line[0]) + 1 if len(line) else row
            to = row
        t, s, m, b = _chunk(raw[at:to], off[(off >= at) & (off <= to)] - at)
        found.append((t, s, m, b + at))
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(len(off), np.int64)
    t, s, m, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return t, s, m, np.searchsorted(b, off)
