"""Indel similarity as Arrow UDFs.

ratio(a, b) = 100 * 2*LCS / (len(a)+len(b)); partial_ratio is the best ratio
of the shorter text against any equally long window of the longer one (windows
may hang over either end).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one bit per character of `a`."""
    if not a or not b:
        return 0
    return _lcs(_places(a), len(a), b)


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


WORD = 63  # bits per machine word; the 64th takes the carry


def _encode(needle: str, hay: str) -> tuple[np.ndarray, np.ndarray]:
    """Character masks of the needle and the hay as mask indices (0: not in the needle)."""
    alphabet = {ch: i + 1 for i, ch in enumerate(dict.fromkeys(needle))}
    masks = np.zeros((len(alphabet) + 1, (len(needle) + WORD - 1) // WORD), dtype=np.uint64)
    for i, ch in enumerate(needle):
        masks[alphabet[ch], i // WORD] |= np.uint64(1 << (i % WORD))
    points = np.frombuffer(hay.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.array([ord(ch) for ch in alphabet], dtype=np.uint32)
    order = np.argsort(letters)
    at = np.minimum(np.searchsorted(letters[order], points), len(letters) - 1)
    codes = np.where(letters[order][at] == points, order[at] + 1, 0).astype(np.int32)
    return masks, codes


def _window_bounds(m: int, masks: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Upper bound of the LCS per full window: characters the two have in common."""
    n = len(codes) - m + 1
    bound = np.zeros(n, dtype=np.int32)
    wanted = np.bitwise_count(masks).sum(axis=1)
    for c in range(1, len(masks)):
        seen = np.concatenate(([0], np.cumsum(codes == c)))
        bound += np.minimum(seen[m:] - seen[:n], int(wanted[c])).astype(np.int32)
    return bound


def _window_lcs(m: int, masks: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """LCS of the needle with every window hay[s:s+m]; their bit rows advance together."""
    words = masks.shape[1]
    low = np.uint64((1 << WORD) - 1)
    last = np.uint64((1 << (m - WORD * (words - 1))) - 1)
    rows = [np.full(len(starts), low if w < words - 1 else last, dtype=np.uint64) for w in range(words)]
    for j in range(m):
        at = codes[starts + j]
        carry = np.uint64(0)
        for w in range(words):
            row = rows[w]
            hit = row & masks[at, w]
            total = row + hit + carry
            carry = total >> np.uint64(WORD)
            rows[w] = (total | (row & ~hit)) & (low if w < words - 1 else last)
    return m - sum(np.bitwise_count(r).astype(np.int32) for r in rows)


def _places(needle: str) -> dict[str, int]:
    """Bit mask of the places of each character."""
    where: dict[str, int] = {}
    for i, ch in enumerate(needle):
        where[ch] = where.get(ch, 0) | (1 << i)
    return where


def _lcs(where: dict[str, int], m: int, text: str) -> int:
    """`lcs_length` of the needle of these places; what is carried beyond its bits is dropped at the end."""
    full = row = (1 << m) - 1
    at = where.get
    for ch in text:
        hit = row & at(ch, 0)
        if hit:
            row = (row + hit) | (row - hit)
    return m - (row & full).bit_count()


def _prefix_best(needle: str, head: str, floor: float = 0.0) -> float:
    """Best ratio of the needle with any prefix of `head`, of those that may pass `floor`; one pass gives every LCS."""
    where = _places(needle)
    m = len(needle)
    full = row = (1 << m) - 1
    best = 0.0
    least = floor * m / (200.0 - floor) - 1e-6  # a shorter prefix scores less, matched throughout
    for k, ch in enumerate(head, start=1):
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
        if k >= least:
            best = max(best, 200.0 * (m - row.bit_count()) / (m + k))
    return best


#: Needle pieces whose exact places in the hay give a first window to beat, and a score from which two places will do.
PIECE, NEAR = 10, 88.0


def _aligned_best(needle: str, hay: str, where: dict[str, int], enough: float = 100.0) -> float:
    """Best ratio of the full windows that line up with a piece of the needle: a lower bound, often close."""
    m, best, tried, hits = len(needle), 0.0, set(), 0
    for at in range(0, m - PIECE + 1, PIECE // 2):
        found = hay.find(needle[at : at + PIECE])
        if found < 0:
            continue
        hits += 1
        if hits > 2 and best > NEAR:
            break
        for shift in (0, 2, -2):
            start = min(max(0, found - at + shift), len(hay) - m)
            if start not in tried:
                tried.add(start)
                best = max(best, 100.0 * _lcs(where, m, hay[start : start + m]) / m)
                if best >= enough:
                    return best
    return best


#: Shortest pieces whose places are worth looking up, and the most windows then scored one by one.
SEED, FEW = 4, 256


def _seeds(needle: str, hay: str, best: float, cutoff: float) -> tuple[list[tuple[int, int]], int] | None:
    """((places in the hay less those in the needle, place behind the piece), edits) of every piece; None if they rule out too little.

    A window that passes `best` and reaches `cutoff` differs from the needle by at most `edits` characters, left out
    or put in.  Of one more pieces at least one is then whole in the window, and no further off its place than the
    edits allow.
    """
    m = len(needle)
    edits = min(int(m * (100.0 - cutoff) / 50.0 + 1e-6), max(0, math.ceil(m * (100.0 - best) / 50.0 - 1e-6) - 1))
    if m < SEED * (edits + 1):
        return None
    found: list[tuple[int, int]] = []
    for i in range(edits + 1):
        a, b = m * i // (edits + 1), m * (i + 1) // (edits + 1)
        piece = needle[a:b]
        at = hay.find(piece)
        while at >= 0:
            found.append((at - a, at + b - a))
            at = hay.find(piece, at + 1)
        if len(found) > FEW:
            return None
    return found, edits


def _seeded_best(needle: str, hay: str, where: dict[str, int], best: float, cutoff: float, seeds, edits: int) -> float:
    """Best ratio over the windows near the seeds: exact where it passes `best` and reaches `cutoff`."""
    m, last = len(needle), len(hay) - len(needle)
    floor = max(best, cutoff)
    # windows cut off by an end of the text
    if any(end < m and off <= edits for off, end in seeds):
        best = max(best, _prefix_best(needle, hay[: m - 1], floor))
    if any(off >= last - edits for off, _ in seeds):
        best = max(best, _prefix_best(needle[::-1], hay[: -m : -1], floor))
    shift = edits // 2  # a full window leaves out as many characters as it puts in
    done = -1
    for off in sorted({off for off, _ in seeds}):
        start = max(done + 1, off - shift, 0)
        stop = min(off + shift, last)
        done = max(done, stop)
        while start <= stop:
            score = _lcs(where, m, hay[start : start + m])
            best = max(best, 100.0 * score / m)
            # one character further a window gains one at most
            needed = max(int(best * m / 100.0 + 1e-6) + 1, math.ceil(cutoff * m / 100.0 - 1e-6))
            start += max(1, needed - score)
    return best


def partial_ratio(needle: str, hay: str, cutoff: float = 0.0, enough: float = 100.0) -> float:
    """Best window ratio; below `cutoff` the result is 0, and any ratio that reaches `enough` will do.

    Exact, without scoring every window.  Where the least score that counts is high, only windows
    near an undamaged piece of the needle can reach it.  Else shifting a window by one changes its
    LCS by at most one, so windows on a coarse grid bound their neighbours, and
    finer grids only visit windows whose bound can still win.
    """
    if not needle or not hay:
        return 0.0
    if len(needle) > len(hay):
        needle, hay = hay, needle
    if needle in hay:
        return 100.0
    m = len(needle)
    where = _places(needle)
    best = _aligned_best(needle, hay, where, enough)
    if best >= enough and best >= cutoff:
        return best
    seeds = _seeds(needle, hay, best, cutoff)
    if seeds is not None:
        best = _seeded_best(needle, hay, where, best, cutoff, *seeds)
        return best if best >= cutoff else 0.0
    # windows cut off by an end of the text
    best = max(best, _prefix_best(needle, hay[: m - 1]), _prefix_best(needle[::-1], hay[: -m : -1]))
    masks, codes = _encode(needle, hay)
    bounds = _window_bounds(m, masks, codes)
    place = np.arange(len(bounds))
    scored = np.zeros(len(bounds), dtype=bool)
    stride = max(1, m // 6)
    while True:
        grid = place[::stride]
        # a window that only reaches the best changes nothing
        over = 100.0 * bounds[grid] / m
        grid = grid[~scored[grid] & (over > best) & (over >= cutoff)]
        if len(grid):
            bounds[grid] = _window_lcs(m, masks, codes, grid)
            scored[grid] = True
            best = max(best, 100.0 * int(bounds[grid].max()) / m)
            bounds = np.minimum.accumulate(bounds - place) + place
            bounds = (np.minimum.accumulate((bounds + place)[::-1]))[::-1] - place
        if stride == 1:
            break
        stride = max(1, stride // 3)
    return best if best >= cutoff else 0.0


BEST = StructType([StructField("at", IntegerType()), StructField("score", DoubleType())])


@F.pandas_udf(BEST)
def best_match(texts: pd.Series, choices: pd.Series) -> pd.DataFrame:
    """First choice with the highest ratio: its position and ratio/100."""
    out = []
    for text, options in zip(texts, choices):
        best = (None, None)
        if text is not None and options is not None:
            for i, option in enumerate(options):
                score = ratio(text, option) / 100.0
                if best[1] is None or score > best[1]:
                    best = (i, score)
        out.append(best)
    return pd.DataFrame(out, columns=["at", "score"]).astype({"at": "Int32", "score": "float64"})
