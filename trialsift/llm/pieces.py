"""Pieces that a byte-level pre-tokenizer cuts texts into, and ids looked up once for each distinct piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

#: Bytes of text cut and looked up at once.
WINDOW = 1 << 20

SPACE, LETTER, DIGIT, SIGN = range(4)


class CharacterClasses:
    """Class of each code point, asked of the vocabulary's own pre-tokenizer the first time it is met."""

    def __init__(self, pre_tokenizer):
        self._ask = pre_tokenizer.pre_tokenize_str
        self._known = np.full(0x110000, -1, dtype=np.int8)
        self._learn(np.arange(128))

    def _learn(self, points: np.ndarray) -> None:
        for p in points.tolist():
            c = chr(p)
            # what the character joins: a letter before it, a digit or a sign
            spans = {span for _, span in self._ask(f"a{c}1{c}!{c}")}
            self._known[p] = LETTER if (0, 2) in spans else SIGN if (3, 6) in spans else DIGIT if (1, 4) in spans else SPACE

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self._known[points]
        if (found < 0).any():
            self._learn(np.unique(points[found < 0]))
            found = self._known[points]
        return found


def piece_starts(points: np.ndarray, classes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pieces begin, by code point; `heads` marks the first of each text."""
    n = len(points)
    new = heads.copy()
    new[1:] |= classes[1:] != classes[:-1]
    begins = new.copy()
    # white space before something else: its last character begins a piece, which a plain space shares with what follows
    after = np.flatnonzero(new & ~heads & (classes != SPACE))
    after = after[classes[after - 1] == SPACE]
    begins[after - 1] = True
    begins[after[points[after - 1] == 32]] = False
    # contractions: an apostrophe of its own with s, t, m, d, re, ve or ll
    quote = np.flatnonzero((points == 39) & begins & new)
    quote = quote[quote + 1 < n]
    quote = quote[~heads[quote + 1]]
    one = points[quote + 1]
    third = np.minimum(quote + 2, n - 1)
    two = np.where((quote + 2 < n) & ~heads[third], points[third], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    begins[quote[short | long] + 1] = False
    rest = np.concatenate([quote[short] + 2, quote[long] + 3])
    begins[rest[rest < n]] = True
    return np.flatnonzero(begins)


class PieceCoder:
    """Ids of whole texts out of the ids of their pieces, which `ids_of` gives."""

    def __init__(self, pre_tokenizer, added: dict[bytes, int]):
        """`added`: strings that are one id each wherever they stand."""
        self.classes = CharacterClasses(pre_tokenizer)
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        self.added_pattern = regex.compile(b"|".join(map(regex.escape, longest_first))) if added else None

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, as little-endian 32-bit strings."""
        raise NotImplementedError

    def _cut(self, data: bytes, heads: np.ndarray) -> np.ndarray:
        """Byte offsets at which pieces begin in `data`; `heads` are the byte offsets at which texts begin."""
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype="<u4")
        at = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
        if not len(points):
            return at
        spans = [m.span() for m in self.added_pattern.finditer(data)] if self.added_pattern else []
        edges = np.array(spans, dtype=np.int64).reshape(-1, 2)
        first = np.zeros(len(points) + 1, dtype=bool)
        first[np.searchsorted(at, np.concatenate([heads, edges.ravel()]))] = True
        cuts = at[piece_starts(points, self.classes(points), first[:-1])]
        if spans:  # an added token is one piece
            within = np.searchsorted(edges[:, 0], cuts, side="left") - 1
            cuts = cuts[(within < 0) | (cuts >= edges[within, 1])]
        return cuts

    def _windows(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
        """(first row, bytes, piece offsets, text offsets) of runs of whole texts, and of parts of longer texts."""
        row = 0
        while row < len(texts):
            end, size = row, 0
            while end < len(texts) and (end == row or size + len(texts[end]) <= WINDOW):
                size += len(texts[end])
                end += 1
            if size <= WINDOW:
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts[row:end]])]).astype(np.int64)
                data = b"".join(texts[row:end])
                yield row, data, self._cut(data, bounds[:-1]), bounds
            else:
                yield from ((row, *part) for part in self._parts(texts[row]))
            row = end

    def _parts(self, text: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """A long text in parts that end where a piece surely ends, whatever follows."""
        margin = 2 + max(map(len, self.added), default=0)
        begin, reach = 0, WINDOW
        while begin < len(text):
            end = begin + reach
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            data = text[begin:end]
            cuts = self._cut(data, np.zeros(1, dtype=np.int64))
            if end < len(text):
                # the last two pieces may still grow, and so may the beginning of an added token
                sure = cuts[:-2][cuts[:-2] <= len(data) - margin]
                if len(sure) < 2:
                    reach *= 2
                    continue
                data, cuts = data[: sure[-1]], sure[:-1]
            yield data, cuts, np.array([0, len(data)])
            begin, reach = begin + len(data), WINDOW

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, where each text's ids begin and the last ones end), window after window."""
        for row, data, cuts, bounds in self._windows(texts):
            edges = np.append(cuts, len(data)).astype(np.int64)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(edges), pa.py_buffer(data)])
            coded = pieces.dictionary_encode()
            found = self.ids_of(coded.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(found), dtype="<i4")
            sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            held = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(flat)).take(coded.indices)
            ids = held.flatten().to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])]) if len(cuts) else np.zeros(1, dtype=np.int64)
            yield row, ids, upto[np.searchsorted(cuts, bounds)]
