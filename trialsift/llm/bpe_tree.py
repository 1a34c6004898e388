"""Byte-level BPE encoding and decoding (operator 11).

A text is cut into pieces (contractions, letters, digits, signs, white space), and
within a piece the adjacent pair of lowest merge rank, leftmost first, is merged
until no pair is left that can be.  A segment tree over the ranks of adjacent pairs
gives that pair at its root; a merge changes three leaves, and their paths to the
root are renewed.

* Trees of many pieces of similar length are kept as one array, a tree a row, and all
  of them merge at once; a piece of more than LONG_PIECE bytes has a tree of its own.
* Pieces are spans of the texts' bytes.  Each distinct piece of a window of texts is
  looked up once, and merged once a task unless the task's memory of pieces is full.
* A text is read in windows of about a MiB that end where a piece ends, so memory
  does not grow with a text's length (but with that of a single piece).

Nothing is shuffled: each row is encoded where it is read.
"""

from __future__ import annotations

import hashlib
import json
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from trialsift.llm.common import release_memory, table
from trialsift.llm.pieces import PieceCoder
from trialsift.llm.tokens import tokenizer_path

#: Distinct pieces whose ids a task remembers.
REMEMBERED = 400_000
#: Bytes of a piece from which its tree is walked by itself.
LONG_PIECE = 256
#: Tree nodes of short pieces that are merged together.
NODES = 1 << 21

_NONE = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary(PieceCoder):
    """Merges, ids and added tokens of a byte-level BPE file."""

    def __init__(self, path: str, specials: bool = True):
        """Without `specials` the strings of added tokens are text like any other."""
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        ids, added = held["model"]["vocab"], held["added_tokens"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.single = np.array([ids[c] for c in byte_characters()], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs, self.rank_of = pairs[order], order
        self.result = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        tokens = [b""] * (max([*ids.values(), *(t["id"] for t in added)]) + 1)
        for token, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for t in added:
            tokens[t["id"]] = t["content"].encode()
        self.tokens = pa.array(tokens, pa.large_binary())
        self.decimals = pa.array([b",%d" % i for i in range(len(tokens))], pa.large_binary())
        found = {t["content"].encode(): t["id"] for t in added} if specials else {}
        super().__init__(Tokenizer.from_file(path).pre_tokenizer, found)
        self.remembered: dict[bytes, bytes] = {}

    @cached_property
    def rank_by_pair(self) -> dict[int, int]:
        return dict(zip(self.pairs.tolist(), self.rank_of.tolist()))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each adjacent pair, _NONE where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], _NONE)

    def merge_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece by one segment tree."""
        symbols = self.single[np.frombuffer(piece, dtype=np.uint8)]
        n = len(symbols)
        width = 1 << max(n - 1, 1).bit_length()
        leaf = np.full(width, _NONE, dtype=np.int64)
        leaf[: n - 1] = self.ranks(symbols[:-1], symbols[1:])
        levels = [leaf]
        while len(levels[0]) > 1:
            levels.insert(0, np.minimum(levels[0][::2], levels[0][1::2]))
        tree = [_NONE, *np.concatenate(levels).tolist()]
        rank_of = self.rank_by_pair
        symbols = symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] != _NONE:
            # the left child first: the leftmost of equal ranks
            node, rank = 1, tree[1]
            while node < width:
                node *= 2
                node += tree[node] != rank
            i = node - width
            j, back = after[i], before[i]
            k = after[j]
            symbols[i], symbols[j], after[i] = int(self.result[rank]), -1, k
            changed = [(j, _NONE), (i, _NONE)]
            if k < n:
                before[k] = i
                changed[1] = (i, rank_of.get(symbols[i] << 32 | symbols[k], _NONE))
            if back >= 0:
                changed.append((back, rank_of.get(symbols[back] << 32 | symbols[i], _NONE)))
            for at, value in changed:
                at += width
                tree[at] = value
                while at > 1:
                    at //= 2
                    least = min(tree[2 * at], tree[2 * at + 1])
                    if tree[at] == least:
                        break
                    tree[at] = least
        return [s for s in symbols if s >= 0]

    def merge_pieces(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian 32-bit strings, of pieces of 2 to `width` (a power of two) bytes; a tree a row."""
        rows = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        place = np.arange(width + 1)
        symbols = np.full((rows, width + 1), -1, dtype=np.int64)
        symbols[place < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.minimum(np.broadcast_to(place + 1, symbols.shape), width).copy()
        before = np.broadcast_to(place - 1, symbols.shape).copy()
        # a leaf holds its rank and its place, so that the least one is the leftmost of the lowest rank
        tree = np.full((rows, 2 * width), _NONE, dtype=np.int64)
        ranks = self.ranks(symbols[:, :-1], symbols[:, 1:])
        tree[:, width:] = np.where(ranks < _NONE, ranks * width + place[:-1], _NONE)
        node = width
        while node > 1:
            node //= 2
            np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2], out=tree[:, node : 2 * node])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            i, rank = root % width, root // width
            j = after[live, i]
            k = after[live, j]
            symbols[live, i] = self.result[rank]
            symbols[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            back = before[live, i]
            held = back >= 0
            row = np.concatenate([live, live, live[held]])
            at = np.concatenate([j, i, back[held]])
            ranks = self.ranks(symbols[row, at], np.concatenate([np.full(len(live), -1), symbols[live, k], symbols[live, i][held]]))
            value = np.where(ranks < _NONE, np.minimum(ranks, len(self.result)) * width + at, _NONE)
            at = at + width
            tree[row, at] = value
            while at[0] > 1:
                at = at // 2
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
            live = live[tree[live, 1] < _NONE]
        kept = symbols >= 0
        flat = symbols[kept].astype("<i4").tobytes()
        ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, as little-endian 32-bit strings."""
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        known = self.remembered
        classes: dict[int, list[bytes]] = {}
        for p in pieces:
            if p not in known:
                if p in self.added:
                    known[p] = np.array([self.added[p]], dtype="<i4").tobytes()
                elif len(p) < 2:
                    known[p] = self.single[list(p)].astype("<i4").tobytes()
                elif len(p) > LONG_PIECE:
                    known[p] = np.array(self.merge_piece(p), dtype="<i4").tobytes()
                else:
                    classes.setdefault(1 << (len(p) - 1).bit_length(), []).append(p)
        for width, new in classes.items():
            step = NODES // (2 * width)
            for i in range(0, len(new), step):
                known.update(zip(new[i : i + step], self.merge_pieces(new[i : i + step], width)))
        return [known[p] for p in pieces]

    def bytes_of(self, ids: np.ndarray) -> pa.Array:
        return self.tokens.take(pa.array(ids))


_OPENED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process and file."""
    if path not in _OPENED:
        _OPENED[path] = Vocabulary(path)
    return _OPENED[path]


def _span(values: pa.Array, a: int, b: int) -> bytes:
    """Bytes of values[a:b], end to end."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)
    data = values.buffers()[2]
    return b"" if data is None else memoryview(data)[offsets[values.offset + a] : offsets[values.offset + b]]


def tokenize(docs: DataFrame, path: str, ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """doc_id and n_tokens of every text, as asked with its ids, the text decoded from them, and digests of both.

    `docs`: doc_id, text; other columns are not read.  Every row gives one, repeated rows
    and rows without an id included.  A null text is an empty one and has no ids; ids of added tokens
    stand where their strings do.  The digests are the lowercase hex sha256 of the decimal ids joined by
    commas, and of the decoded text in UTF-8; they hold no more than a window of a long text.
    """
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    fields += [T.StructField("decoded", T.StringType())] if decoded else []
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] if digests else []
    schema = T.StructType(fields)

    def encode(batches):
        book = vocabulary(path)
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
            n = len(texts)
            count = np.zeros(n, dtype=np.int64)
            parts: list[list[np.ndarray]] = [[] for _ in range(n)] if ids else []
            back: list[list[bytes]] = [[] for _ in range(n)] if decoded else []
            shas = [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)] if digests else []
            for row, found, bounds in book.encode(texts):
                spelled = book.decimals.take(pa.array(found)) if digests else None
                plain = book.bytes_of(found) if digests or decoded else None
                bounds = bounds.tolist()
                for k, (a, b) in enumerate(zip(bounds, bounds[1:]), row):
                    if ids:
                        parts[k].append(found[a:b])
                    if decoded:
                        back[k].append(bytes(_span(plain, a, b)))
                    if digests:
                        # a comma stands before each id; the text's first goes
                        shas[k][0].update(_span(spelled, a, b)[0 if count[k] else 1 :])
                        shas[k][1].update(_span(plain, a, b))
                    count[k] += b - a
            out = [batch.column("doc_id"), pa.array(count)]
            if ids:
                flat = [np.concatenate(p) if p else np.zeros(0, dtype=np.int32) for p in parts]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([*flat, np.zeros(0, dtype=np.int32)]))))
            if decoded:
                out.append(pa.array([b"".join(p).decode("utf-8", "replace") for p in back], pa.string()))
            if digests:
                out += [pa.array([s[j].hexdigest() for s in shas], pa.string()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def detokenize(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and `decoded`, the text of a row's `ids`, in which bytes that are no UTF-8 become U+FFFD; null ids give null.

    `rows`: doc_id, ids (array of int).  A null or unknown id stands for nothing.
    """
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("decoded", T.StringType())])

    def decode(batches):
        book = vocabulary(path)
        top = len(book.tokens)
        for batch in batches:
            out = []
            for held in batch.column("ids"):
                values = held.values
                if values is None:
                    out.append(None)
                    continue
                values = values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                values = values[(values >= 0) & (values < top)]
                out.append(bytes(_span(book.bytes_of(values), 0, len(values))).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=schema.names)

    return rows.select("doc_id", "ids").mapInArrow(decode, schema)


def op11_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False, digests=True)
