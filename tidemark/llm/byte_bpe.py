"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Text becomes an array of code points and, by a table, of code-point classes.
Where matches begin is decided by a small automaton. Each class is a transition
function over its states; functions compose associatively, so a blocked scan
over whole batches gives the state at every character, without regex and without
a loop over characters. The slices between boundaries feed pair merging by rank,
whose results are cached. Each id keeps the byte offset at which it starts in the text;
decoding copies the bytes of all ids to their offsets at once, and a range of ids can be
decoded without the rest.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import map_arrow

#: Slices whose ids are remembered by one worker, in each of two generations.
CACHE_ENTRIES = 300_000
#: Characters scanned at once.
SCAN_CHARS = 1 << 20

# Classes of characters. Blanks are told apart by what follows, apostrophes by the contraction they may start.
LETTER, NUMBER, OTHER, SPACE_LAST, SPACE_MORE, BLANK_LAST, BLANK_MORE, CONTRACT_1, CONTRACT_2, RESET = range(10)
# States: what the match that holds the last character may still take in.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether the character starts a match."""
    if kind == RESET:
        return CLOSED, True
    if kind in (LETTER, NUMBER, OTHER):
        own = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[kind]
        if kind == LETTER and state in (ONE_LEFT, TWO_LEFT):
            return (CLOSED if state == ONE_LEFT else ONE_LEFT), False
        return own, state not in (own, AFTER_SPACE)
    if kind in (SPACE_MORE, BLANK_MORE):
        return IN_BLANKS, state != IN_BLANKS
    if kind == SPACE_LAST:
        return AFTER_SPACE, True
    if kind == BLANK_LAST:
        return CLOSED, True
    if state in (IN_OTHERS, AFTER_SPACE):
        return IN_OTHERS, False
    return (ONE_LEFT if kind == CONTRACT_1 else TWO_LEFT), True


def _functions() -> tuple[np.ndarray, ...]:
    """Transition functions by number: of each class, of each composition, as state tables; who starts a match; the constant ones."""
    basic = [tuple(_step(s, k)[0] for s in range(8)) for k in range(10)] + [(s,) * 8 for s in range(8)]
    rows = list(dict.fromkeys(basic))
    for a in rows:  # grows until the set is closed under composition with the basic functions
        for b in basic:
            if (c := tuple(b[x] for x in a)) not in rows:
                rows.append(c)
    number = {f: i for i, f in enumerate(rows)}
    compose = np.array([[number[tuple(b[x] for x in a)] for b in rows] for a in rows], np.uint8)
    of_class = np.array([number[tuple(_step(s, k)[0] for s in range(8))] for k in range(10)], np.uint8)
    starts = np.array([[_step(s, k)[1] for k in range(10)] for s in range(8)], bool)
    constant = np.array([number[(s,) * 8] for s in range(8)], np.uint8)
    return of_class, compose, np.array(rows, np.uint8), starts, constant


_OF_CLASS, _COMPOSE, _ROWS, _STARTS, _CONSTANT = _functions()
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        # which code points are letters and numbers depends on the Unicode version: the library's own is asked, once
        every = np.setdiff1d(np.arange(sys.maxunicode + 1, dtype=np.uint32), np.arange(0xD800, 0xE000)).tobytes().decode("utf-32-le")
        kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        single = {bytes([i]): i for i in range(256)}
        for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            only = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
            found = bytes(only.encode_ordinary(every)).decode()
            kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        kinds[WHITE_SPACE] = BLANK_MORE
        _classes.append(kinds)
    return _classes[0]


def _scan(functions: np.ndarray, block: int = 64) -> np.ndarray:
    """The composition of all functions up to each place: blocks side by side, then their totals, recursively."""
    n = len(functions)
    if n <= block:
        out = functions.copy()
        for i in range(1, n):
            out[i] = _COMPOSE[out[i - 1], functions[i]]
        return out
    rows = -(-n // block)
    grid = np.full(rows * block, _OF_CLASS[RESET], np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    flat, width = _COMPOSE.ravel(), np.intp(len(_COMPOSE))
    for j in range(1, block):
        grid[j] = flat[grid[j - 1] * width + grid[j]]
    totals = _scan(grid[-1], block)
    grid[:, 1:] = flat[totals[:-1][None, :] * width + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def _starts_within(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which characters start a match. Texts lie side by side in ``points``; text k is ``points[first[k]:end[k]]``."""
    n = len(points)
    kinds = _class_table()[points]
    blank = kinds == BLANK_MORE
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:]
    last[end - 1] = False
    space = points == 0x20
    kinds[last & space] = SPACE_LAST
    kinds[last & ~space] = BLANK_LAST
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        limit = end[np.searchsorted(end, marks, side="right")]
        follow = np.zeros((2, len(marks)), np.uint32)
        for k in (0, 1):
            there = marks + k + 1 < limit
            follow[k, there] = points[marks[there] + k + 1]
        one = np.isin(follow[0], [ord(c) for c in "stmd"])
        two = np.isin(follow[0] << 8 | np.minimum(follow[1], 255), [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        kinds[marks[one]] = CONTRACT_1
        kinds[marks[two & ~one & (follow[0] < 256)]] = CONTRACT_2
    functions = _OF_CLASS[kinds]
    # a text's first character meets no earlier state: its function sends every state where CLOSED goes
    functions[first] = _CONSTANT[_ROWS[functions[first], CLOSED]]
    after = _ROWS[_scan(functions), CLOSED]
    before = np.empty(n, np.uint8)
    before[1:] = after[:-1]
    before[first] = CLOSED
    return _STARTS.ravel()[before * np.intp(10) + kinds]


def boundaries(text: str) -> np.ndarray:
    """Code-point offsets at which matches of the pattern start, and the end of the text.

    The pattern: contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers,
    of other marks, each with one space before it; runs of white space, which leave
    their last character to a match that follows.
    """
    return boundaries_of([text])[0]


class RankEncoder(dict):
    """``encoder[slice]`` is the slice's ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        for word, i in self.rank.items():
            self.words[i] = word
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.frombuffer(b"".join(self.words), np.uint8)  # the bytes of id i are at flat[place[i]:place[i] + sizes[i]]
        self.place = np.cumsum(self.sizes) - self.sizes
        self.packed = {word: i.to_bytes(4, "little") for word, i in self.rank.items()}
        self.by_id = {v: k for k, v in self.packed.items()}
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 40:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> bytes:
        """Join the adjacent pair of lowest rank, the leftmost of equals, while there is one."""
        packed, rank = self.packed, self.rank.get
        if raw in packed:
            return packed[raw]
        if len(raw) > 256:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        far = len(self.words)
        ranks = [rank(a + b, far) for a, b in pairwise(parts)]
        while ranks:
            low = min(ranks)
            if low == far:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [joined := parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(joined + parts[i + 1], far)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + joined, far)
        return b"".join([packed[p] for p in parts])

    def _merge_long(self, raw: bytes) -> bytes:
        """The same over a queue, for slices too long to look through at each step."""
        from heapq import heapify, heappop, heappush

        rank, n = self.rank.get, len(raw)
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, joined = heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(joined + parts[k])) is not None:
                    heappush(heap, (r, i, joined + parts[k]))
            h = before[i]
            if h >= 0 and (r := rank(parts[h] + joined)) is not None:
                heappush(heap, (r, h, parts[h] + joined))
        return b"".join([self.packed[p] for p in parts if p is not None])

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text. Many texts are scanned as one array; a text's end closes its last match."""
        out: list[bytes] = []
        get, k = self.__getitem__, 0
        while k < len(texts):
            size, m = 0, k
            while m < len(texts) and (m == k or size + len(texts[m]) <= SCAN_CHARS):
                size += len(texts[m])
                m += 1
            for text, cuts in zip(texts[k:m], boundaries_of(texts[k:m]), strict=True):
                cuts = cuts.tolist()
                out.append(b"".join([get(text[a:b]) for a, b in pairwise(cuts)]))
            k = m
        return out

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte at which each of packed ids starts, and the end of the last."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])])

    def decode(self, ids: bytes, offsets: np.ndarray | None = None) -> bytes:
        """The bytes that packed ids stand for; ``offsets``: those of the ids, if they are known."""
        at = self.offsets(ids) if offsets is None else offsets
        which = np.frombuffer(ids, "<u4")
        start = np.repeat(self.place[which] - (at[:-1] - at[0]), self.sizes[which])
        return self.flat[start + np.arange(len(start))].tobytes()


def boundaries_of(texts: list[str]) -> list[np.ndarray]:
    """``boundaries`` of each text, found in one scan of all of them.

    Each text starts from the closed state and sees nothing beyond its own end.
    """
    lengths = np.array([len(t) for t in texts], np.intp)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    full = lengths > 0
    where = np.flatnonzero(_starts_within(points, starts[full], ends[full])) if full.any() else starts[:0]
    lo, hi = np.searchsorted(where, starts), np.searchsorted(where, ends)
    return [np.append(where[a:b] - s, n) for a, b, s, n in zip(lo, hi, starts, lengths, strict=True)]


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int), ``offsets`` (array of int: the byte of the text at which each id starts), ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256``, which is over the bytes that come back from the ids.

    A null or empty text has no ids. Repeated rows are encoded each. Columns of those
    names are replaced; all others stay. Memory: one batch and the cache.
    """
    return _encoded(docs, ranks_path, text, True)


def encode_digests(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """As ``encode_documents`` without the ids and offsets themselves, and without the text."""
    return _encoded(docs, ranks_path, text, False)


def _encoded(docs: DataFrame, ranks_path: str, text: str, with_ids: bool) -> DataFrame:
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "offsets"]
    kept = docs.drop(*made).withColumn("__text", F.col(text))
    kept = kept if with_ids else kept.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("__text")).to_pylist()]
            counts, sums, backs, ids, places = [], [], [], [], []
            for packed in encoder.encode_batch(texts):
                counts.append(len(packed) // 4)
                sums.append(hashlib.sha256(packed).hexdigest())
                at = encoder.offsets(packed)
                backs.append(hashlib.sha256(encoder.decode(packed, at)).hexdigest())
                if with_ids:
                    ids.append(packed)
                    places.append(at[:-1].astype(np.int32))
            more = [pa.array(counts, pa.int64()), pa.array(sums), pa.array(backs)]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                more.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                more.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *places]))))
            columns = [(f.name, c) for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([c for _, c in columns] + more, names=[n for n, _ in columns] + made[: len(more)])

    schema = kept.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return map_arrow(kept, run, schema.add("ids", ArrayType(IntegerType())).add("offsets", ArrayType(IntegerType())) if with_ids else schema)


_encoders: dict[str, RankEncoder] = {}


def rank_encoder(path: str) -> RankEncoder:
    if path not in _encoders:
        _encoders[path] = RankEncoder(path)
    return _encoders[path]
