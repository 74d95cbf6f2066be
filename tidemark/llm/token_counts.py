"""Token counts of a piece model by heap-and-linked-list pair merging.

Text becomes code points with blanks written as U+2581. A priority queue holds
adjacent pairs by (rank, position); the lowest-rank pair is popped, its two
symbols are joined in a doubly linked list, and the new neighbours are queued.
The count is the number of initial symbols less the number of merges, plus the
extra bytes of symbols outside the vocabulary. No identifier is ever produced.

Merges cannot cross the seam between a non-blank and a following blank, nor a
line feed, as no piece holds such a sequence (checked when the model is read).
So the text is cut there and each cut's count is kept in a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

BLANK = "▁"
#: Cuts whose counts are remembered by one worker, in each of two generations.
CACHE_ENTRIES = 400_000
#: Longer cuts are counted anew each time, so that the cache holds words, not lines of scripts without blanks.
CACHED_LENGTH = 40
#: Marks that often follow a word; they are counted apart where no piece holds the seam.
MARKS = ".,;:!?*#$%&|)]}"
TOKEN_LIMIT = 4096
#: A queue entry is one integer: rank, place of the left symbol, joined symbol.
ID_BITS, PLACE_BITS = 20, 40
ID_MASK, PLACE_MASK = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1

_models: dict[str, "PieceCounter"] = {}


class PieceCounter(dict):
    """Counts of cuts: ``counter[cut]`` is the number of tokens of a cut that a blank precedes;
    a cut written with a leading line feed stands at the start of a later line, without a blank."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in usable}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in score):
            raise ValueError("the model has pieces across the cuts this counter makes")
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.symbol = {p: k for k, p in enumerate(sorted(score.keys() | {c for p in score for c in p}), 1)}
        if len(self.symbol) >= 1 << ID_BITS:
            raise ValueError("the vocabulary is larger than a queue entry's field")
        self.known = {c for c in self.symbol if c in score and len(c) == 1}
        # pair of symbols -> its part of a queue entry: rank above, joined symbol below, the place between left open
        self.pair = {}
        for piece, value in score.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if left and right:
                    self.pair[left << ID_BITS | right] = order[value] << ID_BITS + PLACE_BITS | self.symbol[piece]
        self.seams = {p[i : i + 2] for p in score for i in range(len(p) - 1)}
        self.old: dict[str, int] = {}

    def __missing__(self, cut: str) -> int:
        n = self.old.get(cut)
        if n is None:
            stem = cut.rstrip(MARKS)
            if len(stem) < len(cut) and stem.strip(" \n") and stem[-1] + cut[len(stem)] not in self.seams:
                n = self[stem] + self["\n" + cut[len(stem) :]]  # no merge crosses there
            else:
                n = self.count_symbols(cut[1:] if cut[:1] == "\n" else BLANK + cut.replace(" ", BLANK))
        if len(cut) <= CACHED_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[cut] = n
        return n

    def count_symbols(self, text: str) -> int:
        n, known = len(text), self.known
        extra = 0
        if not known.issuperset(text):
            extra = sum(len(c.encode()) - 1 for c in text if c not in known)
        if n > 1 << PLACE_BITS:
            raise ValueError("a cut is longer than a queue entry's field")
        pair, symbol = self.pair.get, list(map(self.symbol.get, text, repeat(0)))
        # queued[i]: the entry that stands in the queue for the pair that starts at i; others there are out of date
        queued = [(v | i << ID_BITS) if (v := pair(a << ID_BITS | b)) is not None else None for i, (a, b) in enumerate(pairwise(symbol))]
        heap = [e for e in queued if e is not None]
        if not heap:
            return n + extra
        queued.append(None)
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = 0
        while heap:
            entry = heappop(heap)
            i = entry >> ID_BITS & PLACE_MASK
            if queued[i] != entry:
                continue
            merges += 1
            j = after[i]
            joined = symbol[i] = entry & ID_MASK
            queued[j] = queued[i] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (v := pair(joined << ID_BITS | symbol[k])) is not None:
                    queued[i] = v = v | i << ID_BITS
                    heappush(heap, v)
            h = before[i]
            if h >= 0:
                if (v := pair(symbol[h] << ID_BITS | joined)) is not None:
                    queued[h] = v = v | h << ID_BITS
                    heappush(heap, v)
                else:
                    queued[h] = None
        return n - merges + extra

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if BLANK in text:
            text = text.replace(BLANK, " ")
        total, get = 0, self.__getitem__
        first = True
        for line in text.split("\n"):
            if not first:
                total += 1  # the line feed itself, a single byte
                if not line:
                    continue
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                total += self._count_spaced(line, first)
            else:
                words = line.split(" ")
                if first:
                    total += sum(map(get, words)) if line else self.count_symbols(BLANK)
                else:
                    total += get("\n" + words[0])
                    total += sum(map(get, words[1:]))
            first = False
        return total

    def _count_spaced(self, line: str, first: bool) -> int:
        """A line with blanks in a row or at its ends: a run of blanks goes with the word after it."""
        total, blanks, get = 0, -1 if not first else 0, self.__getitem__
        # blanks: how many spaces stand before the next word, less the one that every cut implies
        for k, word in enumerate(line.split(" ")):
            if k:
                blanks += 1
            if word:
                total += get("\n" + word) if blanks < 0 else get(" " * blanks + word)
                blanks = -1
        if blanks >= 0:
            total += get(" " * blanks)
        return total


def piece_counter(path: str) -> PieceCounter:
    if path not in _models:
        _models[path] = PieceCounter(path)
    return _models[path]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to ``docs``.

    A null or empty text has no tokens. Repeated rows are counted each. Columns of
    those names are replaced; all others stay. Memory: one batch and the cache.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = docs.drop(*made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            counts = [counter.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "__text"] + [pa.array(counts, pa.int64())],
                names=[f.name for f in batch.schema if f.name != "__text"] + ["n_tokens"],
            )

    counted = kept.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "__text": F.col(text)})
    schema = counted.drop("__text").schema.add("n_tokens", "long")
    return map_arrow(counted, run, schema).withColumn("over_limit", F.col("n_tokens") > token_limit)
