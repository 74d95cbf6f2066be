"""Suffix sorting by external induction, with common-prefix values.

Suffixes are of type L or S by whether they are above or below the next one; S* suffixes
are those of type S after one of type L. S* suffixes are sorted first: an induction over
their substrings names them, and the string of names, at most half as long, is solved in
turn. From them all L suffixes follow in one sweep upwards, and from these all S suffixes
in one sweep downwards. Each sweep takes tuples from a priority queue by first character
and by the rank of the next suffix, and queues the tuples of the suffixes before them.

A tuple carries its suffix and the common prefix it has with the tuple queued before it:
one more than the least value met between the two. The queue is a row of first-in
first-out buckets, one a character, as tuples of a character are queued in their order;
what exceeds its memory lies in files and is read back when its bucket is due. Whole
buckets are handled as arrays.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queued tuples held in memory before buckets go to disk: a few, so that a full shard's queue does spill.
QUEUE_BYTES = 4 << 20
NONE = np.uint16(0xFFFF)


class DiskQueue:
    """First-in first-out buckets of (suffix, common prefix), on disk where they exceed ``budget`` bytes."""

    def __init__(self, n_buckets: int, budget: int = QUEUE_BYTES):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n_buckets)]
        self.sizes = np.zeros(n_buckets, np.int64)
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(n_buckets)]
        self.budget, self.used, self.file = budget, 0, None

    def put(self, bucket: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.held[bucket].append((suffixes, common))
        size = suffixes.nbytes + common.nbytes
        self.sizes[bucket] += size
        self.used += size
        while self.used > self.budget:
            self._spill(int(self.sizes.argmax()))

    def _spill(self, bucket: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for suffixes, common in self.held[bucket]:
            self.spilled[bucket].append((self.file.tell(), len(suffixes)))
            self.file.write(suffixes.tobytes())
            self.file.write(common.tobytes())
        self.held[bucket] = []
        self.used -= int(self.sizes[bucket])
        self.sizes[bucket] = 0

    def take(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """All of a bucket, in the order in which it was queued; the bucket is empty afterwards."""
        parts = []
        for at, n in self.spilled[bucket]:
            self.file.seek(at)
            parts.append((np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.uint16)))
        parts += self.held[bucket]
        self.spilled[bucket], self.held[bucket] = [], []
        self.used -= int(self.sizes[bucket])
        self.sizes[bucket] = 0
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _RangeMin:
    """Least value of any range of an array, after n log n preparation."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of [a, b), all non-empty."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << int(k))])
        return out


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are of type S, and the length of the run of equal characters at each place (at most 65534)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change + 1, n)  # end of each run
    which = np.searchsorted(ends, np.arange(n), side="right")
    rises = np.zeros(len(ends), bool)
    rises[:-1] = text[change] < text[change + 1]
    return rises[which], np.minimum(ends[which] - np.arange(n), 65534).astype(np.uint16)


def _sweep(text, own, up, n_chars, seeds, seed_common, cap, budget):
    """One sweep. ``own``: suffixes it induces; ``up``: by rising character. ``seeds(c)``: the suffixes known beforehand of a
    character, in sweep order, that follow the induced ones; yields (character, suffixes, common prefix with the one before, induced)."""
    queue = DiskQueue(n_chars, budget)
    since = np.full(n_chars, NONE)  # least common prefix met since a bucket was last put into
    chars = range(n_chars) if up else range(n_chars - 1, -1, -1)

    def feed(c: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        nonlocal since
        before = suffixes - 1
        good = np.flatnonzero(suffixes > 0)
        good = good[own[before[good]]]
        least = common.min() if cap else 0
        if not len(good):
            since = np.minimum(since, least)
            return
        target = text[before[good]]
        order = np.argsort(target, kind="stable")
        target, place = target[order], good[order]
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        heads = target[first].astype(np.int64)
        if not cap:  # the order alone is asked for
            moved = before[place]
            for h, a, b in zip(heads.tolist(), first.tolist(), [*first[1:].tolist(), len(place)], strict=True):
                queue.put(h, moved[a:b], common[a:b])
            return
        start = np.empty(len(place), np.int64)
        start[1:] = place[:-1] + 1
        start[first] = 0
        least_between = _RangeMin(common)(start, place + 1)
        least_between[first] = np.minimum(least_between[first], since[heads])
        value = np.minimum(least_between, cap - 1).astype(np.uint16) + np.uint16(1)
        last = np.append(first[1:], len(place)) - 1
        since = np.minimum(since, least)
        tails = place[last] + 1
        since[heads] = NONE
        inner = tails < len(common)
        if inner.any():
            since[heads[inner]] = _RangeMin(common)(tails[inner], np.full(int(inner.sum()), len(common), np.int64))
        moved = before[place]
        for h, a, b in zip(heads.tolist(), first.tolist(), (last + 1).tolist(), strict=True):
            queue.put(h, moved[a:b], value[a:b])

    try:
        for c in chars:
            fresh = True  # nothing of this character has come out yet
            while True:
                suffixes, common = queue.take(c)
                if not len(suffixes):
                    break
                if fresh:
                    common = common.copy()
                    common[0] = 0
                    fresh = False
                yield c, suffixes, common, True
                feed(c, suffixes, common)
            suffixes, common = seeds(c)
            if len(suffixes):
                common = common.copy()
                common[0] = 0 if fresh else NONE  # NONE: the caller's seam
                if not fresh:
                    common[0] = seed_common(c, suffixes[0])
                yield c, suffixes, common, False
                feed(c, suffixes, common)
    finally:
        queue.close()


def _induce(text, rising, runs, stars, star_common, n_chars, cap, budget):
    """From S* suffixes in order: all suffixes in order, with capped common prefixes. Both sweeps."""
    star_char = text[stars]
    star_from = np.searchsorted(star_char, np.arange(n_chars + 1))
    falls: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n_chars)]
    last_of = {}

    def star_seeds(c):
        a, b = star_from[c], star_from[c + 1]
        return stars[a:b], star_common[a:b]

    def seam_up(c, first):
        return np.uint16(min(cap, int(min(runs[last_of[c]], runs[first]))))

    for c, suffixes, common, induced in _sweep(text, ~rising, True, n_chars, star_seeds, seam_up, cap, budget):
        if induced:
            falls[c].append((suffixes, common))
            last_of[c] = suffixes[-1]
    out = []
    low_of = {}

    def fall_seeds(c):
        if not falls[c]:
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        s = np.concatenate([x[0] for x in falls[c]])
        m = np.concatenate([x[1] for x in falls[c]])
        falls[c] = []
        # downwards, a suffix's value is with the one above it
        return s[::-1], np.concatenate([np.zeros(1, np.uint16), m[:0:-1]])

    def seam_down(c, first):
        return np.uint16(min(cap, int(min(runs[low_of[c]], runs[first]))))

    for c, suffixes, common, induced in _sweep(text, rising, False, n_chars, fall_seeds, seam_down, cap, budget):
        if induced:
            low_of[c] = suffixes[-1]
        out.append((suffixes, common))
    out.append((np.array([len(text) - 1]), np.zeros(1, np.uint16)))  # the end, which nothing induces
    order = np.concatenate([x[0] for x in out])[::-1]
    down = np.concatenate([x[1] for x in out])
    return order, np.concatenate([np.zeros(1, np.uint16), down[:0:-1]])


def _sort_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string over a large alphabet in order, by doubling the length that ranks stand for.

    A rank is the number of suffixes before the first of its group; only groups of more than one are sorted again.
    """
    n = len(names)
    order = np.argsort(names)
    head = np.concatenate([[True], names[order][1:] != names[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    width = 1
    while True:
        single = head & np.append(head[1:], True)
        tied = np.flatnonzero(~single)  # places in the order
        if not len(tied) or width >= n:
            return order
        members = order[tied]
        after = members + width
        following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[members] * np.int64(n + 1) + following
        by = np.argsort(key)
        members, key = members[by], key[by]
        order[tied] = members
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[tied] = fresh
        rank[members] = np.maximum.accumulate(np.where(fresh, tied, 0))
        width *= 2


class _Packed:
    """As many characters from each place on as fit into 63 bits, the first lowest; beyond the end all bits are set."""

    def __init__(self, text: np.ndarray, n_chars: int):
        self.bits = max(9, n_chars.bit_length())
        self.step = 63 // self.bits
        n = len(text)
        wide = np.concatenate([text.astype(np.uint64), np.full(self.step, (1 << self.bits) - 1, np.uint64)])
        self.words = wide[:n].copy()
        for k in range(1, self.step):
            self.words |= wide[k : n + k] << np.uint64(k * self.bits)

    def common(self, a: np.ndarray, b: np.ndarray, cap: int | np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of different suffixes, at most ``cap``. The text's last character is nowhere else in it."""
        out = np.zeros(len(a), np.int64)
        limit = np.broadcast_to(np.asarray(cap, np.int64), out.shape)
        live, done = np.arange(len(a)), 0
        a, b, words = a.astype(np.int64), b.astype(np.int64), self.words
        while len(live):
            x = words[a] ^ words[b]
            apart = x != 0
            if apart.any():
                at = np.flatnonzero(apart)
                y = x[at]
                out[live[at]] = done + np.bitwise_count((y & (~y + np.uint64(1))) - np.uint64(1)).astype(np.int64) // self.bits
            done += self.step
            on = ~apart
            full = on & (limit[live] <= done)
            out[live[full]] = done
            on &= ~full
            live, a, b = live[on], a[on] + self.step, b[on] + self.step
        return np.minimum(out, limit)


def _star_prefixes(packed: _Packed, stars: np.ndarray, ordered: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each of ``ordered`` with the one before it; ``stars``: the same places, rising.

    If d after the suffix before a place there is one of ``stars`` too, the place d further on has at most d less
    in common with the suffix before it. So only every eighth place is compared from its start, and those after
    it from where that bound ends.
    """
    common = np.zeros(len(stars), np.uint16)
    if len(stars) < 2:
        return common
    before = np.empty(len(stars), np.int64)  # by place: the suffix before it in order; the first one's is itself
    rank = np.empty(len(stars), np.int64)
    rank[np.searchsorted(stars, ordered)] = np.arange(len(stars))
    before[:] = ordered[np.maximum(rank - 1, 0)]
    known = np.zeros(len(stars), np.int64)
    some = np.arange(0, len(stars), 8)
    some = some[rank[some] > 0]
    known[some] = packed.common(stars[some], before[some], cap)
    last = np.zeros(len(stars), np.int64)
    last[some] = some
    last = np.maximum.accumulate(last)
    rest = np.ones(len(stars), bool)
    rest[some] = False
    rest = np.flatnonzero(rest & (rank > 0))
    further = stars[rest] - stars[last[rest]]
    least = np.maximum(known[last[rest]] - further, 0)
    is_star = np.zeros(int(stars[-1]) + 2, bool)
    is_star[stars] = True
    least[~is_star[np.minimum(before[last[rest]] + further, len(is_star) - 1)]] = 0
    known[rest] = least + packed.common(stars[rest] + least, before[rest] + least, cap - least)
    common[rank] = known
    common[0] = 0
    return common


def sort_suffixes(text: np.ndarray, cap: int = 65534, budget: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (small non-negative integers) in order; each one's common prefix with the one before, at most ``cap``.

    A suffix that ends comes before those it starts. An empty text has none.
    """
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    text = np.append(text.astype(np.uint16) + np.uint16(1), np.uint16(0))  # an end below all characters
    n_chars = int(text.max()) + 1
    rising, runs = _types(text)
    rising[-1] = True
    stars = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    # substrings between S* places are sorted by inducing from S* places by first character alone
    by_char = stars[np.argsort(text[stars], kind="stable")]
    order, _ = _induce(text, rising, runs, by_char, np.zeros(len(stars), np.uint16), n_chars, 0, budget)
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    by_piece = order[is_star[order]]
    ends = np.append(stars[1:] + 1, len(text))
    length = np.zeros(len(text), np.int64)
    length[stars] = ends - stars
    # equal neighbours are one name
    packed = _Packed(text, n_chars)
    a, b = by_piece[:-1], by_piece[1:]
    equal = length[a] == length[b]
    maybe = np.flatnonzero(equal)
    if len(maybe):
        size = length[a[maybe]]
        equal[maybe] = packed.common(a[maybe], b[maybe], size) >= size
    name = np.zeros(len(text), np.int64)
    name[by_piece] = np.cumsum(np.concatenate([[0], ~equal]))
    if len(stars) > 1 and equal.any():
        sorted_stars = stars[_sort_names(name[stars])]
    else:
        sorted_stars = by_piece
    common = _star_prefixes(packed, stars, sorted_stars, cap)
    order, common = _induce(text, rising, runs, sorted_stars, common, n_chars, cap, budget)
    return order[1:], common[1:]
