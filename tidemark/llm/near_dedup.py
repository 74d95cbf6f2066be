"""Near-duplicate classes by Order MinHash.

A text is its sequence of five-word shingles, each labelled with how often it occurred
before. A sketch takes the labelled shingles of the two least hash values and keeps them
in the order in which they stand in the text, so it agrees with probability near the
edit similarity, not the set similarity. Each sketch is a band; texts that agree in a
band, and whose lengths allow the similarity, meet in a bucket. A candidate pair is
verified by aligning its words within a band around the diagonal: words matched in
order over the words of the longer text, at least 0.8.

Equal texts are one representative from the start. Members of a bucket are aligned with
the bucket's least member first. What is left in more than one class is compared across
classes, all pairs of every bucket: in those of at most COLD members each pair is a row and is
verified; larger ones are settled in cells of their members, see ``crowded_links``, where no pair
becomes a row and none is lost: a cell gives the links that join its classes, fewer than it has
members. So groups of thousands of copies cost one alignment a copy, and texts that merely share
a passage some machine words a pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import Stash, map_arrow
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
#: In buckets of at most so many members pairs are rows; larger ones are settled in cells.
COLD = 32
#: Members of a large bucket meet in blocks of about so many, and of about so many words.
CROWD_BLOCK = 1024
CROWD_WORDS = 1 << 20
#: Bits of the marks of a long text.
MARK_BITS = 1 << 16
#: Texts whose words a worker keeps while it verifies pairs.
MEMO_TEXTS = 500
#: Words that a worker keeps split while it settles a cell.
MEMO_WORDS = 1 << 19

_GAPS = bytes(0x20 if b <= 0x20 else b for b in range(256))
_rng = np.random.default_rng(20240917)
_FACTORS = _rng.integers(1, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space and control characters."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_GAPS).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)])) for f in (np.uint64(_ROOT), np.uint64(pow(_ROOT, -1, 1 << 64)))]
    return _powers[0], _powers[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _tables(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)])])
    return _mix((total[ends] - total[starts]) * down[starts] + lengths.astype(np.uint64))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of which each is mixed with how often it occurred before."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return h
    run = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), run, 0))
    seen = np.empty(len(h), np.uint64)
    seen[order] = (run - first).astype(np.uint64)
    return np.where(seen > 0, _mix(h + seen * np.uint64(0x632BE59BD9B4E019)), h)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the five-word shingles, labelled by occurrence; of all words as one if there are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    word = word_hashes(words)
    k = min(SHINGLE, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = (h + word[i : n - k + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
    return labelled(_mix(h))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key a band: the order-keeping sketches of the labelled shingles."""
    n = len(h)
    first = np.empty(len(_FACTORS), np.int64)
    second = np.empty(len(_FACTORS), np.int64)
    block = max(1, (1 << 18) // n)
    for a in range(0, len(_FACTORS), block):
        x = h[None, :] * _FACTORS[a : a + block, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        rows = np.arange(len(x))
        i = x.argmin(axis=1)
        if n > 1:
            x[rows, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
            j = x.argmin(axis=1)
        else:
            j = i
        first[a : a + block], second[a : a + block] = np.minimum(i, j), np.maximum(i, j)
    sketch = _mix(h[first] * np.uint64(0x9FB21C651E98DF25) + _mix(h[second]))
    return _mix(sketch + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def aligned_similarity(a: list[bytes], b: list[bytes], least: float = SIMILARITY) -> float:
    """Words that the best alignment in a band matches, over the words of the longer text; 0 where it is below ``least`` for certain.

    The band is as wide as a pair that is similar enough can stray from the diagonal, so for such a pair the value is exact.
    """
    nx, ny = len(a), len(b)
    most = max(nx, ny)
    need = math.ceil(least * most - 1e-9)
    if not min(nx, ny) or min(nx, ny) < need:
        return 0.0
    head = 0
    while head < min(nx, ny) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(nx, ny) - head and a[nx - 1 - tail] == b[ny - 1 - tail]:
        tail += 1
    u, v = a[head : nx - tail], b[head : ny - tail]
    matched = head + tail
    if u and v:
        width = most - need + 1
        where: dict[bytes, int] = {}
        for i, s in enumerate(u):
            where[s] = where.get(s, 0) | 1 << i
        full = (1 << len(u)) - 1
        band = (1 << 2 * width + 1) - 1
        row = full
        for j, s in enumerate(v):  # one row of the alignment at a time, all columns of the band at once
            m = where.get(s)
            if m:
                m &= band << j - width if j >= width else band >> width - j
                hit = row & m
                row = ((row + hit) | (row - hit)) & full
        matched += len(u) - row.bit_count()
    return matched / most if matched >= need else 0.0


def length_class(n: int, least: float = SIMILARITY) -> int:
    """Texts of which the shorter has at least ``least`` of the other's words are in one class or in neighbouring ones."""
    return math.floor(math.log(n) / -math.log(least) + 1e-9)


def sketch_documents(docs: DataFrame, id_column: str, text: str, least: float = SIMILARITY) -> DataFrame:
    """``id, sig, keys, n, lc``: a digest of the words, the band keys (null for a text without words), the number of words, and its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, keys, sizes = [], [], []
            for t in batch.column(1).to_pylist():
                words = normal_words(t)
                sigs.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                keys.append(band_keys(shingle_hashes(words)) if words else None)
                sizes.append(len(words))
            flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
            offsets = pa.array(np.concatenate([[0], np.cumsum([0 if k is None else BANDS for k in keys])]).astype(np.int32))
            columns = [pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(sizes, pa.int32()), pa.array([length_class(n, least) if n else 0 for n in sizes], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "sig", "keys", "n", "lc"])

    source = docs.select(F.col(id_column).alias("id"), text)
    schema = StructType([StructField("id", source.schema["id"].dataType)])
    return map_arrow(source, run, schema.add("sig", "binary").add("keys", ArrayType(LongType())).add("n", "integer").add("lc", "integer"))


def word_marks(words: list[bytes]) -> bytes:
    """Bits at the hashes of the words, each labelled with how often it occurred before: between two and four bits a word, up to ``MARK_BITS``."""
    marks = np.zeros(min(MARK_BITS, max(64, 1 << (2 * len(words) - 1).bit_length())), bool)
    marks[labelled(word_hashes(words)) & np.uint64(len(marks) - 1)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def crowded_links(hot: DataFrame, groups: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a, b, similarity`` (a < b): links that join all classes which similar pairs of one bucket join. ``hot``: key, l, rep, n, lc, c, size, longest. ``groups``: id, keys. ``texts``: id, text.

    Large buckets meet in cells of two blocks of members, so no task gets all of one. A cell looks at each pair of
    classes not joined yet. Its marks come first: a bit that only one text of a pair has stands for a word of it that the
    other lacks, and that no alignment matches, so a pair with more such bits than the similarity leaves it words is out
    for certain, and no other is. Then the words both have, then the alignment. Of the buckets in which a pair meets one
    looks at it: that of a band they share, of those the next from a place that differs by pair, which spreads the work.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([word_marks(normal_words(t)) for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "text", "keys", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        t = t.take(pc.sort_indices(t["text"])).combine_chunks()  # the same links in each run
        marks = [np.frombuffer(m, np.uint64) for m in t["marks"].to_pylist()]
        width = min(map(len, marks))  # powers of two; wider marks are folded, as places are remainders
        bits = np.ascontiguousarray(np.array([np.bitwise_or.reduce(m.reshape(-1, width)) for m in marks]).T)
        ones = np.bitwise_count(bits).sum(axis=0, dtype=np.int32)
        n, side, spin = t["n"].to_numpy(), t["side"].to_numpy(), t["spin"].to_numpy()
        keys = np.array(t["keys"].to_pylist(), np.int64)
        key, alone = t["key"][0].as_py(), t["alone"][0].as_py()
        upper = t["lc"].to_numpy() == t["l"].to_numpy()
        c = t["c"].combine_chunks().dictionary_encode()
        c = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy()
        joined = list(range(len(c)))
        bags: dict[int, np.ndarray] = {}
        memo: dict[int, list[bytes]] = {}
        held = 0

        def root(k: int) -> int:
            while joined[k] != k:
                joined[k] = k = joined[joined[k]]
            return k

        def words(k: int) -> list[bytes]:
            nonlocal held
            if k not in memo:
                if held > MEMO_WORDS:
                    memo.clear()
                    held = 0
                memo[k] = normal_words(t["text"][k].as_py())
                held += len(memo[k])
            return memo[k]

        def bag(k: int) -> np.ndarray:
            if k not in bags:
                bags[k] = np.sort(labelled(word_hashes(words(k))))
            return bags[k]

        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        y = x if alone else y
        left, right, values = [], [], []
        for i0 in range(0, len(x), 64):
            i = x[i0 : i0 + 64, None]
            j = y[None, :]
            common = np.zeros((len(i), len(y)), np.int32)
            for row in bits:
                common += np.bitwise_count(row[i] & row[j])
            need = np.ceil(least * np.maximum(n[i], n[j]) - 1e-9)
            may = (c[i] != c[j]) & (upper[i] | upper[j]) & (n[i] - (ones[i] - common) >= need) & (n[j] - (ones[j] - common) >= need)
            if alone:
                may &= i < j
            p, q = np.nonzero(may)
            p, q = x[p + i0], y[q]
            turn = (np.arange(BANDS) - (spin[p] + spin[q])[:, None]) % BANDS
            band = np.where(keys[p] == keys[q], turn, BANDS).argmin(axis=1)
            here = (keys[p, band] == key) & (keys[q, band] == key)
            for u, v in zip(p[here].tolist(), q[here].tolist(), strict=True):
                cu, cv = root(c[u]), root(c[v])
                if cu == cv or len(np.intersect1d(bag(u), bag(v), assume_unique=True)) < least * max(n[u], n[v]) - 1e-9:
                    continue
                s = aligned_similarity(words(u), words(v), least)
                if s >= least:
                    joined[cu] = cv
                    left.append(u)
                    right.append(v)
                    values.append(s)
        rep = t["rep"].combine_chunks()
        yield pa.RecordBatch.from_arrays([rep.take(pa.array(left, pa.int64())), rep.take(pa.array(right, pa.int64())), pa.array(values, pa.float64())], names=["a", "b", "similarity"])

    # a pair of one length class meets in two buckets, of which that of their class counts
    hot = hot.join(hot.where("lc = l").select("key", "l").distinct(), ["key", "l"], "left_semi")
    kits = texts.join(hot.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "text").join(groups.select("id", "keys"), "id")
    kits = map_arrow(kits, marked, StructType(list(kits.schema)).add("marks", "binary"))
    rows = hot.withColumn("blocks", F.ceil(F.greatest(F.col("size") / CROWD_BLOCK, F.col("size") * F.col("longest") / CROWD_WORDS)).cast("int"))
    rows = rows.join(kits, F.col("rep") == F.col("id")).drop("id").withColumn("hash", F.xxhash64("rep"))
    rows = rows.withColumn("blk", F.pmod("hash", "blocks").cast("int")).withColumn("spin", F.pmod(F.shiftright("hash", 32), F.lit(BANDS)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "l", F.least("blk", "other").alias("low"), F.greatest("blk", "other").alias("high"), (F.col("blk") > F.col("other")).cast("int").alias("side"), (F.col("blk") == F.col("other")).alias("alone"), "rep", "n", "lc", "c", "spin", "marks", "keys", "text")
    kind = hot.schema["rep"].dataType
    met = rows.groupBy("key", "l", "low", "high").applyInArrow(run, StructType([StructField("a", kind), StructField("b", kind)]).add("similarity", "double"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def verify_pairs(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a, b, similarity`` of the pairs that are similar enough. ``texts``: id, text. A text travels once for each pair it is the higher id of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}

        def prepared(i, text: str) -> tuple[list[bytes], np.ndarray]:
            if i not in memo:
                if len(memo) >= MEMO_TEXTS:
                    memo.clear()
                words = normal_words(text)
                memo[i] = words, np.sort(labelled(word_hashes(words)))
            return memo[i]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found, values = [], []
            for i in range(len(a)):
                x, hx = prepared(a[i], left[i])
                y, hy = prepared(b[i], right[i])
                # words that both have: no alignment matches more, and equal hashes of different ones only add to it
                if len(np.intersect1d(hx, hy, assume_unique=True)) < least * max(len(x), len(y)) - 1e-9:
                    continue
                s = aligned_similarity(x, y, least)
                if s >= least:
                    found.append(i)
                    values.append(s)
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(values, pa.float64())], names=["a", "b", "similarity"])

    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    joined = joined.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return map_arrow(joined, run, StructType([joined.schema["a"], joined.schema["b"]]).add("similarity", "double"))


def similar_links(groups: DataFrame, texts: DataFrame, least: float, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b, similarity`` between different texts, and ``id, label`` of what they connect. ``groups``: id, keys, n, lc."""
    # matched words are at most those of the shorter text, so pairs of too different lengths can't be similar
    may = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9
    single = groups.select(F.col("id").alias("rep"), "n", "lc", F.posexplode("keys").alias("band", "key"))
    shared = stash.save(single.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "keys")
    members = single.join(shared, "key").select("key", "band", "rep", "n", "lc", F.col("rep").alias("c"))
    members = stash.save(members.select("*", F.explode(F.array("lc", F.col("lc") + 1)).alias("l")), "members-1")
    near_texts = stash.save(texts.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "texts")
    links, tried = [], []
    together = lambda parts: reduce(DataFrame.unionByName, parts)

    def attempt(pairs: DataFrame, name: str) -> bool:
        """Verify the pairs that were not tried; whether any are similar."""
        pairs = pairs.distinct()
        if tried:
            pairs = pairs.join(together(tried), ["a", "b"], "left_anti")
        tried.append(stash.save(pairs, f"pairs-{name}"))
        links.append(stash.save(verify_pairs(tried[-1], near_texts, least), f"links-{name}"))
        return not links[-1].isEmpty()

    first = members.groupBy("key", "l").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rep", "n")).alias("f")).where("size > 1")
    first = stash.save(first.select("key", "l", F.col("f.rep").alias("a"), F.col("f.n").alias("na")), "first")
    to_first = members.join(first, ["key", "l"]).where((F.col("rep") != F.col("a")) & may(F.col("n"), F.col("na")))
    labels = None
    if attempt(to_first.select("a", F.col("rep").alias("b")), "first"):
        labels = components(links[0], stash, "labels-first")
        members = members.drop("c").join(labels, F.col("rep") == F.col("id"), "left").withColumn("c", F.coalesce("label", "rep")).drop("id", "label")
    members = stash.save(members, "members-labelled")
    # only what is left of a bucket in more than one class
    sized = members.groupBy("key", "l").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("n").alias("longest")).where("c0 <> c1").select("key", "l", "size", "longest")
    buckets = stash.save(members.join(stash.save(sized, "sized"), ["key", "l"]), "buckets")
    cold = buckets.where(F.col("size") <= COLD).select("key", "l", "rep", "n", "lc", "c")
    x, y = cold.alias("x"), cold.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.l") == F.col("y.l")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")) & may(F.col("x.n"), F.col("y.n"))
    on = on & (F.col("x.l") == F.greatest("x.lc", "y.lc"))  # a pair of one length class meets twice
    rest = x.join(y, on).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    more = attempt(rest, "rest")
    hot = buckets.where(F.col("size") > COLD)
    if not hot.isEmpty():
        found = crowded_links(hot, groups, near_texts, least).join(tried[-1], ["a", "b"], "left_anti")
        links.append(stash.save(found, "links-crowded"))
        more = not links[-1].isEmpty() or more
    if more:
        labels = components(together(links), stash, "labels")
    return stash.save(together(links), "links"), None if labels is None else stash.save(labels, "labels-last")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, class_id, copy_of, links_tried``, a row for each distinct non-null id of ``docs``.

    ``class_id``: the least id among all documents that links or equal words connect;
    ``copy_of``: the least id of those with equal words; ``links_tried``: similar texts
    among those the search compared it with, which stops once classes are known, so not all there are.
    A null, empty or blank text is in a class of its own. Rows with a null id have no row. Of rows with one id
    the first text by value counts, a null last. Ids may be of any type that has an order. An empty table gives
    an empty one. Texts of fewer than five words are one shingle. Columns other than the id are not returned.
    """
    stash = Stash(docs.sparkSession, "near")
    source = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("id is not null")
    if _repeats(source, "id"):  # from here on all steps see the same text of an id
        source = stash.save(source.groupBy("id").agg(F.min("text").alias("text")), "one-text")
    sketched = stash.save(sketch_documents(source, "id", "text", least), "sketches")
    groups = sketched.where("sig is not null").groupBy("sig").agg(F.min(F.struct("id", "keys", "n", "lc")).alias("r"))
    groups = stash.save(groups.select("sig", "r.id", "r.keys", "r.n", "r.lc"), "groups")
    links, labels = similar_links(groups, source, least, stash)
    stash.keep("sketches", "groups", "links", "labels-last")
    reps = groups.select("sig", F.col("id").alias("rep"))
    if labels is None:
        reps = reps.select("sig", "rep", F.col("rep").alias("class_id"))
    else:
        reps = reps.join(labels, F.col("rep") == F.col("id"), "left").select("sig", "rep", F.coalesce("label", "rep").alias("class_id"))
    counted = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("links_tried"))
    reps = reps.join(counted, reps["rep"] == counted["id"], "left").select("sig", "rep", "class_id", "links_tried")
    out = sketched.select("id", "sig").join(reps, "sig", "left")
    return out.select(
        F.col("id").alias(id_column), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("rep", "id").alias("copy_of"), F.coalesce("links_tried", F.lit(0)).cast("long").alias("links_tried")
    )


def _repeats(source: DataFrame, id_column: str) -> bool:
    return not source.groupBy(id_column).count().where("count > 1").isEmpty()
