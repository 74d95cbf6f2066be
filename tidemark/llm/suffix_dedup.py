"""Removal of repeated byte strings by distributed suffix sorting.

Every byte that a string of LENGTH bytes covers which also starts anywhere else goes.

A string of LENGTH bytes has a lead: its substring of half its length of least hash. Equal
strings have equal leads at equal places in them, so they meet wherever texts are dealt
by lead. A lead that occurs once belongs to no repeated string. Around each other lead
stands a context, the bytes of all strings that it can lead. Contexts that are equal as a
whole are counted before anything is moved: each is repeated throughout, and one of them
stands for all. The different contexts of one lead form part of a shard, whose suffixes
are sorted by external induction with their common prefixes; a suffix that has LENGTH
bytes in common with a neighbour starts a repeated string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from .common import Stash, map_arrow
from .induced_sort import sort_suffixes

LENGTH = 200
#: A lead is this part of a string: the shorter, the fewer leads there are, and the more often one recurs by chance.
ANCHOR_PART = 2
MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
#: Symbols sorted as one shard; a worker needs about 60 bytes for each at once.
SHARD_SYMBOLS = 2_000_000
#: Leads with more different contexts than this are cut further, by where in the string the lead stands.
HOT_CONTEXTS = 20_000

_ROOT = 0x9E3779B97F4A7C15 ^ 0x5BF03635F0A5B4AC | 1
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)])) for f in (np.uint64(_ROOT), np.uint64(pow(_ROOT, -1, 1 << 64)))]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _window(values: np.ndarray, w: int, best, fill) -> np.ndarray:
    """``best`` of each w values in a row, by blocks: the rest of one block and the start of the next."""
    n = len(values)
    rows = -(-n // w)
    grid = np.full(rows * w, fill, values.dtype)
    grid[:n] = values
    grid = grid.reshape(rows, w)
    left = best.accumulate(grid, axis=1).ravel()
    right = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - w + 1], left[w - 1 : n])


def leads(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: places of its leads, their hashes, hashes of their contexts, and the contexts' ends.

    The lead of a string is its substring of least hash; where several share it, each leads.
    """
    k = length // ANCHOR_PART
    n = len(raw)
    if n < length:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e.astype(np.uint64), e, e
    up, down = _tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = _mix((total[k:] - total[:-k]) * down[: n - k + 1])
    w = length - k + 1
    least = _window(h, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero(_window(padded, w, np.maximum, np.uint64(0)) == h)
    start, end = np.maximum(at - (length - k), 0), np.minimum(at + length, n)
    context = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at - start).astype(np.uint64))
    return at, h[at], context, start, end  # start and end are those of the context


def _utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def find_leads(docs: DataFrame, length: int) -> DataFrame:
    """``lead, context, id, at, start, end`` for each lead of each text. ``docs``: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, lead, context, start, end = leads(_utf8(t), length)
                parts.append((lead.view(np.int64), context.view(np.int64), np.full(len(at), i, np.int64), at.astype(np.int32), start.astype(np.int32), end.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["lead", "context", "id", "at", "start", "end"])

    return map_arrow(docs, run, "lead long, context long, id long, at int, start int, end int")


def cut_contexts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of contexts. ``wanted``: lead, times, id, at, start, end; ``at`` is the lead's place in the bytes."""
    per = wanted.groupBy("id").agg(F.collect_list(F.struct("lead", "times", "at", "start", "end")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids, texts, cuts = (batch.column(k).to_pylist() for k in range(3))
            for i, t, cs in zip(ids, texts, cuts, strict=True):
                raw = _utf8(t)
                for c in cs:
                    for column, v in zip(out, (c["lead"], c["times"], i, c["at"] - c["start"], c["start"], raw[c["start"] : c["end"]]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=["lead", "times", "id", "at", "start", "bytes"])

    return map_arrow(docs.join(per, "id").select("id", "text", "cuts"), run, "lead long, times long, id long, at int, start int, bytes binary")


def repeated_starts(contexts: list[bytes], places: list[tuple[int, int]], times: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Of different contexts: the ranges of starts whose string of ``length`` bytes starts elsewhere too.

    ``places``: text and offset of each, as contexts of one text may overlap and a string is not
    repeated by itself; ``times``: how many places a context stands for.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(int(first[-1]), np.uint16)  # 0 between contexts
    for a, c in zip(first.tolist(), contexts, strict=False):
        text[a : a + len(c)] = np.frombuffer(c, np.uint8).astype(np.uint16) + np.uint16(1)
    order, common = sort_suffixes(text, cap=length)
    run = np.flatnonzero(common < length)  # suffixes of equal strings are side by side
    context = np.searchsorted(first, order, side="right") - 1
    number = {i: k for k, i in enumerate({i for i, _ in places})}
    base = np.array([number[i] << 40 | at for i, at in places], np.int64) - first[:-1]
    place = base[context] + order
    apart = np.minimum.reduceat(place, run) != np.maximum.reduceat(place, run)
    apart |= (np.maximum.reduceat(np.array(times, np.int64)[context], run) > 1) & (np.diff(np.append(run, len(order))) > 1)
    hit = np.zeros(len(text), bool)
    hit[order] = np.repeat(apart, np.diff(np.append(run, len(order))))
    # a common prefix may run over an end; only strings that fit into their context count
    hit &= np.repeat(first[1:], sizes + 1) - 1 - np.arange(len(text)) >= length
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    which = np.searchsorted(first, edge[::2], side="right") - 1
    for c, a, b in zip(which.tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        found[c].append((a - int(first[c]), b - int(first[c])))
    return found


def shared_reach(leads_of: np.ndarray, sides: list[bytes], width: int) -> np.ndarray:
    """How far each of ``sides``, read away from its lead, agrees with any other of the same lead."""
    n = len(sides)
    room = np.array([len(x) for x in sides], np.int64)
    flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sides), np.uint8).reshape(n, width)
    key = np.concatenate([leads_of.astype(">i8").view(np.uint8).reshape(n, 8), flat], axis=1)
    by_room = np.argsort(room, kind="stable")  # of sides that NULs make equal the shorter comes first, as an end is below every byte
    order = by_room[np.argsort(np.ascontiguousarray(key[by_room]).view(f"S{8 + width}").ravel(), kind="stable")]
    rows = flat[order]
    same = rows[1:] == rows[:-1]
    met = np.where(same.all(axis=1), width, same.argmin(axis=1))
    met = np.minimum(met, np.minimum(room[order][1:], room[order][:-1]))
    met[leads_of[order][1:] != leads_of[order][:-1]] = 0
    most = np.zeros(n, np.int64)
    most[:-1] = met
    most[1:] = np.maximum(most[1:], met)
    out = np.empty(n, np.int64)
    out[order] = most
    return out


def trimmed(held: list[tuple], length: int) -> list[tuple[int, int, int, bytes]]:
    """``times, id, start, bytes`` of contexts, less what no string of ``length`` bytes shared within a lead can reach."""
    k = length // ANCHOR_PART
    lead = np.array([h[0] for h in held], np.int64)
    before = shared_reach(lead, [h[5][: h[3]][::-1] for h in held], length - k)
    after = shared_reach(lead, [h[5][h[3] + k :] for h in held], length - k)
    out = []
    for h, b, a in zip(held, before.tolist(), after.tolist(), strict=True):
        if b + k + a >= length:
            out.append((h[1], h[2], h[4] + h[3] - b, h[5][h[3] - b : h[3] + k + a]))
    return out


def sort_shards(contexts: DataFrame, length: int) -> DataFrame:
    """``id, start, end``: repeated bytes found among different contexts. Rows come sorted by lead within a partition.

    Contexts of a lead never leave their shard; a shard takes in leads until it is full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def solve() -> pa.RecordBatch:
            out = ([], [], [])
            kept = trimmed(held, length)
            if kept:
                found = repeated_starts([c[3] for c in kept], [(c[1], c[2]) for c in kept], [c[0] for c in kept], length)
                for (times, i, start, _), ranges in zip(kept, found, strict=True):
                    if times == 1:  # others are repeated throughout, and known to be
                        for a, b in ranges:
                            for column, v in zip(out, (i, start + a, start + b - 1 + length), strict=True):
                                column.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "start", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= SHARD_SYMBOLS:
                    yield solve()
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[5]) + 1
        if held:
            yield solve()

    return map_arrow(contexts, run, "id long, start long, end long")


def remove_bytes(docs: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """``docs`` (row, text, rest) less the bytes of ``spans`` (id, start, end): rest, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, left."""
    per = spans.groupBy(F.col("id").alias("row")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("spans"))
    d = docs.join(per, "row", "left").select("rest", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, texts = [], [], [], [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = _utf8(t)
                kept, at, gone, n = [], 0, 0, 0
                end = -1
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if s[0] > end:
                        n += 1
                        kept.append(raw[at : s[0]])
                        gone += s[1] - s[0]
                    elif s[1] > end:
                        gone += s[1] - end
                    end = at = max(end, s[1])
                kept.append(raw[at:])
                left = b"".join(kept)
                sizes.append(len(raw))
                removed.append(gone)
                runs.append(n)
                digests.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(t if not gone else left.decode("utf-8", "ignore"))
            more = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)] + [pa.array(digests, pa.string())]
            if with_text:
                more.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["rest", *MADE, "left"][: 1 + len(more)])

    schema = StructType([d.schema["rest"]])
    for c in MADE[:-1]:
        schema = schema.add(c, "long")
    schema = schema.add(MADE[-1], "string")
    return map_arrow(d, run, schema.add("left", "string") if with_text else schema)


def repeated_spans(docs: DataFrame, length: int, stash: Stash) -> DataFrame:
    """``id, start, end`` (bytes): spans, which may overlap, whose strings of ``length`` bytes also start elsewhere. ``docs``: id, text."""
    found = stash.save(find_leads(docs, length), "leads")
    # written first, so that the join is nothing but one, and a lead that very many texts have can be split in it
    shared = stash.save(found.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lead"), "again")
    again = stash.save(found.join(shared, "lead"), "shared")
    stash.drop("leads", "again")
    kinds = stash.save(again.groupBy("lead", "context").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "at", "start", "end")).alias("one")), "contexts")
    whole = again.join(kinds.where("times > 1").select("lead", "context"), ["lead", "context"])
    whole = stash.save(whole.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), "whole")
    per_lead = stash.save(kinds.groupBy("lead").agg(F.count(F.lit(1)).alias("n_contexts")).where("n_contexts > 1"), "per-lead")
    mixed = stash.save(kinds.join(per_lead, "lead").select("lead", "times", "one.id", "one.at", "one.start", "one.end", "n_contexts"), "mixed")
    stash.drop("shared", "contexts")
    cut = cut_contexts(mixed.where(F.col("n_contexts") <= HOT_CONTEXTS), docs)
    shards = cut.repartition("lead").sortWithinPartitions("lead")
    sorted_spans = stash.save(sort_shards(shards, length), "sorted")
    hot = mixed.where(F.col("n_contexts") > HOT_CONTEXTS)
    if not hot.isEmpty():
        sorted_spans = sorted_spans.unionByName(stash.save(_hot_spans(cut_contexts(hot, docs), length), "hot"))
    stash.keep("numbered", "whole", "sorted", "hot")
    return whole.unionByName(sorted_spans)


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for leads of very many contexts: dealt by the string itself, and counted before anything is moved."""
    n = F.length("bytes")
    each = contexts.where(n >= length).select("id", "start", "times", "bytes", F.explode(F.sequence(F.lit(0), n - length)).alias("at"))
    each = each.select("id", "times", (F.col("start") + F.col("at")).cast("long").alias("start"), F.md5(F.expr(f"substring(bytes, at + 1, {length})")).alias("string"))
    often = each.groupBy("string").agg(F.max("times").alias("n"), F.min(F.struct("id", "start")).alias("a"), F.max(F.struct("id", "start")).alias("b")).where("n > 1 or a <> b").select("string")
    return each.where("times = 1").join(often, "string").select("id", "start", (F.col("start") + length).alias("end"))


def with_rows(docs: DataFrame, id_column: str, stash: Stash) -> DataFrame:
    """``docs`` (as ``rest``, text) with a number of its own for each row, ``row``.

    Ids that are whole numbers, none null and none repeated, serve as they are. Others, of any type, are
    numbered, and the numbered table is written first, so that a task done again gives no other numbers.
    """
    fields = docs.schema["rest"].dataType
    key = F.col("rest")[id_column]
    kind = fields[id_column].dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        ids = docs.select(key.cast("long").alias("k"))
        if ids.groupBy("k").count().where("count > 1 or k is null").isEmpty():
            return docs.withColumn("row", key.cast("long"))
    return stash.save(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and, unless ``with_text`` is off, the text that is left.

    Texts are UTF-8 bytes; matches never cross texts; strings are judged on the input. Where a cut
    falls inside a character, what is left of the character goes from the returned text too (the
    digest is over the bytes). A null text is empty; so is what is left of it, null. Each row is a text
    of its own, whatever its id: ids may be null, repeated, or of any type, and repeated rows match each
    other. An empty table gives an empty one; columns of the made names are replaced, all others stay.
    """
    names = [c for c in docs.columns if c not in MADE]
    kept = [c for c in names if c != text]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("__some")).alias("rest"), F.col(f"`{text}`").alias("text"))
    stash = Stash(docs.sparkSession, "suffix")
    d = with_rows(d, id_column, stash)
    spans = repeated_spans(d.select(F.col("row").alias("id"), "text"), length, stash)
    out = remove_bytes(d, spans, with_text)
    columns = [F.col("left").alias(c) if c == text else F.col("rest")[c].alias(c) for c in (names if with_text else kept)]
    return out.select(*columns, *MADE)
