"""Signatures and the similarity tier."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BITS = 64


def bits(vector: Column) -> Column:
    """The signs of 64 numbers as one long."""
    ones = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _cells(rows: DataFrame, key: str, block_rows: int) -> tuple[DataFrame, int]:
    """``rows`` with ``cell, side``, and the number of blocks: of every two blocks of about ``block_rows`` rows one cell has both.

    A row goes to one cell for each block, so the rows of two blocks are what a cell holds. ``side`` is 0 and 1 for the
    lower and the upper block; a cell of one block has only side 0.
    """
    n = rows.count()
    blocks = max(1 + min(7, n // 1024), -(-n // block_rows))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("blk", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("other", other)
    dealt = dealt.withColumn("cell", F.least("blk", "other") * blocks + F.greatest("blk", "other")).withColumn("side", (F.col("blk") > F.col("other")).cast("int"))
    return dealt.drop("blk", "other"), blocks


def _by_cell(dealt: DataFrame, blocks: int, keys: list[str]) -> GroupedData:
    """Cells take about the same time, so they are dealt to more partitions than there are cells, and those are not merged by their few bytes."""
    cells = blocks * (blocks + 1) // 2
    return dealt.repartition(cells + min(3 * cells, 200), *keys).groupBy(*keys)


def _compare_codes(codes: DataFrame, most: int, linked: bool, block_rows: int) -> DataFrame:
    """``x, y, distance`` of pairs of codes within ``most`` bits: all, or if ``linked`` only as many as connect what all of them connect in a cell."""
    tile, chunk = 4096, 64  # so that a tile of differences stays in the processor's cache

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        code, side = t["code"].to_numpy(), t["side"].to_numpy()
        low, high = code[side == 0].view(np.uint64), code[side == 1].view(np.uint64)
        alone = not t["cell"][0].as_py() % (blocks + 1)  # both blocks are one
        base = 0 if alone else len(low)
        high = low if alone else high
        both = low if alone else np.concatenate([low, high])
        label = np.arange(len(both))
        parent = list(range(len(both)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i0 in range(0, len(low), chunk):
            found = []
            for j0 in range(i0 // tile * tile if alone else 0, len(high), tile):
                i, j = np.nonzero(np.bitwise_count(low[i0 : i0 + chunk, None] ^ high[None, j0 : j0 + tile]) <= most)
                i, j = i + i0, j + j0 + base
                if alone:
                    i, j = i[i < j], j[i < j]
                if linked and len(i):
                    i, j = i[label[i] != label[j]], j[label[i] != label[j]]
                    at = np.unique(i * len(both) + label[j], return_index=True)[1]
                    i, j = i[at], j[at]
                found.append((i, j))
            i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            if linked and len(i):
                new = np.zeros(len(i), bool)
                for k, (u, v) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                    u, v = root(u), root(v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        new[k] = True
                i, j = i[new], j[new]
                label = np.array(parent)
                while (label != label[label]).any():
                    label = label[label]
            if len(i):
                x, y = both[i].view(np.int64), both[j].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.bitwise_count(both[i] ^ both[j]).astype(np.int32))], names=["x", "y", "distance"])

    dealt, blocks = _cells(codes.where("code is not null").select("code"), "code", block_rows)
    return _by_cell(dealt, blocks, ["cell"]).applyInArrow(run, "x bigint, y bigint, distance int")


def code_pairs(codes: DataFrame, most: int, block_rows: int = 32768) -> DataFrame:
    """``x, y, distance`` of all pairs of different codes (x < y) within ``most`` bits. ``codes``: code, each once.

    Blocks of codes meet block by block, see ``_cells``; two codes cost an exclusive or and a count of bits. Probing
    an index with what differs in few bits is exact too, but at 19 of 64 bits that is 48,000 probes and codes met a code for
    250,000 codes, each of them a row that is exchanged, where this compares 125,000 codes a code in memory.
    """
    return _compare_codes(codes, most, False, block_rows)


def code_links(codes: DataFrame, most: int, block_rows: int = 32768) -> DataFrame:
    """``x, y, distance`` of pairs within ``most`` bits that connect all that ``code_pairs`` connects: fewer from a cell than it has codes."""
    return _compare_codes(codes, most, True, block_rows)


def hamming_pairs(sig: DataFrame, most: int) -> DataFrame:
    """``a, b, distance`` of all pairs of ids within ``most`` bits. ``sig``: id, code. Codes are compared once each, however many ids have them."""
    near = code_pairs(sig.select("code").distinct(), most)
    equal = sig.select("code").distinct().select(F.col("code").alias("x"), F.col("code").alias("y"), F.lit(0).alias("distance"))
    both = near.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"), "distance").select("p.*", "distance").unionByName(equal)
    a, b = sig.select(F.col("id").alias("a"), F.col("code").alias("x")), sig.select(F.col("id").alias("b"), F.col("code").alias("y"))
    return both.join(a, "x").join(b, "y").where("a < b").select("a", "b", "distance")


def hamming_clusters(sig: DataFrame, most: int) -> DataFrame:
    """``id, label`` of single-link clusters of more than one id, without all pairs of equal codes: those join their code's least id."""
    least = sig.groupBy("code").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    near = code_links(sig.select("code").distinct(), most)
    x, y = least.select(F.col("code").alias("x"), F.col("rep").alias("a")), least.select(F.col("code").alias("y"), F.col("rep").alias("b"))
    labels = clusters(near.join(x, "x").join(y, "y").select("a", "b"))
    d = least.join(labels, F.col("rep") == F.col("id"), "left").where("n > 1 or label is not null").select("code", F.coalesce("label", "rep").alias("label"))
    return sig.select("id", "code").join(d, "code").select("id", "label")


def cosine_pairs(vectors: DataFrame, least: float, block_rows: int = 32768) -> DataFrame:
    """``a, b, similarity`` (a < b) of all pairs of at least ``least``, exactly. ``vectors``: id, vec.

    Blocks of vectors meet block by block, see ``_cells``, so a cell's work has a bound and nothing is broadcast. All
    pairs are compared: at low thresholds in 64 dimensions no index rules any out for certain, so the work grows with
    the square of the rows. A product of single-precision matrices rules out pairs that are below ``least`` by more
    than its error can be; the others are computed in double precision, one dimension after the other. Vectors of
    different lengths, and those with null elements, are in no pair; a vector of zeros is similar to none by a number, so its
    pairs are NaN, which like everywhere in Spark is above all numbers.
    """
    tile, chunk = 4096, 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        vec = t["vec"].combine_chunks() if isinstance(t["vec"], pa.ChunkedArray) else t["vec"]
        n = t["n"][0].as_py()
        full = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), n)
        side = t["side"].to_numpy()
        at = np.flatnonzero(side == 0)
        alone = not t["cell"][0].as_py() % (blocks + 1)  # both blocks are one
        to = at if alone else np.flatnonzero(side == 1)
        with np.errstate(all="ignore"):
            norms = np.zeros(len(full))
            for k in range(n):
                norms += full[:, k] * full[:, k]
            unit = (full / np.sqrt(norms)[:, None]).astype(np.float32)
            low, high = unit[at], unit[to]
            bound = np.float32(least - 2.4e-7 * (n + 8))
            for i0 in range(0, len(at), chunk):
                for j0 in range(i0 // tile * tile if alone else 0, len(to), tile):
                    i, j = np.nonzero(~(low[i0 : i0 + chunk] @ high[j0 : j0 + tile].T < bound))
                    i, j = i + i0, j + j0
                    if alone:
                        i, j = i[i < j], j[i < j]
                    i, j = at[i], to[j]
                    for part in range(0, len(i), 1 << 16):
                        x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                        dot = np.zeros(len(x))
                        for k in range(n):
                            dot += full[x, k] * full[y, k]
                        s = dot / np.sqrt(norms[x] * norms[y])
                        sure = ~(s < least)
                        yield pa.RecordBatch.from_arrays([t["id"].take(pa.array(x[sure])).combine_chunks(), t["id"].take(pa.array(y[sure])).combine_chunks(), pa.array(s[sure])], names=["a", "b", "similarity"])

    v = vectors.where("id is not null and size(vec) > 0 and not exists(vec, x -> x is null)").select("id", "vec", F.size("vec").alias("n"))
    longest = v.agg(F.max("n")).first()[0] or 1
    dealt, blocks = _cells(v, "id", max(1024, min(block_rows, (1 << 21) // longest)))
    schema = StructType([StructField("a", v.schema["id"].dataType), StructField("b", v.schema["id"].dataType), StructField("similarity", DoubleType())])
    met = _by_cell(dealt, blocks, ["cell", "n"]).applyInArrow(run, schema)
    return met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def clusters(pairs: DataFrame) -> DataFrame:
    """``id, label`` of single-link clusters; labels are least ids.

    Each round takes the least label around each id, then the label of that label; it ends when
    no label changes, so clusters are whole however long their chains are. Rounds are written to
    the checkpoint folder and read back: size estimates of checkpointed joins multiply round by round.
    """
    spark = pairs.sparkSession
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/clusters-{uuid.uuid4().hex}"

    def saved(d: DataFrame, name: str) -> DataFrame:
        schema = d.schema
        d.write.parquet(f"{root}/{name}")
        return spark.read.schema(schema).parquet(f"{root}/{name}")

    def drop(name: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = saved(pairs.select(F.explode(ways).alias("w")).select("w.*").distinct(), "edges")
    labels = saved(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")), "0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("label").alias("m"))
        new = labels.join(near, labels["id"] == near["u"]).select(labels["id"], F.least("label", "m").alias("l"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("j"), F.col("label").alias("jl"))
        new = saved(new.join(jump, F.col("l") == F.col("j"), "left").select("id", F.least("l", F.coalesce("jl", "l")).alias("label"), "old"), str(step))
        drop(str(step - 1))
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            drop("edges")
            return labels
