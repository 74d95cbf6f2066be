"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into m segments of about log2(N) bits and indexed by each. A query
probes segment values at growing radius, segment after segment. Once segments 0..s
have been searched to radius r and the others to r - 1, every code within distance
m * r + s has been met; a query whose kth verified distance is covered stops.

Where the values to probe outnumber the codes there are, or are too many to list, queries that
are still open are compared with all codes instead, in blocks of queries: exact as well.

Equal codes are one entry with their k least ids, so copies cost nothing, and a code
met through several segments is taken at the first one only, which its distances by
segment tell, so candidates need no de-duplication.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stash

BITS = 64
K = 10
#: Values of a segment that are listed at most; beyond, open queries are compared with all codes.
MAX_FLIPS = 100_000
#: Open queries compared with a code at once.
SCAN_BLOCK = 256


def sign_code(vector: Column | str) -> Column:
    """The signs of up to 64 numbers as one long: bit i is set where number i is above 0. Null for a null vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.when(v.isNotNull(), F.aggregate(F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Segments:
    """m cuts of 64 bits."""

    def __init__(self, n_codes: int):
        self.m = max(2, min(8, BITS // max(8, round(math.log2(max(2, n_codes))))))
        self.edges = [BITS * s // self.m for s in range(self.m + 1)]

    def value(self, code: Column, s: int) -> Column:
        width = self.edges[s + 1] - self.edges[s]
        return F.shiftrightunsigned(code, self.edges[s]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    def mask(self, s: int) -> Column:
        return F.lit(_signed(((1 << self.edges[s + 1]) - 1) ^ ((1 << self.edges[s]) - 1))).cast("long")

    def n_flips(self, s: int, r: int) -> int:
        return math.comb(self.edges[s + 1] - self.edges[s], r)

    def flips(self, s: int, r: int) -> Column:
        """All values of the segment's width with r bits set, as an array."""
        width = self.edges[s + 1] - self.edges[s]
        values = [sum(1 << b for b in bits) for bits in combinations(range(width), r)]
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def steps(self):
        """(radius, segments searched together, distance covered afterwards)."""
        yield [(0, s) for s in range(self.m)] + [(1, s) for s in range(self.m)], 2 * self.m - 1
        for r in range(2, max(b - a for a, b in zip(self.edges, self.edges[1:], strict=False)) + 1):
            half = self.m if r < 4 else max(1, self.m // 2)
            for a in range(0, self.m, half):
                b = min(self.m, a + half)
                yield [(r, s) for s in range(a, b)], self.m * r + b - 1


def scan(active: DataFrame, classes: DataFrame, n_active: int) -> DataFrame:
    """``q, code, least, n, d``: all codes within the bound of each query, from all codes and all queries, block by block."""
    n_blocks = -(-n_active // SCAN_BLOCK)
    blocks = active.groupBy(F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("q", "bound")).alias("qs"))
    codes = classes.select("code", F.element_at("ids", 1).alias("least"), F.size("ids").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))
    near = F.filter(F.transform("qs", lambda x: F.struct(x["q"].alias("q"), x["bound"].alias("bound"), hamming(x["q"], F.col("code")).alias("d"))), lambda x: x["d"] <= x["bound"])
    return codes.join(blocks, "b").select("code", "least", "n", F.explode(near).alias("x")).select("x.q", "code", "least", "n", "x.d")


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_column: str = "id", code_column: str = "code") -> DataFrame:
    """``query_id, rank, id, distance``: for each query the k rows of least (distance, id).

    ``rows`` and ``queries`` have an id and a code (long). Rows with a null id or code are in
    no result; a query with a null code has no rows. Repeated rows are repeated neighbours only
    if their ids differ. With fewer than k rows, all of them are returned. An empty table gives none.
    """
    spark = rows.sparkSession
    stash = Stash(spark, "hamming")
    ids = rows.select(F.col(id_column).alias("id"), F.col(code_column).alias("code")).where("id is not null and code is not null").dropDuplicates()
    first = Window.partitionBy("code").orderBy("id")
    classes = ids.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stash.save(classes, "classes")
    n_codes, n_ids = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    found_schema = "q long, code long, least long, n int, d int"
    asked = queries.select(F.col(id_column).alias("query_id"), F.col(code_column).alias("q")).where("query_id is not null and q is not null")
    enough = min(k, n_ids)
    if not enough:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("distance")).where(F.lit(False))
    seg = Segments(n_codes)
    entries = F.array(*[F.struct(F.lit(s).alias("s"), seg.value(F.col("code"), s).alias("v")) for s in range(seg.m)])
    postings = stash.save(classes.select("code", F.element_at("ids", 1).alias("least"), F.size("ids").alias("n"), F.explode(entries).alias("e")).select("e.s", "e.v", "code", "least", "n"), "postings")
    active = stash.save(asked.select("q").distinct().withColumn("bound", F.lit(BITS)), "active-0")
    found = spark.createDataFrame([], found_schema)
    done = []  # found rows of queries that have stopped
    for step, (probed, covered) in enumerate(seg.steps(), 1):
        if max(seg.n_flips(s, r) for r, s in probed) > MAX_FLIPS or sum(seg.n_flips(s, r) for r, s in probed) > n_codes:
            met = scan(active, classes, active.count())
            best = Window.partitionBy("q").orderBy("d", "least")
            done.append(stash.save(met.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn"), "scanned"))
            break
        probes = None
        for r, s in probed:
            p = active.select("q", "bound", F.lit(s).alias("s"), F.lit(r).alias("r"), F.explode(seg.flips(s, r)).alias("f"))
            p = p.select("q", "bound", "s", "r", seg.value(F.col("q"), s).bitwiseXOR(F.col("f")).alias("v"))
            probes = p if probes is None else probes.unionByName(p)
        # sizes estimated before an explode say nothing about it: without the hint, probes would be broadcast
        p, e = probes.alias("p"), postings.hint("merge").alias("e")
        apart = F.col("p.q").bitwiseXOR(F.col("e.code"))
        new = F.lit(True)  # not met at a lower radius, nor at this one through an earlier segment
        for s in range(seg.m):
            own = F.bit_count(apart.bitwiseAND(seg.mask(s)))
            new = new & F.when(F.lit(s) < F.col("p.s"), own > F.col("p.r")).otherwise(own >= F.col("p.r"))
        met = p.join(e, (F.col("p.s") == F.col("e.s")) & (F.col("p.v") == F.col("e.v")) & new & (F.bit_count(apart) <= F.col("p.bound")))
        met = met.select("p.q", "e.code", "e.least", "e.n", F.bit_count(apart).alias("d"))
        best = Window.partitionBy("q").orderBy("d", "least")
        both = found.unionByName(met).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).withColumn("upto", F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, 0)))
        bound = F.min(F.when(F.col("upto") >= enough, F.col("d"))).over(Window.partitionBy("q"))
        kept = stash.save(both.withColumn("bound", F.coalesce(bound, F.lit(BITS))).select("q", "code", "least", "n", "d", "bound"), f"found-{step}")
        done.append(kept.where(F.col("bound") <= covered).drop("bound"))
        found = kept.where(F.col("bound") > covered).drop("bound")
        stopped = kept.where(F.col("bound") <= covered).select("q").distinct()
        bounds = kept.where(F.col("bound") > covered).groupBy("q").agg(F.min("bound").alias("b"))
        left = active.join(stopped, "q", "left_anti").join(bounds, "q", "left").select("q", F.coalesce("b", "bound").alias("bound"))
        active = stash.save(left, f"active-{step}")
        if active.isEmpty():
            break
    else:
        done.append(found)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    every = stash.save(every.select("q", "code", "d"), "every")
    stash.keep("classes", "every")
    each = every.join(classes, "code").select("q", "d", F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy("d", "id")
    lists = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "d"))).alias("near"))
    out = asked.join(lists, "q").select("query_id", F.explode("near").alias("x"))
    return out.select("query_id", F.col("x.rank").alias("rank"), F.col("x.id").alias("id"), F.col("x.d").alias("distance"))
