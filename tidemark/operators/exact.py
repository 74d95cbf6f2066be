"""Exact duplicates: size, then content digest, then the choice of what to keep.

Sizes are counted on metadata alone. The digest is computed where the content is read, and
the content goes no further: what is exchanged are paths, sizes and digests. Counting and
ranking of a digest's members share one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import exprs as X
from tidemark.operators.keepers import KeeperStrategy, PathKeeper

EXACT = "EXACT_HASH"


def size_collisions(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Files whose size another one has, with ``n_same_size``. Sizes are counted before anything is exchanged."""
    d = files.where("size_bytes > 0")
    sizes = d.groupBy(*by, "size_bytes").agg(F.count(F.lit(1)).alias("n_same_size")).where("n_same_size >= 2")
    return d.join(sizes, [*by, "size_bytes"])


def quick_hash(content: str = "content", head: int = 4096):
    """Digest of the first bytes: the cheap tier of a three-stage funnel."""
    return F.md5(F.substring(F.col(content).cast("binary"), 1, head))


def exact_members(files: DataFrame, by: tuple[str, ...] = (), funnel: bool = False) -> DataFrame:
    """Files that another one equals, with ``digest`` and ``n_members``. ``funnel``: heads are compared before whole contents."""
    keys = (*by, "size_bytes")
    d = files.where("size_bytes > 0")
    if funnel:
        d = d.withColumn("head", quick_hash())
        keys = (*keys, "head")
    d = d.withColumn("digest", F.sha2("content", 256)).drop("content")
    return d.withColumn("n_members", F.count(F.lit(1)).over(Window.partitionBy(*keys, "digest"))).where("n_members >= 2").drop("head")


def ranked_members(members: DataFrame, by: tuple[str, ...] = (), keeper: KeeperStrategy | None = None) -> DataFrame:
    """Add ``score``, ``rank`` (1: to keep) and ``action``."""
    keeper = keeper or PathKeeper()
    w = Window.partitionBy(*by, "size_bytes", "digest").orderBy(F.desc("score"), *keeper.order())
    d = members.withColumn("score", keeper.score()).withColumn("rank", F.row_number().over(w))
    return d.withColumn("action", F.when(F.col("rank") == 1, "KEEP").otherwise("DUPLICATE"))


def numbered_members(ranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``group_id``: clusters in the order (size descending, digest), from 1; and ``member_no``: members in the order (group_id, rank), from 1.

    Numbers come from counts by size, so only one row a size meets in one task, not one a cluster.
    """
    clusters = ranked.where("rank = 1").select(*by, "size_bytes", "digest", "n_members")
    sizes = clusters.groupBy(*by, "size_bytes").agg(F.count(F.lit(1)).alias("n"), F.sum("n_members").alias("m"))
    before = Window.partitionBy(*by).orderBy(F.desc("size_bytes")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sizes = sizes.select(*by, "size_bytes", earlier("n", before).alias("groups_before"), earlier("m", before).alias("members_before"))
    within = Window.partitionBy(*by, "size_bytes").orderBy("digest")
    numbers = clusters.withColumns({"k": F.row_number().over(within), "mk": earlier("n_members", within.rowsBetween(Window.unboundedPreceding, -1))}).join(sizes, [*by, "size_bytes"])
    numbers = numbers.select(*by, "size_bytes", "digest", (F.col("groups_before") + F.col("k")).alias("group_id"), (F.col("members_before") + F.col("mk")).alias("first_no"))
    return ranked.join(numbers, [*by, "size_bytes", "digest"]).withColumn("member_no", F.col("first_no") + F.col("rank")).drop("first_no")


def duplicate_records(files: DataFrame, by: tuple[str, ...] = (), keeper: KeeperStrategy | None = None) -> DataFrame:
    """One row a member of a cluster, in the layout of a duplicate record, and ``rank``, ``size_bytes`` and ``member_no``."""
    d = numbered_members(ranked_members(exact_members(files, by), by, keeper), by)
    return d.select(
        *by, "group_id", F.lit(EXACT).alias("match_type"), "action", "category", F.lit("100%").alias("similarity"), F.lit(1.0).alias("similarity_score"),
        X.size_mb(F.col("size_bytes")).alias("size_mb"), "path", F.lit(None).cast("string").alias("dimensions"), "rank", "size_bytes", "member_no",
    )


def prune_matched(catalog: DataFrame, matched: DataFrame) -> DataFrame:
    """What earlier tiers have not matched."""
    return catalog.join(matched.select("path").distinct(), "path", "left_anti")


def scan_stats(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("total_files"), F.count_if("is_media").alias("media_files"))


def category_breakdown(records: DataFrame) -> DataFrame:
    return records.where("action = 'DUPLICATE'").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def summary(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """One row: counts of files, groups by tier, and what the duplicates waste."""
    groups = lambda kind: F.count_if((F.col("action") == "KEEP") & (F.col("match_type") == kind))
    r = records.agg(
        groups(EXACT).alias("exact_duplicate_groups"), groups("VISUAL_AI_NEAR_DUPLICATE").alias("visual_ai_groups"), groups("CONTENT_NEAR_DUPLICATE").alias("content_duplicate_groups"),
        F.count_if(F.col("action") == "KEEP").alias("total_duplicate_groups"), F.coalesce(F.sum(F.when(F.col("action") == "DUPLICATE", F.col("size_bytes"))), F.lit(0)).alias("wasted_bytes"),
    )
    mb = F.col("wasted_bytes") / float(X.MB)
    both = scan_stats(catalog).withColumn("__one", F.lit(1)).join(r.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return both.withColumns({"wasted_mb": X.rounded(mb, 2), "wasted_gb": X.rounded(mb / 1024, 3)})
