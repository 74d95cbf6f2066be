"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash


def components(links: DataFrame, stash: Stash, name: str) -> DataFrame:
    """``id, label`` for each id in ``links`` (a, b): label is the least id of its component.

    Each round every id points to the least around it, and to what that points to; then links
    are drawn between what their ends point to, once each, and those within one are gone. So a
    star is done after one round, and a chain loses at least half its length in each. A round is
    written out, so the lineage stays short.
    """
    links = stash.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    labels = None
    step = 0
    while True:
        step += 1
        ends = links.select(F.col("a").alias("id"), F.col("b").alias("m")).union(links.select("b", "a"))
        to = stash.save(ends.groupBy("id").agg(F.min("m").alias("m")).select("id", F.least("id", "m").alias("to")), f"{name}-to-{step}")
        next_ = to.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jumped = stash.save(to.join(next_, "to").select("id", F.col("next").alias("to")), f"{name}-jumped-{step}")
        if labels is None:
            labels = jumped.select("id", F.col("to").alias("label"))
        else:
            moved = jumped.select(F.col("id").alias("label"), "to")
            labels = stash.save(labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")), f"{name}-labels-{step}")
        left, right = jumped.select(F.col("id").alias("a"), F.col("to").alias("x")), jumped.select(F.col("id").alias("b"), F.col("to").alias("y"))
        drawn = links.join(left, "a").join(right, "b").where("x <> y")
        links = stash.save(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-links-{step}")
        if links.isEmpty():
            return labels
