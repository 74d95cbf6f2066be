"""Near duplicates by content: word shingles of five, Jaccard similarity of at least 0.8.

Exact, by prefix filtering. Of two sets that are similar enough, each has a common shingle
among its rarest n - ceil(0.8 n) + 1, so only those are posted. Equal sets are one from the
start; members of a posting are compared with its least member first, and then, if classes
are left, across classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.similarity import clusters

SHINGLE = 5
SIMILARITY = 0.8


def shingle_sets(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id, sh, n``: sorted hashes of the different shingles; of all words as one if there are fewer than five; empty without words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    d = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), words.alias("w"))
    k = F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1))
    each = F.transform(F.sequence(F.lit(1), k), lambda i: F.xxhash64(F.array_join(F.slice("w", i, SHINGLE), " ")))
    sh = F.when(F.size("w") > 0, F.array_sort(F.array_distinct(each))).otherwise(F.array().cast("array<bigint>"))
    return d.select("id", sh.alias("sh")).withColumn("n", F.size("sh"))


def content_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``id_column, class_id`` (the least id of the class) for each different non-null id; ids are whole numbers.

    A text without words is in a class of its own. Of rows with one id the first text by value counts.
    """
    one = docs.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(text).alias(text))
    sets = shingle_sets(one, id_column, text).withColumn("sig", F.sha2(F.array_join("sh", ","), 256))
    reps = sets.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "sh", "n")).alias("r")).select("sig", "r.*").checkpoint()
    shingles = reps.select("id", "n", F.explode("sh").alias("h"))
    spread = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = shingles.join(spread, "h").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    prefix = F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    posted = ranked.select("id", "n", F.explode(prefix).alias("p")).where("p.df > 1").select(F.col("p.h").alias("h"), "id", "n").checkpoint()
    may = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        d = pairs.join(reps.select(F.col("id").alias("b"), F.col("sh").alias("y")), "b").join(reps.select(F.col("id").alias("a"), F.col("sh").alias("x")), "a")
        common = F.size(F.array_intersect("x", "y"))
        return d.where(common >= least * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")

    first = posted.groupBy("h").agg(F.min(F.struct("id", "n")).alias("f")).select("h", F.col("f.id").alias("a"), F.col("f.n").alias("na"))
    near = posted.join(first, "h").where((F.col("id") != F.col("a")) & may(F.col("n"), F.col("na"))).select("a", F.col("id").alias("b")).distinct().checkpoint()
    links = verified(near).checkpoint()
    labels = clusters(links)
    known = posted.join(labels, "id", "left").withColumn("c", F.coalesce("label", "id")).drop("label")
    x, y = known.alias("x"), known.alias("y")
    on = (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & may(F.col("x.n"), F.col("y.n"))
    across = x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    # of the second round only what joins classes matters: links between labels
    label = labels.select(F.col("id").alias("i"), "label")
    more = verified(across).join(label.withColumnsRenamed({"i": "a", "label": "la"}), "a", "left").join(label.withColumnsRenamed({"i": "b", "label": "lb"}), "b", "left")
    joined = clusters(more.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    d = sets.join(reps.select("sig", F.col("id").alias("rep")), "sig", "left").join(labels.withColumnsRenamed({"id": "rep", "label": "l1"}), "rep", "left")
    d = d.withColumn("l1", F.coalesce("l1", "rep", "id")).join(joined.withColumnsRenamed({"id": "l1", "label": "l2"}), "l1", "left")
    return d.select(F.col("id").alias(id_column), F.coalesce("l2", "l1").alias("class_id"))
