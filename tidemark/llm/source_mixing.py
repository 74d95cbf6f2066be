"""Mixing sources to target weights by Poisson replication.

Each source gets a rate: its target share of the mixture over what it has. A
document's number of copies is the Poisson quantile of a uniform number seeded by a
hash of its id, with that rate as the mean. So counts need no state, are the same in
every run and on every executor, and survive recomputation. Copies are dealt to
partitions by a hash and ordered by it there: a global shuffle with one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash

SEED = "mix-1"
MAX_PART = 64
#: Rates of so many sources (under 1 KB each) are broadcast; those of more are joined by key.
MAX_BROADCAST_SOURCES = 10_000


def uniform(seed: str, *key: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the seed and the key. Nulls count as the word null."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """``source, n_docs, n_bytes, weight, rate, parts, cdf`` for each source of ``docs``.

    ``weights``: target shares of the bytes of the mixture, by source; None: equal shares.
    Sources without a weight get none of it; weights need not add up to 1. ``epochs``: bytes
    of the mixture over bytes of ``docs``. A null source is one source, of the name ''.
    Sources without a byte get the rate 0. One row a source: aggregated before its one exchange.

    ``cdf``: the Poisson distribution of rate / parts, as far as 52 bits tell it from 1. A rate
    over MAX_PART is cut into equal parts, whose counts add up to a Poisson count of the whole.
    """
    spark = docs.sparkSession
    per = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("n_bytes")
    )
    per = Stash(spark, "mix").save(per, "sources")
    if weights is None:
        per = per.withColumn("weight", F.when(F.col("n_bytes") > 0, 1.0).otherwise(0.0))
    else:
        given = spark.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "source string, weight double")
        per = per.join(given, "source", "left").withColumn("weight", F.when(F.col("n_bytes") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    total = per.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    scale = total[0] * epochs / total[1] if total[1] else 0.0
    per = per.withColumn("rate", F.when(F.col("weight") > 0, F.col("weight") * scale / F.col("n_bytes")).otherwise(0.0))
    per = per.withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_PART), F.lit(1)))
    part = F.col("rate") / F.col("parts")
    first = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf"))
    steps = F.sequence(F.lit(1), (F.lit(40) + F.ceil(part * 4)).cast("int"))
    more = lambda a, i: F.struct((a["p"] * part / i).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * part / i)).alias("cdf"))
    return per.withColumn("cdf", F.aggregate(steps, first, more)["cdf"])


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    epochs: float = 1.0,
    seed: str = SEED,
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in shuffled order, and
    ``copy_no`` (from 0), ``n_copies``, ``mix_rate`` and ``mix_key`` (order within the mixture).

    Rows of one id get the same count, and so do all of a null id; ties of the key stay in one partition. An empty table gives an empty table; columns of
    those names are replaced, all others stay. A hot source costs no more than its rows: its rate comes
    from sums made before the exchange, and copies are dealt by hash, not by source.
    """
    kept = docs.drop("copy_no", "n_copies", "mix_rate", "mix_key")
    rates = source_rates(kept, weights, epochs, source, text).select(F.col("source").alias("__source"), F.col("rate").alias("mix_rate"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    if rates.count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    d = kept.select(F.struct("*").alias("__row"), F.col(id_column).alias("__id"), F.coalesce(F.col(source), F.lit("")).alias("__source")).join(rates, "__source")
    one = lambda k: F.size(F.filter("__cdf", lambda c: c < uniform(seed, F.col("__id"), k))).cast("long")
    n = F.aggregate(F.sequence(F.lit(0), (F.col("__parts") - 1).cast("int")), F.lit(0).cast("long"), lambda acc, k: acc + one(k))
    d = d.withColumn("n_copies", F.when(F.col("mix_rate") > 0, n).otherwise(F.lit(0).cast("long"))).where("n_copies > 0")
    d = d.select("__row", "__id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)).alias("copy_no"), "n_copies", "mix_rate")
    d = d.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col("__id").cast("string"), F.lit("null")), F.col("copy_no").cast("string"))))
    d = d.repartition(partitions, "mix_key") if partitions else d.repartition("mix_key")
    d = d.sortWithinPartitions("mix_key")
    return d.select(*[F.col("__row")[c].alias(c) for c in kept.columns], "mix_rate", "n_copies", "copy_no", "mix_key")
