"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one integer whose bit k says that rule k failed. A policy is a versioned mask over
those bits: applying one, comparing two, or asking what each rule alone is worth
reads the ledger and never the texts again. All of it is built-in column functions;
nothing is shuffled to build the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

#: Measurements, in this order, besides n_lines and n_upper.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WORD_GAP = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A named test over measurements. ``failed`` is SQL text, so one rule serves every engine."""

    bit: int
    name: str
    failed: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "capitals", "100 * n_upper > 50 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(r.mask for r in RULES if r.name in self.rules)


BASE_POLICY = Policy("base-1", ("too_short", "repeated_windows"))
POLICIES = (BASE_POLICY, Policy("strict-1", tuple(r.name for r in RULES)))
DEFAULT_POLICY = POLICIES[-1]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of its whole texts.

    Repeated windows of three words: windows are hashed; hash and place share one long, so
    that one primitive sort brings equal windows together. Those whose hash parts agree are
    then compared word by word; if any two differ, that document's windows alone are sorted
    by their words, so the count is exact.

    A null or empty text has no words, lines or symbols: all measurements are 0.
    Repeated rows are measured each; columns with the names of measurements are replaced.
    """
    made = [*MEASURES, "n_lines", "n_upper"]
    d = docs.drop(*made)
    d = d.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns({"__w": F.array_remove(F.split("__t", WORD_GAP), ""), "__l": F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_upper": F.char_length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            # the low bits of a packed window that hold its place
            "__m": F.expr("shiftleft(1L, cast(ceil(log2(size(__w) + 1)) as int)) - 1"),
        }
    )
    window = "xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))"
    d = d.withColumn("__p", F.expr(f"if(n_words < 4, array(), sort_array(transform(sequence(0, cast(n_words as int) - 3), i -> ({window} & ~__m) | cast(i as bigint))))"))
    # windows next to one of the same hash part
    d = d.withColumn("__c", F.expr("filter(__p, (x, j) -> (coalesce(get(__p, j - 1), ~x) & ~__m) = (x & ~__m) or (coalesce(get(__p, j + 1), ~x) & ~__m) = (x & ~__m))"))
    alike = " and ".join(f"get(__w, cast(x & __m as int) + {k}) = get(__w, cast(get(__c, j - 1) & __m as int) + {k})" for k in range(3))
    d = d.withColumn("__clash", F.expr(f"exists(transform(__c, (x, j) -> j > 0 and (get(__c, j - 1) & ~__m) = (x & ~__m) and not ({alike})), b -> b)"))
    words = ", ".join(f"'w{k}', get(__w, i + {k})" for k in range(3))
    d = d.withColumn("__z", F.expr(f"if(__clash, sort_array(transform(sequence(0, cast(n_words as int) - 3), i -> named_struct({words}, 'i', i))), array())"))
    equal = lambda j: " and ".join(f"x.w{k} <=> get(__z, {j}).w{k}" for k in range(3))
    exact = f"transform(filter(__z, (x, j) -> ({equal('j - 1')}) or ({equal('j + 1')})), x -> x.i)"
    d = d.withColumn("__s", F.expr(f"if(__clash, {exact}, transform(__c, x -> cast(x & __m as int)))"))
    d = d.withColumn("n_repeat_words", F.expr("size(array_distinct(concat(__s, transform(__s, x -> x + 1), transform(__s, x -> x + 2))))").cast("long"))
    return d.drop("__t", "__w", "__l", "__m", "__p", "__c", "__clash", "__z", "__s")


def build_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``, the text dropped: what policies and ablations read."""
    d = measure(docs, text).drop("fail_bits")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(r.mask)).otherwise(0).cast("long"))
    return d.withColumn("fail_bits", once(bits)).drop(text)


def apply_policy(ledger: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``policy`` to a ledger."""
    bits = F.col("fail_bits")
    base = bits.bitwiseAND(F.lit(BASE_POLICY.mask)) != 0
    return ledger.withColumns({"base_failed": base, "kept": ~base & (bits.bitwiseAND(F.lit(policy.mask)) == 0), "policy": F.lit(policy.version)})


def compare_policies(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Documents kept and rejected under each policy, from one pass over distinct bit patterns."""
    by_bits = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** rules rows
    masks = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask")) for p in policies])
    each = by_bits.select("n", "fail_bits", F.explode(masks).alias("p")).select("n", "p.policy", (F.col("fail_bits").bitwiseAND(F.col("p.mask")) == 0).alias("ok"))
    return each.groupBy("policy").agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("rejected"))


def ablate(ledger: DataFrame, policy: Policy = DEFAULT_POLICY, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those it alone rejects (which leaving it out would keep)."""
    by_bits = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    own = [r for r in rules if r.mask & policy.mask]
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("mask")) for r in own])
    each = by_bits.select("n", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("b"), F.explode(listed).alias("r"))
    return each.groupBy("r.rule").agg(
        F.sum(F.when(F.col("b").bitwiseAND(F.col("r.mask")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("r.mask"), F.col("n")).otherwise(0)).alias("n_only"),
    )
