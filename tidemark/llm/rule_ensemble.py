"""A sparse ensemble of rules as a quality classifier.

Shallow trees are grown one after another on what the ones before leave unexplained.
Every path to a node is a conjunctive rule over statistics of a text; rules and
statistics that a lasso-penalised logistic fit gives no weight are dropped. What is
left compiles into one Spark column expression, so scoring stays inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once
from .rule_ledger import measure

#: At most so many labelled rows are learned from: those whose hashed id comes first.
FIT_ROWS = 20_000
THRESHOLD = 0.7
#: Statistics a score may use, as SQL over the measurements.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
NAMES = tuple(FEATURES)


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v > self.cut if self.above else v <= self.cut

    def column(self) -> Column:
        c = F.col(f"__f_{NAMES[self.feature]}")
        return c > self.cut if self.above else c <= self.cut


Rule = frozenset[Condition]


@dataclass(frozen=True)
class RuleEnsemble:
    """Weights of rules: score = 1 / (1 + exp(-(bias + sum of the weights of rules that hold)))."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            held = F.lit(True)
            for c in sorted(rule, key=lambda c: (c.feature, c.above, c.cut)):
                held = held & c.column()
            total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        say = lambda c: f"{NAMES[c.feature]} {'>' if c.above else '<='} {c.cut:.4g}"
        return [f"{w:+.3f}  {' and '.join(sorted(map(say, r)))}" for r, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def _best_cut(x: np.ndarray, g: np.ndarray, rows: np.ndarray, min_rows: int) -> tuple[float, int, float] | None:
    best = None
    total, n = g[rows].sum(), len(rows)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v, s = x[order, f], np.cumsum(g[order])[:-1]
        k = np.arange(1, n)
        gain = s**2 / k + (total - s) ** 2 / (n - k) - total**2 / n
        gain[(v[1:] <= v[:-1]) | (k < min_rows) | (n - k < min_rows)] = -np.inf
        if len(gain) and (i := int(np.argmax(gain))) is not None and gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-12):
            best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    return best


def _grow(x: np.ndarray, g: np.ndarray, rows: np.ndarray, depth: int, path: Rule, found: dict[Rule, None], out: np.ndarray, min_rows: int) -> None:
    cut = _best_cut(x, g, rows, min_rows) if depth and len(rows) >= 2 * min_rows else None
    if cut is None:
        out[rows] = g[rows].mean()
        return
    _, f, at = cut
    for above in (False, True):
        rule = path | {Condition(f, above, at)}
        found[rule] = None
        inside = rows[(x[rows, f] > at) == above]
        _grow(x, g, inside, depth - 1, rule, found, out, min_rows)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 2e-3, steps: int = 600, seed: int = 7) -> RuleEnsemble:
    """Grow trees on a seeded half of the rows each, then weigh their rules with a lasso."""
    n = len(y)
    rate = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    if n < 20 or y.min(initial=1) == y.max(initial=0):
        return RuleEnsemble(bias, ())
    rng = np.random.default_rng(seed)
    found: dict[Rule, None] = {}
    margin = np.full(n, bias)
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(n)[: max(20, n // 2)])
        part = np.zeros(n)
        _grow(x, g, rows, depth, frozenset(), found, part, max(3, n // 1000))
        margin += 2.0 * part
    rules = list(found)
    z = np.column_stack([np.logical_and.reduce([c.holds(x) for c in r]) for r in rules]).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that agree on every row are one rule
    first = np.sort(first)
    rules, z = [rules[i] for i in first], z[:, first]
    spread = z.std(axis=0)
    mean = z.mean(axis=0)
    ok = spread > 0
    rules, z = [r for r, k in zip(rules, ok, strict=True) if k], (z[:, ok] - mean[ok]) / spread[ok]
    step = 4 * n / max(np.linalg.norm(z, 2) ** 2, 1e-9)
    w = v = np.zeros(z.shape[1])
    b, t = bias, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        err = 1 / (1 + np.exp(-(z @ v + b))) - y
        new = v - step * (z.T @ err) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 4 * err.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    scaled = w / spread[ok]
    kept = [(r, float(x)) for r, x in zip(rules, scaled, strict=True) if x]
    return RuleEnsemble(float(b - (scaled * mean[ok]).sum()), tuple(kept))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as one column ``__row``, and the statistics of its texts as ``__f_`` columns, all finite; a null or empty text has zeros."""
    m = measure(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text")), "__text")
    return m.select("__row", *[F.expr(f"cast({sql} as double)").alias(f"__f_{k}") for k, sql in FEATURES.items()])


def held_out(id_column: str = "doc_id") -> Column:
    """Rows no label of which is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    """Learn from at most ``fit_rows`` labelled rows that are not held out. Only their statistics reach the driver.

    Rows with a null label or id, or a null text, are left out; of different labels of one id the greatest counts.
    Of more labelled ids those of the least hash are learned from; what is broadcast is at most ``fit_rows`` ids and
    labels. With no labels, or all alike, the ensemble is a constant.
    """
    chosen = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).alias("__id")).agg(F.max(label).alias("__y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows))
    known = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")).where("__text is not null").join(chosen, "__id")
    rows = with_features(known, "__text").select("__row.__id", "__row.__y", *[f"__f_{k}" for k in NAMES])
    got = rows.orderBy(F.xxhash64("__id"), "__id", *[f"__f_{k}" for k in NAMES]).limit(fit_rows).toPandas()
    x = got[[f"__f_{k}" for k in NAMES]].to_numpy(float)
    return fit_rules(x.reshape(len(got), len(NAMES)), got["__y"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` to ``docs``; columns of those names are replaced, all others stay.

    Null and empty texts have statistics of zero and a score like any other. Repeated rows are scored each.
    """
    kept = docs.drop("score", "predicted")
    d = with_features(kept, text).withColumn("score", once(model.column()))
    return d.select(*[F.col("__row")[c].alias(c) for c in kept.columns], "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
