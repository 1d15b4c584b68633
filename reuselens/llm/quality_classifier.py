"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees on a bounded sample of labelled rows propose rules: each path from a root is a conjunction of
comparisons. A lasso logistic regression over the rules' truth values keeps few of them; these are compiled into Spark
column expressions, so scoring is a projection over the measurements.

Defined cases: null and empty texts are measured as empty and scored like any row, very long ones as a whole; without training rows, or with one class
only, the score is the share of good labels (0.5 without any); null ids are not held out; ties, repeated rows and other
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TRAIN_ROWS, fresh, held_out, training_rows
from .textstats import measure_column

#: Statistic: numerator and denominator among the measurements (none: 1).
STATISTICS = {
    "words": ("n_words", None),
    "symbols": ("n_symbols", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "capitals": ("n_upper", "n_chars"),
    "lower": ("n_lower", "n_chars"),
    "bangs": ("n_bang", "n_words"),
    "distinct": ("n_distinct_words", "n_words"),
    "stutter": ("n_repeat_next", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "stops": ("n_stops", "n_words"),
    "line_length": ("n_chars", "n_lines"),
}


def statistic_columns(measured: Column) -> dict[str, Column]:
    def one(num: str, den: str | None) -> Column:
        x = measured[num].cast("double")
        return x if den is None else x / F.greatest(measured[den].cast("double"), F.lit(1.0))

    return {name: one(*parts) for name, parts in STATISTICS.items()}


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        """The score, 0 to 1, as a column expression."""

        def holds(rule: Rule) -> Column:
            out = F.lit(True)
            for c in rule:
                out = out & (stats[c.statistic] > c.threshold if c.above else stats[c.statistic] <= c.threshold)
            return out

        total = F.lit(self.intercept)
        for rule, w in self.weights:
            total = total + F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], use: np.ndarray, names: list[str], depth: int, least: int) -> tuple[list[tuple[Rule, np.ndarray]], np.ndarray]:
    """One tree by greedy gain on binned statistics, of which ``use`` are looked at. Returns all paths with their rows, and the leaf values per row."""
    value = np.zeros(len(grad))
    paths: list[tuple[Rule, np.ndarray]] = []

    def split(rows: np.ndarray, path: Rule, left: int) -> None:
        g, h = grad[rows], hess[rows]
        best = (1e-6, -1, -1)
        if left and len(rows) >= 2 * least:
            base = g.sum() ** 2 / (h.sum() + 1.0)
            for f in use:
                edges = cuts[f]
                if not len(edges):
                    continue
                c, n = codes[rows, f], len(edges) + 1
                gs, hs, ns = (np.cumsum(np.bincount(c, w, n))[:-1] for w in (g, h, None))
                ok = (ns >= least) & (len(rows) - ns >= least)
                gain = np.where(ok, gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base, 0.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            value[rows] = -g.sum() / (h.sum() + 1.0)
            return
        _, f, k = best
        low = codes[rows, f] <= k
        for part, above in ((rows[low], False), (rows[~low], True)):
            own = (*path, Condition(names[f], above, float(cuts[f][k])))
            paths.append((own, part))
            split(part, own, left - 1)

    split(np.arange(len(grad)), (), depth)
    return paths, value


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 20, depth: int = 3, rate: float = 0.3, penalty: float = 2e-3, bins: int = 32, least: int = 10, steps: int = 400) -> RuleEnsemble:
    """The ensemble for statistics ``x`` (rows by names) and labels ``y``. Draws have fixed seeds."""
    n = len(y)
    share = float(y.mean()) if n else 0.5
    if not n or share in (0.0, 1.0):
        share = min(max(share, 0.01), 0.99) if n else 0.5
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    # midpoints between neighbouring quantiles, so that thresholds don't sit on a value
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)))
        cuts.append((q[1:] + q[:-1]) / 2)
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    margin = np.full(n, np.log(share / (1 - share)))
    masks: dict[Rule, np.ndarray] = {}
    seen: dict[bytes, Rule] = {}
    for t in range(trees):
        # each tree sees half of the statistics, so that no single one decides where several tell the classes apart
        use = np.random.Generator(np.random.PCG64(t)).permutation(x.shape[1])[: (x.shape[1] + 1) // 2]
        p = 1 / (1 + np.exp(-margin))
        paths, value = _grow(codes, p - y, np.maximum(p * (1 - p), 1e-6), cuts, use, names, depth, least)
        margin += rate * value
        for rule, rows in paths:
            mask = np.zeros(n, bool)
            mask[rows] = True
            if (key := np.packbits(mask).tobytes()) not in seen:  # of rules with the same rows, the first
                seen[key] = rule
                masks[rule] = mask
    rules = list(masks)
    z = np.stack([masks[r] for r in rules], 1).astype(np.float64) if rules else np.zeros((n, 0))
    center, scale = z.mean(0), np.maximum(z.std(0), 1e-9)
    z = (z - center) / scale
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1.0)
    w, b = np.zeros(z.shape[1]), float(np.log(share / (1 - share)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw = vw - step * (z.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0.0)
        nb = vb - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    kept = [(rules[k], float(w[k] / scale[k])) for k in np.flatnonzero(np.abs(w) > 1e-9)]
    return RuleEnsemble(float(b - (w * center / scale).sum()), tuple(kept))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAIN_ROWS) -> RuleEnsemble:
    """Fit on at most ``bound`` labelled rows: their statistics, a few numbers each, come to the driver."""
    rows = training_rows(docs, labels, label, bound).withColumn("measured", measure_column(F.col("text")))
    got = rows.select("doc_id", "y", "measured").select("doc_id", "y", *[c.alias(k) for k, c in statistic_columns(F.col("measured")).items()]).toPandas()
    got = got.sort_values(["doc_id", *STATISTICS], kind="stable")  # the same sums in the same order
    return fit(got[list(STATISTICS)].to_numpy(float), got["y"].to_numpy(float), list(STATISTICS))


def scored(docs: DataFrame, model: RuleEnsemble, score: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the score. One pass, no shuffle."""
    (measured,) = fresh(docs, "measured")
    out = docs.withColumn(measured, measure_column(F.col(text)))
    return out.withColumn(score, model.column(statistic_columns(F.col(measured)))).drop(measured)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that score ``threshold`` or more, with the columns of ``docs``."""
    (score,) = fresh(docs, "score")
    return scored(docs, train(docs, labels), score).where(F.col(score) >= threshold).drop(score)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
