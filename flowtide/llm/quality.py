"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark column expressions on the whole text.  Boosted shallow
trees (numpy, on a bounded sample of labelled rows) propose conjunctive rules,
one for every path from a root to an inner node or leaf; a logistic regression
with a lasso penalty weighs them, and the few rules that keep a weight are
compiled into one column expression, so scoring is a projection of the scan.

``MAX_FIT_ROWS`` bounds the labelled rows that are fitted on (those of least
hash of ``doc_id``); scoring covers every row.

Rows: null and empty texts have all statistics 0 and get a score like any
other.  Labels that are null, that repeat (the least counts) or that name no
document are no obstacle; without labels of both kinds every score is the share
of label 1 (0.5 without labels).  Only ``doc_id`` and ``text`` of the documents
are read.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FIT_ROWS = 12_000
CUT = 0.3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
_SYMBOLS = "#$%&*+<=>@[]^_{}~\\/"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _statistics(a: Column) -> dict[str, Column]:
    """Statistics by name over a struct of ``t`` (text), ``w`` (words) and ``l`` (lines)."""
    t, w, l = a["t"], a["w"], a["l"]  # noqa: E741
    n = F.greatest(F.length(t), F.lit(1))
    words = F.greatest(F.size(w), F.lit(1))
    lines = F.greatest(F.size(l), F.lit(1))
    share = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    again = F.when(F.size(w) > 1, F.size(F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.get(w, i) == F.get(w, i - 1)))).otherwise(0)
    return {
        "chars": F.log1p(F.length(t).cast("double")),
        "upper": share(_UPPER),
        "symbols": share(_SYMBOLS),
        "bangs": share("!?"),
        "bars": share("|"),
        "digits": share("0123456789"),
        "stops": share(".,;:"),
        "word_length": F.length(t) / words,
        "distinct_words": F.size(F.array_distinct(w)) / words,
        "repeats": again / words,
        "distinct_lines": F.size(F.array_distinct(l)) / lines,
        "line_length": F.log1p(F.length(t) / lines),
    }


NAMES = ["chars", "upper", "symbols", "bangs", "bars", "digits", "stops", "word_length", "distinct_words", "repeats", "distinct_lines", "line_length"]


def statistics(text: Column) -> Column:
    """All statistics of a text as one struct of doubles."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    parts = lambda t: F.struct(
        t.alias("t"), F.array_remove(F.split(t, r"[ \t\r\n]+"), "").alias("w"), F.array_remove(F.split(t, "\n"), "").alias("l")
    )
    measured = lambda a: F.struct(*[e.cast("double").alias(name) for name, e in _statistics(a).items()])
    return bind(bind(whole, parts), measured)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): value > threshold or <=."""

    terms: tuple[tuple[int, bool, float], ...]

    def hits(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, cut in self.terms:
            out &= (x[:, f] > cut) == above
        return out

    def column(self, names: list[str], s: Column) -> Column:
        out = F.lit(True)
        for f, above, cut in self.terms:
            out = out & ((s[names[f]] > cut) if above else (s[names[f]] <= cut))
        return out


@dataclass(frozen=True)
class RuleModel:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self, text: Column) -> Column:
        """The score of a text, one expression over its statistics."""

        def weigh(s: Column) -> Column:
            gives = [F.when(rule.column(self.names, s), F.lit(float(w))).otherwise(F.lit(0.0)) for rule, w in zip(self.rules, self.weights)]
            z = F.aggregate(F.array(F.lit(float(self.intercept)), *gives), F.lit(0.0), lambda a, x: a + x)
            return 1.0 / (1.0 + F.exp(-z))

        return bind(statistics(text), weigh)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * rule.hits(x)
        return 1 / (1 + np.exp(-z))


def _grow(x, bins, cuts, grad, hess, rows, depth, terms, out, least):
    """A tree by second-order gain over binned statistics; collects its paths."""
    if terms:
        out.append(tuple(terms))
    leaf = [(rows, grad[rows].sum() / (hess[rows].sum() + 1.0))]
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        b = bins[rows, f]
        gl = np.cumsum(np.bincount(b, grad[rows], len(edges) + 1))[:-1]
        hl = np.cumsum(np.bincount(b, hess[rows], len(edges) + 1))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=len(edges) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(nl < least) | (len(rows) - nl < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    _, f, k = best
    if f is None:
        return leaf
    left = bins[rows, f] <= k
    value = float(cuts[f][k])
    return _grow(x, bins, cuts, grad, hess, rows[left], depth - 1, [*terms, (f, False, value)], out, least) + _grow(
        x, bins, cuts, grad, hess, rows[~left], depth - 1, [*terms, (f, True, value)], out, least
    )


def propose(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, seed: int = 17) -> list[Rule]:
    """Rules of boosted trees, each grown on half of the rows."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    cuts = [c[(c >= x[:, f].min()) & (c < x[:, f].max())] for f, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rng, z = np.random.default_rng(seed), np.zeros(len(x))
    paths: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(x)) < 0.5)
        for at, step in _grow(x, bins, cuts, y - p, p * (1 - p), rows, depth, [], paths, max(5, len(x) // 500)):
            z[at] += 0.5 * step
    unique: dict[bytes, Rule] = {}
    for terms in paths:
        rule = Rule(terms)
        hits = rule.hits(x)
        if 0 < hits.sum() < len(x):
            unique.setdefault(hits.tobytes(), rule)
    return list(unique.values())


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on standardised columns; (weights, intercept)."""
    mean, dev = m.mean(axis=0), m.std(axis=0) + 1e-9
    s = (m - mean) / dev
    w, b = np.zeros(s.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    top = np.random.default_rng(0).normal(size=s.shape[1])
    for _ in range(30):  # largest curvature
        top = s.T @ (s @ top)
        top /= np.linalg.norm(top)
    step = 1.0 / (0.25 * (np.linalg.norm(s @ top) ** 2 / len(s) + 1) * 1.05)
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(s @ v + c))) - y
        nw, nb = v - step * (s.T @ r) / len(s), c - step * r.mean()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w / dev, b - float((w * mean / dev).sum())


def fit(names: list[str], x: np.ndarray, y: np.ndarray, penalty: float = 2e-4) -> RuleModel:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return RuleModel(names, [], [], float(np.log(p / (1 - p))))
    rules = propose(x, y)
    m = np.stack([r.hits(x) for r in rules], axis=1).astype(np.float32)
    w, b = lasso_logistic(m, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(names, [rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> RuleModel:
    """Fit on at most ``max_rows`` labelled rows that are not held out.

    One text stands for each sampled ``doc_id``: the one of least hash.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    sample = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # max_rows rows of two numbers
    names = NAMES
    one = near.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("m"))
    rows = one.select("y", statistics(F.col("m.text")).alias("s")).select("y", "s.*").toPandas()
    rows = rows.sort_values([*names, "y"])
    return fit(names, rows[names].to_numpy(float).reshape(-1, len(names)), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, cut: float = CUT) -> DataFrame:
    """Rows: doc_id, held_out, score, predicted."""
    doc_id = F.col("doc_id").cast("long")
    scored = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= cut).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: RuleModel, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``cut``."""
    return docs.where(model.column(F.col("text")) >= cut)
