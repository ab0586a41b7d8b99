"""Quality: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Shallow trees, grown on the bins of one feature at a time in a fixed cycle
and shrunk by a small rate, add up to one lookup table per feature. The pairs whose residuals differ most over a coarse
grid then get tables of their own in the same way. A score is the logistic function of the sum of looked-up values.

Defined cases: a null text counts as empty; an empty text has features of 0 and a score like any other; without labelled
rows of both classes the score is the share of the class there is (0.5 without any); repeated rows score alike; a row
without id is held out; an empty table has no scores; further columns are left out, whatever their names. A very long text is
read whole; its words take about 60 bytes of memory each.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES = ("log_chars", "log_words", "word_length", "distinct_words", "top_word", "upper", "digits", "marks", "odd_marks", "pipes", "bangs", "not_ascii", "line_length", "distinct_lines", "word_runs")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


UPPER = _class("".join(map(chr, range(65, 91))))
LOWER = _class("".join(map(chr, range(97, 123))))
DIGIT = _class("0123456789")
MARK = _class("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
ODD = _class("#$%&*@^~<>{}[]\\_=+")
HIGH = (np.arange(256) >= 128).astype(float)
CLASSES = np.stack([UPPER, LOWER, DIGIT, MARK, ODD, _class("|"), _class("!"), HIGH], 1)


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for k, x in enumerate(texts):
        if not x:
            continue
        raw = np.frombuffer(x.encode(errors="surrogatepass"), np.uint8)
        upper, lower, digit, mark, odd, pipe, bang, high = np.bincount(raw, minlength=256) @ CLASSES
        words, lines = x.split(), x.split("\n")
        n, size = max(1, len(words)), len(raw)
        counts = Counter(words)
        runs = sum(map(str.__eq__, words, words[1:]))
        out[k] = (math.log1p(size), math.log1p(len(words)), size / n, len(counts) / n, max(counts.values(), default=0) / n, upper / max(1.0, upper + lower), digit / size, mark / size, odd / n, pipe / n, bang / n, high / size, math.log1p(size / len(lines)), len(set(lines)) / len(lines), runs / n)
    return out


@dataclass
class AdditiveModel:
    """cuts[f]: ascending limits of the bins of feature f; tables[f]: a value per bin; pairs: (f, g, cuts of f, of g, grid)."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, f], side="right")]
        for f, g, cf, cg, grid in self.pairs:
            z += grid[np.searchsorted(cf, x[:, f], side="right"), np.searchsorted(cg, x[:, g], side="right")]
        return z

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features(texts)), -40, 40)))


def _limits(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int) -> np.ndarray:
    """Values per bin of a tree with so many leaves, split where the gain is largest; g, h: sums over the rows of each bin."""
    parts = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        left, right = cg[:-1] ** 2 / (ch[:-1] + ridge), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge)
        gain = left + right - cg[-1] ** 2 / (ch[-1] + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    while len(parts) < leaves:
        gain, cut, k = max((*best(a, b), k) for k, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of two levels over a grid: the better first axis, then each side by the other axis."""
    best_gain, best_out = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, len(a)):
            out, gain = np.zeros_like(a), 0.0
            for s in (slice(0, k), slice(k, len(a))):
                gs, hs = a[s].sum(0), b[s].sum(0)
                v = _tree(gs, hs, ridge, 2)
                out[s] = v
                gain += float((2 * v * gs - v * v * (hs + ridge / len(gs))).sum())
            if gain > best_gain:
                best_gain, best_out = gain, out if axis == 0 else out.T
    return best_out


def fit(x: np.ndarray, y: np.ndarray, counts: dict[int, int], bins: int = 32, rounds: int = 120, rate: float = 0.1, leaves: int = 3, ridge: float = 5.0, pairs: int = 6, pair_bins: int = 6, pair_rounds: int = 30) -> AdditiveModel:
    """counts: labelled rows of each class, for the prior of the intercept."""
    n_features = len(FEATURES)
    if not len(y) or y.min() == y.max():
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return AdditiveModel(math.log(share / (1 - share)), [np.empty(0)] * n_features, [np.zeros(1)] * n_features, [])
    cuts = [_limits(x[:, f], bins) for f in range(n_features)]
    at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    share = y.mean()
    intercept = math.log(share / (1 - share))
    z = np.full(len(y), intercept)
    for _ in range(rounds):
        for f in range(n_features):
            p = 1 / (1 + np.exp(-z))
            g = np.bincount(at[f], weights=y - p, minlength=len(tables[f]))
            h = np.bincount(at[f], weights=p * (1 - p), minlength=len(tables[f]))
            step = rate * _tree(g, h, ridge, leaves)
            tables[f] += step
            z += step[at[f]]
    limits = [_limits(x[:, f], pair_bins) for f in range(n_features)]
    coarse = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(limits)]

    def grids(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        shape = (len(limits[f]) + 1, len(limits[g]) + 1)
        cell = coarse[f] * shape[1] + coarse[g]
        return tuple(np.bincount(cell, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

    def strength(f: int, g: int) -> float:
        a, b = grids(f, g)
        return float((a**2 / (b + ridge)).sum())

    chosen = sorted(((strength(f, g), f, g) for f in range(n_features) for g in range(f + 1, n_features)), reverse=True)[:pairs]
    tables2 = {(f, g): np.zeros((len(limits[f]) + 1, len(limits[g]) + 1)) for _, f, g in chosen}
    for _ in range(pair_rounds):
        for (f, g), grid in tables2.items():
            step = rate * _grid_tree(*grids(f, g), ridge)
            grid += step
            z += step[coarse[f], coarse[g]]
    shift = math.log((counts[1] / counts[0]) / (y.mean() / (1 - y.mean()))) if counts.get(0) and counts.get(1) else 0.0
    return AdditiveModel(intercept + shift, cuts, tables, [(f, g, limits[f], limits[g], grid) for (f, g), grid in tables2.items()])


def train(spark: SparkSession, sf_dir: str, most: int = common.MOST_LABELLED) -> AdditiveModel:
    """Fit on at most `most` labelled documents outside the held-out fold; executors compute their features."""
    import pyarrow as pa

    sample, counts = common.labelled_sample(spark, sf_dir, "quality", most)

    def run(batches):
        for batch, texts in common.blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("label")), pa.array(features(texts).tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = sorted(sample.mapInArrow(run, "doc_id long, label int, x array<double>").collect())
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows], float), counts)


def score(df: DataFrame, model: AdditiveModel, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def work(texts: list[str]) -> dict[str, object]:
        return {"score": model.scores(texts).tolist()}

    out = common.map_blocks(df, "score double", work, doc_id, text)
    return out.select(doc_id, common.held_out(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark, sf_dir):
    return score(common.table(spark, sf_dir, "documents"), train(spark, sf_dir))
