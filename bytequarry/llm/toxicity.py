"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The n-grams are those of SIZES characters within a document's distinct words, lower-cased, without outer marks, and with a
mark for a word's begin and end; an n-gram's value is its number of occurrences there. In training, each n-gram's column is
multiplied by its smoothed log-count ratio between the classes, and a logistic regression with an L2 penalty is fitted to
that. N-grams are hashed to a fixed number of columns, by their characters' code points, so any script has n-grams of the
same length. Training and scoring share one tokeniser (`grams`), which works on blocks of documents at once and keeps nothing.

Training takes at most MOST_LABELLED documents and MOST_ENTRIES entries of the sample's matrix, both documented bounds: a
class's documents are taken whole, in the order of their ids' hashes, as long as its share of the entries lasts.

Defined cases: a null text counts as empty; an empty text has the score of the intercept; without any labelled row of both
classes the score is the share of the class there is (0.5 without any); repeated rows score alike; a row without id is
held out; an empty table has no scores; further columns don't matter to `score` and are kept by `keep_clean`, whatever
their names. A very long text makes a block of its own, with about 60 bytes of memory per character.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of an n-gram, and hashed columns.
SIZES = (3, 4, 5)
COLUMNS = 1 << 19
EDGE = ".,;:!?\"'()[]{}<>#$%&*+-/=@^_|~`"
MOST_LABELLED, MOST_ENTRIES = 3_000, 5_000_000
BLOCK_CHARS = 1_000_000
#: Weights are multiples of 1 / GRAIN, so that their sums are exact and a score doesn't depend on the texts beside it.
GRAIN = 1 << 20


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of a block of texts: the pairs of text and word, each once, by text, and the words."""
    rows = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
    raw = rows.values.dictionary_encode()
    known = pc.utf8_trim(raw.dictionary, EDGE).dictionary_encode()
    names = known.dictionary.to_pylist()
    size = np.diff(rows.offsets.to_numpy())
    pairs = np.repeat(np.arange(len(texts)), size) * max(1, len(names)) + known.indices.to_numpy()[raw.indices.to_numpy()]
    pairs = np.unique(pairs)
    return *np.divmod(pairs, max(1, len(names))), names


def grams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of word and hashed column of every n-gram of the words."""
    points = np.frombuffer("".join([f"<{w}>" for w in names]).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, names), np.int64, len(names)) + 2
    owner = np.repeat(np.arange(len(names), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
    who, column = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = h[: max(0, len(points) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        if n in SIZES:
            at = np.flatnonzero(left[: len(h)] >= n)
            x = h[at] ^ (h[at] >> np.uint64(31))
            x = x * np.uint64(0xBF58476D1CE4E5B9)
            who.append(owner[at])
            column.append((x >> np.uint64(40)).astype(np.int32) & (COLUMNS - 1))
    return np.concatenate(who), np.concatenate(column)


@dataclass
class ToxicityModel:
    weights: np.ndarray | None
    intercept: float

    def logits(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.intercept)
        doc, word, names = words(texts)
        who, column = grams(names)
        value = np.bincount(who, weights=self.weights[column], minlength=len(names))
        return self.intercept + np.bincount(doc, weights=value[word], minlength=len(texts))

    def scores(self, texts: list[str]) -> list[float]:
        return (1 / (1 + np.exp(-np.clip(self.logits(texts), -40, 40)))).tolist()


def entries(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct columns and their values of each text."""
    doc, word, names = words(texts)
    who, column = grams(names)
    order = np.argsort(who, kind="stable")
    column, size = column[order], np.bincount(who, minlength=len(names))
    first = np.cumsum(size) - size
    n = size[word]
    at = np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    cell, count = np.unique(np.repeat(doc, n) * COLUMNS + column[at], return_counts=True)
    cut = np.searchsorted(cell, np.arange(1, len(texts)) * COLUMNS)
    return list(zip(np.split((cell % COLUMNS).astype(np.int32), cut), np.split(count.astype(np.float32), cut), strict=True))


def lbfgs(value_and_gradient, x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Minimize a smooth convex function."""
    f, g = value_and_gradient(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, used = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ q)
            q -= a * y
            used.append(a)
        if steps:
            q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y, rho), a in zip(steps, reversed(used), strict=True):
            q += (a - rho * (y @ q)) * s
        slope, t = -(g @ q), 1.0 if steps else 1.0 / max(1.0, float(np.abs(g).sum()))
        if slope > -1e-9:
            break
        while True:
            new = x - t * q
            f2, g2 = value_and_gradient(new)
            if f2 <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = new - x, g2 - g
        if (sy := s @ y) > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y, 1 / sy)]
        done = abs(f - f2) < 1e-7 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    return x


def fit(rows: Iterable[tuple[list[str], int]], counts: dict[int, int], **options) -> ToxicityModel:
    """rows: the words and the label of each document; counts: labelled rows of each class, for the prior."""
    rows = list(rows)
    return fit_entries(entries([" ".join(w) for w, _ in rows]) if rows else [], [y for _, y in rows], counts, **options)


def fit_entries(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], counts: dict[int, int], least: int = 3, smoothing: float = 1.0, penalty: float = 1.0) -> ToxicityModel:
    """rows: the columns and values of each document. Columns with a total of less than `least` are left out."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return ToxicityModel(None, math.log(share / (1 - share)))
    size = np.array([len(c) for c, _ in rows])
    column, value = np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows])
    doc = np.repeat(np.arange(len(y), dtype=np.int32), size)
    total = np.bincount(column, weights=value, minlength=COLUMNS)
    kept = np.flatnonzero(total >= least)
    place = np.full(COLUMNS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    column = place[column]
    ok = column >= 0
    column, value, doc = column[ok], value[ok], doc[ok]
    p = np.bincount(column, weights=value * y.astype(np.float32)[doc], minlength=len(kept))
    q = total[kept] - p + smoothing
    p = p + smoothing
    ratio = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(doc, weights=value * (x[:-1].astype(np.float32) * ratio)[column], minlength=len(y)) + x[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        slope = np.bincount(column, weights=value * error.astype(np.float32)[doc], minlength=len(kept)) * ratio
        return float((np.logaddexp(0, z) - y * z).sum() + penalty / 2 * (x[:-1] @ x[:-1])), np.append(slope + penalty * x[:-1], error.sum())

    x = lbfgs(objective, np.zeros(len(kept) + 1))
    seen = {k: float((y == k).sum()) for k in (0, 1)}
    shift = math.log((counts[1] / counts[0]) / (seen[1] / seen[0])) if counts.get(0) and counts.get(1) else 0.0
    weights = np.zeros(COLUMNS, np.float32)
    weights[kept] = np.round(x[:-1] * ratio * GRAIN) / GRAIN
    return ToxicityModel(weights, float(x[-1]) + shift)


def affordable(sizes: list[tuple[int, int, int]], most: int = MOST_ENTRIES) -> set[int]:
    """The ids to learn from. sizes: id, label and entries, in the order in which documents are taken."""
    of = {k: sum(n for _, y, n in sizes if y == k) for k in (0, 1)}
    out = set()
    for k in (0, 1):
        left = max(most // 2, most - of[1 - k])
        for i, y, n in sizes:
            if y == k and (left := left - n) >= 0:
                out.add(i)
            elif left < 0 and y == k:
                break
    return out


def train(spark: SparkSession, sf_dir: str, most: int = MOST_LABELLED) -> ToxicityModel:
    """Fit on at most `most` labelled documents outside the held-out fold. Executors make the entries; no text comes here."""
    sample, counts = common.labelled_sample(spark, sf_dir, "toxic", most)

    def run(batches):
        for batch, texts in common.blocks(batches, "text", BLOCK_CHARS):
            got = entries(texts)
            column, value = pa.array([c for c, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "label")), column, value], names=["doc_id", "label", "columns", "values"])

    with common.Scratch(spark) as scratch:
        rows = scratch.table(common.mapped(sample.select("doc_id", "label", "text"), run, "doc_id long, label int, columns array<int>, values array<float>"), "entries")
        sizes = [tuple(r) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "label", F.size("columns")).collect()]  # at most `most` rows
        ids = spark.createDataFrame([(i,) for i in sorted(affordable(sizes))], "doc_id long")
        t = rows.join(F.broadcast(ids), "doc_id").toArrow()  # at most MOST_ENTRIES entries
    order = np.argsort(t["doc_id"].to_numpy(), kind="stable").tolist()
    flat = lambda c: np.split(t[c].combine_chunks().flatten().to_numpy(), np.cumsum(pc.list_value_length(t[c]).to_numpy())[:-1]) if len(order) else []
    columns, values, labels = flat("columns"), flat("values"), t["label"].to_pylist()
    return fit_entries([(columns[k], values[k]) for k in order], [labels[k] for k in order], counts)


def score(df: DataFrame, model: ToxicityModel, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def work(texts: list[str]) -> dict[str, object]:
        return {"score": shared.value.scores(texts)}

    out = common.map_blocks(df, "score double", work, doc_id, text, chars=BLOCK_CHARS)
    return out.select(doc_id, common.held_out(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of df whose text scores below the threshold, all their columns as they were."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        with common.steady():
            for batch, texts in common.blocks(batches, text, BLOCK_CHARS):
                yield batch.filter(pa.array([s < threshold for s in shared.value.scores(texts)], pa.bool_()))

    return common.mapped(df, run, df.schema)


def op5_toxicity(spark, sf_dir):
    return score(common.table(spark, sf_dir, "documents"), train(spark, sf_dir))
