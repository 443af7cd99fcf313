"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting goes round the features, and each time fits a shallow regression tree on the gradients summed by bin; the trees of a feature add
up to one lookup table. Then the pairs of features that explain most of what is left get tables over coarse bins in the same way. A score is the sum of one entry of
each table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import shingles
from alphaloom.llm.common import fold, in_parts, sample_rate, table

#: Labelled rows that the model is fitted on, on average at most.
TRAINING_ROWS = 20_000
FOLDS = 5
CUT = 0.3

FEATURES = (
    "log_bytes", "upper", "digits", "shouts", "signs", "bars", "stops", "others", "wide", "word_length", "log_lines", "words_per_line", "repeated_lines", "repeated_words",
    "top_word", "repeated_shingles", "short_words", "sentences",
)

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)


def _features(text: bytes, words: np.ndarray, lengths: np.ndarray) -> list[float]:
    n, w = max(len(text), 1), max(len(words), 1)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    punctuation = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    shouts, signs, bars, stops = int(c[33] + c[63]), int(c[35] + c[36] + c[37] + c[38] + c[42]), int(c[124]), int(c[44] + c[46])
    lines = [x for x in text.split(b"\n") if x]
    _, counts = np.unique(words, return_counts=True) if len(words) else (None, np.ones(1, np.int64))
    grams = len(words) - shingles.WORDS + 1
    if grams > 0:
        g = words[:grams].copy()
        for k in range(1, shingles.WORDS):
            g = g * np.uint64(6364136223846793005) + words[k : k + grams]
        repeated = 1 - len(np.unique(g)) / grams
    else:
        repeated = 0.0
    return [
        float(np.log1p(len(text))), upper / max(upper + lower, 1), int(c[48:58].sum()) / n, shouts / n, signs / n, bars / n, stops / w,
        (punctuation - shouts - signs - bars - stops) / n, int(c[128:].sum()) / n, float(lengths.mean()) if len(lengths) else 0.0, float(np.log1p(len(lines))), len(words) / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1), 1 - len(counts) / w, int(counts.max()) / w, repeated, float((lengths <= 3).mean()) if len(lengths) else 0.0, int(c[46]) / max(len(lines), 1),
    ]


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES per text, of the whole text."""
    out = []
    for _, some in shingles.in_groups(texts):
        data = b" ".join([*some, b""])
        begins, words = shingles.word_hashes(data)
        space = np.flatnonzero(shingles._SPACE[np.frombuffer(data, np.uint8)])
        lengths = space[np.searchsorted(space, begins)] - begins
        cuts = np.searchsorted(begins, np.concatenate(([0], np.cumsum([len(x) + 1 for x in some])))).tolist()
        out += [_features(x, words[a:b], lengths[a:b]) for x, a, b in zip(some, cuts[:-1], cuts[1:], strict=True)]
    return np.array(out, np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # of each feature: coarse bin by bin

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.intercept)
        for t, b in zip(self.tables, bins, strict=True):
            total += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[float, int]:
    """The best split of a row of bins (gain, first bin on the right)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 2.0, ridge: float = 1.0) -> np.ndarray:
    """The values of a regression tree over ordered bins, from sums of gradients and weights by bin."""
    gain, k = _cut(g, h, least, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate((tree(g[:k], h[:k], depth - 1, least, ridge), tree(g[k:], h[k:], depth - 1, least, ridge)))


def pair_tree(g: np.ndarray, h: np.ndarray, least: float = 2.0, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """A tree of two levels over a grid: a split of one axis, then one of the other axis on each side; and its gain."""
    best, out = 0.0, np.zeros_like(g)
    total = g.sum() ** 2 / (h.sum() + ridge)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            value, gain = np.zeros_like(a), -total
            for rows in (slice(0, k), slice(k, None)):
                x, y = a[rows].sum(axis=0), b[rows].sum(axis=0)
                value[rows] = tree(x, y, 1, least, ridge)
                _, c = _cut(x, y, least, ridge)
                for part in (slice(0, c), slice(c, None)):
                    gain += x[part].sum() ** 2 / (y[part].sum() + ridge)
            if gain > best:
                best, out = gain, value.T if flip else value
    return out, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, depth: int = 2, rate: float = 0.15, n_pairs: int = 6, pair_rounds: int = 30, coarse: int = 6) -> Model:
    """x: rows of features, y: labels of 0 and 1. Without both labels every score is the smoothed rate of label 1."""
    p = (y.sum() + 1.0) / (len(y) + 2.0)
    start = float(np.log(p / (1 - p)))
    if len(set(y.tolist())) < 2:
        return Model(start, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    model = Model(start, edges, [np.zeros(len(e) + 1) for e in edges])
    binned = model.bins(x)
    total = np.full(len(y), start)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for f, b in enumerate(binned):
            r, w = residual()
            step = rate * tree(np.bincount(b, r, len(edges[f]) + 1), np.bincount(b, w, len(edges[f]) + 1), depth)
            model.tables[f] += step
            total += step[b]
    model.coarse = [np.minimum(np.arange(len(e) + 1) * coarse // (len(e) + 1), coarse - 1) for e in edges]
    grid = [c[b] for c, b in zip(model.coarse, binned, strict=True)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        r, w = residual()
        at = grid[i] * coarse + grid[j]
        return tuple(np.bincount(at, v, coarse * coarse).reshape(coarse, coarse) for v in (r, w))

    gains = sorted(((pair_tree(*sums(i, j))[1], (i, j)) for i, j in combinations(range(x.shape[1]), 2)), key=lambda g: (-g[0], g[1]))
    model.pairs = [ij for gain, ij in gains[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((coarse, coarse)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            step = rate * pair_tree(*sums(i, j))[0]
            t += step
            total += step[grid[i], grid[j]]
    return model


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        x = features(_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled documents outside the held-out fold: on all, or on a share that the ids decide, TRAINING_ROWS on average."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)).select("doc_id", "quality").distinct()
    n = known.count()
    some = known.filter(sample_rate(F.col("doc_id"), min(1.0, TRAINING_ROWS / max(n, 1)), "quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.col("quality").cast("int"), F.col("text"))  # TRAINING_ROWS bounds what is broadcast
    got = rows.mapInArrow(_with_features, "quality int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["quality"].to_numpy())) if len(x) else np.zeros(0, np.int64)  # whatever order the rows came in
    return fit(x[order], got["quality"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per document, of its whole text.

    A null text scores as an empty one; a null id counts as empty text in its fold. Repeated rows score alike; an empty table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            p = model.score(features(_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
