"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear support vector machines between its languages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import fold, in_parts, sample_rate, table

#: Closely related languages. A language that stands in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "uz", "kk", "ky"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh", "yue", "wuu"),
}
#: Hashed features; documents that the model is fitted on, on average at most: of each language, and of all together.
SIZE = 8192
TRAINING_DOCS, TRAINING_TOTAL = 500, 2000
#: Texts whose vectors a worker holds at a time.
TEXTS = 256
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
#: The score under which with_language() takes an answer for none: what two coin tosses, for the family and for the language, would give.
LEAST_SCORE = 0.25

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ALONE, _TWO, _THREE = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


def family(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang.split("-")[0] in v), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(text: str | None) -> np.ndarray | None:
    """Square roots of the counts of the text's hashed pairs and triples of bytes, lower-cased and with anything but letters as blanks, at length 1; None without a letter."""
    if not has_letter(text):
        return None
    b = _LETTER[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    counts = np.zeros(SIZE, np.float64)
    for i in range(0, len(b), 1 << 20):
        x = b[max(0, i - 2) : i + (1 << 20)].astype(np.uint32)
        seen = 2 if i else 0
        for n in (1, 2, 3):
            if len(x) < n:
                continue
            key = x[: len(x) - n + 1].copy()
            for k in range(1, n):
                key = (key << np.uint32(8)) | x[k : len(x) - n + 1 + k]
            key = ((key + np.uint32(n << 26)) * (_ALONE, _TWO, _THREE)[n - 1]) >> np.uint32(19)
            counts += np.bincount(key[max(0, seen - n + 1) :], minlength=SIZE)
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)).astype(np.float32)


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 8.0, passes: int = 12) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss) over some rows of x, by dual coordinate descent; y: -1 and 1. The last weight is the bias."""
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows))
    norm = np.array([float(x[k] @ x[k]) for k in rows]) + 1 + 0.5 / c  # the bias is a feature that is always 1
    rng = np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            v = x[rows[i]]
            grad = y[i] * (v @ w + bias) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - grad / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * v
                bias += step
                alpha[i] = new
    return np.append(w, bias)


def _slope(margins: np.ndarray, y: np.ndarray) -> float:
    """a of 1 / (1 + exp(-a margin)), by likelihood on a grid."""
    grid = np.array([0.5, 1, 2, 3, 4, 6, 8])
    loss = [np.logaddexp(0, -a * y * margins).mean() + 0.002 * a for a in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Machines:
    """One-versus-one machines between names; choose() votes."""

    names: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE + 1), np.float32))
    slopes: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, rows: np.ndarray, names: np.ndarray) -> Machines:
        """names: of the rows of x in rows. No row is copied, so that the driver holds x once."""
        order = sorted(set(names.tolist()))
        weights, slopes = [], []
        for a, b in combinations(order, 2):
            of = (names == a) | (names == b)
            own, y = rows[of], np.where(names[of] == a, 1.0, -1.0)
            w = svm(x, own, y)
            weights.append(w)
            slopes.append(_slope(np.array([x[k] @ w[:-1] for k in own]) + w[-1], y))
        return cls(order, np.array(weights, np.float32).reshape(-1, x.shape[1] + 1), slopes)

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x the number of the name with most votes (ties: greatest sum of margins, then first), and the least probability with which it won a vote."""
        n = len(x)
        if len(self.names) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margins = (x @ self.weights[:, :-1].T + self.weights[:, -1]).astype(np.float64)
        votes, sums, least = np.zeros((n, len(self.names))), np.zeros((n, len(self.names))), np.ones((n, len(self.names)))
        for k, ((a, b), s) in enumerate(zip(combinations(range(len(self.names)), 2), self.slopes, strict=True)):
            m = margins[:, k]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sums[:, a] += m
            sums[:, b] -= m
            p = 1 / (1 + np.exp(-s * m))
            least[:, a], least[:, b] = np.minimum(least[:, a], p), np.minimum(least[:, b], 1 - p)
        best = np.where(votes == votes.max(axis=1, keepdims=True), sums, -np.inf).argmax(axis=1)
        return best, least[np.arange(n), best]


@dataclass
class Model:
    families: Machines | None = None
    languages: dict[str, Machines] = field(default_factory=dict)

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """A language and a score for each text; TEXTS at a time are one matrix product for the families, and one for the languages of each family."""
        texts = iter(texts)
        while some := [vector(t) for t in islice(texts, TEXTS)]:
            rows = [k for k, v in enumerate(some) if v is not None] if self.families else []
            out = [(UNDETERMINED, 0.0)] * len(some)
            if rows:
                x, at = np.stack([some[k] for k in rows]), np.array(rows)
                which, p = self.families.choose(x)
                for f, name in enumerate(self.families.names):
                    own = np.flatnonzero(which == f)
                    if len(own):
                        machines = self.languages[name]
                        lang, q = machines.choose(x[own])
                        for k, i, s in zip(at[own].tolist(), lang.tolist(), (p[own] * q).tolist(), strict=True):
                            out[k] = machines.names[i], s
            yield from out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if (v := vector(text.as_py())) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.astype(np.float16).tobytes()], pa.binary())], names=["lang", "v"])


def train(docs: DataFrame) -> Model:
    """Fits on documents with a language outside the held-out fold: on all of a language, or on a share that the ids decide, on average TRAINING_DOCS or a language's part of
    TRAINING_TOTAL, whichever is less. What reaches the driver is at most about TRAINING_TOTAL x 16 KB, however many languages there are.
    """
    known = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model()
    rates = {lang: min(1.0, min(TRAINING_DOCS, TRAINING_TOTAL / len(counts)) / n) for lang, n in counts.items()}
    rate = F.lit(0.0)
    for lang, share in sorted(rates.items()):
        rate = F.when(F.col("lang") == lang, F.lit(share)).otherwise(rate)
    some = known.filter(sample_rate(F.col("doc_id"), rate, "language")).select("lang", "text").mapInArrow(_vectors, "lang string, v binary").toArrow()
    rows = sorted(zip(some["lang"].to_pylist(), some["v"].to_pylist(), strict=True))  # whatever order they came in
    del some
    if not rows:
        return Model()
    langs, x = np.array([r[0] for r in rows]), np.empty((len(rows), SIZE), np.float32)
    for k, (_, v) in enumerate(rows):
        x[k] = np.frombuffer(v, np.float16)
    del rows
    of, all_rows = np.array([family(n) for n in langs]), np.arange(len(langs))
    return Model(Machines.fit(x, all_rows, of), {f: Machines.fit(x, all_rows[of == f], langs[of == f]) for f in sorted(set(of.tolist()))})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per document, of its whole text.

    A null or empty text or one without a letter is UNDETERMINED at score 0, as is every text if no language could be learned. A null id counts as empty text in its fold.
    Repeated rows are predicted alike; an empty table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            got = list(model.predict(x.as_py() for x in batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, every column, whose language the model tells with a score of at least least; where lang is null, it is the predicted one.

    Null and empty texts and those without a letter go. A model that learned no language (no document with one outside the held-out fold) tells nothing: then every text
    with a letter stays as it is. Repeated rows stay or go alike; an empty table gives no rows; no name of a column clashes.
    """
    column = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = batch.column("text")
            if model.families is None:
                yield batch.filter(pa.array([has_letter(x.as_py()) for x in texts], pa.bool_()))
                continue
            got = list(model.predict(x.as_py() for x in texts))
            if column is not None:
                told = batch.column(column)
                batch = batch.set_column(column, batch.schema.field(column), pa.array([x.as_py() if x.is_valid else g for x, (g, _) in zip(told, got, strict=True)], told.type))
            yield batch.filter(pa.array([g != UNDETERMINED and s >= least for g, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
