"""Quality classifier: Naive Bayes support vectors (NB-SVM).

N-gram indicators are scaled by class log-count ratios and a linear model with
hinge loss is fitted to them by dual coordinate descent. Indicators are of words
and word pairs, and of one to three shapes in a row (a shape: letter case, marks
at the end, and whether the word repeats the one before), hashed to `dims` places.

The fit takes at most `max_rows` labelled rows, those with the smallest hash of
their id, one an id, and of those no more than `max_bytes` of n-gram places; that bounds
its broadcast and what comes to the driver. N-grams of fewer than 3 of these rows are left out. Scoring reads every document once, without a shuffle, with two arrays of
`dims` numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, table, written

DIMS = 1 << 18
MAX_ROWS = 6000
MAX_BYTES = 1 << 28
THRESHOLD = 0.3


def shape(word: bytes) -> int:
    """A small number for how a word looks."""
    body = word.rstrip(b".,;:!?#*$%&|<>\"')]")
    marks = len(word) - len(body)
    case = 0 if not body else 1 if body.islower() else 2 if body.istitle() else 3 if body.isupper() else 4 if body.isdigit() else 5
    last = b".,;:!?#*$%&|<>\"')]".find(word[-1:]) + 1
    return case + 6 * min(marks, 3) + 24 * last


class Words(dict):
    """word -> CRC of its lower-case form, and its shape in the upper half; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = zlib.crc32(word.lower()) | shape(word) << 32
        return value


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(text: str, words: Words, dims: int) -> np.ndarray:
    """The places of the n-grams that a text has, ascending."""
    row = text.encode("utf-8", "surrogatepass").split()
    if not row:
        return np.empty(0, np.int32)
    both = np.fromiter(map(words.__getitem__, row), np.uint64, len(row))
    word = both & np.uint64(0xFFFFFFFF)
    looks = (both >> np.uint64(32)) * np.uint64(2)
    looks[1:] += word[1:] == word[:-1]
    grams = [
        mixed(word, 1), mixed(mixed(word[:-1], 2) + word[1:], 2),
        mixed(np.unique(looks), 3), mixed(np.unique(looks[:-1] << np.uint64(12) | looks[1:]), 4),
        mixed(np.unique(looks[:-2] << np.uint64(24) | looks[1:-1] << np.uint64(12) | looks[2:]), 5)]
    return np.unique((np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - dims.bit_length() + 1)).astype(np.int32))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, cost: float = 1.0, epochs: int = 15, seed: int = 0) -> np.ndarray:
    """Weights (the bias last) of the linear model with hinge loss, by coordinate descent on its dual.

    Each row is scaled to length one and has a constant feature.
    """
    w, alpha = np.zeros(dims + 1), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            j, x = rows[i], values[i]
            slope = y[i] * (w[j] @ x + w[dims]) - 1
            new = min(max(alpha[i] - slope / (x @ x + 1), 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w[j] += step * x
                w[dims] += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), fitted by Newton steps to labels pulled in a little."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def values(self, at: np.ndarray) -> np.ndarray:
        x = self.ratios[at]
        length = np.sqrt(x @ x)
        return x / length if length else x

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at] @ self.values(at) + self.weights[-1])

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, dims: int, least: int = 3) -> np.ndarray:
    """log of (share of class 1 that has an n-gram / share of class 0), smoothed; 0 for n-grams of fewer than `least` rows."""
    counts = np.zeros((2, dims))
    for at, label in zip(rows, y, strict=True):
        counts[int(label > 0), at] += 1
    shares = [(counts[k] + 1) / ((y > 0).sum() * k + (y < 0).sum() * (1 - k) + 2) for k in (0, 1)]
    return np.where(counts.sum(axis=0) >= least, np.log(shares[1] / shares[0]), 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, dims: int) -> Model:
    """The model for rows of places and labels 1 and -1. With one class or none its score is constant."""
    if not len(y) or abs(y.sum()) == len(y):
        up = (y > 0).sum()
        return Model(np.zeros(dims), np.zeros(dims + 1), 0.0, float(np.log((up + 1) / (len(y) - up + 1))))

    def solve(take: np.ndarray) -> Model:
        some = [rows[i] for i in take]
        model = Model(log_count_ratios(some, y[take], dims), np.zeros(dims + 1), 1.0, 0.0)
        model.weights = dual_descent(some, [model.values(r) for r in some], y[take], dims)
        return model

    # a fifth that the first model has not seen sets the scale of the scores
    every = np.arange(len(y))
    first, seen = solve(every[every % 5 != 0]), every[every % 5 == 0]
    slope, shift = logistic_fit(np.array([first.margin(rows[i]) for i in seen]), y[seen])
    model = solve(every)
    model.slope, model.shift = max(slope, 0.0), shift
    return model


def held_out(doc_id: str = "doc_id", fold: int = 0) -> F.Column:
    """True where crc32 of the id as text leaves that remainder by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == fold, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fold: int | None = 0, max_rows: int = MAX_ROWS, dims: int = DIMS, max_bytes: int = MAX_BYTES,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents, at most max_rows of them, without those of the held-out fold (None: all).

    Of those rows the first whose n-gram places come to max_bytes in all are fitted on the driver, in the order of a hash of their ids.

    Of an id's labels the largest counts; of an id's rows in docs the one whose n-gram
    places are smallest, so no id brings more than one row. Null ids, labels and rows
    without a text of their own learn nothing or count as empty; no labels: a constant score.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    if fold is not None:
        known = known.filter(~held_out(fold=fold))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # max_rows bounds the broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            places = [features(t.as_py(), words, dims).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(places, pa.binary())], names=["doc_id", "label", "places"])

    own = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    found = own.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, places binary")
    found = written(found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("places").alias("places")), "fit-rows")
    # a window over two numbers of each of at most max_rows rows
    so_far = F.sum(F.length("places")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    fitting = found.select("doc_id", so_far.alias("so_far")).filter(F.col("so_far") <= max_bytes).select("doc_id")
    found = found.join(F.broadcast(fitting), "doc_id").toArrow()
    order = np.lexsort([[zlib.crc32(x) for x in found.column("places").to_pylist()], found.column("doc_id").to_numpy()])
    rows = [np.frombuffer(found.column("places")[int(i)].as_py(), np.int32) for i in order]
    y = np.where(found.column("label").to_numpy()[order] > 0, 1, -1) if len(order) else np.empty(0, int)
    return fit(rows, y, dims)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: 0 to 1, higher where label 1 is likelier.

    Null and empty texts get the score of a text without n-grams. Null and repeated
    ids are carried along. Very long texts are scored whole, one at a time; equal texts
    score alike. Other columns are ignored. An empty table gives an empty table.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), score_column(docs.sparkSession, model)(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))


def score_column(spark: SparkSession, model: Model):
    """A function from a text column to its score."""
    shared = spark.sparkContext.broadcast((Model(model.ratios.astype(np.float32), model.weights.astype(np.float32), model.slope, model.shift)))
    dims = len(model.ratios)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, own = Words(), shared.value
        for texts in batches:
            yield pa.array([own.score(features(t.as_py() or "", words, dims)) for t in texts], pa.float64())

    return scored


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
