"""Quality classifier: kernel ridge regression by random Fourier features, with isotonic calibration.

Each document is reduced to statistics of its text. Standardised, they go through cosines of random projections, whose
inner products approximate a Gaussian kernel. The ridge weights solve the normal equations; every task sums its share of
them, and Spark adds the shares entry by entry, so their size does not depend on the number of documents. Raw scores of
the training rows are counted into BINS bins, and pooling adjacent violators over the bins makes them calibrated
likelihoods of label 1.

Labels are read only for rows that are not held out. Ids, language, source and labels are never inputs of a score.
Defined cases: a null or empty text has the statistics of an empty text and gets a score like any other; a null id counts
as empty text when held-out rows are chosen; labels that are null or for no document are not used; a document with
several labels counts once for each; without labels of both kinds every score is 0.5; an empty table gives no rows; rows that
repeat are scored alike. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.stats import NAMES, statistics
from quantloom.llm.store import BROADCAST_ROWS, held_out, in_arrow, landed, text_of

FEATURES = 160
#: Width of the kernel: projections of the standardised statistics have this standard deviation.
GAMMA = 0.25
RIDGE = 1e-3
BINS = 512
THRESHOLD = 0.3


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.turn + self.shift
        return np.concatenate((np.sqrt(2 / len(self.shift)) * np.cos(z), np.ones((len(x), 1))), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated likelihood, linear between the bins."""
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0, 1)


def projections(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.normal(0, GAMMA, (len(NAMES), FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES)


def pooled(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic fit to good / total by pooling adjacent violators, for bins with rows."""
    blocks: list[list[float]] = []
    for g, t in zip(good, total):
        blocks.append([g, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g1, t1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g1, blocks[-1][1] + t1, blocks[-1][2] + n1]
    return np.concatenate([np.full(int(n), g / t) for g, t, n in blocks]) if blocks else np.zeros(0)


def _arrays(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(NAMES))


def fit(training: DataFrame) -> Model | None:
    """A model from rows (x, y), y being 0 or 1; None if they are all alike in y.

    Each task that reads a piece of the table gives one share of FEATURES ** 2 / 2 sums, so their number follows its bytes.
    """
    n = len(NAMES)
    sums = training.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(n)],
        *[F.sum(F.col("x")[k] * F.col("x")[k]).alias(f"q{k}") for k in range(n)]).head()
    if not sums["n"] or not 0 < sums["y"] < sums["n"]:
        return None
    mean = np.array([sums[f"s{k}"] for k in range(n)]) / sums["n"]
    scale = np.sqrt(np.maximum(np.array([sums[f"q{k}"] for k in range(n)]) / sums["n"] - mean ** 2, 0))
    turn, shift = projections()
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), turn, shift, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    size = FEATURES + 2

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This task's share of the sums of products of features and label: one entry a row, upper triangle."""
        share = np.zeros((size, size))
        for batch in batches:
            z = np.concatenate((model.features(_arrays(batch)), np.asarray(batch.column("y"))[:, None]), 1)
            share += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array((i * size + j).astype(np.int32)), pa.array(share[i, j])], names=["at", "v"])

    total = np.zeros(size * size)
    for row in in_arrow(training, equations, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[row["at"]] = row["v"]
    full = total.reshape(size, size)
    full = np.triu(full) + np.triu(full, 1).T
    left = full[:-1, :-1] / sums["n"] + RIDGE * np.eye(size - 1)
    model.weights = np.linalg.solve(left, full[:-1, -1] / sums["n"])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = bin_of(model.raw(_arrays(batch)))
            total_ += np.bincount(at, minlength=BINS)
            good += np.bincount(at, np.asarray(batch.column("y"), float), BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(total_), pa.array(good)], names=["at", "n", "y"])

    counts = in_arrow(training, binned, "at int, n double, y double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    rows = sorted((r["at"], r["n"], r["y"]) for r in counts.collect() if r["n"])
    at, t, g = (np.array(v, float) for v in zip(*rows))
    model.edges, model.levels = LOW + (at + 0.5) * (HIGH - LOW) / BINS, pooled(g, t)
    return model


#: Range of raw scores that is binned; scores beyond it go to the outer bins.
LOW, HIGH = -0.75, 1.75


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    rows = docs.select(*keep, text_of().alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return in_arrow(rows, statistics, (fields + ", " if fields else "") + "x array<double>")


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and y of the labels that may be learned from."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.select("doc_id", F.col("quality").cast("double").alias("y"))


def train(numbers: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on labelled rows that are not held out; ``numbers`` has doc_id and x."""
    return fit(landed(numbers.join(learnable(labels), "doc_id").select("x", "y"), "training"))


def scored(numbers: DataFrame, model: Model | None) -> DataFrame:
    """Add ``score`` to rows with ``x``, which is dropped."""
    keep = [c for c in numbers.columns if c != "x"]
    if model is None:
        return numbers.select(*keep, F.lit(0.5).alias("score"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(model.score(_arrays(batch)))], names=[*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbers.select(*keep).schema)
    return in_arrow(numbers, judge, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    numbers = landed(with_statistics(docs, ["doc_id"]), "statistics")
    out = scored(numbers, train(numbers, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject.

    Statistics for training are taken of labelled documents only, if their ids are few enough to be sent to the texts (all
    that are labelled are learned from either way).
    """
    ids = learnable(labels).select("doc_id")
    learned = docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_ROWS else docs
    model = train(with_statistics(learned, ["doc_id"]), labels)
    if model is None:
        return docs
    fields = docs.schema
    text = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quantloom.llm.stats import table

        for batch in batches:
            yield batch.filter(pa.array(model.score(table(batch.column(text))) >= THRESHOLD))

    return in_arrow(docs, good, fields)
