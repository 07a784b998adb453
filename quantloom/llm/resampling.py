"""Importance resampling towards a target distribution, over hashed word n-grams.

Features of a text are its runs of one to three words (A-Z in lower case; letters, digits and all beyond ASCII), joined by one
space and counted as often as they occur. A feature's bucket is its CRC-32 modulo BUCKETS. The counts of all buckets over the
documents (s, together S) and over the target texts (t, together T) give each bucket a gain, the whole part of a thousand
times the logarithm of its smoothed share in the target over that in the documents. A document's weight is the sum of the
gains of its features, its score adds Gumbel noise from a hash of its id, and the highest scores are a draw without
replacement in proportion to the weights' exponentials.

CRCs come in matrices: distinct features of equal length are the rows of a two-dimensional array of bytes, all rows go through
the CRC together, one column after the other, and the buckets are scattered back to where the features occurred. A text is
read in slices of words, so what a task holds does not grow with the features of a long one; features of more than LONG bytes,
of which a matrix would hold a row or two, are hashed one by one.

Two passes read the documents, one for the counts of buckets (at most BUCKETS rows leave a task) and one for the weights;
the BUCKETS gains go to the tasks. Places come from ranges of the order, each sorted on its own.

Defined cases: a null or empty text, and one without words, has no features, weight 0 and a score, but too few words to be drawn;
a null id hashes like an empty one and comes last among ties; rows that repeat have the same score and take a place each, in
any order; without documents there are no rows; without target texts all gains follow from s alone. Columns that are kept
and have the name of a result column give way to it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import with_place
from quantloom.llm.store import in_arrow, landed, text_of
from quantloom.llm.text import Chunk, chunks

GRAMS = 3
BUCKETS = 10_000
#: Words whose features are held at a time, and the bytes from which on a feature is hashed alone.
SLICE_WORDS = 1 << 17
LONG = 1 << 12
#: The reflected polynomial of the usual CRC-32. Fixed value.
POLYNOMIAL = 0xEDB88320
RESULT = ["n_features", "weight", "score", "rank"]


def crc_table() -> np.ndarray:
    """CRC of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


TABLE = crc_table()


def crc_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes; all rows advance by one column at a time."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def crc_of_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of ``data``, by matrices of the distinct contents of equal length."""
    out = np.zeros(len(starts), np.uint32)
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, cuts):
        size = int(sizes[rows[0]]) if len(rows) else 0
        if size > LONG:
            for row in rows:
                out[row] = zlib.crc32(data[starts[row]:ends[row]])
        elif size:
            matrix = np.lib.stride_tricks.sliding_window_view(data, size)[starts[rows]]
            coded = pa.Array.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(matrix)]).dictionary_encode()
            distinct = np.frombuffer(coded.dictionary.buffers()[1], np.uint8, len(coded.dictionary) * size).reshape(-1, size)
            out[rows] = crc_rows(distinct)[coded.indices.to_numpy(zero_copy_only=False)]
    return out


def joined_words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk one after the other with a space behind each, and where each word begins and ends there."""
    sizes = c.ends - c.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    source = np.zeros(len(c.data) + 1, np.int8)
    np.add.at(source, c.starts, 1)
    np.add.at(source, c.ends, -1)
    out[inside] = c.data[np.cumsum(source[:-1]) > 0]
    return out, starts, ends


def buckets(c: Chunk, n_buckets: int = BUCKETS, grams: int = GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, buckets) of the features of a chunk, a slice of words and a length of run at a time."""
    data, starts, ends = joined_words(c)
    left = c.bounds[1:][c.docs] - np.arange(len(starts))  # words from here to the end of the document
    for low in range(0, len(starts), SLICE_WORDS):
        for k in range(grams):
            first = low + np.flatnonzero(left[low:low + SLICE_WORDS] > k)
            if len(first):
                yield c.docs[first], crc_of_ranges(data, starts[first], ends[first + k]) % np.uint32(n_buckets)


def bucket_counts(texts: DataFrame, n_buckets: int = BUCKETS, grams: int = GRAMS) -> list[int]:
    """How many features of all texts fall into each bucket. One number for each bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, _, c in chunks(batch.column("text"), "symbol"):
                for _, found in buckets(c, n_buckets, grams):
                    total += np.bincount(found, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    parts = in_arrow(texts.select(text_of().alias("text")), count, "bucket int, n long")
    found = {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    return [found.get(k, 0) for k in range(n_buckets)]


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """The gain of each bucket, in doubles."""
    n, all_s, all_t = len(source), float(sum(source)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(source, target)], np.int64)


def noise(id_column: str, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, target: DataFrame, id_column: str, keep: list[str], n_buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """The kept columns with ``_r_n``, ``_r_words`` and ``_r_weight`` of each document."""
    gain = gains(bucket_counts(docs, n_buckets, grams), bucket_counts(target, n_buckets, grams))
    body = docs.select(*keep, text_of().alias("_r_text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for at, end, c in chunks(batch.column(batch.num_columns - 1), "symbol"):
                words[at:end] = c.counts
                for owner, found in buckets(c, n_buckets, grams):
                    n[at:end] += np.bincount(owner, minlength=end - at)
                    np.add.at(weight[at:end], owner, gain[found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(words), pa.array(weight)],
                                             names=[*batch.schema.names[:-1], "_r_n", "_r_words", "_r_weight"])

    schema = body.drop("_r_text").schema.add("_r_n", "long").add("_r_words", "long").add("_r_weight", "long")
    return in_arrow(body, weigh, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, id_column: str = "doc_id", keep: list[str] | None = None,
             min_words: int = 20, seed: int = 42, n_buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """Every document with ``n_features``, ``weight``, ``score`` and, where it is drawn, ``rank``.

    Of the documents of at least ``min_words`` words, ``percent`` of a hundred are drawn, rounded down. ``keep`` names the columns
    to go with them (all by default); the id is always there.
    """
    keep = [c for c in dict.fromkeys([id_column, *(docs.columns if keep is None else keep)]) if c not in RESULT]
    rows = weighted(docs, target, id_column, keep, n_buckets, grams)
    rows = rows.withColumn("_r_score", F.col("_r_weight") + noise(id_column, seed)).withColumn("_r_few", F.col("_r_words") < min_words)
    rows = landed(rows, "weights")
    drawn = rows.where(~F.col("_r_few")).count() * percent // 100
    order = [F.col("_r_few"), F.col("_r_score").desc(), F.col(id_column).asc_nulls_last()]
    placed = with_place(rows, order, "_r_place")
    return placed.select(*keep, F.col("_r_n").alias("n_features"), F.col("_r_weight").alias("weight"), F.col("_r_score").alias("score"),
                         F.when(F.col("_r_place") <= drawn, F.col("_r_place")).alias("rank"))
