"""Statistics of documents for the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quantloom.llm.text import chunks

#: Names of the statistics, all finite for any text.
NAMES = ["log_bytes", "log_words", "word_length", "upper", "digit", "punct", "symbol", "other", "blank", "lines", "distinct", "repeat_next",
         "repeat_pair", "top_word", "shouted", "marked", "ends", "bars", "long_words", "short_words"]


def _classes() -> np.ndarray:
    """Rows: upper, digit, sentence marks, symbols, beyond ASCII, blanks, line ends, bars."""
    out = np.zeros((8, 256), np.uint8)
    out[0, 65:91] = 1
    out[1, 48:58] = 1
    out[2, [33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 1
    out[3, [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = 1
    out[4, 128:] = 1
    out[5, [32, 9, 11, 12, 13]] = 1
    out[6, 10] = 1
    out[7, 124] = 1
    return out


def table(column) -> np.ndarray:
    """A row of statistics for each text."""
    out = np.zeros((len(column), len(NAMES)))
    classes = _classes()
    for at, end, c in chunks(column, "space", lower=False):
        n, sizes = end - at, np.diff(c.offsets).astype(float)
        safe, words = np.maximum(sizes, 1), np.maximum(c.counts, 1).astype(float)

        def total(flags, bounds):
            sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
            return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)

        shares = [total(classes[k][c.data], c.offsets) for k in range(8)]
        lengths = c.ends - c.starts
        last = c.data[c.ends - 1]
        hashes = c.word_hashes()
        order = np.lexsort((hashes, c.docs))
        h, d = hashes[order], c.docs[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        where = np.flatnonzero(new)
        runs = np.diff(np.append(where, len(h)))
        top = np.zeros(n)
        np.maximum.at(top, d[where], runs)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (c.docs[1:] == c.docs[:-1])
        pair, pair_docs = c.shingles(2, hashes)
        po = np.lexsort((pair, pair_docs))
        pair, pair_docs = pair[po], pair_docs[po]
        again = np.zeros(len(pair), bool)
        again[1:] = (pair[1:] == pair[:-1]) & (pair_docs[1:] == pair_docs[:-1])
        upper_of = total(classes[0][c.data], np.append(c.starts, len(c.data))) if len(c.starts) else np.zeros(0)
        shouted = (upper_of >= 2) & (upper_of >= 0.5 * lengths)
        marked = classes[3][last].astype(bool)
        values = [np.log1p(sizes), np.log1p(c.counts), total(lengths, c.bounds) / words, shares[0] / safe, shares[1] / safe, shares[2] / safe,
                  shares[3] / safe, shares[4] / safe, shares[5] / safe, np.log1p(shares[6] / words), total(new[np.argsort(order)], c.bounds) / words,
                  total(same, c.bounds) / words, np.bincount(pair_docs, again, n) / words, top / words, total(shouted, c.bounds) / words,
                  total(marked, c.bounds) / words, total(np.isin(last, [33, 46, 63]), c.bounds) / words, shares[7] / words,
                  total(lengths > 12, c.bounds) / words, total(lengths < 3, c.bounds) / words]
        out[at:end] = np.stack(values, 1)
    return out


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the column ``text`` gives way to ``x``, an array of statistics."""
    for batch in batches:
        keep = [n for n in batch.schema.names if n != "text"]
        x = table(batch.column("text"))
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in keep], pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[*keep, "x"])
