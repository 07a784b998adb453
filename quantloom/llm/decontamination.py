"""Benchmark decontamination by SimHash over item-sized windows.

Documents and benchmark items are read as words (ASCII letters, digits and all beyond ASCII; A-Z in lower case) and as shingles
of five words. For each benchmark item, the windows of a document that are as long as the item (the whole document where it
is shorter) have SimHash fingerprints: each bit is the majority of that bit over the hashes of the window's shingles, taken
as often as they occur. Items are found by a multi-index: a fingerprint of 64 bits has BLOCKS blocks, and if two fingerprints differ
in at most RADIUS bits, one block differs in at most BLOCK_RADIUS; the index lists, for each value of each block, all items
that near, so every fingerprint within the radius is found. TABLES independent fingerprints make it unlikely that a true
match lies beyond the radius in all of them. Candidates are verified exactly by the weighted similarity of window and item: the
sum of the smaller over the sum of the larger counts of each shingle.

Windows that share no shingle with any item have similarity zero and are not fingerprinted.

Defined cases: null or empty texts and items contain and match nothing; a document or an item of fewer than five words is one
shingle, so they match only if they are the same words; an item may be found in any number of documents and the other way
round; equal items are reported each; rows that repeat are judged alike; an empty table gives no rows. Extra columns are not
read. The items go to all tasks in slices of about SLICE_BYTES of text, one pass over the documents for each; a benchmark of
some hundred thousand items is one slice. What a task holds is bounded: a document is gone through in pieces, and the index
has at most about ENTRIES entries, as the more items there are the more of the near values are left to the queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.store import in_arrow, landed, text_of
from quantloom.llm.text import Lookup, chunks, mix

WIDTH = 5
SIMILARITY = 0.75
TABLES, BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 3, 4, 16, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Text of the items that go to all tasks at once, entries of all indices of a task, and windows of a piece of a document.
SLICE_BYTES, ENTRIES, PIECE = 1 << 26, 6_000_000, 1 << 12
U64 = np.uint64
#: One arbitrary odd number for each table.
SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], U64)


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """A row of TABLES * 64 bits for each shingle."""
    hashes = mix(shingles[:, None] * SEEDS[None, :])
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(shingles), -1), axis=1)


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of ranges of shingles; ``sums`` are running sums of their bits, from a row of zeros."""
    ones = sums[ends] - sums[starts]
    return np.packbits(2 * ones > (ends - starts)[:, None], axis=1).view(U64)


def running(bits: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bits) + 1, bits.shape[1]), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def near_values(bits: int = BLOCK_BITS, radius: int = BLOCK_RADIUS) -> np.ndarray:
    """All numbers of so many bits with at most ``radius`` ones."""
    values = np.arange(1 << bits, dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius]


class MultiIndex:
    """Fingerprints (a row of TABLES words each) of which all within RADIUS of a query are found.

    A block of an item is listed under all values within ``spread`` bits of it, a query asks for all values within the rest of
    BLOCK_RADIUS; whatever the split, they meet if the blocks differ in at most BLOCK_RADIUS bits.
    """

    def __init__(self, prints: np.ndarray, spread: int = BLOCK_RADIUS):
        self.prints, self.spread = prints, spread
        self.offsets = np.arange(TABLES * BLOCKS, dtype=np.int64) << BLOCK_BITS
        self.keys = None

    def around(self, prints: np.ndarray, radius: int) -> np.ndarray:
        """Block and value of all values near the blocks of each fingerprint: (fingerprints, blocks, values)."""
        blocks = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), -1)
        return (blocks[:, :, None] ^ near_values(BLOCK_BITS, radius).astype(np.uint16)) + self.offsets[None, :, None]

    def build(self) -> None:
        """The lists, as sorted (block and value, item); made in the task, as they are much larger than the fingerprints."""
        keys = self.around(self.prints, self.spread)
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), keys[0].size)
        order = np.argsort(keys.ravel(), kind="stable")
        self.owner, self.keys = owner[order], keys.ravel()[order]

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) within RADIUS in at least one table, each once."""
        if self.keys is None:
            self.build()
        found = [np.zeros(0, np.int64)]
        radius = BLOCK_RADIUS - self.spread
        step = max(1, (1 << 20) // (TABLES * BLOCKS * near_count(BLOCK_BITS, radius)))
        for low in range(0, len(queries), step):
            part = queries[low:low + step]
            values = self.around(part, radius)
            per_block = values.shape[2]
            values = values.ravel()
            begin = np.searchsorted(self.keys, values)
            many = np.searchsorted(self.keys, values, "right") - begin
            at = np.repeat(np.arange(len(values)), many)
            item = self.owner[np.arange(len(at)) + np.repeat(begin - np.cumsum(many) + many, many)]
            block = at // per_block
            q, t = block // len(self.offsets), block % len(self.offsets) // BLOCKS
            close = np.bitwise_count(part[q, t] ^ self.prints[item, t]) <= RADIUS
            found.append(np.unique((low + q[close]) * len(self.prints) + item[close]))
        pairs = np.concatenate(found)
        return pairs // len(self.prints), pairs % len(self.prints)


def near_count(bits: int, radius: int) -> int:
    return sum(math.comb(bits, k) for k in range(radius + 1))


def spread_for(items: int) -> int:
    """How many bits the lists of so many items may spread over within ENTRIES."""
    fits = [r for r in range(BLOCK_RADIUS + 1) if items * TABLES * BLOCKS * near_count(BLOCK_BITS, r) <= ENTRIES]
    return max(fits, default=0)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger counts of the hashes in two arrays."""
    keys, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(at[:len(a)], minlength=len(keys)), np.bincount(at[len(a):], minlength=len(keys))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


class Benchmark:
    """Items by their number of shingles, with an index for each, and the shingles that occur in any."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.shingles = [np.zeros(0, U64)] * len(ids)
        self.ids = ids
        for at, end, c in chunks(pa.array(texts, pa.large_string()), "symbol"):
            hashes, docs = c.shingles(WIDTH)
            bounds = np.searchsorted(docs, np.arange(end - at + 1))
            for k in range(end - at):
                self.shingles[at + k] = hashes[bounds[k]:bounds[k + 1]]
        every = np.concatenate([np.zeros(0, U64), *self.shingles])
        self.known = Lookup(np.unique(every))
        self.groups = {}
        sizes = np.array([len(s) for s in self.shingles])
        for n in np.unique(sizes[sizes > 0]):
            items = np.flatnonzero(sizes == n)
            prints = np.concatenate([fingerprints(running(bits_of(self.shingles[i])), np.array([0]), np.array([n])) for i in items])
            self.groups[int(n)] = (items, MultiIndex(prints, spread_for(len(ids))))

    def leaks(self, shingles: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first shingle, shingles) of the best window for each item that a document contains.

        ``hits`` are the places of shingles that occur in some item.
        """
        best: dict[int, tuple[float, int, int]] = {}
        total, longest = len(shingles), max(self.groups, default=0)
        piece = max(PIECE, longest)
        for low in range(0, total, piece):  # windows that begin here
            part, mine = shingles[low:low + piece + longest], hits[np.searchsorted(hits, low):np.searchsorted(hits, low + piece + longest)] - low
            if len(mine):
                self._search_piece(part, mine, low, min(piece, total - low), total, best)
        return [(self.ids[item], *found) for item, found in sorted(best.items())]

    def _search_piece(self, shingles: np.ndarray, hits: np.ndarray, low: int, begins: int, total: int, best: dict) -> None:
        """Better windows for ``best`` among those that begin at the first ``begins`` shingles of a piece that starts at ``low``."""
        sums = running(bits_of(shingles))
        for n, (items, index) in self.groups.items():
            size = min(n, total)
            if size < SIMILARITY * n:  # a window so much shorter cannot be similar enough
                continue
            last = min(begins - 1, total - size - low)
            if last < 0:
                continue
            mark = np.zeros(last + 2, np.int32)
            near = hits[hits - size + 1 <= last]
            np.add.at(mark, np.maximum(near - size + 1, 0), 1)
            np.add.at(mark, np.minimum(near, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            for q, k in zip(*index.search(fingerprints(sums, starts, starts + size))):
                start, item = int(starts[q]), int(items[k])
                similarity = weighted_similarity(shingles[start:start + size], self.shingles[item])
                if similarity >= SIMILARITY and similarity > best.get(item, (0.0, 0, 0))[0]:
                    best[item] = (similarity, low + start, size)

    def scan(self, column) -> Iterator[tuple[int, list[tuple[int, float, int, int]]]]:
        """(row, leaks) of the rows of a text column that have any."""
        for at, _, c in chunks(column, "symbol"):
            hashes, docs = c.shingles(WIDTH)
            hits = np.flatnonzero(self.known.find(hashes) >= 0)
            if not len(hits):
                continue
            owners = docs[hits]
            for d in np.unique(owners):
                low, high = np.searchsorted(docs, [d, d + 1])
                found = self.leaks(hashes[low:high], hits[owners == d] - low)
                if found:
                    yield at + int(d), found


def slices(benchmark: DataFrame, size: int | None = None) -> Iterator[Benchmark]:
    """The benchmark in parts of about ``size`` bytes, one after the other. Empty texts match nothing and are left out."""
    items = benchmark.select(F.col("item_id").cast("long"), text_of().alias("text")).where("text <> ''")
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (size or SLICE_BYTES)))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        rows = part.orderBy("item_id", "text").collect()
        yield Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows])


def one_by_one(benchmark: DataFrame, step) -> DataFrame | None:
    """``step(slice, result so far)`` for each slice. Results between slices are landed, so the driver holds one slice at a time."""
    out = None
    for items in slices(benchmark):
        out = step(items, None if out is None else landed(out, "slice"))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each document and item it contains: similarity, first word and number of words of the best window."""
    rows = docs.select(id_column, text_of().alias("text"))
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, item_id long, similarity double, first_word long, n_words long"

    def find(items: Benchmark, before: DataFrame | None) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(row, *leak) for row, leaks in items.scan(batch.column("text")) for leak in leaks]
                ids = batch.column(id_column).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()),
                     pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] + WIDTH - 1 for f in found], pa.int64())],
                    names=[id_column, "item_id", "similarity", "first_word", "n_words"])

        part = in_arrow(rows, scan, schema)
        return part if before is None else before.unionByName(part)

    return one_by_one(benchmark, find)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item."""
    text, schema = docs.columns.index("text"), docs.schema

    def keep(items: Benchmark, before: DataFrame | None) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[row for row, _ in items.scan(batch.column(text))]] = False
                yield batch.filter(pa.array(good))

        return in_arrow(docs if before is None else before, clean, schema)

    return one_by_one(benchmark, keep)
