"""Words, hashes and shingles of Arrow text columns, computed on the bytes of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 19
#: Primes below 2 ** 31 of the polynomial word hash and a base for each, and what combines words to shingles (an arbitrary odd
#: number). Modulo a power of two such hashes are equal for some unlike texts whatever the base; modulo primes they aren't.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_238_904_571, 1_872_340_913)
COMBINE = 0xD6E8FEB86659FD93

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo prime, kept for the next call."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 1)
        have, done = np.ones(size, np.uint32), 1
        while done < size:
            more = min(done, size - done)
            have[done:done + more] = have[:more].astype(U64) * U64(pow(base, done, prime)) % U64(prime)
            done += more
        _powers[base, prime] = have
    return have[:n]


def running_sums(data: np.ndarray) -> list[np.ndarray]:
    """For each prime the running sum of all bytes (plus one) times the powers of its base, modulo the prime."""
    out = []
    for base, prime in zip(BASES, PRIMES):
        terms = (data.astype(U64) + U64(1)) * powers(base, prime, len(data))
        if len(data) >= 1 << 24:  # else the sums stay below 2 ** 64
            terms %= U64(prime)
        np.cumsum(terms, out=terms)
        sums = np.zeros(len(data) + 1, np.uint32)
        sums[1:] = terms % U64(prime)
        out.append(sums)
    return out


def hashes_of_ranges(sums: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, read off running sums; 62 bits tell texts apart."""
    out = np.zeros(len(starts), U64)
    for total, base, prime in zip(sums, BASES, PRIMES):
        back = powers(pow(base, -1, prime), prime, len(total))
        part = (total[ends].astype(U64) + U64(prime) - total[starts]) % U64(prime)
        out = (out << U64(31)) ^ (part * back[starts] % U64(prime))
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit over the whole output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def separators(kind: str) -> np.ndarray:
    """Which bytes end a word. space: blanks and control whitespace; symbol: every ASCII byte but letters and digits."""
    out = np.zeros(256, bool)
    if kind == "space":
        out[[32, *range(9, 14)]] = True
    else:
        out[:128] = True
        out[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return out


def lowering() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


class Chunk:
    """Some documents of a batch: bytes, document bounds, and words as [start, end) with the document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str = "space", lower: bool = True):
        self.data = lowering()[data] if lower else data
        self.offsets = offsets
        self._sums = None
        self.n_docs = len(offsets) - 1
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        inside = ~separators(kind)[data]
        before = np.concatenate(([False], inside[:-1])) & ~first[:-1]
        after = np.concatenate((inside[1:], [False])) & ~first[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of document d are bounds[d] to bounds[d + 1]
        self.counts = np.diff(self.bounds)
        self.docs = np.repeat(np.arange(self.n_docs), self.counts)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges in order of their starts. A long text is gone through in steps, each with sums of its own."""
        if len(self.data) <= STEP_BYTES:
            if self._sums is None:
                self._sums = running_sums(self.data)
            return hashes_of_ranges(self._sums, starts, ends)
        out, at = np.zeros(len(starts), U64), 0
        while at < len(starts):
            low = int(starts[at])
            stop = max(at + 1, int(np.searchsorted(starts, low + STEP_BYTES)))
            sums = running_sums(self.data[low:int(ends[at:stop].max())])
            out[at:stop] = hashes_of_ranges(sums, starts[at:stop] - low, ends[at:stop] - low)
            at = stop
        return out

    def word_hashes(self) -> np.ndarray:
        return self.range_hashes(self.starts, self.ends)

    def shingles(self, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``width`` words and its document. A document of fewer words is one shingle."""
        hashes = self.word_hashes() if hashes is None else hashes
        n, step = len(hashes), U64(COMBINE)
        out = np.zeros(max(n - width + 1, 0), U64)
        for k in range(width):
            out = out * step + hashes[k:k + len(out)]
        place = np.arange(len(out)) - self.bounds[self.docs[:len(out)]]
        keep = place + width <= self.counts[self.docs[:len(out)]]
        docs, out = self.docs[:len(out)][keep], out[keep]
        for size in range(1, width):
            short = np.flatnonzero(self.counts == size)
            if len(short):
                at, own = self.bounds[short], np.zeros(len(short), U64)
                for k in range(size):
                    own = own * step + hashes[at + k]
                docs, out = np.concatenate((docs, short)), np.concatenate((out, own + U64(size)))
        order = np.argsort(docs, kind="stable") if np.any(self.counts < width) else slice(None)
        return mix(out)[order], docs[order]


class Lookup:
    """Place of 64-bit keys in a list, by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        bits = max(int(4 * len(keys)).bit_length(), 4)
        self.mask = U64((1 << bits) - 1)  # keys are spread already
        self.keys, self.at = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = keys & self.mask
        while len(left):
            free = self.at[slot[left]] < 0
            mine, first = np.unique(slot[left[free]], return_index=True)
            winner = left[free][first]
            self.keys[mine], self.at[mine] = keys[winner], winner
            left = np.setdiff1d(left, winner, assume_unique=True)
            slot[left] = (slot[left] + U64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        flat = keys.ravel()
        out, slot = np.full(len(flat), -1, np.int32), flat & self.mask
        left = np.flatnonzero(flat)
        while len(left):
            s = slot[left]
            hit = self.keys[s] == flat[left]
            out[left[hit]] = self.at[s[hit]]
            left = left[~hit & (self.at[s] >= 0)]
            slot[left] = (slot[left] + U64(1)) & self.mask
        return out.reshape(keys.shape)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each row begins and ends; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, bounds) of runs of rows that hold about STEP_BYTES together."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, min(n, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1))
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def chunks(column, kind: str = "space", lower: bool = True) -> Iterator[tuple[int, int, Chunk]]:
    for at, end, data, offsets in steps(column):
        yield at, end, Chunk(data, offsets, kind, lower)
