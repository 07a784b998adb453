"""Importance resampling against a version that goes feature by feature."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from quantloom.llm import resampling
from quantloom.llm.text import chunks

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, n int"


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def by_hand(docs, target, percent=5):
    def count(texts):
        return collections.Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1])

    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, own = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
                     for b in (zlib.crc32(f.encode()) % 10_000 for f in own))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = order[:percent * len(order) // 100]
    rank = collections.Counter((x[0], x[3]) for x in drawn)
    return sorted((x[:4] for x in out), key=str), rank


def check(spark, docs, target, **options):
    frame = spark.createDataFrame([(*d, "mine", 3) for d in docs], SCHEMA)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(frame, goal, keep=["doc_id", "rank", "n"], **options).collect()
    rows, rank = by_hand(docs, target, options.get("percent", 5))
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == rows
    drawn = [r for r in got if r["rank"] is not None]
    assert collections.Counter((r.doc_id, r.score) for r in drawn) == rank
    assert sorted(r["rank"] for r in drawn) == list(range(1, len(drawn) + 1))
    assert all(r.n == 3 for r in got)
    return drawn


def test_resampling(spark):
    rng = np.random.default_rng(0)
    words = ["Ann", "b2", "caf\u00e9", "\u65e5\u672c", "x" * 40, "d", "e-f", "\U0001f600", "g\u2028h"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \t.,;"), (None, "one two " * 15), (None, "one two " * 15), (5, docs[5][1])]
    drawn = check(spark, docs, ["b2 d d Ann", None, "caf\u00c9 caf\u00e9", ""], percent=30)
    assert len(drawn) > 20
    check(spark, docs, [])
    check(spark, [], ["a b"])
    check(spark, [(1, None)], ["a b"])


def test_long_texts_in_slices(spark, monkeypatch):
    long = [(1, "word other " * 30_000 + "q" * 9000 + " end"), (2, "a " * 25), (3, "z" * 50_000)]
    check(spark, long, ["word other"], percent=100)
    column = pa.array([t for _, t in long])

    def all_buckets():
        out = [np.zeros(0, np.int64)]
        for at, _, c in chunks(column, "symbol"):
            out += [(at + d) * 10_000 + b for d, b in resampling.buckets(c)]
        return np.sort(np.concatenate(out))

    whole = all_buckets()
    monkeypatch.setattr(resampling, "SLICE_WORDS", 7)
    short = [t[:3000] for _, t in long]
    column = pa.array(short)
    sliced = all_buckets()
    monkeypatch.undo()
    assert len(whole) and np.array_equal(sliced, all_buckets())


def test_crc_matrices():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 4, 5000).astype(np.uint8)
    starts = rng.integers(0, 400, 300)
    ends = starts + rng.choice([1, 2, 3, 17, 64, 4500], 300)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resampling.crc_of_ranges(data, starts, ends).tolist() == want
    assert resampling.crc_rows(np.zeros((0, 3), np.uint8)).tolist() == []
