"""The quality classifier, the toxicity tagger and decontamination."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import decontamination, quality, toxicity
from quantloom.llm.text import chunks
from quantloom.llm.store import table

SF = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("operator, column, least", [(quality.classify, "quality", 0.97), (toxicity.classify, "toxic", 0.93)])
def test_held_out_accuracy(spark, operator, column, least):
    labels = table(spark, LARGE, "labels")
    got = operator(table(spark, LARGE, "documents"), labels)
    rows = got.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", column).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[column] for r in judged]) >= least


@pytest.mark.parametrize("operator", [quality.classify, toxicity.classify])
def test_edge_cases(spark, operator):
    rows = [(1, ""), (2, None), (None, "some words here"), (3, "x" * 100_000), (4, "a " * 50_000), (4, "a " * 50_000), (5, "é !!! \U0001F600")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    labels = table(spark, SF, "labels")
    train = table(spark, SF, "documents").select("doc_id", "text")
    for known in (labels, labels.limit(0), labels.selectExpr("doc_id", "cast(null as int) quality", "cast(null as int) toxic")):
        got = operator(docs.select("doc_id", "text").union(train), known).collect()
        assert len(got) == 1007 and all(0 <= r.score <= 1 for r in got)
    assert operator(docs.limit(0), labels).count() == 0
    twice = [r.score for r in operator(docs, labels).collect() if r.doc_id == 4]
    assert twice[0] == twice[1]


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end quality",
                               "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end toxic")
    for operator in (quality.classify, toxicity.classify):
        a, b = ({r.doc_id: round(r.score, 6) for r in operator(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_kept_documents_are_those_predicted(spark, monkeypatch):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = sorted(r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted)
    for bound in (quality.BROADCAST_ROWS, 0):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", bound)
        assert sorted(r.doc_id for r in quality.keep_good(docs, labels).collect()) == good


def test_pooling_adjacent_violators():
    levels = quality.pooled(np.array([1.0, 0.0, 2.0, 1.0, 3.0]), np.array([2.0, 2.0, 2.0, 2.0, 3.0]))
    assert np.allclose(levels, [0.25, 0.25, 0.75, 0.75, 1.0]) and (np.diff(levels) >= 0).all()


def test_random_features_approximate_the_kernel():
    turn, shift = quality.projections()
    model = quality.Model(np.zeros(len(turn)), np.ones(len(turn)), turn, shift, np.zeros(1), np.zeros(1), np.zeros(1))
    x = np.random.default_rng(1).normal(0, 1, (40, len(turn)))
    z = model.features(x)[:, :-1]
    exact = np.exp(-quality.GAMMA ** 2 * ((x[:, None] - x[None]) ** 2).sum(2) / 2)
    assert np.abs(z @ z.T - exact).mean() < 0.08


def test_marginals_equal_the_step_by_step_recursion():
    draw = np.random.default_rng(0)
    for counts in ([5, 1, 70, 0, 33], [3], [200, 64, 32]):
        odds, trans, at = np.exp(draw.normal(0, 2, sum(counts))), draw.uniform(0.1, 2, (2, 2)), 0
        got = toxicity.marginals(odds, np.array(counts), trans)
        for n in counts:
            steps = [trans * np.array([1, x]) for x in odds[at:at + n]]
            forward, a, b = [], np.array([1.0, 0.0]), np.ones(2)
            for step in steps:
                a = a @ step / (a @ step).sum()
                forward.append(a)
            for t in range(n - 1, -1, -1):
                both = forward[t] * b
                assert abs(both[1] / both.sum() - got[at + t]) < 1e-9
                b = steps[t] @ b / (steps[t] @ b).sum()
            at += n


def test_transitions_are_fitted_by_the_likelihood():
    draw = np.random.default_rng(1)
    for counts in ([7], [3, 0, 40, 1, 66]):
        counts, odds, tie = np.array(counts), np.exp(draw.normal(0, 1, sum(counts))), draw.normal(0, 1, (2, 2))

        def total(x):
            out, at = 0.0, 0
            for n in counts:
                a = np.array([1.0, 0.0])
                for o in odds[at:at + n]:
                    a = (a @ np.exp(x)) * [1, o]
                out, at = out + np.log(a.sum()), at + n
            return out

        # Expected numbers of steps are the slopes of the log of the sum over all paths.
        toxicity.marginals(odds, counts, np.exp(tie), got := np.zeros((2, 2)))
        for i, j in np.ndindex(2, 2):
            d = np.zeros((2, 2))
            d[i, j] = 1e-5
            assert abs((total(tie + d) - total(tie - d)) / 2e-5 - got[i, j]) < 1e-5
        assert abs(got.sum() - counts.sum()) < 1e-9


def test_sample_is_bounded_and_long_texts_do_not_crowd_it_out(spark):
    ids = [i for i in range(400) if not held(i)]
    bound = {1: 20_000, 0: 40_000}

    def sampled(texts):
        docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, texts)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, x) for i, (_, x) in zip(ids, texts)], "doc_id long, toxic int")
        got, toxic, weight, share = toxicity.sample(docs, labels, bound)
        assert abs(share - np.mean([x for _, x in texts])) < 1e-9
        return [[len(t) + 1 for t, x in zip(got, toxic) if x == k] for k in (False, True)], dict(zip(toxic.tolist(), weight))

    # Ten short toxic texts and one very long: the short ones are all there.
    short, long_ = ("bad " * 200, 1), ("bad " * 500_000, 1)
    (good, bad), weight = sampled([long_, *[short] * 10, *[("fine " * 50, 0)] * 250])
    assert bad == [801] * 10 and 159 - 1 <= len(good) <= 40_000 // 251
    assert abs(weight[True] / weight[False] - (11 / 10) / (250 / len(good))) < 1e-9
    # The bound holds for both labels, also where long ones are many.
    (good, bad), _ = sampled([*[("bad " * 6_000, 1)] * 30, *[short] * 60, *[("fine " * 50, 0)] * 200])
    assert bad == [801] * (20_000 // 801) and sum(good) <= 40_000
    # Only long ones: the least number is there, the smallest.
    (_, bad), _ = sampled([*[("bad " * (20_000 + k), 1) for k in range(8)], *[("fine " * 50, 0)] * 20])
    assert sorted(bad) == [4 * (20_000 + k) + 1 for k in range(toxicity.MIN_DOCS)]


def test_offending_offsets(spark):
    draw = random.Random(2)
    texts, toxic = [], []
    for i in range(300):
        words = ["".join(draw.choices("abcdeoé", k=5)) for _ in range(40)]
        if i % 3 == 0:
            words[draw.randrange(40)] = draw.choice(["grrmoron", "grrscum", "zzidiot"])
        texts.append(" ".join(words))
        toxic.append(i % 3 == 0)
    model = toxicity.fit(texts, np.array(toxic), np.ones(300))
    text = "é\U0001F600 abc grrmoron, zzidiot. the grrnew end"
    row = toxicity.tag(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], model).head()
    assert row.score > 0.5 and [text[s.start:s.end] for s in row.spans][0].startswith("grrmoron")


def similar(a, b):
    return decontamination.weighted_similarity(a, b)


def test_decontamination_equals_brute_force(spark):
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(4000)]
    items = [" ".join(draw.choices(vocabulary, k=draw.randrange(15, 60))) for _ in range(40)] + ["", None, "three word item", "one two three four five"]
    docs = []
    for i in range(200):
        words = draw.choices(vocabulary, k=draw.randrange(0, 200))
        if i % 3 == 0:
            part = (draw.choice(items[:40])).split()
            cut = draw.choice([0, 0, 1, 2, 5])
            part = part[cut:]
            if draw.random() < 0.5:
                part[draw.randrange(len(part))] = "Changed"
            words[len(words) // 2:len(words) // 2] = part
        docs.append((i, draw.choice([" ", "\n", ", "]).join(words)))
    docs += [(500, None), (501, ""), (502, "Three WORD item"), (503, "three word item and more"), (None, items[0]), (504, items[1]), (504, items[1])]
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontamination.find_leaks(frame, benchmark).collect()}
    import pyarrow as pa

    def sets(texts):
        out = []
        for at, end, c in chunks(pa.array(texts, pa.large_string()), "symbol"):
            hashes, owner = c.shingles(5)
            out += [hashes[owner == k] for k in range(end - at)]
        return out

    want = set()
    item_sets = sets(items)
    for (doc, _), s in zip(docs, sets([t for _, t in docs])):
        for item, t in enumerate(item_sets):
            n = min(len(s), len(t))
            if n and np.isin(s, t).any():
                best = max(similar(s[p:p + n], t) for p in range(len(s) - n + 1))
                if best >= 0.75:
                    want.add((doc, item, round(best, 9)))
    assert got == want and len(want) > 30
    kept = {r.doc_id for r in decontamination.keep_clean(frame, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in want}
    assert decontamination.find_leaks(frame.limit(0), benchmark).count() == 0
    assert decontamination.find_leaks(frame, benchmark.limit(0)).count() == 0


def test_every_fingerprint_within_the_radius_is_found():
    draw = np.random.default_rng(6)
    prints = draw.integers(0, 2 ** 63, (30, decontamination.TABLES)).astype(np.uint64)
    splits = [decontamination.MultiIndex(prints, spread) for spread in range(decontamination.BLOCK_RADIUS + 1)]
    for turn in range(200):
        index = splits[-1] if turn % 5 else splits[turn // 5 % len(splits)]
        k, t = draw.integers(30), draw.integers(decontamination.TABLES)
        query = draw.integers(0, 2 ** 63, (1, decontamination.TABLES)).astype(np.uint64)
        flips = draw.choice(64, decontamination.RADIUS, replace=False)
        query[0, t] = prints[k, t] ^ np.uint64(sum(1 << int(f) for f in flips))
        distance = np.bitwise_count(prints ^ query)
        assert sorted(index.search(query)[1]) == np.flatnonzero((distance <= decontamination.RADIUS).any(1)).tolist()


def test_size_of_the_index_is_bounded():
    near = [decontamination.near_count(16, r) for r in range(4)]
    assert near == [len(decontamination.near_values(16, r)) for r in range(4)] == [1, 17, 137, 697]
    for items in (1, 200, 700, 4_000, 20_000, 400_000):
        entries = items * 12 * near[decontamination.spread_for(items)]
        assert entries <= decontamination.ENTRIES
    assert decontamination.spread_for(200) == 3 and decontamination.spread_for(20_000) == 1


def test_long_text_in_pieces():
    """Pieces find what one piece finds, and hold little: 2 million words with an item here and there."""
    draw = np.random.default_rng(8)
    items = [" ".join(f"i{k}w{draw.integers(10_000)}" for _ in range(n)) for k, n in enumerate((5, 40, 40, 300))]
    marks = decontamination.Benchmark(list(range(4)), items)
    words = [f"w{x}" for x in draw.integers(0, 50_000, 30_000)]
    for at, k in ((0, 0), (4_080, 1), (8_190, 2), (12_000, 3), (29_700, 3)):
        words[at:at + len(items[k].split())] = items[k].split()
    column = pa.array([" ".join(words)])
    (_, found), = marks.scan(column)
    assert [f[0] for f in found] == [0, 1, 2, 3] and all(f[1] == 1.0 for f in found)
    assert [f[2] for f in found] == [0, 4_080, 8_190, 12_000]
    whole = decontamination.PIECE
    try:
        decontamination.PIECE = 1 << 20
        assert list(marks.scan(column)) == [(0, found)]
    finally:
        decontamination.PIECE = whole
    long = pa.array([" ".join(words * 66)])  # 2 million words
    tracemalloc.start()
    (_, again), = marks.scan(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[0] for f in again] == [0, 1, 2, 3] and peak < 500e6


def test_benchmark_in_slices(spark, monkeypatch):
    draw = np.random.default_rng(9)
    items = [(i, " ".join(f"t{x}" for x in draw.integers(0, 3_000, 12))) for i in range(300)]
    docs = [(i, " ".join(["lead"] * 9 + items[i][1].split() + ["tail"] * 9)) for i in range(0, 300, 7)] + [(1000, "nothing here at all"), (1001, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items + [(500, ""), (501, None)], "item_id long, text string")
    want = {(i, i) for i in range(0, 300, 7)}
    for size in (1 << 26, 4_000):
        monkeypatch.setattr(decontamination, "SLICE_BYTES", size)
        assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, benchmark).collect()} == want
        assert sorted(r.doc_id for r in decontamination.keep_clean(frame, benchmark).collect()) == [1000, 1001]
