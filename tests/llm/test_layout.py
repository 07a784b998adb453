"""Mixing, sharding, and the pipeline."""

import itertools
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import mixing, queries, sharding

SF = "/root/testdata/sf0.001"


def fill(budget, children):
    """Whole-number water filling by hand: {name: (weight, capacity)} to real shares."""
    left, shares = dict(children), {}
    budget = Fraction(min(budget, sum(c for _, c in children.values())))
    while left:
        total = sum(w for w, _ in left.values())
        short = {n for n, (w, c) in left.items() if c * total <= budget * w}
        if not short:
            return shares | {n: budget * w / total for n, (w, _) in left.items()}
        for n in short:
            shares[n] = Fraction(left.pop(n)[1])
            budget -= shares[n]
    return shares


def test_budgets(spark):
    leaves = [("a", "x", 100), ("a", "y", 5), ("b", "x", 50), ("b", "y", 0), ("c", "x", 7), ("z", "x", 1000)]
    weights = {"a": 3, "b": 2, "c": 1, "z": 0}
    frame = spark.createDataFrame(leaves, "l0 string, l1 string, tokens long")
    for total, epochs in itertools.product((0, 1, 37, 100, 161, 400), (1, 3)):
        got = mixing.budgets(frame, ["l0", "l1"], [mixing.weighted("l0", weights, 1), F.when(F.col("l1") == "x", 2).otherwise(1)], F.lit(total), epochs)
        got = {(r.l0, r.l1): r.budget for r in got.collect()}
        tops = {}
        for top in "abc":
            tops[top] = sum(t for a, _, t in leaves if a == top) * epochs
        want_top = fill(total, {t: (weights[t], c) for t, c in tops.items()})
        for top, share in want_top.items():
            own = {k: v for k, v in got.items() if k[0] == top}
            assert abs(sum(own.values()) - share) < 1
            inside = fill(sum(own.values()), {l1: (2 if l1 == "x" else 1, t * epochs) for a, l1, t in leaves if a == top})
            assert all(abs(own[top, l1] - s) < 1 for l1, s in inside.items())
        assert sum(got.values()) == min(total, sum(tops.values())) and ("z", "x") not in got


def test_prefix_of_epochs(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "l", "s") for i in range(500)] + [(None, "a b", "l", "s"), (7, None, "l", None)],
                                 "doc_id long, text string, lang string, source string")
    every = 0
    for fraction, epochs in ((0.0, 1), (0.3, 1), (1.0, 1), (2.5, 3)):
        rows = mixing.mix(docs, {"lang": F.col("lang")}, [F.lit(1)], fraction, epochs, seed=3).collect()
        total = docs.select(F.sum(mixing.n_tokens())).head()[0]
        assert sum(r.tokens_taken for r in rows) == int(total * fraction)
        partly = [r for r in rows if r.tokens_taken % r.n_tokens]
        assert len(partly) <= 1 and all(r.epochs == -(-r.tokens_taken // r.n_tokens) for r in rows)
        every = max(every, max((r.epochs for r in rows), default=0))
    assert every == 3
    a, b = ({r.doc_id for r in mixing.mix(docs, {"lang": F.col("lang")}, [F.lit(1)], 0.3, 1, seed=s).collect()} for s in (1, 2))
    assert a != b and mixing.mix(docs.limit(0), {"lang": F.col("lang")}, [F.lit(1)]).count() == 0


def test_shares_of_siblings_before_ancestors(spark):
    # b has one short source; what it lacks goes to its sibling, so domain a gets its share and no more.
    leaves = spark.createDataFrame([("a", "x", 1000), ("b", "x", 10), ("b", "y", 1000)], "l0 string, l1 string, tokens long")
    got = {(r.l0, r.l1): r.budget for r in mixing.budgets(leaves, ["l0", "l1"], [F.lit(1), F.lit(1)], F.lit(400), 1).collect()}
    assert got == {("a", "x"): 200, ("b", "x"): 10, ("b", "y"): 190}


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"c{k} int" for k in range(dims)))
    rows = cells.withColumn("at", sharding.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(1 << bits * dims))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("n", [0, 1, 5, 8, 100, 1003])
def test_shards(spark, n):
    rows = [(None if i % 50 == 3 else i // 2, None if i % 17 == 0 else "x" * (i % 90) ** 2, None if i % 5 == 0 else "en", f"s{i % 7}", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got = sharding.shard_documents(docs, 8).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(counts[s]))
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) and r["size"] == len((r.text or "").encode()) + 1 for r in got)


def test_copies_in_a_cell_are_adjacent(spark):
    docs = spark.createDataFrame([(i, f"text {i % 10}", "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    rows = sharding.shard_documents(docs, 8).orderBy("shard", "slot").collect()
    assert sum(a.text != b.text for a, b in zip(rows, rows[1:])) == 9


def test_shards_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 90), "en", f"s{i % 7}", i % 90) for i in range(2000)], "doc_id long, text string, lang string, source string, size long")
    got = sharding.shard(docs, 8, ["lang", "source"], ["size"], ["doc_id"], "size").groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(got) == 8 and max(r.b for r in got) - min(r.b for r in got) <= 2 * 90 and all(r.m == r.n - 1 for r in got)


def test_curve_prunes_files(spark):
    """Fewer shards hold any one language or source than a deal by chance would give."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = sharding.shard_documents(docs, 64, keep_text=False)
    touched = got.groupBy("source").agg(F.count_distinct("shard").alias("n")).agg(F.avg("n")).head()[0]
    assert touched < 32


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count() and {r["shard"] for r in out} == set(range(8))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s1", 0), (1, "", "en", "s1", 0), (2, "a " * 20000, "en", "s1", 5)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        for frame in (odd, docs.limit(0), odd.withColumn("n", F.lit(1))):
            stage(spark, frame, SF).collect()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_extra_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["id", "epochs", "n_tokens", "tokens_taken", "size", "shard", "slot", "law", "text_crc32", "best", "label", "node", "mark", "a.b"]
    odd = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        taken = [n for n in names if n in ("size", "shard", "slot", "law", "text_crc32") and name == "sharding"]
        assert set(odd.columns) - set(taken) <= set(out.columns) and (name == "sharding" or out.columns == odd.columns)
        wrong = F.lit(False)
        for n in names:
            wrong = wrong | ~F.col(f"`documents_{n}`" if n in taken else f"`{n}`").eqNullSafe(F.concat(F.lit(f"{n}-"), "doc_id"))
        assert out.count() > 0 and out.where(wrong).count() == 0


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and queries.ORACLES.keys() <= queries.QUERIES.keys()


def test_codes_of_many_values(spark):
    values = [f"v{i * i % 997:04}" for i in range(3000)] + [None] * 40 + ["hot"] * 1500
    frame = spark.createDataFrame([(v,) for v in values], "s string").repartition(7)
    got = {r._h_value: r._h_code for r in sharding._category_codes(frame, "s", 5).collect()}
    before, known = 0, sorted(v for v in values if v is not None)
    assert set(got) == set(known)
    for v, same in itertools.groupby(known):
        n = len(list(same))
        assert got[v] == 1 + int((before + n / 2) * 30 / len(known))
        before += n
    assert sharding._category_codes(frame.limit(0), "s", 5).count() == 0
