"""Exact deduplication by composable polynomial fingerprints.

Texts are equal if they are identical after white space is deleted. A normalised text is cut into chunks. Each chunk has a
polynomial hash modulo two primes; a text's fingerprint is the sum of its chunk hashes, each multiplied by the base to the
power of the number of bytes that follow the chunk, so chunks are hashed in parallel, in any order, and added up by a plain
sum; the chunks of a long text go to many tasks. Texts of equal fingerprint, length and number of chunks are then compared chunk by chunk: over a group, the smallest
and the largest content of each chunk place must be the same. That is a fold, so it meets no pairs, needs no text of a group in one
place, and a group of any size shrinks before it is shuffled. A group that fails (a collision of fingerprints) is grouped
anew by its texts themselves.

Defined cases: a null text is empty; texts that are empty once normalised are equal to one another; of rows that tie in
length and id (or have a null id, which comes last) the choice is the smaller digest of the original text; an empty table
gives no rows; a row that repeats as a whole is there as often in the result, and as its copies cannot be told apart all of
them are marked as kept if one is. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.store import in_arrow, landed, small, text_of
from quantloom.llm.text import text_bytes
from quantloom.session import shuffle_width

#: Two primes below 2 ** 31, so products fit 64 bits, and a base for each. Fixed values.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_003)
#: Code points in a chunk.
CHUNK = 1 << 15
#: A text of more chunks than this (by its bytes) is hashed by several tasks.
DEALT = 8
SPACE = " \t\n\x0b\f\r"


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo prime, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have:have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


def chunk_hashes(column, base: int, prime: int) -> np.ndarray:
    """Polynomial hash of each text of a column (bytes as coefficients plus one, the last byte at power 0)."""
    data, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    table = powers(base, prime, int(sizes.max(initial=0)))
    for k in range(len(sizes)):  # texts of up to a chunk
        part = data[offsets[k]:offsets[k + 1]]
        if len(part):
            out[k] = ((part.astype(np.uint64) + np.uint64(1)) * table[:len(part)][::-1] % np.uint64(prime)).sum() % np.uint64(prime)
    return out


def shifted(hashes: np.ndarray, after: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Hashes of chunks times the base to the number of bytes that follow."""
    return np.array([int(h) * pow(base, int(n), prime) % prime for h, n in zip(hashes, after)], np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        after = batch.column("after").to_numpy(zero_copy_only=False)
        parts = [pa.array(shifted(chunk_hashes(batch.column("chunk"), b, p), after, b, p), pa.int64()) for b, p in zip(BASES, PRIMES)]
        names = [n for n in batch.schema.names if n not in ("chunk", "after")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *parts], names=[*names, "part0", "part1"])


def normalised(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def chunk_rows(df: DataFrame, keys: list[str], text: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of a normalised text, cut in one pass: keys, place, chunk, and the bytes of text that follow it."""
    parts = F.when(F.length(text) <= chunk, F.array(F.col(text))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    rows = df.select(*keys, F.octet_length(text).cast("long").alias("_bytes"), parts.alias("chunk"))
    upto = F.aggregate("chunk", F.array(F.lit(0).cast("long")), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + F.octet_length(x))))
    rows = rows.withColumn("upto", F.slice(upto, 2, F.greatest(F.size("chunk"), F.lit(1))))
    rows = rows.select(*keys, "_bytes", F.posexplode(F.arrays_zip("chunk", "upto")).alias("place", "_p"))
    return rows.select(*keys, "place", F.col("_p.chunk").alias("chunk"), (F.col("_bytes") - F.col("_p.upto")).alias("after"))


def fingerprints(df: DataFrame, keys: list[str], text: str, chunk: int = CHUNK) -> DataFrame:
    """Rows by their keys, with ``times`` (rows of these keys, all of the same text), ``f0`` and ``f1``."""
    short = F.octet_length(text) <= DEALT * chunk
    # The chunks of a long text are dealt to all tasks; short texts are hashed where they are read.
    dealt = chunk_rows(df.where(~short), keys, text, chunk).repartition(shuffle_width(df.sparkSession), *keys, "place")
    rows = chunk_rows(df.where(short), keys, text, chunk)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys, "place").schema)
    schema = f"{fields}, part0 long, part1 long"
    parts = in_arrow(rows, _fingerprints, schema).unionByName(in_arrow(dealt, _fingerprints, schema))
    sums = parts.groupBy(*keys).agg(
        F.sum((F.col("place") == 0).cast("long")).alias("times"), F.sum("part0").alias("part0"), F.sum("part1").alias("part1"))
    # Rows of the same keys add the same parts as often as they occur.
    return sums.select(*keys, "times", *[F.expr(f"(part{k} div times) % {p}").alias(f"f{k}") for k, p in enumerate(PRIMES)])


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept and the SHA-256 of the normalised text."""
    raw = text_of(text)
    rows = docs.select(F.col(id_column).alias("id"), F.length(raw).cast("long").alias("points"), F.xxhash64(raw).alias("mark"),
                       normalised(raw).alias("norm"))
    rows = rows.withColumns({"size": F.octet_length("norm").cast("long"), "text_sha256": F.sha2("norm", 256)})
    keys = ["id", "points", "mark", "size", "text_sha256"]
    prints = landed(fingerprints(rows, keys, "norm", chunk), "fingerprints")
    group = ["f0", "f1", "size"]
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), "id", "mark")).alias("best")
    groups = prints.groupBy(*group).agg(F.sum("times").alias("group_size"), F.count(F.lit(1)).alias("rows"), best)
    groups = landed(groups, "groups")
    several = groups.where("rows > 1").select(*group)
    # Chunkwise comparison of the texts of a group, the fingerprint standing for it.
    members = landed(prints.join(several, group).select("id", "mark", "text_sha256", *group).distinct(), "members")
    texts = rows.select("id", "mark", "text_sha256", "norm")
    same = (F.col("a.id").eqNullSafe(F.col("b.id"))) & (F.col("a.mark") == F.col("b.mark")) & (F.col("a.text_sha256") == F.col("b.text_sha256"))
    # Where the members are few enough to be broadcast, texts outside groups never leave their task.
    members = texts.alias("a").join(small(members).alias("b"), same).select("b.f0", "b.f1", "b.size", "a.norm")
    places = chunk_rows(members, group, "norm", chunk).groupBy(*group, "place").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    collided = landed(places.where("low <> high").select(*group).distinct(), "collisions")
    if collided.isEmpty():
        out = prints.join(groups, group)
        out = out.withColumn("best_id", F.col("best.id")).withColumn("best_mark", F.col("best.mark"))
    else:
        out = _resolved(prints, groups, collided, texts, group, best)
    times = out.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return times.select(
        F.col("id").alias(id_column), F.col("best_id").alias("keep_id"), "group_size",
        (F.col("id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark"))).alias("kept"), "text_sha256")


def _resolved(prints: DataFrame, groups: DataFrame, collided: DataFrame, texts: DataFrame, group: list[str], best: Column) -> DataFrame:
    """Groups whose texts differ are grouped by the texts themselves; all others stay."""
    parts = landed(prints.join(collided, group, "left_semi"), "collided")
    key = ["id", "mark", "text_sha256"]
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.mark") == F.col("b.mark")) & (F.col("a.text_sha256") == F.col("b.text_sha256"))
    full = parts.alias("b").join(texts.dropDuplicates(key).alias("a"), same).select("b.*", "a.norm")
    own = full.groupBy("norm").agg(F.sum("times").alias("group_size"), F.count(F.lit(1)).alias("rows"), best)
    apart = full.join(own, "norm").drop("norm")
    rest = prints.join(collided, group, "left_anti").join(groups, group)
    out = rest.unionByName(apart.select(*rest.columns))
    return out.withColumn("best_id", F.col("best.id")).withColumn("best_mark", F.col("best.mark"))
