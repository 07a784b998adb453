"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a few bits each and a row's place on the Hilbert curve through that grid orders
the table; the ordered table is cut into runs. Rows that are near in all of the columns end up in the same run, so files
written from the runs have narrow minima and maxima in every column and a filter on any of them skips most files.

Text columns get equal-depth codes from the order of their values (one row for each value is counted), numbers get the
position of their highest bit. A null has a place of its own before all values. Ties on the curve are ordered by the
columns named in ``order``; rows that tie there too have the same content as far as the table tells, and any order of
them is right. An empty table gives no rows. Extra columns are kept, but for those named like a result (``shard``, ``slot``,
``law``, for documents ``size`` and ``text_crc32``), which is put in their place; columns that begin with ``_h_`` are reserved.

The place of a row in the whole order comes without a single sorted task: the table is dealt by ranges of the curve,
sorted within each, and written with a running number; one count for each range then gives the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.store import landed, small, text_of
from quantloom.session import shuffle_width

#: Bits for each dimension of the grid.
BITS = 5


def curve_steps(dims: int) -> tuple[list[int], int]:
    """The curve as a machine: entry ``state << dims | cell`` holds ``next state << dims | place``, for all orientations.

    A state is the corner where the curve enters a cell and the axis along which it leaves. The place of a cell is its
    position on the Gray code after the cell is turned back to the standard orientation.
    """
    mask = (1 << dims) - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    place_of = {gray(i): i for i in range(1 << dims)}

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def axis(i: int) -> int:
        i = 0 if i == 0 else i if i % 2 else i - 1
        return ((~i & (i + 1)).bit_length() - 1) % dims  # trailing ones

    out = []
    for corner in range(1 << dims):
        for along in range(dims):
            for cell in range(1 << dims):
                place = place_of[turn(cell ^ corner, -(along + 1))]
                to_corner = corner ^ turn(entry(place), along + 1)
                to_axis = (along + axis(place) + 1) % dims
                out.append(((to_corner * dims + to_axis) << dims) | place)
    return out, dims


def hilbert_index(codes: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of a cell whose coordinates are integers of ``bits`` bits each."""
    table, dims = curve_steps(len(codes))
    lookup, state, index = F.lit(table), F.lit(0), F.lit(0).cast("long")
    for level in reversed(range(bits)):
        cell = F.lit(0)
        for k, code in enumerate(codes):
            cell = cell.bitwiseOR(F.shiftleft(F.shiftright(code.cast("int"), level).bitwiseAND(1), k))
        found = F.element_at(lookup, F.shiftleft(state, dims).bitwiseOR(cell) + 1)
        index = F.shiftleft(index, dims).bitwiseOR(found.bitwiseAND((1 << dims) - 1).cast("long"))
        state = F.shiftright(found, dims)
    return index


def _category_codes(df: DataFrame, column: str, bits: int) -> DataFrame:
    """One row for each value: an equal-depth code from 1 that follows the order of the values.

    There may be as many values as rows (a source that is a URL), so what comes before a value is summed within ranges of the
    order, and the sums of the ranges, one for each partition, are added.
    """
    counts = df.groupBy(F.col(column).cast("string").alias("_h_value")).agg(F.count(F.lit(1)).alias("_h_n"))
    counts = counts.where("_h_value IS NOT NULL").repartitionByRange(shuffle_width(df.sparkSession), "_h_value")
    ranged = counts.sortWithinPartitions("_h_value").withColumn("_h_at", F.monotonically_increasing_id())
    ranged = landed(ranged, "values").withColumn("_h_part", F.shiftright("_h_at", 33))
    sums = ranged.groupBy("_h_part").agg(F.sum("_h_n").alias("_h_sum"))
    upto = Window.orderBy("_h_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range, not for each value
    sums = sums.select("_h_part", F.coalesce(F.sum("_h_sum").over(upto), F.lit(0)).alias("_h_sum0"),
                       F.sum("_h_sum").over(Window.partitionBy()).alias("_h_total"))
    inside = Window.partitionBy("_h_part").orderBy("_h_at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_h_sum0") + F.coalesce(F.sum("_h_n").over(inside), F.lit(0))
    placed = ranged.join(small(sums, shuffle_width(df.sparkSession)), "_h_part")
    code = 1 + F.floor((before + F.col("_h_n") / 2) * ((1 << bits) - 2) / F.col("_h_total"))
    return placed.select("_h_value", code.cast("int").alias("_h_code"))


def curve_order(df: DataFrame, categories: list[str], numbers: list[str], bits: int = BITS) -> DataFrame:
    """The table with ``_h_index``, the place on the curve through all the named columns."""
    out, codes = df, []
    for k, column in enumerate(categories):
        values = landed(_category_codes(df, column, bits), "codes")
        values = small(values.select(F.col("_h_value").alias(f"_h_value{k}"), F.col("_h_code").alias(f"_h_code{k}")))
        out = out.join(values, F.col(column).cast("string") == F.col(f"_h_value{k}"), "left").drop(f"_h_value{k}")
        codes.append(F.coalesce(F.col(f"_h_code{k}"), F.lit(0)))
    for column in numbers:
        highest = F.length(F.bin(F.greatest(F.col(column).cast("long"), F.lit(0))))
        codes.append(F.coalesce(F.least(highest, F.lit((1 << bits) - 1)), F.lit(0)))
    return out.withColumn("_h_index", hilbert_index(codes, bits)).drop(*[f"_h_code{k}" for k in range(len(categories))])


def shard(df: DataFrame, shards: int, categories: list[str], numbers: list[str], order: list[str], size: str | None = None,
          bits: int = BITS) -> DataFrame:
    """Add ``shard`` (0 to shards - 1), ``slot`` (from 0 without gaps) and ``law``.

    Without ``size`` runs hold equally many rows, at most one apart (law rows). With ``size`` a row goes to the run in
    which it begins when the sizes are laid end to end, so runs are equal but for one row (law bytes).
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot", "law")
    placed = curve_order(df, categories, numbers, bits)
    width = shuffle_width(spark)
    keys = ["_h_index", *order]
    sorted_ = placed.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    ranged = landed(sorted_.withColumn("_h_at", F.monotonically_increasing_id()), "curve")
    ranged = ranged.withColumns({"_h_part": F.shiftright("_h_at", 33), "_h_in": F.col("_h_at").bitwiseAND((1 << 33) - 1)})
    weight = F.lit(1) if size is None else F.col(size)
    parts = ranged.groupBy("_h_part").agg(F.count(F.lit(1)).alias("_h_rows"), F.sum(weight).alias("_h_sum"))
    upto = Window.orderBy("_h_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range, not for each document
    parts = parts.select(
        "_h_part", F.coalesce(F.sum("_h_rows").over(upto), F.lit(0)).alias("_h_rows0"),
        F.coalesce(F.sum("_h_sum").over(upto), F.lit(0)).alias("_h_sum0"), F.sum("_h_rows").over(Window.partitionBy()).alias("_h_all"),
        F.sum("_h_sum").over(Window.partitionBy()).alias("_h_total"))
    out = ranged.join(small(parts, width), "_h_part")
    rank = F.col("_h_rows0") + F.col("_h_in")
    if size is None:
        base, extra = F.expr("_h_all div {0}".format(shards)), F.col("_h_all") % shards
        long_runs = extra * (base + 1)
        # The first runs hold one row more; where there are fewer rows than runs, each row is a run.
        at = F.when(rank < long_runs, F.floor(rank / (base + 1))).otherwise(
            extra + F.floor((rank - long_runs) / F.greatest(base, F.lit(1))))
        begin = F.when(rank < long_runs, F.floor(rank / (base + 1)) * (base + 1)).otherwise(
            long_runs + F.floor((rank - long_runs) / F.greatest(base, F.lit(1))) * base)
        out = out.withColumns({"shard": at.cast("int"), "slot": (rank - begin).cast("long"), "law": F.lit("rows")})
    else:
        inside = Window.partitionBy("_h_part").orderBy("_h_in").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("_h_sum0") + F.coalesce(F.sum(size).over(inside), F.lit(0))
        out = out.withColumn("shard", F.least(F.floor(start * shards / F.greatest("_h_total", F.lit(1))), F.lit(shards - 1)).cast("int"))
        out = out.withColumn("_h_rank", rank)
        first = out.groupBy("shard").agg(F.min("_h_rank").alias("_h_first"))
        out = out.join(small(first, shards), "shard")
        out = out.withColumns({"slot": F.col("_h_rank") - F.col("_h_first"), "law": F.lit("bytes")})
    return out.select(*df.columns, "shard", "slot", "law")


def shard_documents(docs: DataFrame, shards: int = 8, keep_text: bool = True) -> DataFrame:
    """Documents in curve order of language, source and size, as equally long runs.

    ``size`` is the bytes of the text plus one. Null texts count as empty, null ids come first among ties.
    """
    docs = docs.withColumns({"size": (F.octet_length(text_of()) + 1).cast("long"), "text_crc32": F.crc32(text_of())})
    docs = docs if keep_text else docs.select("doc_id", "lang", "source", "size", "text_crc32")
    return shard(docs, shards, ["lang", "source"], ["size"], ["text_crc32", "doc_id"])
