"""Rank weights: the i-th best of m assets of a side gets a share proportional to ``((m - i + 1) / m) ** power``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: smallest exponent, so power 0 means (almost exactly) equal weights.
MIN_POWER = 1e-6
# Rows of a book and accounts, respectively, that meet in one task.
BOOK_BLOCK, ACCOUNT_BLOCK = 2_000, 50_000


def raw_weight(rank: Column, count: Column, power: Column) -> Column:
    return F.pow((count - rank + 1) / F.greatest(count, F.lit(1)), F.greatest(power, F.lit(MIN_POWER)))


def rank_sums(num: int, power: float) -> list[float]:
    """The m-th number is the sum of the raw weights of a side of m assets, for m from 1 to ``num``.

    It lets every row find its normalised weight on its own, without a window over the side. Each sum follows from the
    one before, as the weights of m assets are those of m - 1 scaled by ((m - 1) / m) ** power, and one more of 1.
    """
    power, sums, last = max(power, MIN_POWER), [], 0.0
    for m in range(1, num + 1):
        last = 1.0 + last * ((m - 1) / m) ** power
        sums.append(last)
    return sums


def with_unit_weights(rows: DataFrame, ranked: list[str]) -> DataFrame:
    """Adds ``<name>_weight`` for each name: signed weight at gross 1 of a ranked asset for the run on the same row.

    Reads ``<name>_rank_top``, ``<name>_rank_bottom`` and ``<name>_n_assets`` (0 where the asset is not ranked) and the
    run's ``num_long``, ``num_short``, ``rank_power``, ``long_sums`` and ``short_sums``. An asset that the run does not
    hold gets 0. Done in three projections, each reusing values of the one before, so every piece of generated code
    stays small enough to be compiled.
    """
    sizes, places, weights = [], [], []
    for x in ranked:
        longs = f"least(double(num_long), {x}_n_assets)"
        sizes += [f"{longs} AS _{x}_longs", f"least(double(num_short), {x}_n_assets - {longs}) AS _{x}_shorts"]
        places += [
            f"CASE WHEN {x}_rank_top <= _{x}_longs THEN _{x}_longs WHEN {x}_rank_bottom <= _{x}_shorts THEN -_{x}_shorts "
            f"ELSE 0D END AS _{x}_count",
            f"CASE WHEN {x}_rank_top <= _{x}_longs THEN {x}_rank_top ELSE {x}_rank_bottom END AS _{x}_rank"]
        size = f"abs(_{x}_count)"
        weights.append(
            f"CASE WHEN _{x}_count <> 0 THEN _{x}_count / (_{x}_longs + _{x}_shorts) "
            f"* power(({size} - _{x}_rank + 1) / greatest({size}, 1D), greatest(rank_power, {MIN_POWER}D)) "
            f"/ get(CASE WHEN _{x}_count > 0 THEN long_sums ELSE short_sums END, int({size}) - 1) ELSE 0D END AS {x}_weight")
    helpers = [f"_{x}_{part}" for x in ranked for part in ("longs", "shorts", "count", "rank")]
    return rows.selectExpr("*", *sizes).selectExpr("*", *places).selectExpr("*", *weights).drop(*helpers)


def side_budgets(selection: DataFrame, group: list[str], gross: float) -> DataFrame:
    """Gross exposure given to each side: in proportion to its number of requested assets."""
    counts = selection.groupBy(*group).agg(
        F.count_if(F.col("side") == "LONG").alias("n_long"), F.count_if(F.col("side") == "SHORT").alias("n_short"))
    total = F.col("n_long") + F.col("n_short")
    return counts.withColumn("gross_long", gross * F.col("n_long") / total).withColumn(
        "gross_short", gross * F.col("n_short") / total)


def weights_from_ranks(selection: DataFrame, predictions: DataFrame, group: list[str], gross: float,
                       power: float = 0.0) -> DataFrame:
    """Signed weights ``(*group, id, side, rank, weight)`` of chosen assets ``(*group, id, side)``.

    Budgets count every requested asset; assets without a prediction ``(*group, id, pred)`` are dropped before
    ranking. An asset chosen on both sides keeps its short weight. No rows when ``gross`` is not positive. The
    selection is as small as the position counts that were asked for.
    """
    if gross <= 0:
        selection = selection.where(F.lit(False))
    requested = Window.partitionBy(*group)
    scored = (
        selection.select(*group, "id", "side")
        .withColumn("_share", F.count(F.lit(1)).over(Window.partitionBy(*group, "side")) / F.count(F.lit(1)).over(requested))
        .join(predictions.select(*group, "id", "pred"), [*group, "id"])
    )
    side = Window.partitionBy(*group, "side")
    is_long = F.col("side") == "LONG"
    best_first = [F.when(is_long, F.col("pred")).desc_nulls_last(), F.when(is_long, F.col("id")).asc_nulls_last(),
                  F.when(~is_long, F.col("pred")).asc_nulls_last(), F.when(~is_long, F.col("id")).desc_nulls_last()]
    ranked = (
        scored.withColumn("rank", F.row_number().over(side.orderBy(*best_first)))
        .withColumn("_count", F.count(F.lit(1)).over(side))
        .withColumn("_raw", raw_weight(F.col("rank"), F.col("_count"), F.lit(float(power))))
        .withColumn("weight", F.when(is_long, 1.0).otherwise(-1.0) * gross * F.col("_share") * F.col("_raw")
                    / F.sum("_raw").over(side))
    )
    both = F.count(F.lit(1)).over(Window.partitionBy(*group, "id")) > 1
    return (
        ranked.withColumn("_both", both).where(~F.col("_both") | ~is_long)
        .select(*group, "id", "side", "rank", "weight")
    )


def target_notionals(weights: DataFrame, accounts: DataFrame, leverage: float | None = None, group: list[str] | None = None,
                     book_block: int = BOOK_BLOCK, account_block: int = ACCOUNT_BLOCK) -> DataFrame:
    """Weights times account value for every ``(account, value)`` that is positive: ``(account, id, target_value)``.

    Weights carry the target leverage already. With ``leverage`` given and not positive there are no targets. ``group``
    names columns of both tables, for instance a strategy, by which an account gets its book; they are kept. Every account
    meets every asset of its book, which is the result, so the two are joined block by block: a group's book and its accounts
    are counted and cut into as many blocks as their sizes ask for, and a row is repeated for each block of the other
    side. A book that fits one block is not cut, and its accounts are not repeated.
    """
    group = group or []
    funded = accounts.where((F.col("value") > 0) & ~F.isnan("value"))  # NaN is greater than any number in Spark
    if leverage is not None and leverage <= 0:
        funded = funded.where(F.lit(False))
    one = F.lit(0).alias("_all")  # so that a single book is a group too

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy(one, *group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    sizes = blocks(weights, book_block, "_books").join(blocks(funded, account_block, "_parts"), ["_all", *group])
    book = weights.select(one, *group, "id", "weight").join(sizes, ["_all", *group]).select(
        *group, "id", "weight", F.pmod(F.xxhash64("id"), "_books").cast("int").alias("_book"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    cut = funded.select(one, *group, "account", "value").join(sizes, ["_all", *group]).select(
        *group, "account", "value", F.explode(F.sequence(F.lit(0), F.col("_books") - 1)).alias("_book"),
        F.pmod(F.xxhash64("account"), "_parts").cast("int").alias("_part"))
    return cut.join(book, [*group, "_book", "_part"]).select(*group, "account", "id", (F.col("weight") * F.col("value")).alias("target_value"))


def undersized(targets: DataFrame, min_trade_value: float) -> DataFrame:
    """Targets whose size in money is below the minimum."""
    return targets.where(F.abs("target_value") < min_trade_value)
