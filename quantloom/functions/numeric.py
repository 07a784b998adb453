"""Rounding rules for order sizes and prices.

Half-to-even rounding looks at the exact binary value of a double, as the float rounding of common languages does; SQL
``bround`` looks at its shortest decimal text instead and differs on values such as 2.675. ``format_number`` rounds the
exact value, so the rule is one expression of SQL text over two columns: it takes few calls to build, and the generated
code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the price rule.
MAX_PRICE_DECIMALS = 6
INTEGER_PRICE_ABOVE = 100_000
PRICE_DIGITS = 5
#: No double has a digit that counts beyond this place.
LAST_PLACE = 340
#: From here on neighbouring doubles are whole numbers or farther apart.
_LARGEST = float(2**53)


def with_half_even(df: DataFrame, out: str, value: Column, decimals: Column) -> DataFrame:
    """Adds ``out``: ``value`` rounded half to even at a per-row number of decimals, any integer; NULL decimals give NULL.

    With decimals the text of the exactly rounded value is read back as the nearest double. Below zero decimals the exact
    remainder by the power of ten decides, and values from 2 ** 53 on stay. NaN and infinite values stay.
    """
    v, s = f"`_{out}_v`", f"`_{out}_s`"
    m = f"pow(10D, -{s})"
    over = f"abs({v}) % {m}"
    rounded = f"""CASE
        WHEN {s} >= 0 AND abs({v}) < double('infinity') THEN double(replace(format_number({v}, least({s}, {LAST_PLACE})), ',', ''))
        WHEN {s} < 0 AND abs({v}) < {_LARGEST:.0f}D THEN signum({v}) * ((abs({v}) - {over}) + CASE
            WHEN {over} > {m} / 2 OR ({over} = {m} / 2 AND ((abs({v}) - {over}) / {m}) % 2 = 1) THEN {m} ELSE 0D END)
        WHEN {s} IS NOT NULL THEN {v} END"""
    held = df.withColumns({f"_{out}_v": value.cast("double"), f"_{out}_s": decimals.cast("int")})
    return held.withColumn(out, F.expr(rounded)).drop(f"_{out}_v", f"_{out}_s")


# Two whole numbers hold a value below _SUMMABLE to 55 binary places, and some eight million such values add up without overflow.
_HIGH, _LOW, _SUMMABLE = float(2**15), float(2**40), float(2**25)


def order_free_sum(value: Column) -> Column:
    """Sum of doubles whose bits do not depend on the order of the rows; 0 where there are none.

    Each value is cut into two whole numbers, whose sums are exact, at 2 ** -55. Values from 2 ** 25 on, infinite ones and NaN are
    added as doubles, so among several large finite ones the last bits may still differ.
    """
    scaled = value * _HIGH
    high = F.floor(scaled)
    low = F.floor((scaled - high) * _LOW)
    fits, zero = F.abs(value) < _SUMMABLE, F.lit(0)
    whole = F.coalesce(F.sum(F.when(fits, high)), zero).cast("double") + F.coalesce(F.sum(F.when(fits, low)), zero).cast("double") / _LOW
    return whole / _HIGH + F.coalesce(F.sum(F.when(~fits, value)), F.lit(0.0))


def with_size_up(df: DataFrame, out: str, notional: Column, price: Column, decimals: Column) -> DataFrame:
    """Adds ``out``: smallest size at ``decimals`` whose value reaches ``notional``; 0 for a price that is not positive."""
    step, raw = f"`_{out}_step`", f"`_{out}_raw`"
    sized = df.withColumns({
        f"_{out}_step": F.pow(F.lit(10.0), -decimals),
        f"_{out}_raw": F.when(price > 0, F.try_divide(notional, price)).otherwise(0.0)})
    whole = F.expr(f"CASE WHEN {raw} > 0 THEN ceil({raw} / {step}) * {step} ELSE 0D END")
    return with_half_even(sized, out, whole, decimals).drop(f"_{out}_step", f"_{out}_raw")


def with_perp_price(df: DataFrame, out: str, price: Column, size_decimals: Column) -> DataFrame:
    """Adds ``out``: whole numbers above 100 000, else five significant digits and at most six decimals minus the size
    decimals. Where the size decimals are unknown only the five digits apply.
    """
    px, places, five = f"`_{out}_px`", f"`_{out}_places`", f"`_{out}_five`"
    # The five digits do not apply to a price above the limit, which is only made whole.
    digits = F.expr(f"CASE WHEN {px} > {INTEGER_PRICE_ABOVE} OR {px} = 0 THEN 0 ELSE {PRICE_DIGITS - 1} - floor(log10(abs({px}))) END")
    held = df.withColumns({f"_{out}_px": price, f"_{out}_places": F.lit(MAX_PRICE_DECIMALS) - size_decimals})
    once = with_half_even(held, f"_{out}_five", F.col(px), digits)
    twice = with_half_even(once, f"_{out}_all", F.col(five), F.col(places))
    chosen = F.expr(f"CASE WHEN {px} > {INTEGER_PRICE_ABOVE} OR {places} IS NULL THEN {five} ELSE `_{out}_all` END")
    return twice.withColumn(out, chosen).drop(*[f"_{out}_{x}" for x in ("px", "places", "five", "all")])
