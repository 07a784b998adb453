"""Positions of all matches of regular expressions, with DataFrame functions only.

Spark's functions give matched texts but no positions. A pattern that matches the gap before each match as well gives
both, and positions are running sums of lengths. Gap patterns begin with ``\\G``, so a search that has found the last match
ends at once instead of trying again from every later character, and rule patterns are written without nested
backtracking; so the work is linear in the text. Positions count code points, from 0, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of span. ``gate`` is a cheap regular expression or, if ``plain``, a text that every match needs."""

    kind: str
    pattern: str
    gate: str
    plain: bool = False
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def opens(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.gate)) if self.plain else text.rlike(self.gate)


def matches(df: DataFrame, keys: list[str], text: str, rules: list[Rule], todo: str | None = None) -> DataFrame:
    """One row for each match: keys, ``kind``, ``rule`` (with its version), ``hit``, ``start``, ``end``, ``before``.

    ``before`` is the text of up to 40 characters ahead of the match, since the previous match of its kind. ``todo`` names
    an array of the rules that a row is to be scanned with; without it all are.
    """
    body = F.col(text)
    found = []
    for rule in rules:
        whole = F.lit("\\G(?s:(.*?))(" + rule.pattern + ")")
        open_ = rule.opens(body) if todo is None else F.array_contains(todo, rule.name) & rule.opens(body)
        found.append(F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.name).alias("rule"),
            F.when(open_, F.regexp_extract_all(body, whole, F.lit(1))).alias("gaps"),
            F.when(open_, F.regexp_extract_all(body, whole, F.lit(2))).alias("hits")))
    some = F.filter(F.array(*found), lambda x: F.size(x["hits"]) > 0)
    rows = df.select(*keys, F.explode(some).alias("f"))
    rows = rows.select(*keys, "f.kind", "f.rule", F.posexplode(F.arrays_zip("f.gaps", "f.hits")).alias("at", "m"))
    rows = rows.select(*keys, "kind", "rule", "at", F.col("m.hits").alias("hit"), F.length("m.gaps").cast("long").alias("gap"),
                       F.expr("right(m.gaps, 40)").alias("before"))
    upto = Window.partitionBy(*keys, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("hit").cast("long")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    return rows.drop("at", "gap")


def listed(kinds: list[str], by_kind: bool, only: list[str] | None = None) -> Column:
    """kind:start:end of grouped span rows, comma-joined, by start then kind as listed, or the other way round."""
    place = F.array_position(F.lit(kinds), F.col("kind"))
    text = F.concat_ws(":", "kind", "start", "end")
    order = [place, F.col("start")] if by_kind else [F.col("start"), place]
    row = F.struct(*[o.cast("long").alias(f"o{k}") for k, o in enumerate(order)], F.col("end").alias("e"), text.alias("t"))
    row = row if only is None else F.when(F.col("kind").isin(only), row)
    return F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), ",")


def count_of(kind: str) -> Column:
    return F.count(F.when(F.col("kind") == kind, 1)).cast("long").alias(f"n_{kind}")
