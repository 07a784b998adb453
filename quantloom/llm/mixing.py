"""Mixing sources to target weights by a hierarchical token budget.

A tree of levels (domain, language, source) has a weight at each node. The budget is divided among the children of a node
by weight. A child that has fewer tokens than its share (a shortage) takes what it has, and the rest is divided among its
siblings by weight, again and again until none is short; only what the whole family cannot take goes to the siblings of
the parent. Both follow from filling from the top with the capacity of each subtree, as a family is short only if all
of it is used. Shares are whole tokens and add up exactly.

Each leaf then reads its documents in epochs. An epoch is an order of the leaf's documents by a hash of seed, epoch and
document; the leaf takes the prefix of that endless sequence that holds its budget. So every document comes once in each
full epoch, and those at the beginning of the last epoch once more.

Defined cases: a null level is a node named ``(none)``; a weight that is missing is the default of its level, a weight of
zero or less takes nothing; a null or empty text has no tokens and is never taken; rows that repeat, ids included, are
taken alike; an empty table gives no rows. Extra columns are kept, but for those named like a result (``n_tokens``, ``epochs``,
``tokens_taken``), which is put in their place; names that begin with ``_m_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.store import landed, small, text_of

#: Slices of a leaf's order; the prefix is found among their sums, and only the slice where it ends is sorted.
SLICES = 4096
WORDS = "[^\\x20\\x09-\\x0D]+"


def n_tokens(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORDS)).cast("long")


def shares(nodes: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """Divide ``_m_family`` (the budget of a family) by ``_m_weight`` among rows that hold at most ``_m_cap``: ``_m_budget``.

    Filled in order of capacity for each weight, a child is short if what is left, at its weight's part of the weights
    that are left, exceeds its capacity. The children that are not short come last and divide the rest; their shares are
    differences of rounded-down running sums, which keeps them whole, exact and within their capacity.
    """
    ratio = F.col("_m_cap").cast("decimal(38,12)") / F.col("_m_weight").cast("decimal(20,0)")
    by = Window.partitionBy(*family).orderBy(ratio, *order)
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*family)

    def exact(column: Column) -> Column:
        return column.cast("decimal(38,0)")

    nodes = nodes.withColumns({
        "_m_caps": F.coalesce(F.sum("_m_cap").over(upto), F.lit(0)),
        "_m_left": F.sum("_m_weight").over(everything) - F.coalesce(F.sum("_m_weight").over(upto), F.lit(0))})
    short = exact(F.col("_m_cap")) * exact(F.col("_m_left")) <= exact(F.col("_m_family") - F.col("_m_caps")) * exact(F.col("_m_weight"))
    # Once one is not short, none after it is: the level of filling is lower than their ratios.
    nodes = nodes.withColumn("_m_short", F.min(short.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.when(F.col("_m_short") == 0, F.col("_m_weight"))
    nodes = nodes.withColumns({
        "_m_rest": F.col("_m_family") - F.coalesce(F.sum(F.when(F.col("_m_short") == 1, F.col("_m_cap"))).over(everything), F.lit(0)),
        "_m_open": F.sum(rest).over(everything),
        "_m_run": F.sum(rest).over(by.rowsBetween(Window.unboundedPreceding, 0))})

    def part(run: Column) -> Column:
        return F.floor(exact(F.col("_m_rest")) * exact(run) / exact(F.col("_m_open"))).cast("long")

    given = part(F.col("_m_run")) - part(F.col("_m_run") - F.col("_m_weight"))
    return nodes.withColumn("_m_budget", F.when(F.col("_m_short") == 1, F.col("_m_cap")).otherwise(given)).drop(
        "_m_caps", "_m_left", "_m_short", "_m_rest", "_m_open", "_m_run")


def budgets(leaves: DataFrame, levels: list[str], weights: list[Column], total: Column, max_epochs: int) -> DataFrame:
    """Leaf budgets: ``leaves`` has the levels and ``tokens``; a weight column is an expression over a level's name."""
    known = [f"_m_w{k}" for k in range(len(levels))]
    leaves = leaves.withColumns({name: F.greatest(w.cast("long"), F.lit(0)) for name, w in zip(known, weights)})
    open_ = F.lit(True)
    for name in known:
        open_ = open_ & (F.col(name) > 0)
    leaves = leaves.where(open_).withColumn("_m_cap", F.col("tokens") * max_epochs)
    tree = None
    for depth in range(1, len(levels) + 1):
        at = levels[:depth]
        nodes = leaves.groupBy(*at).agg(F.sum("_m_cap").alias("_m_cap"), F.max(known[depth - 1]).alias("_m_weight"))
        if tree is None:
            everything = Window.partitionBy()
            nodes = nodes.withColumn("_m_family", F.least(F.sum("_m_cap").over(everything), total.cast("long")))
        else:
            parents = tree.select(*at[:-1], F.col("_m_budget").alias("_m_family"))
            nodes = nodes.join(parents, at[:-1])
        tree = shares(nodes, at[:-1], at)
    return tree.select(*levels, F.col("_m_budget").alias("budget"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[Column], fraction: float = 1.0, max_epochs: int = 1,
        seed: int = 0, id_column: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """Rows that the mixture takes, with ``n_tokens``, ``epochs`` (times taken in whole or part) and ``tokens_taken``.

    ``levels`` names the tree from the top. The budget is ``fraction`` of all tokens of the table.
    """
    names = list(levels)
    docs = docs.drop("n_tokens", "epochs", "tokens_taken")
    nodes = [f"_m_l{k}" for k in range(len(names))]
    rows = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit("(none)")) for n, c in zip(nodes, levels.values())})
    rows = rows.withColumns({"n_tokens": n_tokens() if tokens is None else tokens,
                             "_m_id": F.coalesce(F.col(id_column).cast("string"), F.lit(""))})
    leaves = rows.groupBy(*nodes).agg(F.sum("n_tokens").alias("tokens"))
    leaves = landed(leaves, "leaves")
    plan = budgets(leaves, nodes, weights, F.lit(_budget(leaves, fraction)), max_epochs)
    plan = leaves.join(plan, nodes).where("budget > 0").select(
        *nodes, F.expr("budget div tokens").alias("_m_full"), F.expr("budget % tokens").alias("_m_part"))
    plan = landed(plan, "budgets")
    # The order of the epoch that is read in part: 60 bits of a hash, the highest of which number the slices.
    rows = rows.join(small(plan), nodes).where("n_tokens > 0")
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col("_m_full"), F.col("_m_id")).cast("binary"))
    rows = rows.withColumn("_m_at", F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long"))
    rows = rows.withColumn("_m_slice", F.shiftright("_m_at", 60 - 12))
    slices = rows.where("_m_part > 0").groupBy(*nodes, "_m_part", "_m_slice").agg(F.sum("n_tokens").alias("_m_sum"))
    upto = Window.partitionBy(*nodes).orderBy("_m_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_m_before", F.coalesce(F.sum("_m_sum").over(upto), F.lit(0)))
    last = slices.where("_m_before < _m_part AND _m_before + _m_sum >= _m_part").select(*nodes, F.col("_m_slice").alias("_m_end"), "_m_before")
    last = landed(last, "ends")
    rows = rows.join(small(last), nodes, "left")
    keep = [*docs.columns, *nodes, "n_tokens", "_m_full"]
    # Rows outside the slice in which the prefix ends need no order.
    plain = rows.where("_m_end IS NULL OR _m_slice <> _m_end").select(
        *keep, F.when(F.col("_m_slice") < F.col("_m_end"), F.col("n_tokens")).otherwise(F.lit(0)).alias("_m_more"))
    inside = Window.partitionBy(*nodes).orderBy("_m_at", "_m_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("_m_slice = _m_end").withColumn("_m_begin", F.col("_m_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    room = F.greatest(F.least(F.col("n_tokens"), F.col("_m_part") - F.col("_m_begin")), F.lit(0))
    edge = edge.select(*keep, room.alias("_m_more"))
    out = plain.unionByName(edge)
    out = out.withColumns({"epochs": (F.col("_m_full") + (F.col("_m_more") > 0).cast("int")).cast("long"),
                           "tokens_taken": F.col("_m_full") * F.col("n_tokens") + F.col("_m_more")}).where("epochs > 0")
    levels_out = {n: F.col(k) for n, k in zip(names, nodes) if n not in docs.columns}
    return out.withColumns(levels_out).select(*docs.columns, *levels_out, "n_tokens", "epochs", "tokens_taken")


def _budget(leaves: DataFrame, fraction: float) -> int:
    total = leaves.agg(F.sum("tokens")).head()[0] or 0
    return int(total * fraction)


#: Production weights, a fixed table: domains, languages, and a default for whatever is not named.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
DEFAULT_WEIGHT = 1


def weighted(column: str, table: dict[str, int], default: int = DEFAULT_WEIGHT) -> Column:
    """Weight of a node by its name."""
    out = F.lit(default)
    for name, weight in table.items():
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out


def domain() -> Column:
    """The documents carry no domain: sources are grouped into four by the number in their name."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(number == "", F.lit(0)).otherwise(number.try_cast("int") % 4))


def production_tree() -> tuple[dict[str, Column], list[Column]]:
    """Levels and weights of domain, language and source."""
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    return levels, [weighted("_m_l0", DOMAIN_WEIGHTS), weighted("_m_l1", LANG_WEIGHTS), F.lit(DEFAULT_WEIGHT)]


def mix_documents(docs: DataFrame, fraction: float = 0.8, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """Documents mixed to the production weights."""
    levels, weights = production_tree()
    return mix(docs, levels, weights, fraction, max_epochs, seed)
