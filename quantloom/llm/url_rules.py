"""URL filter by hand-written rules and by association rules mined from what those decide.

A URL has a host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case) and a path (from there up to ``?``, ``#`` or the
end). A hand-written rule names a host and the beginning of a path; it fits that host and its subdomains, and the longest
rule that fits decides. The distinct URLs so decided, or others that are given, are the labels.

A URL's tokens are its scheme, the parts of its host, the segments of its path, its file ending and its query parameters. Spark's
FP-growth mines the combinations of tokens that are frequent among labelled URLs, with the label as one more token, which gives
rules "these tokens, so this label" with support and confidence. Rules below either bound go, and so does a rule that says
no more than one with fewer tokens: one of the same label, made of some of its tokens, at least as confident. All tokens of a
labelled URL are mined. As FP-growth's work can double with each token of a basket, tokens that can be in no kept rule are left out
first, and baskets still longer than MINED_TOKENS are divided: one for each token with those after it, again and again.

The rules are matched by an inverted index: each is listed under its rarest token, so a URL looks up its own tokens and
compares only the rules found there. The surest rule that fits decides (confidence, then support, then fewer tokens, then their
text); where none fits the verdict is allow. The index goes to the tasks: the number of rules depends on how many combinations of
tokens reach the least support, not on the size of the corpus. The pages are judged where they are read; the labelled URLs are
shuffled, and once for each prefix they fall under where they are divided.

Defined cases: a null URL and one without ``://`` have an empty host and path, fit no rule and are allowed; rows that repeat are judged alike,
ids may be null; without labels nothing is mined; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.store import in_arrow, landed, small


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that are given.
RULES = [HostRule("allow", "com", "/"), HostRule("block", "example.com", "/en/"), HostRule("allow", "www.example.com", "/en/"),
         HostRule("block", "net", "/es/"), HostRule("block", "net", "/fr/")]
#: Least share of the labelled URLs (and least number) in which a combination occurs with the label, and least share of those
#: with the combination that have the label.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.01, 5, 0.9
#: Longest basket that FP-growth gets; longer ones are first divided by their tokens. All tokens take part in mining and matching.
MINED_TOKENS = 12
LABEL = "="


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: list[HostRule], field: str) -> Column:
    """``field`` of the longest rule that fits columns ``host`` and ``path``, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        inside = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        out = F.when(inside & F.startswith(F.col("path"), F.lit(rule.path)), F.lit(getattr(rule, field))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL with columns ``host`` and ``path``: host parts from the right, path segments, ending, parameters, scheme."""

    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))

    file = F.element_at(F.split("path", "/"), -1)
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    scheme = F.regexp_extract(url, "^(?s:(.*?))://", 1)
    return F.array_distinct(F.concat(
        named("host", F.reverse(F.split("host", "\\."))), named("path", F.split("path", "/")),
        named("ending", F.array(F.regexp_extract(file, "\\.([A-Za-z0-9]+)$", 1))), named("query", F.split(query, "&")),
        named("scheme", F.array(lowered(scheme)))))


@dataclass(frozen=True)
class Mined:
    """A rule: these tokens, so this verdict."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float

    @property
    def rank(self) -> tuple:
        return (-self.confidence, -self.support, len(self.tokens), self.tokens)


def divided(baskets: DataFrame, least: int, min_confidence: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """Counts (prefix, token, mark, n, all) of tokens behind their prefix, and the baskets (prefix, tokens, mark, n) that are left to combine.

    The first prefix is empty. A token behind a prefix is dropped for a label only where no kept rule can hold both: too few
    URLs with the label, or as many against it as without the token. A token with none against it is counted, and not
    combined. A label is dropped behind a prefix if the URLs against it that hold all the tokens, and so every combination, are
    too many for the confidence. Where a basket is still longer than MINED_TOKENS, its prefix is continued by each of its tokens, rarest first;
    a continued prefix has the tokens after that one.
    """
    rows = baskets.select(F.array().cast("array<string>").alias("prefix"), "tokens", "mark", F.lit(1).cast("long").alias("n"))
    open_marks = rows.select("prefix", "mark").distinct().withColumn("before", F.lit(None).cast("long"))
    counts, parts = [], []
    while True:
        seen = rows.select("prefix", F.explode("tokens").alias("token"), "mark", "n").groupBy("prefix", "token", "mark").agg(F.sum("n").alias("n"))
        seen = seen.withColumn("all", F.sum("n").over(Window.partitionBy("prefix", "token"))).where(F.col("n") >= least)
        seen = seen.join(small(open_marks), ["prefix", "mark"]).withColumn("against", F.col("all") - F.col("n"))
        level = landed(seen.where("before IS NULL OR against < before").select("prefix", "token", "mark", "n", "all", "against"), "level")
        counts.append(level.drop("against"))
        mixed = level.where("against > 0")
        by_count = F.array_sort(F.collect_set(F.struct("all", "token")))
        more = mixed.groupBy("prefix").agg(F.transform(by_count, lambda x: x["token"]).alias("more"))
        rows = rows.join(small(more, mixed.count()), "prefix").select("prefix", F.array_intersect("more", "tokens").alias("tokens"), "mark", "n", F.size("more").alias("of"))
        rows = landed(rows.where(F.size("tokens") > 1).groupBy("prefix", "tokens", "mark", "of").agg(F.sum("n").alias("n")), "parts")
        whole = F.sum(F.when(F.size("tokens") == F.col("of"), F.col("n")).otherwise(0)).alias("whole")
        live = rows.groupBy("prefix", "mark").agg(F.sum("n").alias("most"), whole)
        live = live.withColumn("against", F.sum("whole").over(Window.partitionBy("prefix")) - F.col("whole"))
        live = live.where((F.col("most") >= least) & (F.col("most") / (F.col("most") + F.col("against")) >= min_confidence))
        live = landed(live.select("prefix", "mark"), "live")
        live = small(live, live.count())
        rows = rows.join(live, "prefix", "left_semi").drop("of")
        long = landed(rows.groupBy("prefix").agg(F.max(F.size("tokens")).alias("most")).where(F.col("most") > MINED_TOKENS).select("prefix"), "long")
        n_long = long.count()
        if not n_long:
            return counts, [*parts, rows]
        long = small(long, n_long)
        parts.append(rows.join(long, "prefix", "left_anti"))
        longer = F.concat("prefix", F.array("token")).alias("prefix")
        open_marks = mixed.join(long, "prefix", "left_semi").join(live, ["prefix", "mark"], "left_semi").select(longer, "mark", F.col("against").alias("before"))
        rows = rows.join(long, "prefix", "left_semi").select("prefix", "tokens", "mark", "n", F.posexplode("tokens").alias("at", "token"))
        rows = rows.select(longer, F.slice("tokens", F.col("at") + 2, F.size("tokens")).alias("tokens"), "mark", "n").where(F.size("tokens") > 0)


def combined(parts: DataFrame, least: int) -> DataFrame:
    """(tokens, mark, n, all) of the frequent combinations of a prefix and two or more tokens behind it, by one FP-growth.

    Items carry the number of their prefix, so those of different prefixes never meet.
    """
    prefixes = landed(parts.select("prefix").distinct().select(F.monotonically_increasing_id().cast("string").alias("at"), "prefix"), "prefixes")
    items = F.transform(F.array_compact(F.concat(F.array("mark"), "tokens")), lambda x: F.concat(F.col("at"), F.lit(":"), x))
    rows = parts.join(small(prefixes), "prefix").select(items.alias("items"), "n")
    # A row for each URL again, by thousands, so that no array is long.
    rows = rows.select("items", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(1000).cast("long"))).alias("first"))
    rows = rows.select("items", F.explode(F.sequence(F.col("first"), F.least(F.col("n"), F.col("first") + 999))).alias("copy"))
    baskets = landed(rows.select("items"), "baskets")
    n = baskets.count()
    if n < least:
        return parts.sparkSession.createDataFrame([], "tokens array<string>, mark string, n long, all long")
    frequent = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(baskets).freqItemsets
    bare = F.transform("items", lambda x: F.regexp_replace(x, "^[0-9]+:", ""))
    frequent = landed(frequent.select(F.substring_index(F.get("items", F.lit(0)), ":", 1).alias("at"), F.array_sort(bare).alias("items"),
                                      F.col("freq").alias("n")), "frequent")

    def is_mark(x: Column) -> Column:
        return F.startswith(x, F.lit(LABEL))

    apart = frequent.select("at", F.filter("items", lambda x: ~is_mark(x)).alias("tokens"), F.get(F.filter("items", is_mark), F.lit(0)).alias("mark"), "n")
    apart = apart.where(F.size("tokens") > 1)
    alone = apart.where("mark IS NULL").select("at", "tokens", F.col("n").alias("all"))
    found = apart.where("mark IS NOT NULL").join(alone, ["at", "tokens"]).join(small(prefixes), "at")
    return found.select(F.concat("prefix", "tokens").alias("tokens"), "mark", "n", "all")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> list[Mined]:
    """Rules from a table with ``tokens`` and ``verdict``, a row for each labelled URL. As many as the bounds allow come to the driver."""
    baskets = landed(labelled.select("tokens", F.concat(F.lit(LABEL), F.col("verdict")).alias("mark")), "labelled")
    n = baskets.count()
    if not n:
        return []
    least = max(1, math.ceil(max(min_support, min(1.0, min_count / n)) * n))
    counts, parts = divided(baskets, least, min_confidence)
    single = reduce(DataFrame.unionByName, counts).select(F.concat("prefix", F.array("token")).alias("tokens"), "mark", "n", "all")
    rules = single.unionByName(combined(reduce(DataFrame.unionByName, parts), least))
    rules = rules.withColumns({"tokens": F.array_sort("tokens"), "confidence": F.col("n") / F.col("all")})
    rules = landed(rules.where(F.col("confidence") >= min_confidence).withColumn("at", F.xxhash64("tokens", "mark")), "rules")
    # Rules made of some of a rule's tokens share their first token with it.
    short = rules.select(F.col("tokens").alias("part"), F.col("mark").alias("part_mark"), F.col("confidence").alias("part_confidence"),
                         F.get("tokens", F.lit(0)).alias("token"))
    long = rules.select("at", "tokens", "mark", "confidence", F.explode("tokens").alias("token"))
    implied = long.join(short, "token").where(
        (F.size("part") < F.size("tokens")) & (F.col("part_mark") == F.col("mark")) & (F.col("part_confidence") >= F.col("confidence"))
        & (F.size(F.array_except("part", "tokens")) == 0))
    kept = rules.join(implied.select("at").distinct(), "at", "left_anti")
    return sorted((Mined(tuple(r["tokens"]), r["mark"][len(LABEL):], r["confidence"], r["n"] / n) for r in kept.collect()), key=lambda m: m.rank)


class Index:
    """Rules under the rarest of their tokens (that of fewest rules; of several the last)."""

    def __init__(self, rules: list[Mined]):
        self.rules = rules
        often: dict[str, int] = {}
        for rule in rules:
            for token in rule.tokens:
                often[token] = often.get(token, 0) + 1
        self.under: dict[str, list[int]] = {}
        self.sets = [frozenset(rule.tokens) for rule in rules]
        for k, rule in enumerate(rules):  # best rules first
            self.under.setdefault(min(rule.tokens, key=lambda t: (often[t], t)), []).append(k)

    def best(self, found: set[str]) -> int | None:
        """The first of the rules whose tokens are all there."""
        best = None
        for token in found:
            for k in self.under.get(token, ()):
                if best is not None and k >= best:
                    break
                if self.sets[k] <= found:
                    best = k
        return best


def parsed(pages: DataFrame, keep: list[str], rules: list[HostRule], url: str = "url") -> DataFrame:
    """The kept columns with host, path, the rule that fits and its verdict, and the tokens."""
    rows = pages.select(*keep, F.col(url).cast("string").alias("_u_url"))
    rows = rows.withColumns({"host": host(F.col("_u_url")), "path": path(F.col("_u_url"))})
    return rows.withColumns({"rule": fitting(rules, "name"), "verdict": fitting(rules, "verdict"), "tokens": tokens(F.coalesce("_u_url", F.lit("")))})


def judge(pages: DataFrame, rules: list[HostRule] = RULES, labelled: DataFrame | None = None, id_column: str = "page_id",
          url: str = "url", **bounds: float) -> tuple[DataFrame, list[Mined]]:
    """(id, host, path, rule, verdict, why) of each page, and the mined rules.

    ``why`` names the tokens of the mined rule that decided. ``labelled`` has ``url`` and ``verdict`` (allow or block); by
    default they are the distinct URLs that the rules decide.
    """
    if labelled is None:
        labelled = parsed(pages, [], rules, url).where("rule IS NOT NULL").select("_u_url", "tokens", "verdict")
    else:
        labelled = parsed(labelled, [F.col("verdict").alias("_u_verdict")], rules).where("host <> ''").select("_u_url", "tokens", F.col("_u_verdict").alias("verdict"))
    mined = mine(labelled.distinct(), **bounds)
    index = Index(mined)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, why = batch.column("verdict").to_pylist(), [None] * batch.num_rows
            for row, found in enumerate(batch.column("tokens").to_pylist()):
                if verdicts[row] is None:
                    k = index.best(set(found))
                    verdicts[row] = "allow" if k is None else index.rules[k].verdict
                    why[row] = None if k is None else " ".join(index.rules[k].tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(why, pa.string())],
                                             names=["id", "host", "path", "rule", "verdict", "why"])

    rows = parsed(pages, [F.col(id_column).alias("id")], rules, url)
    rows = rows.select("id", "host", "path", "rule", "verdict", F.when(F.col("rule").isNull(), F.col("tokens")).otherwise(F.array()).alias("tokens"))
    kind = pages.schema[id_column].dataType.simpleString()
    judged = in_arrow(rows, decide, f"id {kind}, host string, path string, rule string, verdict string, why string")
    return judged.withColumnRenamed("id", id_column), mined


def judge_pages(pages: DataFrame) -> DataFrame:
    return judge(pages)[0]
