"""Secret scan with an incremental ledger of blobs.

A version of a file is a path and a text. Its blob is named by the SHA-256 of the text, so however often and under however
many paths a text occurs, it is scanned once with each version of each rule. The ledger is a table of (blob, rules it was
scanned with); findings are a table of (blob, rule, kind, start, end). A scan reads the ledger, scans the blobs that lack
a rule with just the rules they lack, and appends to both tables. Findings of the present rules are then joined to all
paths of a blob.

Defined cases: a null text is empty and has no findings; rows that repeat share a blob; an empty table appends nothing;
a null path is a path like any other. Extra columns are not read. An increment is one directory that is complete once
Spark has committed it, findings before the ledger; so a job that died between them scans its blobs again and the
doubled findings are dropped on reading.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.spans import Rule, count_of, listed, matches
from quantloom.llm.store import exists, join_path, landed, small, text_of
from quantloom.session import work_path

ASSIGN = "(?i:(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
#: Base kinds, in their order, then what this scan adds. Patterns and published key prefixes.
BASE = ["assign", "access", "hex"]
RULES = [
    Rule("assign", ASSIGN, ASSIGN),
    Rule("access", "AKIA[A-Z0-9]{16,}+", "AKIA", True),
    Rule("hex", "(?:\\G|(?<![0-9a-f]))[0-9a-f]{24,}+", "[0-9a-f]{24}"),
    Rule("private_key", "-----BEGIN (?:[A-Z0-9]++ ){0,3}PRIVATE KEY-----", "PRIVATE KEY-----", True),
    Rule("github", "(?:\\G|(?<![A-Za-z0-9_]))gh[pousr]_[A-Za-z0-9]{36,}+", "gh[pousr]_"),
    Rule("slack", "(?:\\G|(?<![A-Za-z0-9-]))xox[abeoprs]-[A-Za-z0-9-]{10,}+", "xox", True),
    Rule("google", "(?:\\G|(?<![A-Za-z0-9_-]))AIza[A-Za-z0-9_-]{35,}+", "AIza", True),
    Rule("stripe", "(?:\\G|(?<![A-Za-z0-9_]))[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+", "k_(?:live|test)_"),
    Rule("jwt", "(?:\\G|(?<![A-Za-z0-9_.-]))eyJ[A-Za-z0-9_-]{8,}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", "eyJ", True),
]
KINDS = [r.kind for r in RULES]


def valid() -> Column:
    """What a match must satisfy beyond its pattern."""
    value = F.regexp_extract("hit", ASSIGN, 2)
    return (F.col("kind") != "assign") | (F.length(value) >= 6)


def scan(versions: DataFrame, ledger: str, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Scan what is new in ``versions``; append to the ledger and return the blobs that were scanned (blob, rules)."""
    spark = versions.sparkSession
    body, known, every = text_of(text), join_path(ledger, "scanned"), F.lit([r.name for r in rules])
    names = versions.select(F.sha2(body, 256).alias("blob")).distinct()
    if exists(spark, known):
        seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        names = names.join(seen, "blob", "left").select("blob", todo.alias("rules")).where(F.size("rules") > 0)
    else:
        names = names.withColumn("rules", every)
    # What is to be scanned goes by hashes; a text that no rule can match is left where it is read.
    part = uuid.uuid4().hex
    todo = landed(names, "unseen")
    gate = F.lit(False)
    for rule in rules:
        gate = gate | rule.opens(F.col("body"))
    blobs = versions.select(body.alias("body")).where(gate).select(F.sha2("body", 256).alias("blob"), "body")
    blobs = blobs.dropDuplicates(["blob"]).join(todo, "blob")
    found = matches(blobs, ["blob"], "body", rules, "rules").where(valid())
    found.select("blob", "rule", "kind", "start", "end").write.parquet(join_path(ledger, "findings", part))
    todo.write.parquet(join_path(known, part))
    return spark.read.parquet(join_path(known, part))


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return _parts(spark, join_path(ledger, "scanned"), "blob string, rules array<string>")


def findings(spark: SparkSession, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """Findings of the present versions of the rules, once each."""
    rows = _parts(spark, join_path(ledger, "findings"), "blob string, rule string, kind string, start long, end long")
    return rows.where(F.col("rule").isin([r.name for r in rules])).distinct()


def on_paths(versions: DataFrame, ledger: str, paths: list[str], rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """All paths with counts and lists of their blobs' findings; paths without findings are there too."""
    spark = versions.sparkSession
    digest = findings(spark, ledger, rules).groupBy("blob").agg(
        *[count_of(k) for k in BASE], listed(KINDS, False, BASE).alias("base"), listed(KINDS, False).alias("spans"), F.count(F.lit(1)).alias("n_spans"))
    digest = landed(digest, "secrets")
    blob = F.sha2(text_of(text), 256).alias("blob")
    out = versions.select(*paths, blob).join(small(digest, long_column="spans"), "blob", "left")
    return out.select(*paths, *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
                      F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
                      F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"))


def scan_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """All documents through one ledger, in two increments.

    The first holds about half of the documents and knows all rules but the last. The second holds all of them and every
    rule; it scans the blobs that are new with all rules, and those of the first with the one they lack.
    """
    ledger = ledger or work_path(docs.sparkSession, "ledger")
    scan(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger, RULES[:-1])
    scan(docs, ledger)
    return on_paths(docs, ledger, ["doc_id"])
