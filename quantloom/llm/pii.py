"""Personal data by weak supervision.

Candidate spans come from a regular expression for each kind. Labelers vote on every candidate: a validity check of the
regular expression's match, a gazetteer of known parts, and the words ahead of the span. A vote is for (1), against (-1) or
none (0). Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how likely
each pattern means personal data (a latent class model with two classes). Those likelihoods are the soft labels on which
a logistic span classifier is trained, over kind, length, context and votes.

Base kinds are kept whatever the classifier says; candidates of the other kinds are kept if it is sure enough and they do
not overlap a base span. The number of patterns is bounded by the votes and features (at most PATTERNS rows whatever the
corpus), so both fits work on one small table of counts that covers all documents.

Defined cases: a null or empty text has no spans; an empty table gives no rows; rows that repeat are judged alike; with no
candidates there is nothing to fit. Extra columns are not read; names that begin with ``_p_`` are reserved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.spans import Rule, count_of, listed, matches
from quantloom.llm.store import landed, small, text_of

#: Base kinds and added ones, in their order. Patterns.
BASE = ["email", "ip", "card", "phone"]
RULES = [
    Rule("email", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", True),
    Rule("ip", "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}", "[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]"),
    Rule("card", "[0-9](?:[\\x20-]?[0-9])++", "[0-9](?:[\\x20-]?[0-9]){15}"),
    Rule("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9]"),
    Rule("national_phone", "(?<![0-9A-Za-z+(])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", "[0-9]{3}[ .-][0-9]{4}"),
    Rule("ssn", "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "[0-9]-[0-9]{2}-[0-9]"),
    Rule("iban", "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
]
KINDS = [r.kind for r in RULES]
#: Gazetteers, fixed values: mail hosts and endings, card issuers' first digits, calling codes, IBAN countries.
HOSTS = "(?i)(?:example|gmail|googlemail|outlook|hotmail|yahoo|icloud|gmx|proton|web|aol|mail)[0-9]*\\.|\\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
CALLING = "^\\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
COUNTRIES = "^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
#: Words that speak for or against a kind when they stand ahead of it. Fixed values.
CONTEXT = {
    "email": "(?i)e-?mail|contact|write|reach|correo|courriel|kontakt", "ip": "(?i)\\bip\\b|host|server|login|address|client",
    "card": "(?i)card|visa|master|amex|payment|tarjeta|carte|karte", "phone": "(?i)phone|tel|call|mobile|fax|ring",
    "national_phone": "(?i)phone|tel|call|mobile|fax|ring", "ssn": "(?i)ssn|social security|social-security",
    "iban": "(?i)iban|account|bank|konto|compte|cuenta",
}
AGAINST = "(?i)version|v\\.? ?$|order|invoice|isbn|issn|part(?: no| number)|serial|ticket|ref(?:erence)?[ :#.]*$|[$#=/]$"
LABELERS = ["form", "gazetteer", "context"]
#: Three votes with three values, seven kinds, three lengths: the most rows that the fits can see.
PATTERNS = 3 ** 3 * 7 * 3
ACCEPT = 0.8
ROUNDS = 50


def digits() -> Column:
    return F.regexp_replace("hit", "[^0-9]", "")


def luhn() -> Column:
    """Whether the digits of a hit pass the Luhn check."""
    turned = F.reverse(digits())
    number = F.transform(F.split(turned, "(?<=.)(?=.)"), lambda d, i: F.when(
        i % 2 == 1, d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)).otherwise(d.try_cast("int")))
    return F.aggregate(number, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid_base() -> Column:
    n = F.length(digits())
    def part(x):
        return F.regexp_replace(x, "^0+(?=.)", "")

    octets = F.forall(F.split("hit", "\\."), lambda x: (F.length(part(x)) <= 3) & (part(x).substr(1, 3).try_cast("int") <= 255))
    return (F.when(F.col("kind") == "ip", octets).when(F.col("kind") == "card", n.between(16, 19) & luhn())
            .when(F.col("kind") == "phone", n.between(8, 15)).otherwise(True))


def votes(rows: DataFrame) -> DataFrame:
    """Votes of the labelers and the features of each candidate."""
    kind, hit = F.col("kind"), F.col("hit")
    first3 = digits().substr(1, 3)
    form = (F.when(kind.isin("ip", "card", "phone"), 1)  # those passed their check
            .when((kind == "email") & hit.rlike("\\.[A-Za-z]{2,}$"), 1)
            .when((kind == "ssn") & hit.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), 1)
            .when((kind == "national_phone") & first3.rlike("^[2-9]"), 1)
            .when((kind == "iban") & F.length(hit).between(15, 34), 1).otherwise(-1))
    known = (F.when(kind == "email", hit.rlike(HOSTS)).when(kind == "card", digits().rlike(ISSUERS))
             .when(kind == "phone", hit.rlike(CALLING)).when(kind == "iban", hit.rlike(COUNTRIES))
             .when(kind == "ip", ~hit.rlike("^(?:0|127|255)\\.|^(?:10|192\\.168)\\.")))
    gazetteer = F.when(known, 1).when(~known, -1).otherwise(0)
    named = F.lit(False)
    for k, words in CONTEXT.items():
        named = named | ((kind == k) & F.col("before").rlike(words))
    context = F.when(named, 1).when(F.col("before").rlike(AGAINST), -1).otherwise(0)
    size = F.when(F.length("hit") < 12, 0).when(F.length("hit") < 20, 1).otherwise(2)
    return rows.withColumns({"form": form, "gazetteer": gazetteer, "context": context, "size": size})


def fit_labelers(patterns: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Expectation-maximisation on (votes, count): likelihood of each pattern, and for each labeler P(vote | class).

    It starts from the mean vote, so class 1 is the one that the votes are for. Counts are smoothed by one.
    """
    belief = {v: min(max(0.5 + sum(v) / (2.5 * max(len(v), 1)), 0.05), 0.95) for v, _ in patterns}
    reliability: list[dict] = []
    for _ in range(rounds if patterns else 0):
        reliability, prior = [], [1.0, 1.0]
        for v, n in patterns:
            prior[1] += n * belief[v]
            prior[0] += n * (1 - belief[v])
        for k in range(len(patterns[0][0])):
            # Smoothing leans to voters that are better than chance, which keeps the classes from changing sides.
            table = {(x, c): 1.0 + (x == (1 if c else -1)) for x in (-1, 0, 1) for c in (0, 1)}
            for v, n in patterns:
                table[v[k], 1] += n * belief[v]
                table[v[k], 0] += n * (1 - belief[v])
            sums = [sum(table[x, c] for x in (-1, 0, 1)) for c in (0, 1)]
            reliability.append({key: value / sums[key[1]] for key, value in table.items()})
        for v, _ in patterns:
            odds = math.log(prior[1] / prior[0]) + sum(math.log(r[x, 1] / r[x, 0]) for r, x in zip(reliability, v))
            belief[v] = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
    return belief, reliability


def features(kind: str, size: int, v: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], *[float(size == s) for s in (0, 1, 2)], *map(float, v)]


def fit_classifier(rows: list[tuple[str, int, tuple[int, ...], float, float]], rounds: int = 300, ridge: float = 1.0) -> list[float]:
    """Logistic regression by gradient steps on (kind, size, votes, count, soft label)."""
    table = [(features(k, s, v), n, y) for k, s, v, n, y in rows]
    total = sum(n for _, n, _ in table) or 1.0
    weights = [0.0] * (4 + len(KINDS) + len(LABELERS))
    for _ in range(rounds):
        step = [ridge * w / total for w in weights]
        for x, n, y in table:
            p = 1 / (1 + math.exp(-max(min(sum(a * b for a, b in zip(weights, x)), 30), -30)))
            for j, value in enumerate(x):
                if value:
                    step[j] += n / total * (p - y) * value
        weights = [w - 1.5 * g for w, g in zip(weights, step)]
    return weights


def spans(docs: DataFrame, keys: list[str], text: str = "_p_text") -> DataFrame:
    """Accepted spans: keys, kind, start, end, hit, ``base`` and the classifier's ``probability``."""
    rows = matches(docs, keys, text, RULES).where(valid_base())
    rows = landed(votes(rows).drop("rule", "before"), "candidates")
    counts = rows.groupBy("kind", "size", *LABELERS).agg(F.count(F.lit(1)).alias("n"))
    seen = [(r["kind"], r["size"], tuple(r[k] for k in LABELERS), float(r["n"])) for r in counts.collect()]
    by_votes: dict[tuple[int, ...], float] = {}
    for _, _, v, n in seen:
        by_votes[v] = by_votes.get(v, 0.0) + n
    belief, _ = fit_labelers(sorted(by_votes.items()))
    weights = fit_classifier(sorted((k, s, v, n, belief[v]) for k, s, v, n in seen))
    values = [F.lit(1.0), *[(F.col("kind") == k).cast("double") for k in KINDS], *[(F.col("size") == s).cast("double") for s in (0, 1, 2)],
              *[F.col(k).cast("double") for k in LABELERS]]
    odds = F.lit(0.0)
    for w, value in zip(weights, values):
        odds = odds + value * w
    rows = rows.withColumns({"base": F.col("kind").isin(BASE), "probability": 1 / (1 + F.exp(-odds))})
    # Added spans must not overlap a base span: the largest base end before their end and the smallest base start after their start.
    own = Window.partitionBy(*keys)
    ahead = own.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = own.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)  # a frame that only grows
    rows = rows.withColumns({"_p_last": F.max(F.when(F.col("base"), F.col("end"))).over(ahead),
                             "_p_next": F.min(F.when(F.col("base"), F.col("start"))).over(behind)})
    free = (F.coalesce(F.col("_p_last"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("_p_next"), F.col("end")) >= F.col("end"))
    return rows.where(F.col("base") | ((F.col("probability") >= ACCEPT) & free)).drop("_p_last", "_p_next")


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row for each document with counts of base spans, their digest, all spans and their number."""
    body = text_of()
    blob = F.sha2(body, 256)
    # Texts that no rule can match are left out first; of the others each text is scanned once.
    texts = docs.select(blob.alias("_p_blob"), body.alias("_p_text"))
    gate = F.lit(False)
    for rule in RULES:
        gate = gate | rule.opens(F.col("_p_text"))
    texts = texts.where(gate).dropDuplicates(["_p_blob"])
    found = spans(texts, ["_p_blob"])
    digest = found.groupBy("_p_blob").agg(
        *[count_of(k) for k in BASE], listed(KINDS, True, BASE).alias("base"), listed(KINDS, True).alias("spans"), F.count(F.lit(1)).alias("n_spans"))
    digest = landed(digest, "pii")
    out = docs.select("doc_id", blob.alias("_p_blob")).join(small(digest, long_column="spans"), "_p_blob", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
                      F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
                      F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"))
