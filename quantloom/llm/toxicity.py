"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, so tokens are labelled from them first: a token of a toxic document is toxic if it has a
feature (the word, or a beginning or end of it) that occurs in toxic documents too often, and in others too seldom, to be
chance, allowing for the number of features that are tried. On these labelled tokens a chain with the states other and
toxic is trained; a state's score is the sum of the weights of the token's features, and neighbours are tied by transition
weights, which are fitted by the same likelihood. Forward-backward gives each token its marginal probability of being toxic. A document's score is a logistic
function of the largest marginal and of the expected number of toxic tokens; the offending spans are runs of tokens whose
marginal is at least a half.

The fit uses a sample of labelled rows that are not held out: whole documents of at most SAMPLE_BYTES of text for each of
the two labels, in order of a hash of the id. Texts longer than a sixteenth of that come after all others, smallest first, so a few long
ones do not crowd out the rest. MIN_DOCS documents of each label are read in any case, also beyond SAMPLE_BYTES. Scores, spans and every text are computed on all documents in full. Ids, language,
source and labels are never inputs of a score.

Defined cases: a null or empty text, and one without words, has no spans and the lowest score; a null id counts as empty text when held-out
rows are chosen; without labels of both kinds, or if no feature tells them apart, every score is the share of toxic labels (0 without any); an
empty table gives no rows; rows that repeat are scored alike. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.store import held_out, in_arrow, landed, small, text_of
from quantloom.llm.text import Chunk, Lookup, chunks, mix

#: Most bytes of text that the fit reads, of toxic documents and of others.
SAMPLE_BYTES = {1: 3 << 19, 0: 3 << 20}
#: So many of the longest short texts fit in; a text is long beyond that. Bytes of short texts that are drawn before they are put in order.
FIT, AHEAD = 16, 4
#: Byte lengths of word beginnings and ends that are features beside the whole word.
FRONTS, BACKS = (4, 5, 6), (4,)
#: Documents that a feature must occur in to have a weight.
MIN_DOCS = 3
STEPS, RATE, RIDGE = 45, 0.35, 2e-5
BLOCK = 32
CLIP = 12.0
THRESHOLD = 0.5
U64 = np.uint64


def features(c: Chunk) -> np.ndarray:
    """A row of feature hashes for each word; 0 where a word is too short for a feature."""
    size = c.ends - c.starts
    out = np.zeros((len(size), 1 + len(FRONTS) + len(BACKS)), U64)
    out[:, 0] = c.word_hashes()
    for k, n in enumerate(FRONTS, 1):
        out[:, k] = np.where(size >= n, mix(c.range_hashes(c.starts, np.minimum(c.starts + n, c.ends)) + U64(k)), U64(0))
    for k, n in enumerate(BACKS, 1 + len(FRONTS)):
        out[:, k] = np.where(size >= n, mix(c.range_hashes(np.maximum(c.ends - n, c.starts), c.ends) + U64(k)), U64(0))
    return out


def marginals(odds: np.ndarray, counts: np.ndarray, trans: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Probability of state 1 at each position of chains laid end to end; ``pairs`` (2 x 2) gets the expected numbers of steps.

    ``odds`` are exp(score of state 1 - score of state 0), ``counts`` the lengths of the chains, ``trans`` the 2 x 2 factors from
    one state to the next; a chain starts from state 0. Chains are cut into blocks whose transfer matrices are multiplied
    for all blocks at once, so long chains cost no more steps than their number of blocks.
    """
    if not len(odds):
        return np.zeros(0)
    n_blocks = -(-counts // BLOCK)
    first = np.concatenate(([0], np.cumsum(n_blocks)))
    start = np.concatenate(([0], np.cumsum(counts)))[:-1]
    chain = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(odds)) - start[chain]
    at = first[chain] * BLOCK + place
    e = np.zeros(first[-1] * BLOCK)
    e[at] = odds
    e = np.ascontiguousarray(e.reshape(-1, BLOCK).T)  # 0 marks places beyond the end of a chain
    (t00, t01), (t10, t11) = trans
    real = e > 0
    p = np.array([1.0, 0.0, 0.0, 1.0])[:, None] * np.ones(e.shape[1])
    for t in range(BLOCK):
        q = np.stack((p[0] * t00 + p[1] * t10, (p[0] * t01 + p[1] * t11) * e[t], p[2] * t00 + p[3] * t10, (p[2] * t01 + p[3] * t11) * e[t]))
        p = np.where(real[t], q / q.max(0), p)
    # From block to block: what comes in from the left, and what the right has to say.
    left, right = np.zeros((2, e.shape[1])), np.ones((2, e.shape[1]))
    order = np.argsort(-n_blocks, kind="stable")
    most = int(n_blocks.max())
    active = [order[:np.searchsorted(-n_blocks[order], -k, "left")] for k in range(most)]
    a = np.zeros((2, len(counts)))
    a[0] = 1.0
    for k in range(most):
        d = active[k]
        b = first[d] + k
        left[:, b] = a[:, d]
        new = np.stack((a[0, d] * p[0, b] + a[1, d] * p[2, b], a[0, d] * p[1, b] + a[1, d] * p[3, b]))
        a[:, d] = new / new.max(0)
    a = np.ones((2, len(counts)))
    for k in reversed(range(most)):
        d = active[k]
        b = first[d] + k
        right[:, b] = a[:, d]
        new = np.stack((p[0, b] * a[0, d] + p[1, b] * a[1, d], p[2, b] * a[0, d] + p[3, b] * a[1, d]))
        a[:, d] = new / new.max(0)
    forward = np.empty((BLOCK, e.shape[1]))  # share of state 1
    come = left[1] / left.sum(0)
    x0, x1 = left
    for t in range(BLOCK):
        y0, y1 = x0 * t00 + x1 * t10, (x0 * t01 + x1 * t11) * e[t]
        total = y0 + y1
        x0, x1 = np.where(real[t], y0 / total, x0), np.where(real[t], y1 / total, x1)
        forward[t] = x1 / (x0 + x1)
    out = np.empty_like(forward)
    x0, x1 = right
    for t in reversed(range(BLOCK)):
        up, down = forward[t] * x1, (1 - forward[t]) * x0
        out[t] = up / (up + down)
        if pairs is not None:
            last = forward[t - 1] if t else come
            step = np.stack(((1 - last) * t00 * x0, (1 - last) * t01 * e[t] * x1, last * t10 * x0, last * t11 * e[t] * x1))
            pairs += (step / step.sum(0))[:, real[t]].sum(1).reshape(2, 2)
        y0, y1 = t00 * x0 + t01 * e[t] * x1, t10 * x0 + t11 * e[t] * x1
        total = y0 + y1
        x0, x1 = np.where(real[t], y0 / total, x0), np.where(real[t], y1 / total, x1)
    return out.T.ravel()[at]


@dataclass
class Model:
    lookup: Lookup
    weights: np.ndarray  # by feature; then 0 for unknown ones
    bias: float
    trans: np.ndarray
    final: np.ndarray  # constant, logit of the largest marginal, log of the expected number of toxic tokens

    def token_probabilities(self, c: Chunk) -> np.ndarray:
        found = self.lookup.find(features(c))
        score = self.weights[found].sum(1) + self.bias
        return marginals(np.exp(np.clip(score, -CLIP, CLIP)), c.counts, self.trans)

    def summary(self, c: Chunk, p: np.ndarray) -> np.ndarray:
        """The two inputs of the document score."""
        top, total = np.zeros(c.n_docs), np.zeros(c.n_docs)
        if len(p):
            np.maximum.at(top, c.docs, p)
            total = np.bincount(c.docs, p, c.n_docs)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.stack((np.ones(c.n_docs), np.log(top / (1 - top)), np.log(total + 1e-6)), 1)

    def score(self, c: Chunk, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(c, p) @ self.final, -30, 30)))


def once_a_document(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and documents, each pair once, without the features that are missing."""
    flat, own = hashes.ravel(), np.repeat(docs, hashes.shape[1])
    _, first = np.unique(flat ^ mix(own.astype(U64) + U64(1)), return_index=True)
    first = first[flat[first] != 0]
    return flat[first], own[first]


def telling(hashes: np.ndarray, docs: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that mark toxic documents: 64-bit hashes. ``docs`` is the document of each row of hashes."""
    keys, own_docs = once_a_document(hashes, docs)
    keys, at = np.unique(keys, return_inverse=True)
    own = toxic[own_docs]
    bad, good = np.bincount(at, own, len(keys)), np.bincount(at, ~own, len(keys))
    n_bad, n_good = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    # Log likelihood ratio of the two rates against one common rate, one-sided, against the number of features tried.
    rate, low, high = (bad + good) / (n_bad + n_good), good / n_good, bad / n_bad

    def term(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    gain = term(bad, n_bad, high) + term(good, n_good, low) - term(bad, n_bad, rate) - term(good, n_good, rate)
    return keys[(high > 10 * low) & (gain > np.log(max(len(keys), 1)) + 1) & (bad >= MIN_DOCS)]


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model | None:
    """Train on whole texts with document labels; ``weight`` says how many documents of the corpus each stands for."""
    if not len(texts) or toxic.all() or not toxic.any():
        return None
    parts = [(at, c, features(c)) for at, _, c in chunks(pa.array(texts), "symbol")]
    hashes = np.concatenate([f for _, _, f in parts])
    docs = np.concatenate([c.docs + at for at, c, _ in parts])
    counts = np.concatenate([c.counts for _, c, _ in parts])
    marks = Lookup(telling(hashes, docs, toxic))
    y = ((marks.find(hashes) >= 0).any(1) & toxic[docs]).astype(float)
    if not y.any():
        return None
    seen = np.unique(np.bincount(docs[y > 0], minlength=len(texts)).nonzero()[0])
    use = np.flatnonzero(~toxic | np.isin(np.arange(len(texts)), seen))  # toxic documents with no telling token teach no tokens
    keep = np.isin(docs, use)
    hashes, y, docs = hashes[keep], y[keep], docs[keep]
    counts = counts[use]
    keys, often = np.unique(once_a_document(hashes, docs)[0], return_counts=True)
    lookup = Lookup(keys := keys[often >= MIN_DOCS])
    found = lookup.find(hashes)
    found[found < 0] = len(keys)
    # Parameters: features, an idle place for unknown ones, and a bias.
    w = np.zeros(len(keys) + 1)
    bias = np.array([np.log((y.sum() + 1) / (len(y) + 2))])
    follows = np.concatenate(([False], docs[1:] == docs[:-1])) if len(docs) else np.zeros(0, bool)
    prev = np.concatenate(([0.0], y[:-1])) * follows
    n11, n1 = (y * prev).sum(), prev.sum()
    n01, n0 = (y * (1 - prev)).sum(), (1 - prev).sum()
    # Transitions begin with counts of the labelled chains, relative to independence, so that the bias carries how rare the state is.
    share = (y.sum() + 1) / (len(y) + 2)
    stay, enter = (n11 + 1) / (n1 + 2), (n01 + 1) / (n0 + 2)
    trans = np.array([[(1 - enter) / (1 - share), enter / share], [(1 - stay) / (1 - share), stay / share]])
    tie, steps = np.log(trans), np.array([[n0 - n01, n01], [n1 - n11, n11]])
    m, v = [np.zeros_like(x) for x in (w, bias, tie)], [np.zeros_like(x) for x in (w, bias, tie)]
    scale = 1.0 / max(y.sum(), 1)
    for step in range(1, STEPS + 1):
        score = np.clip(w[found].sum(1) + bias[0], -CLIP, CLIP)
        p = marginals(np.exp(score), counts, np.exp(tie), pairs := np.zeros((2, 2)))
        miss = (p - y) * scale
        grads = [np.bincount(found.ravel(), np.repeat(miss, found.shape[1]), len(w)) + RIDGE * w, np.array([miss.sum()]), (pairs - steps) * scale + RIDGE * tie]
        for k, (x, g) in enumerate(zip((w, bias, tie), grads)):
            m[k] = 0.8 * m[k] + 0.2 * g
            v[k] = 0.95 * v[k] + 0.05 * g * g
            x -= RATE * (m[k] / (1 - 0.8 ** step)) / (np.sqrt(v[k] / (1 - 0.95 ** step)) + 1e-7)
        w[-1] = 0.0
    model = Model(lookup, w, float(bias[0]), np.exp(tie), np.zeros(3))
    x = np.concatenate([model.summary(c, model.token_probabilities(c)) for _, c, _ in parts])
    model.final = logistic(x, toxic.astype(float), weight)
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; slopes are kept from turning negative."""
    out = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * out
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(out))
        step = np.linalg.solve(curve, slope)
        out -= step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        out[1:] = np.maximum(out[1:], 0.0)
    return out


def sample(docs: DataFrame, labels: DataFrame, per_label: dict[int, int] = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Whole texts, labels and weights of the rows to fit on, and the share of toxic labels."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    # Rows are chosen by id and size; texts are then read for the chosen ones only.
    known = docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("bytes")).join(known.select("doc_id", "toxic"), "doc_id")
    known = landed(known, "labelled")
    sizes = {r["toxic"]: (r["bytes"], r["n"]) for r in known.groupBy("toxic").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n for _, n in sizes.values())
    share = sizes.get(1, (0, 0))[1] / total if total else 0.0
    if len(sizes) < 2:
        return [], np.zeros(0, bool), np.zeros(0), share
    # Ids by a hash, each with all its rows; short texts before long ones.
    ids = known.groupBy("doc_id", "toxic").agg(F.sum("bytes").alias("bytes"))
    ids = ids.withColumn("long", F.col("bytes") > F.when(F.col("toxic") == 1, per_label[1] // FIT).otherwise(per_label[0] // FIT))
    ids = landed(ids.withColumn("place", F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000), "ids")
    short = {r["toxic"]: r["bytes"] for r in ids.where(~F.col("long")).groupBy("toxic").agg(F.sum("bytes").alias("bytes")).collect()}
    # No more ids than can matter are put in order: short ones of about AHEAD times the bytes, and the smallest long ones.
    parts = {k: min(1.0, AHEAD * per_label[k] / max(short.get(k, 0), 1)) for k in (0, 1)}
    ahead = ids.where(~F.col("long") & (F.col("place") < F.when(F.col("toxic") == 1, parts[1]).otherwise(parts[0])))
    for k in (0, 1):
        ahead = ahead.unionByName(ids.where(F.col("long") & (F.col("toxic") == k)).orderBy("bytes", "place", "doc_id").limit(FIT))
    own = Window.partitionBy("toxic").orderBy("long", F.when(F.col("long"), F.col("bytes")), "place", "doc_id")
    upto = F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0))
    ahead = ahead.withColumns({"upto": upto, "at": F.row_number().over(own)})
    within = F.col("upto") <= F.when(F.col("toxic") == 1, per_label[1]).otherwise(per_label[0])
    chosen = landed(ahead.where(within | (F.col("at") <= MIN_DOCS)).select("doc_id", "toxic"), "chosen")
    rows = docs.select("doc_id", text_of().alias("text")).join(small(chosen), "doc_id")
    got = rows.orderBy("doc_id", "toxic", "text").select("text", "toxic").collect()
    toxic = np.array([r["toxic"] == 1 for r in got], bool)
    weight = np.where(toxic, sizes[1][1] / max(toxic.sum(), 1), sizes[0][1] / max((~toxic).sum(), 1))
    return [r["text"] for r in got], toxic, weight / max(weight.mean(), 1e-9) if len(got) else weight, share


def tag(docs: DataFrame, keys: list[str], model: Model | None, base: float = 0.0, text: str = "text") -> DataFrame:
    """keys, score, and the offending spans: starts and ends in code points, and the largest marginal of each."""
    rows = docs.select(*keys, text_of(text).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            score = np.full(batch.num_rows, base)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for at, end, c in chunks(column, "symbol") if model is not None else ():
                p = model.token_probabilities(c)
                score[at:end] = model.score(c, p)
                bad = np.flatnonzero(p >= 0.5)
                if len(bad):
                    points = np.concatenate(([0], np.cumsum((c.data & 0xC0) != 0x80)))  # code points before each byte
                    begins = np.flatnonzero(np.concatenate(([True], (np.diff(bad) > 1) | (np.diff(c.docs[bad]) > 0))))
                    for i, j in zip(begins, np.append(begins[1:], len(bad))):
                        d = c.docs[bad[i]]
                        zero = points[c.offsets[d]]
                        spans[at + d].append({"start": int(points[c.starts[bad[i]]] - zero), "end": int(points[c.ends[bad[j - 1]]] - zero),
                                              "probability": float(p[bad[i:j]].max())})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.array(score), pa.array(spans, kind)], names=[*keys, "score", "spans"])

    return in_arrow(rows, judge, f"{fields}, score double, spans array<struct<start: long, end: long, probability: double>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans of each document."""
    texts, toxic, weight, base = sample(docs, labels)
    out = tag(docs, ["doc_id"], fit(texts, toxic, weight), base)
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                      listed.alias("spans"))
