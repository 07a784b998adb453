"""Near-duplicate groups by SuperMinHash.

A document's set is its distinct shingles of five words. SuperMinHash draws for each shingle a random permutation of the signature's
places and gives the place at rank j a value in [j, j + 1); a place keeps its smallest value. Ranks of one shingle are
thus correlated (each rank once), which lowers the variance of the estimate, and once every place has a value below j no
rank from j on can change anything: all documents of a step go through the ranks together, and each leaves as soon as that
holds for it.

Signatures are cut into bands; documents that agree in a band share a bucket. With BANDS bands of ROWS places a pair at the
threshold shares none with probability (1 - 0.75 ** ROWS) ** BANDS, about 5e-6. Then:

* Documents of equal sets become one node. Buckets with the same members count once.
* Forest: within a bucket, dealt at random to blocks of BLOCK nodes three times over, each node proposes its most similar
  predecessor by signature. Proposals are verified on the full sets, and union-find joins what holds.
* Rest: buckets whose nodes are still in several groups are gone through in full. Nodes outside a bucket's largest group meet all of
  its nodes, in blocks. Nodes whose signatures rule the threshold out leave; the others are compared on their full sets within
  the task, block by block, which writes only links that join groups.

So no link between groups is lost but by chance of the signatures, pairs within a group that is already joined are not looked at,
and pairs are never written out in full.

Defined cases: a null or empty text, and one without words, has an empty set and is linked with nothing; a text of fewer than
five words is one shingle; a null id is never the name of a group unless all its rows lack one; rows that repeat are
linked like any equal texts; an empty table gives no rows. Extra columns are not read. Sets are compared by 64-bit hashes of their
shingles, built on word hashes modulo two primes. A node is named by a 64-bit hash of its set and has a second, independent one
and the set's size besides; documents that agree in the name but not in those are told apart, so unlike sets are one node
only if 128 bits agree by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.store import in_arrow, landed, small, text_of
from quantloom.llm.text import chunks, mix

WIDTH = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
BLOCK = 256
#: Signatures that agree in fewer places rule a pair out: below the mean at the threshold by 3.9 standard deviations of
#: independent places; those of SuperMinHash vary less.
AGREE = int(PLACES * (0.75 - 3.9 * (0.75 * 0.25 / PLACES) ** 0.5))
U64 = np.uint64
LAST = U64(0xFFFFFFFFFFFFFFFF)
GOLDEN = 0x9E3779B97F4A7C15


def signatures(hashes: np.ndarray, docs: np.ndarray, n_docs: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each document's distinct shingles: rows of ``places`` values, rank in the high and fraction in the low 32 bits."""
    out = np.full(n_docs * places, LAST)
    left = np.arange(len(hashes))
    order = picks = None
    for rank in range(places):
        if not len(left):
            break
        h, d = hashes[left], docs[left]
        draw = mix(h + U64((rank + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF))
        pick = (rank + (((draw & U64(0xFFFFFFFF)) * U64(places - rank)) >> U64(32)).astype(np.int64))
        if rank == 0:
            place, picks = pick, pick
        elif rank == 1:
            place = np.where(pick == picks, 0, pick)  # the first exchange put place 0 there
        else:
            rows = np.arange(len(left))
            if order is None:  # the shingles that go on get their permutation in full
                order = np.broadcast_to(np.arange(places, dtype=np.uint8), (len(left), places)).copy()
                for k, before in enumerate((picks[:, 0], picks[:, 1])):
                    order[rows, before], order[rows, k] = order[rows, k], order[rows, before].copy()
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, rank]
        value = (U64(rank) << U64(32)) | (draw >> U64(32))
        np.minimum.at(out, d * places + place, value)
        open_ = (out.reshape(n_docs, places).max(1) >> U64(32)) > U64(rank)
        stay = open_[d]
        if rank == 0:
            picks = picks[stay]
        elif rank == 1:
            picks = np.stack((picks[stay], pick[stay]), 1)
        else:
            order = order[stay]
        left = left[stay]
    return out.reshape(n_docs, places)


def distinct(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, their documents, and how many each has."""
    bounds = np.searchsorted(docs, np.arange(n_docs + 1))
    sets = [np.unique(hashes[bounds[d]:bounds[d + 1]]) for d in range(n_docs)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([np.zeros(0, U64), *sets]), np.repeat(np.arange(n_docs), sizes), sizes


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash of each band of each row, different for different bands."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(GOLDEN), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out + parts[:, :, k])
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, c in chunks(batch.column("text")):
            hashes, docs, sizes = distinct(*c.shingles(WIDTH), end - at)
            signature = signatures(hashes, docs, end - at)
            node, proof = np.zeros(end - at, U64), np.zeros(end - at, U64)
            np.add.at(node, docs, mix(hashes))
            np.add.at(proof, docs, mix(hashes ^ U64(GOLDEN)))
            short = mix(signature + U64(1)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")[at:end], batch.column("mark")[at:end], pa.array(sizes), _long(mix(node)), _long(mix(proof)),
                 pa.array([row.tobytes() for row in short], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1, dtype=np.int32) * BANDS), _long(bands(signature).ravel()))],
                names=["id", "mark", "n", "node", "proof", "signature", "bands"])


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    """Runs of equal (bucket, part), which may go on from one batch to the next."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
        if not part.num_rows:
            continue
        key = np.stack([part.column(k).to_numpy() for k in ("bucket", "part")])
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0).any(0)) + 1))
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield _group(part.slice(int(i), int(j - i)), names)
        rest = part.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield _group(rest, names)


def _group(part: pa.Table, names: list[str]) -> dict:
    out = {k: part.column(k) if k == "text" else part.column(k).to_numpy() for k in names if k != "signature"}
    if "signature" in names:
        raw = b"".join(part.column("signature").to_pylist())
        out["signature"] = np.frombuffer(raw, np.uint16).reshape(part.num_rows, PLACES)
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a block with its most similar predecessor."""
    low, high = [], []
    for g in _groups(batches, ["node", "signature"]):
        for k in range(1, len(g["node"])):
            agree = (g["signature"][:k] == g["signature"][k]).sum(1)
            best = int(agree.argmax())
            if agree[best] >= AGREE:
                low.append(g["node"][best])
                high.append(g["node"][k])
        if len(low) > 50_000:
            yield _pairs(low, high)
            low, high = [], []
    yield _pairs(low, high)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a part that have a counterpart in another group which their signatures do not rule out.

    ``side`` 1 marks nodes outside the bucket's largest group; each pair that is looked at has one of them.
    """
    names = ["bucket", "part", "node", "label", "side"]
    for g in _groups(batches, [*names, "signature"]):
        keep = np.zeros(len(g["node"]), bool)
        for k in np.flatnonzero(g["side"] == 1):
            near = ((g["signature"] == g["signature"][k]).sum(1) >= AGREE) & (g["label"] != g["label"][k])
            keep |= near
            keep[k] |= near.any()
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(g[n][keep]) for n in names], names=names)


def overlaps(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``rows`` with all sets."""
    keys, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    out = np.zeros((len(rows), len(sets)), np.int64)
    for low in range(0, len(keys), DENSE // max(len(sets), 1) + 1):  # the shingles in slices, so memory is bounded
        high = low + DENSE // max(len(sets), 1) + 1
        here = (at >= low) & (at < high)
        has = np.zeros((len(sets), min(high, len(keys)) - low), np.float32)
        has[owner[here], at[here] - low] = 1.0
        out += np.rint(has[rows] @ has.T).astype(np.int64)
    return out


#: Entries of the table of sets and shingles that is held at a time.
DENSE = 1 << 23


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between groups in a part, on the full sets: for each node outside the largest group one to each other group."""
    for g in _groups(batches, ["node", "label", "side", "text"]):
        sets = list(_text_sets(g["text"]))
        rows = np.flatnonzero(g["side"] == 1)
        if not len(rows):
            continue
        sizes = np.array([len(x) for x in sets])
        both = overlaps(sets, rows)
        linked = 100 * both >= PERCENT * (sizes[rows][:, None] + sizes[None, :] - both)
        linked &= g["label"][rows][:, None] != g["label"][None, :]
        low, high = [], []
        for i, k in enumerate(rows):
            others = np.flatnonzero(linked[i])
            _, first = np.unique(g["label"][others], return_index=True)
            low += g["node"][others[first]].tolist()
            high += [g["node"][k]] * len(first)
        if low:
            yield _pairs(low, high)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _text_sets(column) -> Iterator[np.ndarray]:
    """The set of shingles of each text."""
    for at, end, c in chunks(column):
        hashes, docs = c.shingles(WIDTH)
        bounds = np.searchsorted(docs, np.arange(end - at + 1))
        for k in range(end - at):
            yield np.unique(hashes[bounds[k]:bounds[k + 1]])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the full sets of two texts are similar enough."""
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(_text_sets(batch.column("text_a")), _text_sets(batch.column("text_b")))):
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked[k] = 100 * both >= PERCENT * (len(x) + len(y) - both) and len(x) > 0
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])


def texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node and text of the nodes in ``wanted`` (distinct)."""
    wanted = nodes.join(wanted, "node").select("node", F.col("best.id").alias("id"), F.col("best.mark").alias("mark"))
    wanted = landed(wanted, "wanted")
    same = F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.mark") == F.col("w.mark"))
    return texts.alias("t").join(small(wanted).alias("w"), same).select("w.node", "t.text").dropDuplicates(["node"])


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that are linked, judged on the whole texts of the nodes."""
    pairs = landed(pairs.distinct(), "pairs")
    body = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts)
    rows = pairs.join(body.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(body.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    judged = in_arrow(rows.select("a", "b", "text_a", "text_b"), _verify, "a long, b long, linked boolean")
    return landed(judged.where("linked").select("a", "b"), "verified")


def _local_union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over this task's links: every node with the least node it is joined to here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.array(list(parent), np.int64)
    roots = np.array([find(int(x)) for x in nodes], np.int64)
    keep = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(roots[keep]), pa.array(nodes[keep])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node it is joined to) of all nodes with links.

    Tasks unite what they hold, then every node is replaced by its least neighbour, until no link is left; the
    replacements, applied one after the other, lead from a node to its label.
    """
    spark = links.sparkSession
    links = landed(in_arrow(links.select("a", "b"), _local_union, "a long, b long"), "links")
    chain: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        step = landed(least.select("node", F.least("node", "m").alias("to")), "steps")
        chain.append(step)
        moved = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        links = landed(moved.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not chain:
        return spark.createDataFrame([], "node long, label long")
    labels = chain[-1].select("node", F.col("to").alias("label"))
    for step in reversed(chain[:-1]):
        last = labels.select(F.col("node").alias("to"), "label")
        labels = landed(step.join(last, "to", "left").select("node", F.coalesce("label", "to").alias("label")), "labels")
    return landed(labels, "labels")


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def forest_pairs(members: DataFrame, signature: DataFrame) -> DataFrame:
    """Proposals of the first round. ``members`` has bucket, node and the bucket's size."""
    deals = F.when(F.col("size") <= BLOCK, F.lit(1)).otherwise(F.lit(3))
    rows = members.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    rows = rows.withColumn("part", F.col("deal").cast("long") * (1 << 40) + F.pmod(F.xxhash64("node", "bucket", "deal"), _blocks("size")))
    rows = rows.select("bucket", "part", "node").join(signature, "node").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")
    return in_arrow(rows, _forest, "a long, b long")


def rest_links(members: DataFrame, signature: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different groups in buckets that have several, judged block by block on the whole texts.

    A row is repeated for each block it meets; pairs are not written out, only links that join groups are.
    """
    rows = members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    mixed = mixed.where("labels > 1").select("bucket", F.col("main.label").alias("main"), F.col("main.n").alias("in"), (F.col("size") - F.col("main.n")).alias("out"))
    rows = landed(rows.join(mixed, "bucket"), "mixed")
    out_blocks = _blocks("out")
    own = F.pmod(F.xxhash64("node", "bucket"), out_blocks)
    small_side = rows.where("label <> main")
    # A block of nodes outside the main group meets itself, the later blocks outside, and all blocks of the main group.
    to_main = F.sequence(F.lit(0), _blocks("in") - 1)
    queries = small_side.select("bucket", "node", "label", F.lit(1).alias("side"), F.explode(F.transform(
        to_main, lambda j: own * (1 << 31) + j)).alias("part"))
    mine = F.pmod(F.xxhash64("node", "bucket"), _blocks("in"))
    answers = rows.where("label = main").select("bucket", "node", "label", F.lit(0).alias("side"), F.explode(F.transform(
        F.sequence(F.lit(0), out_blocks - 1), lambda i: i * (1 << 31) + mine)).alias("part"))
    among = small_side.select("bucket", "node", "label", F.explode(F.transform(F.sequence(F.lit(0), out_blocks - 1), lambda j: F.struct(
        (-1 - (F.least(own, j) * (1 << 31) + F.greatest(own, j))).alias("part"), F.when(own <= j, 1).otherwise(0).alias("side")))).alias("x"))
    among = among.select("bucket", "node", "label", "x.side", "x.part")
    every = queries.unionByName(answers).unionByName(among).join(signature, "node")
    every = every.select("bucket", "part", "node", "label", "side", "signature").repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    open_ = landed(in_arrow(every, _open, "bucket long, part long, node long, label long, side int"), "open")
    full = open_.join(texts_of(open_.select("node").distinct(), nodes, texts), "node")
    full = full.select("bucket", "part", "node", "label", "side", "text").repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return landed(in_arrow(full, _exact, "a long, b long").distinct(), "rest")


def sets_of(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    body = text_of(text)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    return in_arrow(rows, _sets, f"id {kind}, mark long, n long, node long, proof long, signature binary, bands array<long>")


def told_apart(sets: DataFrame) -> DataFrame:
    """The same rows; where sets of one name differ in their second hash or size, each kind gets a name of its own."""
    both = F.struct("n", "proof")
    doubtful = landed(sets.where("n > 0").groupBy("node").agg(F.min(both).alias("low"), F.max(both).alias("high"))
                      .where("low <> high").select("node", F.lit(True).alias("doubt")), "doubtful")
    if doubtful.isEmpty():
        return sets
    named = sets.join(small(doubtful), "node", "left")
    return named.withColumn("node", F.when(F.col("doubt"), F.xxhash64("node", "proof", "n")).otherwise(F.col("node"))).drop("doubt")


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark (hash of the text), n, and component (least id of the group) of each document."""
    sets = told_apart(landed(sets_of(docs, id_column, text), "sets"))
    some = sets.where("n > 0")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "signature", "bands")).alias("best")
    nodes = landed(some.groupBy("node").agg(best), "nodes")
    signature = nodes.select("node", F.col("best.signature").alias("signature"))
    dealt = nodes.select("node", F.explode("best.bands").alias("bucket"))
    buckets = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("who")).where("size > 1")
    buckets = buckets.groupBy("size", "who").agg(F.min("bucket").alias("bucket"))
    members = landed(dealt.join(buckets.select("bucket", "size"), "bucket"), "members")
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))
    first = verified(forest_pairs(members, signature), nodes, texts)
    labels = components(first)
    second = rest_links(members, signature, labels, nodes, texts)
    if not second.isEmpty():
        labels = components(first.unionByName(second))
    named = nodes.select("node", F.col("best.id").alias("least")).join(labels, "node")
    named = landed(named, "named")
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(small(least), "label").select("node", "component")
    alone = nodes.select("node", F.col("best.id").alias("least"))
    name = landed(alone.join(named, "node", "left").select("node", F.coalesce("component", "least").alias("component")), "names")
    out = sets.where("n > 0").join(name, "node").select("id", "mark", "n", "component")
    return out.unionByName(sets.where("n = 0").select("id", "mark", "n", F.col("id").alias("component")))


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    return groups(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                               F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, one of each group, with all their columns; names that begin with ``_d_`` are reserved."""
    found = landed(groups(docs), "groups")
    rows = docs.withColumn("_d_mark", F.xxhash64(text_of()))
    drop = found.where(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("_d_id"), F.col("mark").alias("_d_other")).distinct()
    drop = landed(drop, "dropped")
    same = F.col("doc_id").eqNullSafe(F.col("_d_id")) & (F.col("_d_mark") == F.col("_d_other"))
    kept = rows.join(small(drop), same, "left_anti")
    # Rows that are there several times are told apart only if there are any.
    if not found.where("n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_d_mark"])
    return kept.select(*docs.columns)
