"""Exact and near deduplication against brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa

from quantloom.llm import exact_dedup, near_dedup
from quantloom.llm import text as text_module
from quantloom.llm.text import chunks
from quantloom.session import work_path

EDGE = ["", None, "a", "A", "a b c d", "a  B c\td", "é É", "x " * 3000, "x " * 3001, " \n", "x" * 70_000, "x" * 69_999 + " x", "x" * 69_999 + "y"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, node string, size int").repartition(3)


def test_exact_groups(spark):
    rows = [*enumerate(EDGE), (None, "a"), (20, "a b c d"), (20, "a b c d"), (21, "ab  cd")]
    got = sorted(map(str, exact_dedup.dedup(docs_of(spark, rows), chunk=1000).collect()))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for text, members in groups.items():
        best = min(members)[3]
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [str((i, best, len(members), i == best, digest)) for *_, i in members]
    assert sorted(re.sub(r"\w+=", "", g.removeprefix("Row")) for g in got) == sorted(want)
    assert exact_dedup.dedup(docs_of(spark, rows).limit(0)).count() == 0


def test_fingerprints_compose():
    import pyarrow as pa

    text = "".join(random.Random(1).choices("abcé", k=5000))
    for base, prime in zip(exact_dedup.BASES, exact_dedup.PRIMES):
        whole = int(exact_dedup.chunk_hashes(pa.array([text]), base, prime)[0])
        parts = [text[i:i + 777] for i in range(0, len(text), 777)]
        after = [len("".join(parts[k + 1:]).encode()) for k in range(len(parts))]
        assert sum(exact_dedup.shifted(exact_dedup.chunk_hashes(pa.array(parts), base, prime), np.array(after), base, prime)) % prime == whole


def test_collisions_are_resolved(spark, monkeypatch):
    # Every text has the same fingerprint, so only the comparison of chunks and the texts themselves tell them apart.
    monkeypatch.setattr(exact_dedup, "PRIMES", (1, 1))
    rows = [(1, "abc"), (2, "abd"), (3, "a bc"), (4, "xyz"), (5, "longer")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(docs_of(spark, rows)).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1)}


def sequential(hashes, places=128):
    """SuperMinHash as published: one element after the other, each with its own permutation."""
    out = [2 ** 64 - 1] * places
    for x in hashes:
        order = list(range(places))
        for j in range(places):
            draw = int(near_dedup.mix(np.array([(int(x) + (j + 1) * near_dedup.GOLDEN) % 2 ** 64], np.uint64))[0])
            k = j + (((draw & 0xFFFFFFFF) * (places - j)) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], (j << 32) | (draw >> 32))
    return out


def test_signatures_equal_the_sequential_definition():
    draw = np.random.default_rng(0)
    for n in (1, 3, 40, 300):
        hashes = np.unique(draw.integers(0, 2 ** 63, n).astype(np.uint64))
        assert near_dedup.signatures(hashes, np.zeros(len(hashes), int), 1)[0].tolist() == sequential(hashes)


def test_signatures_estimate_similarity_with_less_variance_than_independent_places():
    draw, errors = np.random.default_rng(3), []
    for _ in range(150):
        both, a, b = (draw.integers(0, 2 ** 63, n).astype(np.uint64) for n in (60, 10, 10))
        pair = [near_dedup.signatures(np.concatenate((both, x)), np.zeros(70, int), 1)[0] for x in (a, b)]
        errors.append((pair[0] == pair[1]).mean() - 60 / 80)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.75 * 0.25 / 128


def shingles(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen, places = {}, collections.defaultdict(list)
    for i, s in enumerate(sets):
        if s and s in seen:
            parent[find(i)] = find(seen[s])
        elif s:
            seen[s] = i
            shared = collections.Counter(j for x in s for j in places[x])
            for x in s:
                places[x].append(i)
            for j, n in shared.items():
                if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def test_near_groups(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(300)}" for _ in range(120)]
    rows = [*enumerate(EDGE)]
    for i in range(700):  # one large group whose members are often less similar than the threshold
        words = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4, 6, 9])):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10 ** 6)}"
        rows.append((100 + i, " ".join(words)))
    assert sorted(tuple(r) for r in near_dedup.dedup(docs_of(spark, rows)).collect()) == brute(rows)


def test_near_groups_of_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (None, "q r s"), (None, None)]
    got = sorted(map(str, near_dedup.dedup(docs_of(spark, rows)).select("doc_id", "component_id", "kept").collect()))
    want = [(None, 3, False), (7, 3, False), (7, 3, False), (3, 3, True), (None, None, True), (None, None, True)]
    assert got == sorted(f"Row(doc_id={a}, component_id={b}, kept={c})" for a, b, c in want)
    assert near_dedup.keep_one(docs_of(spark, rows)).count() == 3
    assert near_dedup.dedup(docs_of(spark, rows).limit(0)).count() == 0


def thue_morse(n):
    """A word over a and b and its complement: for hashes modulo 2 ** 64 they are equal whatever the base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_unlike_texts_are_not_linked(spark):
    one, other = thue_morse(4096)
    same = "these five words are equal "
    rows = [(1, one), (2, other), (3, same + one), (4, same + other), (5, one)]
    got = {r.doc_id: r.component_id for r in near_dedup.dedup(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_sets_of_one_name_are_told_apart(spark):
    rows = [(1, 9, 100, 7), (2, 9, 100, 7), (3, 9, 200, 7), (4, 9, 200, 8), (5, 4, 1, 7), (6, 0, 100, 7)]
    sets = spark.createDataFrame(rows, "id long, n long, proof long, node long").replace(0, 9, ["n"])
    got = {r.id: r.node for r in near_dedup.told_apart(sets).collect()}
    assert got[1] == got[2] == got[6] and len({got[1], got[3], got[5], got[4]}) == 4 and got[4] == 8


def test_hashes_of_long_texts_in_steps(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "z" * 5000 + " end"
    column = pa.array([text])
    (_, _, whole), = chunks(column)
    want = whole.word_hashes()
    monkeypatch.setattr(text_module, "STEP_BYTES", 100)
    (_, _, stepped), = chunks(column)
    assert np.array_equal(stepped.word_hashes(), want) and len(np.unique(want)) == 3002


def test_chunks_of_a_long_text(spark):
    """Cut in one pass; three documents of 4 and 16 million characters, of which two differ in white space only."""
    took = []
    for n in (1_000_000, 4_000_000):
        texts = ["ab\u00e9c" * n, "ab\u00e9 c" * n, "ab\u00e9c" * n + "x"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        docs.write.mode("overwrite").parquet(path := work_path(spark, "long"))
        started = time.perf_counter()
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(spark.read.parquet(path)).collect()}
        took.append(time.perf_counter() - started)
        assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1)}
    assert took[1] < 8 * took[0]
    rows = exact_dedup.chunk_rows(spark.createDataFrame([(1, "ab\u00e9c" * 10), (2, "")], "k int, t string"), ["k"], "t", 7).collect()
    assert [(r.place, r.chunk, r.after) for r in rows if r.k == 1][-1] == (5, ("ab\u00e9c" * 10)[35:], 0)
    assert sum(len(r.chunk) for r in rows) == 40 and [r.after for r in rows if r.k == 2] == [0]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a long, b long").repartition(5)
    got = {r.node: r.label for r in near_dedup.components(links).collect()}
    assert all(got.get(i, i) == 0 for i in range(61)) and got[200] == 100 and got[300] == 100
