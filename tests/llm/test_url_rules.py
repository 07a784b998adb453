"""URL rules against rules found by trying all combinations of tokens."""

import random
from itertools import combinations

import pytest

from quantloom.llm import url_rules
from quantloom.llm.url_rules import HostRule, Index, Mined

SF = "/root/testdata/sf0.01"
URLS = [
    (1, "http://a.com/x", "a.com", "/x", "com/", "allow"), (2, "HTTP://WWW.Example.COM/en/1?q=/fr/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (3, "https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    (4, "https://x.example.com/en/2#top", "x.example.com", "/en/2", "example.com/en/", "block"),
    (5, "https://example.com/en", "example.com", "/en", "com/", "allow"), (6, "http://net/es/9", "net", "/es/9", "net/es/", "block"),
    (7, "http://xnet/es/9", "xnet", "/es/9", None, "allow"), (8, "http://b.net/fr/?", "b.net", "/fr/", "net/fr/", "block"),
    (9, "http://b.net/FR/", "b.net", "/FR/", None, "allow"), (10, None, "", "", None, "allow"), (11, "", "", "", None, "allow"),
    (12, "no scheme.com/en/", "", "", None, "allow"), (13, "://", "", "", None, "allow"), (14, "http://a.com", "a.com", "", None, "allow"),
    (15, "http://a.com?x=http://b.net/es/", "a.com", "", None, "allow"), (None, "http://a.com#/es/", "a.com", "", None, "allow"),
    (17, "x://y\n.com/\n/en/", "y\n.com", "/\n/en/", "com/", "allow"), (18, "a/b?c://d.net/es/1", "d.net", "/es/1", "net/es/", "block"),
    (19, "http://\u00c4B.com:80/x", "\u00c4b.com:80", "/x", None, "allow")]


def test_hosts_paths_and_rules(spark):
    rows = [u[:2] for u in URLS] + [URLS[0][:2]]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, n int")
    out, mined = url_rules.judge(pages, min_count=100)
    assert mined == [] and out.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    got = [tuple(r)[:5] for r in out.collect()]
    assert sorted(got, key=str) == sorted([(u[0], *u[2:]) for u in URLS] + [(1, *URLS[0][2:])], key=str)


def every_rule(baskets, least, confidence):
    """By trying all combinations: {(tokens, verdict): (confidence, support)} without those that say no more than a smaller one."""
    n, counts = len(baskets), {}
    for tokens, verdict in baskets:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                own = counts.setdefault(c, {"all": 0})
                own["all"] += 1
                own[verdict] = own.get(verdict, 0) + 1
    rules = {(c, v): (x / own["all"], x / n) for c, own in counts.items() for v, x in own.items()
             if v != "all" and x >= least and x / own["all"] >= confidence}
    return {key: value for key, value in rules.items() if not any(
        (c, key[1]) in rules and rules[c, key[1]][0] >= value[0] for k in range(1, len(key[0])) for c in combinations(key[0], k))}


def test_mining_and_matching(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    more = [(10_000 + i, f"https://m{i % 3}.example.org/{'en' if i % 2 else 'pt'}/{i}.html?ref=x") for i in range(50)]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id long, url string"))
    rows = url_rules.parsed(pages, ["page_id"], url_rules.RULES).select("page_id", "rule", "verdict", "tokens").collect()
    baskets = [(r.tokens, r.verdict) for r in rows if r.rule is not None]
    assert len(baskets) > 50 and max(len(t) for t, _ in baskets) <= url_rules.MINED_TOKENS
    out, mined = url_rules.judge(pages, min_support=0.04, min_count=2, min_confidence=0.8)
    want = every_rule(baskets, -(-len(baskets) * 4 // 100), 0.8)
    assert {(m.tokens, m.verdict): (pytest.approx(m.confidence), pytest.approx(m.support)) for m in mined} == want and len(want) > 5
    best = sorted((Mined(c, v, *value) for (c, v), value in want.items()), key=lambda m: m.rank)
    got = {r.page_id: r.verdict for r in out.collect()}
    fired = 0
    for r in rows:
        found = next((m for m in best if set(m.tokens) <= set(r.tokens)), None)
        assert got[r.page_id] == (r.verdict or (found.verdict if found else "allow"))
        fired += r.rule is None and found is not None
    assert fired > 0 and len(got) == len(rows)


def as_rules(mined):
    return {(m.tokens, m.verdict): (pytest.approx(m.confidence), pytest.approx(m.support)) for m in mined}


def test_every_token_of_long_urls_is_mined(spark):
    # What tells the labels apart stands behind more than MINED_TOKENS tokens that all share.
    shared = "/".join(f"d{k}" for k in range(20))
    labelled = spark.createDataFrame([(f"http://a.org/{shared}/{'bad' if i % 2 else 'good'}/{i}", "block" if i % 2 else "allow") for i in range(40)],
                                     "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://b.org/bad/x"), (2, "http://b.org/good/x"), (3, f"http://a.org/{shared}/bad/99")], "page_id long, url string")
    out, mined = url_rules.judge(pages, [], labelled)
    assert as_rules(mined) == {(("path:bad",), "block"): (1.0, 0.5), (("path:good",), "allow"): (1.0, 0.5)}
    assert {r.page_id: r.verdict for r in out.collect()} == {1: "block", 2: "allow", 3: "block"}


@pytest.mark.parametrize("longest", [12, 4])
def test_long_baskets_give_the_rules_of_all_combinations(spark, monkeypatch, longest):
    monkeypatch.setattr(url_rules, "MINED_TOKENS", longest)
    chance = random.Random(7)
    baskets = []
    for _ in range(60):
        tokens = [f"t{k:02}" for k in range(14) if chance.random() < (0.97 if k < 9 else 0.4)]
        bad = sum(t in tokens for t in ("t03", "t11", "t13")) >= 2 and chance.random() < 0.9
        baskets.append((tokens, "block" if bad else "allow"))
    mined = url_rules.mine(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.2, 2, 0.8)
    want = every_rule(baskets, 12, 0.8)
    assert max(len(t) for t, _ in baskets) > 12 and max(len(t) for t, _ in want) > 1
    assert as_rules(mined) == want


def test_tokens_that_nearly_always_stand_together(spark):
    # Forty tokens of which a URL lacks one at most: FP-growth alone would give 2 ** 40 combinations.
    same = [f"p{k:02}" for k in range(40)]
    baskets = [([t for t in same if t != lacking], "block") for lacking in same] + [(same, "block")] * 60
    baskets += [(same, "allow")] * 70 + [([*same, "x"], "allow")] * 30
    mined = url_rules.mine(spark.createDataFrame(baskets, "tokens array<string>, verdict string"))
    assert as_rules(mined) == {(("x",), "allow"): (1.0, 0.15)}


def test_index_lists_each_rule_once():
    rules = [Mined(("a", "b"), "block", 1.0, 0.2), Mined(("a",), "allow", 0.95, 0.3), Mined(("b", "c"), "block", 0.9, 0.1)]
    index = Index(rules)
    assert sorted(k for ks in index.under.values() for k in ks) == [0, 1, 2]
    assert index.best({"a", "b", "c"}) == 0 and index.best({"a", "c"}) == 1 and index.best({"b", "c"}) == 2 and index.best({"c"}) is None


def test_given_labels_and_empty_tables(spark):
    schema = "page_id long, url string"
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.org/{i}") for i in range(40)], schema)
    labelled = spark.createDataFrame([(f"http://{'bad' if i % 2 else 'good'}.org/a{i}", "block" if i % 2 else "allow") for i in range(20)]
                                     + [(None, "block")], "url string, verdict string")
    out, mined = url_rules.judge(pages, [HostRule("allow", "bad.org", "/1")], labelled)
    got = {r.page_id: (r.verdict, r.why) for r in out.collect()}
    assert got[3] == ("block", "host:bad") and got[2] == ("allow", "host:good") and got[1] == ("allow", None) and got[11] == ("allow", None)
    assert all(got[i][0] == ("block" if i % 2 else "allow") for i in range(2, 10))
    assert url_rules.judge_pages(spark.createDataFrame([], schema)).collect() == []
