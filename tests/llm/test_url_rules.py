"""Mined rules against an enumeration of all combinations of tokens."""

import itertools
import random
import time

from pyspark.sql import functions as F

from quire.llm import urls


def enumerated(rows, least, min_confidence):
    """Rules of up to RULE_ITEMS classes of tokens, without those that a shorter one covers. rows: (url, tokens, bad)."""
    where = {}
    for url, tokens, _ in rows:
        for t in tokens:
            where.setdefault(t, set()).add(url)
    bad = {url for url, _, b in rows if b}
    classes = {}
    for t, found in where.items():
        if len(found & bad) >= least:
            classes.setdefault(frozenset(found), []).append(t)
    rules = {}
    for size in range(1, urls.RULE_ITEMS + 1):
        for sets in itertools.combinations(classes, size):
            both = frozenset.intersection(*sets)
            if len(both & bad) >= least and len(both & bad) >= min_confidence * len(both):
                rules[frozenset(t for s in sets for t in classes[s])] = len(both & bad) / len(both)
    return {tuple(sorted(r)): round(c, 9) for r, c in rules.items() if not any(o < r and rules[o] >= c for o in rules)}


def mined(spark, rows, **bounds):
    df = spark.createDataFrame(rows, "url string, tokens array<string>, bad boolean").repartition(3)
    return {tuple(r["items"]): round(r["confidence"], 9) for r in urls.mine_rules(df, **bounds).collect()}


def test_all_rules_of_long_urls_like_an_enumeration(spark):
    """URLs of up to 24 tokens: more than need no groups, so blocks take part."""
    rng = random.Random(12)
    vocab = [f"path:t{i}" for i in range(26)]
    for n in (8, 24):
        rows = []
        for i in range(300):
            tokens = [t for t in vocab[: n + 2] if rng.random() < (0.3 if n == 24 else 0.5)][:n]
            tokens += ["path:same", "path:alike"] if i % 7 == 0 else []
            wrong = {"path:t1", "path:t4"} <= set(tokens) or {"path:t2", "path:t3", "path:t7"} <= set(tokens) or rng.random() < 0.03
            rows.append((f"u{i}", tokens, wrong))
        want = enumerated(rows, 6, 0.7)
        assert len(want) >= 5 and max(map(len, want)) >= 3
        assert mined(spark, rows, min_count=6, min_support=0.0, min_confidence=0.7) == want


def test_a_rule_under_noisier_tokens_is_found(spark):
    """Thirteen tokens are more common in bad URLs than the two that make a URL bad together."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        wrong = i % 4 == 0
        path = ["free", "spins"] if wrong else [rng.choice(["free", "spins", "news"])]
        path += [f"noise{k}" for k in range(13) if rng.random() < (0.9 if wrong else 0.5)]
        rows.append((i, f"https://x.example.info/{'/'.join(path)}/{i}", wrong))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(5000, "https://y.example.info/free/spins"), (5001, "https://y.example.info/free/news")], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, bad boolean")
    began = time.time()
    got = {r["page_id"]: (r["verdict"], r["mined_confidence"]) for r in urls.judge_urls(pages, labels).collect()}
    assert got[5000] == ("block", 1.0) and got[5001][0] == "allow" and time.time() - began < 90
    assert {i for i, (v, _) in got.items() if v == "block"} >= {i for i, _, b in rows if b}


def test_a_block_holds_few_items_of_a_url(spark):
    baskets = spark.createDataFrame([(True, [f"i{k}" for k in range(60)]), (False, ["i1"]), (False, [])], "bad boolean, items array<string>")
    made = urls.blocks_of(baskets, 20)
    assert made.agg(F.max(F.size("items"))).first()[0] <= 25
    named = [tuple(r["items"]) for r in made.filter(F.size("items") == 1).collect()]
    assert len(named) == len(set(named)) and any(x[0].endswith("|i1") for x in named)
