"""Exact dedup without hashing all, language ID, URL filters, BPE, and the pipeline."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from quire.llm import bpe, exact, langid, urls

SF = "/root/testdata/sf0.001"


def test_full_hashes_are_for_survivors_only(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "xy"), (4, "longer text"), (5, None), (6, " "), (7, "a  b"), (7, "a  b")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(docs).collect())
    want = [(1, 7, 4, False), (2, 7, 4, False), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 4, False), (7, 7, 4, True)]
    assert got == want
    same = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(docs, hash_all=True).collect())
    assert same == want
    assert exact.exact_groups(docs).filter("doc_id = 4 AND text_sha256 IS NULL").count() == 1


def test_languages_of_held_out_documents(spark):
    out = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.98 and 0 <= held[1] <= held[2] <= 1


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr"), (3, "12 !!", "en"), (4, None, "en"), (5, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert got[1][0] == "en" and got[2][0] == "fr" and [got[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3


@pytest.mark.parametrize("n", [2, 3, 5, 9, 40])
def test_codewords_lie_apart(n):
    code = langid.codewords(n)
    apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[i + 1 :])
    assert apart >= (1 if n == 2 else 2)


def judge(url):
    """Host, path and rule as the contract says."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r, _ in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


def test_urls_like_plain_python(spark, tables):
    rng = random.Random(9)
    parts = ["http", "://", "a.", "example.", "net", "com", "org", "/", "en/", "de/", "fr/", "?", "#", "NET", "É", "x", "://", ".", ""]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 10))) for _ in range(800)] + [f"{s}://{h}{p}" for s in ("http",) for h in ("example.net", "www.Example.NET", "net", "xnet", "a.example.com", "b.org") for p in ("", "/", "/en/", "/en", "/de/x", "/fr/?/en/", "?/en/", "#/")] + [None, ""]
    d = tables(pages=("page_id long, url string, html string, rule string, host string", [(i, u, None, "r", "h") for i, u in enumerate(made)]), labels=("doc_id long, quality int, toxic int", [(i, 1, 0) for i in range(5)]))
    got = urls.query(spark, d).collect()
    assert len(got) == len(made)
    for r in got:
        host, path, rule = judge(made[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), made[r["page_id"]]
        assert r["verdict"] == (dict(urls.RULES)[rule] if rule else "allow")


def test_mined_rules_block_what_labels_say(spark):
    pages = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.shop.example/{'win' if i % 8 == 0 else 'p'}/{i}") for i in range(400)]
    labels = [(i, i % 8 == 0) for i in range(300)]
    out = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), min_confidence=0.9).collect()
    assert {r["page_id"] for r in out if r["verdict"] == "block"} == {i for i in range(400) if i % 8 == 0}


def test_mined_rules_decide_a_query(spark, tables):
    """Bad pages share two words that are harmless apart; the query's verdicts follow from them alone."""
    rng = random.Random(5)
    words = ["news", "shop", "free", "spins", "about", "team"]
    made, bad = {}, {}
    for i in range(1200):
        path = rng.sample(words, 3)
        made[i] = f"https://h{i % 400}.example.info/{'/'.join(path)}/{i}"
        bad[i] = {"free", "spins"} <= set(path)
    made |= {2000: "https://new.example.info/spins/x/free", 2001: "https://new.example.info/spins/x", 2002: "https://a.net/spins/free", 2003: "https://example.net/en/spins/free", 2004: None, 2005: made[3], 2006: "x" * 100_000}
    d = tables(pages=("page_id long, url string, html string", [(i, u, "") for i, u in made.items()]), labels=("doc_id long, quality int, toxic int", [(i, 1, int(b)) for i, b in bad.items()] + [(2001, None, None)]))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.query(spark, d).collect()}
    assert len(got) == len(made)
    for i, b in bad.items():
        assert got[i] == (None, "block" if b else "allow"), made[i]
    assert [got[i] for i in range(2000, 2007)] == [(None, "block"), (None, "allow"), ("net/", "block"), ("example.net/en/", "allow"), (None, "allow"), got[3], (None, "allow")]


def test_long_and_repeated_urls_are_mined_in_little_time(spark):
    import time

    long = "https://x.example.info/" + "/".join(f"w{i}" for i in range(40))
    nested = [("https://y.example.info/" + "/".join(f"n{j}" for j in range(i))) for i in range(1, 41)]
    rows = [(i, long + f"/{i % 30}") for i in range(600)] + [(1000 + 40 * k + i, u + f"?{k}") for k in range(15) for i, u in enumerate(nested)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, True) for i, _ in rows], "page_id long, bad boolean")
    began = time.time()
    assert {r["verdict"] for r in urls.judge_urls(pages, labels).collect()} == {"block"}
    assert time.time() - began < 60


def test_rules_that_a_shorter_one_covers_are_dropped(spark):
    rows = [(1, ["a"], 0.8, 0.1), (2, ["a", "b"], 0.7, 0.1), (3, ["a", "c"], 0.9, 0.1), (4, ["b", "c"], 0.7, 0.1), (5, ["a", "b", "c"], 0.85, 0.1)]
    rules = spark.createDataFrame(rows, "rule_id long, items array<string>, confidence double, support double")
    assert sorted(r["rule_id"] for r in urls.without_covered(rules).collect()) == [1, 3, 4]


def test_bpe_like_the_library():
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    raw = open(path, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges = bpe.Merges(raw, P.PATTERN)
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x1F600, 0x1F640), 10, 32])) for _ in range(rng.randrange(1, 60))) for _ in range(1500)] + ["", "a" * 2000, " " * 500, "it's we'll\n\n  x", "abab" * 300]
    for text, ids in zip(texts, merges.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert merges.decode(ids) == text.encode()


def test_a_lower_rank_that_opens_late_goes_first():
    pieces = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b"bc", b"cd"]
    ranks = {b: i for i, b in enumerate(pieces)} | {b"bc": 300, b"abc": 280, b"ab": 400, b"cd": 290}
    merges = bpe.Merges(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()), r"\S+|\s+")
    for word in (b"abc", b"abcabcd", b"bcabcdab", b"aabbccdd"):
        want = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(word.decode())
        assert np.frombuffer(merges.replay([word])[0], "<u4").tolist() == merges.alone(word) == want


def test_bpe_query_like_the_library(spark, tables):
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [None, "", " ", "\n\n", "same text", "same text", "ab" * 30_000, "".join(rng.choice("abcde") for _ in range(40_000)), "日本語 " * 2000, "it's 12345 \u00a0 x"]
    rows = [(i % 40, t, "ids", [1]) for i, t in enumerate(texts)] + [(None, "no id", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, words array<int>").repartition(3)
    want = []
    for i, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, bpe.query(spark, tables(documents=(docs.schema, docs.collect()))).collect()), key=key) == sorted(want, key=key)
    assert bpe.query(spark, tables(documents=(docs.schema, []))).count() == 0
    vocab = bpe.multi_vocabulary(spark)
    assert bpe.decode(bpe.encode(docs, vocab), vocab).filter("n_tokens * 4 = length(ids)").count() == len(rows)


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark, tables):
    import corpus_pipeline as cp

    rng = random.Random(2)
    said = lambda: "\n".join(" ".join(rng.choice(["the", "and", "house", "river", "stone"]) + str(rng.randrange(3000)) for _ in range(40)) for _ in range(4))
    clean = [(i, said(), "en", f"s{i % 3}", 0) for i in range(60)]
    rows = clean + [(100, clean[0][1], "en", "s0", 0), (100, clean[0][1], "en", "s0", 0), (101, "12 34", "en", "s1", 0), (102, None, None, None, 0), (103, clean[1][1].replace("\n", " x1\n", 1), "en", "s1", 0)]
    docs = spark.read.parquet(tables(documents=("doc_id long, text string, lang string, source string, n_chars long", rows)) + "/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        seen[name] = [r["doc_id"] for r in docs.collect()]
    ids = {r[0] for r in clean}
    first, second, third, fourth, last = seen.values()
    assert set(first) == ids | {100, 103} and sorted(second) == sorted(first)
    assert ids <= set(third) and len(third) == len(set(third)) == 61  # the texts that were emptied are one group
    assert set(fourth) <= ids and sorted(fourth) == sorted(last)


def test_lists_of_words_take_little_memory_to_merge():
    """Many blocks hold the same words: what a task holds of them is a place for each, and merging is done by parts."""
    import tracemalloc
    from types import SimpleNamespace

    import public_tokenizers as P
    import pyarrow as pa

    spec = SimpleNamespace(value=(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN))
    merges = bpe._merges(spec)
    rng = random.Random(5)
    pool = ["".join(rng.choice("etaoinshr") for _ in range(12)).encode() for _ in range(60_000)]
    lists = [(block, bucket, sorted(rng.sample(pool[bucket::2], 12_000))) for bucket in range(2) for block in range(30)]

    def batches():
        for block, bucket, words in lists:
            data = bpe._pack(np.array([len(w) for w in words], "<u4"), b"".join(words))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], ["block", "bucket", "data"])

    tracemalloc.start()
    try:
        out = [(r["block"], r["bucket"], r["data"]) for batch in bpe._replayer(spec)(batches()) for r in batch.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [x[:2] for x in out] == [x[:2] for x in lists]
    for (_, _, data), (_, _, words) in list(zip(out, lists, strict=True))[::20]:
        counts, ids = bpe._unpack(data, "<u4", "<u4")
        own = [merges.alone(w) for w in words]
        assert counts.tolist() == [len(x) for x in own] and ids.tolist() == [i for x in own for i in x]
    assert peak < 75e6, peak
