import random
import re

from quire.llm import licenses

SCHEMA = "doc_id long, text string, w string, places string, own string, label string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def plain(text):
    words, found = WORD.findall((text or "").translate(LOWER)), []
    for t in licenses.templates():
        for s in range(-len(t["words"]), len(words)):
            here = [0 <= s + o < len(words) and words[s + o] == x for o, x in enumerate(t["words"])]
            share = sum(here) / len(here)
            if all(here[o] for o in t["must"]) and (t["base"] or share >= licenses.LEAST_SHARE):
                found.append((t["label"], t["base"], s, share))
    base = [x for x in found if x[1]]
    names = lambda f: ",".join(sorted({x[0] for x in f}))
    return len(words), len(base), min((x[2] for x in base), default=None), max((x[2] for x in base), default=None), names(base), names(found), max((x[3] for x in found), default=0.0)


def test_every_place_like_a_plain_scan(spark):
    rng = random.Random(4)
    pieces = [t["words"] for t in licenses.templates()]
    texts = [None, "", " \n", "CC-BY cc by cc by", "by cc cc by", "all rights Reserved. All rights reserved all rights", "general public license, general, public", "the MIT license", "Released under the MIT License.", "É cc by é", "cc bÿ", "cc by " * 9000, "cc 1by"]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(6)):
            piece = list(rng.choice(pieces))
            if rng.random() < 0.5:
                del piece[rng.randrange(len(piece)) :]
            if rng.random() < 0.3 and piece:
                piece[rng.randrange(len(piece))] = "other"
            words += piece + [rng.choice(["cc", "by", "license", "plain", "the", "all", "mit"]) for _ in range(rng.randrange(3))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    rows = [(i % 140, t, "w", "p", "o", "l") for i, t in enumerate(texts)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], *plain(r[1])) for r in rows], key=str)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rarest_words_come_first(spark):
    words = spark.createDataFrame([(["a", "b"],), (["a", "c", "c"],), (["a"],)], "w array<string>")
    assert licenses.by_rarity(words, ["a", "b", "c", "d"]) == ["d", "b", "c", "a"]


def test_clean_text_has_no_label(spark):
    docs = spark.createDataFrame([(1, "public domain of rights and a license, by all; free of charge"), (2, "apache helicopter licensed")], "doc_id long, text string")
    assert {(r["n_base"], r["labels"], r["score"]) for r in licenses.scan(docs).collect()} == {(0, "", 0.0)}
