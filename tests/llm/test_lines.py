import random
import re

from quire.llm import lines


def brute(docs):
    gone, earlier = set(), []
    for i, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n")):
            s = {w for w in re.split(r"[\x20\x09-\x0D]+", line) if w}
            if s:
                if any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                    gone.add((i, k))
                earlier.append(s)
    return gone


def test_like_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 10
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 30))] for _ in range(25)]

    def line():
        own = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        return rng.choice([" ", "  ", "\t"]).join(own)

    docs = [(i, "\n".join(line() for _ in range(rng.randrange(0, 6)))) for i in range(150)] + [(900, None), (901, "\n \n"), (902, "one"), (903, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["line"]) for r in lines.removed_lines(df).collect()}
    assert got == brute(docs)
    assert (903, 0) in got and (902, 0) not in got


def test_text_without_later_matches(spark):
    df = spark.createDataFrame([(2, "a b c\nx y\n\nlast", "k", 14), (1, "a b c\nq", "j", 7), (3, None, "z", 0)], "doc_id long, text string, gone string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.dedup_lines(df).collect()}
    assert out == {1: ("a b c\nq", 7), 2: ("x y\n\nlast", 9), 3: (None, 0)}


def test_a_group_of_near_copies_is_settled(spark):
    rng = random.Random(1)
    base = [f"t{i}" for i in range(40)]
    docs = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(40)] = f"u{i}"
        docs.append((i, " ".join(own)))
    got = {(r["doc_id"], r["line"]) for r in lines.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(1, 400)}


def test_sets_move_when_what_found_the_pairs_is_gone(spark, monkeypatch):
    """Verifying reads pairs that are written, not the prefix rows; tables that no later step reads are deleted before sets are moved."""
    done, cut, discard = [], lines.cut, lines.discard
    named = {}

    def spy(df, label="t", compression=None):
        out = cut(df, label, compression)
        done.append((label, "rank" in df._jdf.queryExecution().optimizedPlan().toString()))
        named[tuple(out.inputFiles()[:1])] = label
        return out

    monkeypatch.setattr(lines, "cut", spy)
    monkeypatch.setattr(lines, "discard", lambda df: (done.append(("-" + named[tuple(df.inputFiles()[:1])], False)), discard(df)))
    rng = random.Random(4)
    base = [[f"t{i}x{j}" for j in range(30)] for i in range(20)]
    docs = []
    for i in range(120):
        own = list(base[i % 20])
        own[rng.randrange(30)] = f"u{i}"
        docs.append((i, " ".join(own)))
    got = {(r["doc_id"], r["line"]) for r in lines.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    steps = [x for x, _ in done]
    assert not any(ranked for x, ranked in done if x == "similar")
    assert steps.index("-several") < steps.index("firsts") < steps.index("-firsts") < steps.index("ranked")
    assert steps.count("-pairs") == steps.count("similar") == 2


def test_without_is_an_anti_join(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 AS k").repartition(3)
    gone = spark.range(0, 5000, 3)
    assert sorted(map(tuple, lines._without(rows, gone).collect())) == [(i, i % 7) for i in range(5000) if i % 3]
    assert lines._without(rows, gone.filter("id < 0")).count() == 5000
