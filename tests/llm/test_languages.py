"""Language ID against a plain version, and columns that clash with its own."""

import math

from pyspark.sql import functions as F

from quire.llm import langid


def grams(text):
    """Letter n-grams of 1 to 3 within words, as tuples; an edge of a word counts as a letter at either end."""
    letters = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else "" for c in text]
    flat = [""]
    for c in [*letters, ""]:
        if c or flat[-1]:
            flat.append(c)
    out = []
    for n in (1, 2, 3):
        for i in range(len(flat) - n + 1):
            g = flat[i : i + n]
            if (g[0] or g[-1]) and all(g[1:-1]) and (n > 1 or g[0]):
                out.append(tuple(g))
    return out


def bucket(gram):
    h, full = len(gram), (1 << 64) - 1
    for c in gram:
        h = (h ^ (ord(c) if c else 0)) * 0x9E3779B97F4A7C15 & full
        h ^= h >> 31
    return h >> (64 - langid.BUCKET_BITS)


def judge(text, counts):
    """Prediction and score, bit by bit and language by language."""
    size, langs = 1 << langid.BUCKET_BITS, sorted(counts)
    p = {}
    for lang in langs:
        total = sum(counts[lang].values()) + 0.5 * size
        p[lang] = lambda g, c=counts[lang], t=total: (c.get(g, 0) + 0.5) / t
    code = langid.codewords(len(langs))
    found = [bucket(g) for g in grams(text)]
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    trust, margins = [], []
    for bit in code.T:
        plus, minus = [x for x, b in zip(langs, bit) if b > 0], [x for x, b in zip(langs, bit) if b < 0]
        mean = lambda group, g: sum(p[x](g) for x in group) / len(group)
        trust.append(0.5 * sum((mean(plus, g) - mean(minus, g)) * math.log(mean(plus, g) / mean(minus, g)) for g in range(size)))
        margin = sum(math.log(mean(plus, g) / mean(minus, g)) for g in found)
        margins.append(margin * min(len(found), langid.EVIDENCE) / max(len(found), 1))
    trust = [t / sum(trust) for t in trust]
    loss = [sum(w * math.log1p(math.exp(-m * c)) for w, m, c in zip(trust, margins, word)) * len(trust) for word in code]
    share = [math.exp(min(loss) - x) for x in loss]
    return langs[loss.index(min(loss))], max(share) / sum(share)


def test_like_a_plain_version(spark):
    train = [(1, "the cat and the dog are in the house", "en"), (2, "a bird sings in the tree", "en"), (3, "le chat et le chien sont dans la maison", "fr"), (4, "un oiseau chante dans l'arbre", "fr"), (5, "die Katze und der Hund sind im Haus", "de"), (6, "ein Vogel singt im Baum, groß", "de")]
    new = [(10, "the bird in the house"), (11, "l'oiseau dans la maison"), (12, "der Hund im Baum"), (13, "xyz"), (14, "ÉTÉ é 12"), (15, "a"), (16, "42"), (17, None), (18, ""), (10, "the bird in the house")]
    counts = {}
    for _, text, lang in train:
        own = counts.setdefault(lang, {})
        for g in grams(text):
            own[bucket(g)] = own.get(bucket(g), 0) + 1
    model = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    assert len(got) == len(new)
    want = {i: judge(t or "", counts) for i, t in new}
    for r in got:
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, (r, want[r["doc_id"]])


def test_columns_that_clash_stay_as_they_are(spark):
    rows = [(1, "the cat sat", "en", b"x", 7.0, "mine", True, "c"), (2, "le chat dort", "fr", None, None, None, None, None), (3, "12", "en", b"", 1.0, "", False, ""), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, raw binary, score double, lang_pred string, ambiguous boolean, c1 string")
    model = langid.learn(docs)
    out = langid.clear_language(docs, model, 0.0)
    assert out.schema.names == docs.schema.names and sorted(map(tuple, out.collect())) == sorted((a, t, lang, r and bytearray(r), *rest) for a, t, lang, r, *rest in rows[:2])
    assert langid.clear_language(docs.limit(0), model, 0.5).count() == 0
    assert langid.learn(docs.filter(F.lit(False))) is None
    long = spark.createDataFrame([(1, "the cat sat " * 100_000)], "doc_id long, text string")
    assert langid.predict(long, model).first()["lang_pred"] == "en"
