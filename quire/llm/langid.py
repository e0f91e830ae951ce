"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1; each bit is a binary classifier over hashed letter n-grams (1 to 3, within
words): the log odds of naive Bayes between the languages on either side, all languages weighing alike. A text's
margins decode to the language whose codeword has the least logistic loss, bits weighing by how well they part the
training texts' n-grams. The decision is ambiguous when the second best is close.

Learning takes about ``SAMPLE`` documents of each language, chosen by a hash of the id; only n-gram counts leave the
executors (languages x ``2 ** BUCKET_BITS``). Prediction reads every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when there is nothing to
learn from; repeated rows repeat their results; an empty table gives no rows; columns beyond doc_id, text and lang are
ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bounded_batches, table

SAMPLE, BUCKET_BITS, GRAMS = 2000, 13, (1, 2, 3)
#: n-grams of a text that count as independent evidence, and the score under which a decision is ambiguous.
EVIDENCE, CLEAR = 40.0, 0.75
UNKNOWN = "und"
_TABLE: list = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters():
    """For every code point its lower-case letter, or 0."""
    import sys

    import numpy as np

    if not _TABLE:
        table_ = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table_[i] = ord(low) if len(low) == 1 else i
        _TABLE.append(table_)
    return _TABLE[0]


def grams(texts: list[str]):
    """Hashed n-grams of all texts in a row, the first place of each text's, and whether the text has a letter."""
    import numpy as np

    # each text between blanks of its own, so that its n-grams do not depend on its neighbours
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), np.array([len(t) + 2 for t in texts], np.int64))
    x = _letters()[raw]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0) | (owner[1:] != owner[:-1])
    x, owner = x[keep].astype(np.uint64), owner[keep]
    out, who = [], []
    for n in GRAMS:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, np.uint64)
        inner = np.zeros(len(h), bool)
        for k in range(n):
            part = x[k : len(x) - n + 1 + k]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            inner |= (part == 0) & (0 < k < n - 1)
        whole = ~inner & (owner[n - 1 :] == owner[: len(h)])
        whole &= (x[: len(h)] != 0) | (x[n - 1 :] != 0) if n > 1 else x != 0
        out.append((h[whole] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        who.append(owner[: len(h)][whole])
    g, w = (np.concatenate(out), np.concatenate(who)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    order = np.argsort(w, kind="stable")
    letters = np.zeros(len(texts), bool)
    letters[owner[x != 0]] = True
    return g[order], np.searchsorted(w[order], np.arange(len(texts) + 1)), letters


def codewords(n: int):
    """n codewords: all partitions while they are few, else seeded random ones kept far apart."""
    import numpy as np

    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(bits, float).T
    rng, length = np.random.default_rng(7), 4 * int(np.ceil(np.log2(n))) + 15
    best, gap = None, -1
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), (n, length))
        code = code[:, (code.min(0) < 0) & (code.max(0) > 0)]
        near = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if near > gap:
            best, gap = code, near
    return best


def _chunks(batches, limit=150_000):
    """(rows of the batch, their texts), about ``limit`` characters at a time."""
    for batch in batches:
        raw = batch["raw"].to_pylist()
        first, total, texts = 0, 0, []
        for i, r in enumerate(raw):
            texts.append((r or b"").decode("utf-8", "replace"))
            total += len(texts[-1])
            if total >= limit:
                yield batch.slice(first, i + 1 - first), texts
                first, total, texts = i + 1, 0, []
        if texts:
            yield batch.slice(first), texts


def learn(docs: DataFrame) -> dict | None:
    """A model from doc_id, text and lang; None without anything to learn from."""
    import numpy as np

    bounded_batches(docs.sparkSession)
    size = 1 << BUCKET_BITS
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not known:
        return None
    share = F.lit(0.0)
    for lang, n in known.items():
        share = F.when(F.col("lang") == lang, min(1.0, SAMPLE / n)).otherwise(share)
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for rows, texts in _chunks(batches):
            g, starts, _ = grams(texts)
            for lang, a, b in zip(rows["lang"].to_pylist(), starts[:-1], starts[1:], strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(size, np.int64)
                np.add.at(sums[lang], g[a:b], 1) if b - a < 200 else sums[lang].__iadd__(np.bincount(g[a:b], minlength=size))
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "gram", "n"])

    counts = picked.select("lang", F.col("text").cast("binary").alias("raw")).repartition(8).mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    if not langs:
        return None
    p = np.full((len(langs), size), 0.5)
    p[counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), counts["gram"].to_numpy()] += counts["n"].to_numpy()
    p /= p.sum(1, keepdims=True)
    code = codewords(len(langs))
    weights, trust = np.zeros((code.shape[1], size), np.float32), np.ones(code.shape[1])
    for b, bit in enumerate(code.T):
        if (bit > 0).all():
            continue
        plus, minus = p[bit > 0].mean(0), p[bit < 0].mean(0)
        odds = np.log(plus / minus)
        weights[b] = odds
        trust[b] = 0.5 * ((plus - minus) * odds).sum()
    return {"langs": langs, "code": code, "weights": weights, "trust": trust / trust.sum()}


def _predicted(rows: DataFrame, names: list[str], model: dict | None) -> DataFrame:
    """rows (the columns ``names``, and raw: the text's bytes) with lang_pred, score and ambiguous. ``names`` hold none of these."""
    if model is None:
        return rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(True)}).select(*names, "lang_pred", "score", "ambiguous")
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    schema = T.StructType([*(rows.schema[c] for c in names), *added])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        code, trust = m["code"], m["trust"]
        for rows, texts in _chunks(batches):
            g, starts, letters = grams(texts)
            n = np.diff(starts)
            margins = np.zeros((len(texts), len(trust)))
            full = np.flatnonzero(n)
            if len(full):
                for b in range(len(trust)):
                    margins[full, b] = np.add.reduceat(m["weights"][b][g], starts[:-1][full])
            margins *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
            loss = np.logaddexp(0, -margins[:, None, :] * code[None]) @ trust * len(trust)
            loss -= loss.min(1, keepdims=True)
            share = np.exp(-loss)
            share /= share.sum(1, keepdims=True)
            best, score = loss.argmin(1), share.max(1)
            sure = letters & (n > 0)
            pred = [m["langs"][k] if ok else UNKNOWN for k, ok in zip(best, sure, strict=True)]
            score = np.where(sure, score, 0.0)
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in names), pa.array(pred, pa.string()), pa.array(score), pa.array(score < CLEAR)], [*names, *added.names])

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""
    return _predicted(docs.select("doc_id", F.col("text").cast("binary").alias("raw")), ["doc_id"], model)


def clear_language(docs: DataFrame, model: dict | None, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more; all their columns, whatever their names."""
    own = {f"c{i}": c for i, c in enumerate(docs.columns) if c != "text"}
    sent = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in own.items()], F.col("text").cast("binary").alias("raw"))
    judged = _predicted(sent, [*own, "raw"], model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    name = {c: n for n, c in own.items()}
    return judged.select(*[(F.col("raw").cast("string") if c == "text" else F.col(name[c])).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
