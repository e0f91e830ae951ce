"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Every pattern is run over the whole text. A start inside a run of the pattern's first characters is skipped unless it
follows a match (``\\G``): had the run's start failed, so would it; and quantifiers do not backtrack. This finds the
same leftmost matches in time linear in the text, with no deep recursion. Places come from the gaps between matches.

Kinds: email, ip, card and phone are always kept when their check holds; their score says how sure they are. Others are
added when their check holds and their score reaches ``MIN_SCORE``: iban (mod-97), which nearby words can drop; ssn (area, group
and serial rules), aba (bank routing numbers, weights 3, 7, 1) and nhs (patient numbers, mod-11), which nearby words have
to raise. Words are looked for up to ``AROUND`` characters away, but not beyond the matches of the kind on either side.

Defined cases: a null text is empty; repeated rows give repeated results; a text without spans has empty strings and
zero counts; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ABA = r"(?<![0-9.-])[0-9]{9}(?![0-9.-])"
NHS = r"(?<![0-9.-])[0-9]{3}[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}(?![0-9.-])"
BASE = ("email", "ip", "card", "phone")
#: Kind, pattern, a cheap test of the text, score before words, words that raise it, words that lower it.
KINDS = (
    ("email", EMAIL, "@", 0.9, "mail|contact|write", "example|noreply"),
    ("ip", IP, None, 0.6, "ip|address|host|server", "version|release|section"),
    ("card", CARD, None, 0.8, "card|visa|credit|pay", "order|isbn|serial"),
    ("phone", PHONE, "+", 0.6, "tel|phone|call|mobile|fax", "order|serial|ratio"),
    ("iban", IBAN, None, 0.7, "iban|bank|account|konto|compte|cuenta", "serial|part|order|model"),
    ("ssn", SSN, None, 0.4, "ssn|social|security", "order|serial|isbn"),
    ("aba", ABA, None, 0.4, "aba|routing|transit|rtn", "order|serial|isbn|invoice"),
    ("nhs", NHS, None, 0.4, "nhs|patient|hospital", "order|serial|isbn|phone|tel"),
)
MIN_SCORE, AROUND = 0.6, 48
_CHUNK = 256


def running_totals(values: Column) -> Column:
    """Inclusive running totals of an array, in chunks: linear but for the square of the chunk and of the chunks' number."""

    def short(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")), lambda a: a["all"])

    parts = F.transform(F.sequence(F.lit(0), F.greatest((F.size(values) - 1) / _CHUNK, F.lit(0)).cast("int")), lambda i: short(F.slice(values, i * _CHUNK + 1, _CHUNK)))
    ends = F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0).cast("long")))
    return F.flatten(F.zip_with(parts, short(ends), lambda p, end: F.transform(p, lambda x: x + end - F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0).cast("long")))))


def _with_found(df: DataFrame, may: Column, pattern: str) -> DataFrame:
    """Adds ``raw``: all leftmost matches with start, end (code points), and the text near each up to the matches beside it.

    Steps are columns of their own, so each is worked out once."""
    none = F.array().cast("array<string>")
    df = df.withColumns({"hits": F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)})
    df = df.withColumns({"gaps": F.when(F.size("hits") > 0, F.split("text", pattern, -1)).otherwise(none)})
    steps = F.zip_with("gaps", F.concat(F.array(F.lit("")), F.col("hits")), lambda g, h: (F.char_length(g) + F.char_length(h)).cast("long"))
    df = df.withColumns({"steps": F.when(F.size("hits") > 0, steps).otherwise(F.array().cast("array<long>"))})
    count = F.size("hits")
    near = F.zip_with(F.slice("gaps", 1, count), F.slice("gaps", 2, count), lambda a, b: F.concat(F.substring(a, -AROUND, AROUND), F.lit(" "), F.substring(b, 1, AROUND)))
    places = F.zip_with("hits", F.slice(running_totals(F.col("steps")), 1, count), lambda h, at: F.struct(at.alias("start"), (at + F.char_length(h)).alias("end"), h.alias("value")))
    spans = F.zip_with(places, near, lambda p, n: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["value"].alias("value"), n.alias("near")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string,near:string>>")
    return df.withColumns({"raw": F.when(count > 0, spans).otherwise(nothing)}).drop("hits", "gaps", "steps")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(bare.substr(F.lit(5), F.length(bare)), bare.substr(1, 4))
    number = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(number(c) > 9, F.lit(100)).otherwise(F.lit(10)) + number(c)) % 97).cast("int"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(value) == 1)
    if kind == "ssn":
        return ~F.regexp_like(value, F.lit("^(?:000|666|9)|-00-|-0000$"))
    if kind == "aba":
        digit = lambda i: F.substring(value, i, 1).cast("int")
        total = sum((digit(i) * (3, 7, 1)[(i - 1) % 3] for i in range(2, 10)), digit(1) * 3)
        return (total % 10 == 0) & (value != "0" * 9)
    if kind == "nhs":
        digits = _digits(value)
        digit = lambda i: F.substring(digits, i, 1).cast("int")
        rest = (F.lit(11) - sum((digit(i) * (11 - i) for i in range(2, 10)), digit(1) * 10) % 11) % 11
        return (rest == digit(10)) & (digits != "0" * 10)
    return F.lit(True)


def _score(near: Column, base: float, up: str, down: str) -> Column:
    word = lambda ws: F.regexp_like(F.lower(near), F.lit(rf"(?<![a-z])(?:{ws})"))
    return F.lit(base) + F.when(word(up), 0.3).otherwise(0.0) - F.when(word(down), 0.2).otherwise(0.0)


def _scored(raw: Column, kind: str, base: float, up: str, down: str) -> Column:
    """The raw matches that hold, with their kind and score."""
    good = F.filter(raw, lambda s: _valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(s["near"], base, up, down).alias("score")))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, and an array of (kind, start, end, score) for each kind."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("digits", F.regexp_like("text", F.lit("[0-9]")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    for kind, pattern, sign, base, up, down in KINDS:
        may = F.contains("text", F.lit(sign)) if sign else F.col("digits")
        out = _with_found(out, may, pattern)
        good = _scored(F.col("raw"), kind, base, up, down)
        if kind not in BASE:
            good = F.filter(good, lambda s: s["score"] >= MIN_SCORE)
        out = out.withColumn(kind, F.when(F.size("raw") == 0, none).otherwise(good)).drop("raw")
    return out.drop("digits")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scores(spans: Column) -> Column:
    """Of each span in hundredths."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_spans(table(spark, sf_dir, "documents"))
    strings = spans.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], *[_joined(F.col(k)).alias(k) for k, *_ in KINDS], *[_scores(F.col(k)).alias(f"{k}_scores") for k, *_ in KINDS])
    together = lambda kinds: F.array_join(F.filter(F.array(*kinds), lambda x: x != ""), ",")
    return strings.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(together(BASE), 256).alias("base_sha256"), together([k for k, *_ in KINDS]).alias("spans"), together([f"{k}_scores" for k, *_ in KINDS]).alias("scores")
    )
