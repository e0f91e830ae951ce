"""License scans: a positional index of licence templates, looked up by each file's rarest licence words.

A template is a label, a notice's words, and key phrases in it that must stand; the base phrases are templates that are key
phrases throughout. How rare a licence word is, is counted over all documents. A file's licence words are put in that
order, rarest first; templates whose mandatory words are not all there are out. Of each other template the file's
rarest two mandatory words are looked up in the postings: a word at place p of the file and at offset o of the template
says that the template starts at p - o, and the starts that both words agree on are left. There the key phrases are
verified word by word, and the share of the template's words in their places is the score. As the two words are
mandatory, no place where all key phrases stand is missed.

All of this happens within a row; only the counts of the templates' own words, whose number is fixed, are shuffled.

Defined cases: a null text counts as empty and has no words; a place counts once however its words repeat; labels are
distinct and sorted, and empty strings where there are none; repeated rows are judged alike; an empty table gives no
rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

# fixed values: the base phrases and their labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# fixed values: openings of public licence notices, their labels, and the phrases that must stand
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache license version 2 0",)),
    ("released under the mit license", "mit", ("the mit license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", ("hereby granted free of charge", "obtaining a copy of this software")),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ("source and binary forms", "with or without modification")),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ("permission to use copy modify", "with or without fee")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", ("redistribute it and or modify it", "gnu general public license")),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", ("gnu general public license version 3",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ("mozilla public license",)),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ("cc by nc 4 0",)),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", ("creative commons attribution 4 0",)),
    ("to the extent possible under law the author has dedicated all copyright and related and neighboring rights to the public domain", "cc0-1.0", ("dedicated all copyright", "public domain")),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words looked up for a template, and the least share of its words in their places.
RAREST, LEAST_SHARE = 2, 0.5


def templates(base=BASE, notices=NOTICES) -> list[dict]:
    """label, base, words, and must: the offsets of the words of key phrases."""
    found = [{"label": label, "base": True, "words": phrase.split(), "must": list(range(len(phrase.split())))} for phrase, label in base]
    for text, label, keys in notices:
        words, must = text.split(), set()
        for key in (k.split() for k in keys):
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            must |= set(range(at, at + len(key)))
        found.append({"label": label, "base": False, "words": words, "must": sorted(must)})
    return found


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def by_rarity(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, words of the fewest rows first. words: w. The result is as long as the vocabulary, which is fixed."""
    has = words.select(F.explode(F.array_intersect(F.lit(vocabulary), "w")).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in has.collect()}
    return sorted(vocabulary, key=lambda x: (counts.get(x, 0), x))


def index_of(given: list[dict]) -> Column:
    """The templates as a constant: label, base, words, must, mandatory (distinct words), postings (word to offsets)."""
    rows = []
    for t in given:
        mandatory = list(dict.fromkeys(t["words"][o] for o in t["must"]))
        postings = F.create_map(*[x for word in mandatory for x in (F.lit(word), F.lit([o for o in t["must"] if t["words"][o] == word]))])
        rows.append(F.struct(F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), F.lit(t["words"]).alias("words"), F.lit(t["must"]).alias("must"), F.lit(mandatory).alias("mandatory"), postings.alias("postings")))
    return F.array(*rows)


def _starts(hits: Column, t: Column, word: Column) -> Column:
    """Where the template would start for each place of one of its words."""
    return F.flatten(F.transform(F.filter(hits, lambda h: h["word"] == word), lambda h: F.transform(t["postings"][word], lambda o: h["at"] - o)))


def _in_place(w: Column, t: Column, start: Column, offsets: Column) -> Column:
    return F.filter(offsets, lambda o: F.get(w, start + o).eqNullSafe(F.get(t["words"], o)))


def license_places(docs: DataFrame, base=BASE, notices=NOTICES, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_words, places (label, base, start, share) for every row."""
    given = templates(base, notices)
    vocabulary = sorted({t["words"][o] for t in given for o in t["must"]})
    words = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    order = by_rarity(words.select("w"), vocabulary)
    found = words.withColumn("own", F.array_intersect(F.lit(order), "w"))
    met = F.filter(index_of(given), lambda t: F.size(F.array_except(t["mandatory"], F.col("own"))) == 0)
    met = F.transform(met, lambda t: t.withField("rare", F.slice(F.array_intersect(F.col("own"), t["mandatory"]), 1, RAREST)))
    found = found.withColumn("met", met)
    found = found.withColumn("looked_up", F.array_distinct(F.flatten(F.transform("met", lambda t: t["rare"]))))
    placed = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda h: F.array_contains(F.col("looked_up"), h["word"]))
    none = F.expr("cast(array() as array<struct<word: string, at: int>>)")
    found = found.withColumn("hits", F.when(F.size("met") > 0, placed).otherwise(none))
    w, hits = F.col("w"), F.col("hits")

    def places(t):
        first = _starts(hits, t, t["rare"][0])
        starts = F.when(F.size(t["rare"]) > 1, F.array_intersect(first, _starts(hits, t, F.get(t["rare"], F.lit(1))))).otherwise(F.array_distinct(first))
        verified = F.filter(starts, lambda s: F.size(_in_place(w, t, s, t["must"])) == F.size(t["must"]))
        share = lambda s: F.size(_in_place(w, t, s, F.sequence(F.lit(0), F.size(t["words"]) - 1))) / F.size(t["words"])
        return F.transform(verified, lambda s: F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), share(s).alias("share")))

    all_places = F.filter(F.flatten(F.transform("met", places)), lambda p: p["base"] | (p["share"] >= least_share))
    return found.select("doc_id", F.size("w").cast("long").alias("n_words"), all_places.alias("places"))


def scan(docs: DataFrame, **given) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    found = license_places(docs, **given).withColumn("b", F.filter("places", lambda p: p["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    start = F.transform("b", lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), labels("b").alias("base_labels"), labels("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = [f"({i}, '{t['label']}', {str(t['base']).lower()}, {o}, '{word}', {str(o in t['must']).lower()})" for i, t in enumerate(templates()) for o, word in enumerate(t["words"])]
    return rf"""
WITH t(id, label, base, o, word, must) AS (VALUES {", ".join(rows)}), sizes AS (SELECT id, label, base, count(*) AS n, count(*) FILTER (must) AS n_must FROM t GROUP BY ALL), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d
), places AS (
  SELECT r, id, p - o AS start, count(*) FILTER (must) AS k, count(*) AS share FROM words JOIN t USING (word) GROUP BY ALL
), found AS (
  SELECT r, label, base, start, share / n AS share FROM places JOIN sizes USING (id) WHERE k = n_must AND (base OR share / n >= {LEAST_SHARE})
), each AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN each USING (r)
"""


ORACLE = _oracle()
