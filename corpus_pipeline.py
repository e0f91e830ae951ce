"""From raw documents to token counts: language ID, line dedup, near-duplicate removal, mixing, tokens.

Each stage reads all that the one before kept. All but the last return the columns of documents: stage 1 drops
documents whose language it rejects, stage 2 removes repeated lines from texts, stage 3 keeps one document of each
group of near duplicates, stage 4 repeats or leaves out documents so that sources reach their targets, and stage 5
encodes the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import bpe, langid, lines, mixing, ngrams
from quire.llm.scratch import discard, settled, table

#: Below this score a language decision is a rejection.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language is not clear at all.

    Null and empty texts go; repeated rows share their fate; with no labelled text, or an empty table, all rows stay; other columns are kept."""
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    if model is None:  # nothing to learn from: no document can be rejected for its language
        return docs
    return langid.clear_language(docs, model, LEAST_SCORE)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line; documents stay, whatever is left of them.

    A null text stays null; rows that repeat doc_id and text are judged alike; an empty table stays empty; other columns are kept."""
    return lines.dedup_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest doc_id, then with the smallest hash of its row.

    Texts without words (null, empty, white space) are one group; a null doc_id is the smallest; of rows alike in all columns one
    stays; an empty table stays empty; other columns are kept, whatever their names."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("row"))  # never null, and equal for rows that are alike only
    keyed = docs.select(key.alias("key"), "text", F.struct(*columns).alias("row"))
    joined = ngrams.ngram_join(keyed.select(F.col("key").alias("doc_id"), "text"))
    kept = keyed.select("key", "row").join(joined.filter("kept").select(F.col("doc_id").alias("key")).distinct(), "key", "left_semi")
    number = F.row_number().over(W.partitionBy("key").orderBy(F.lit(1)))
    return kept.withColumn("number", number).filter("number = 1").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it. Which ones follows from their own columns and their source's rules.

    Documents without words are never taken; a null source is one source; repeated rows are taken together; an empty table stays
    empty; other columns are kept, whatever their names."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of its ids and of what they decode to, a row for each copy. Null and empty texts have no ids."""
    return bpe.digests(docs, bpe.multi_vocabulary(spark))


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: A learned classifier and a MinHash forest are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        before, docs = docs, settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if at:
            discard(before)
    return docs
