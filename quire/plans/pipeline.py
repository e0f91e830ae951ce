"""Indexing a folder: scan, split, enrich, and store with all that is derived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import mining, similarity, telemetry
from ..operators.health import detect_changes
from ..operators.sections import structural_neighbors
from ..scratch import cut, discard
from ..sources import documents
from ..sources.store import PARTS, Store, bucket_of
from . import index

Embed = Callable[[DataFrame], DataFrame]  # (content_hash, embed_text) to (content_hash, embedding)


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2("raw", 256))


def with_roles(sections: DataFrame) -> DataFrame:
    return sections.join(index.roles(sections), "id")


def with_embeddings(sections: DataFrame, cache: DataFrame | None, embed: Embed | None) -> DataFrame:
    """Adds ``embedding``: from the cache by content hash, else by the provider; null without one. Each text is embedded once."""
    if embed is None and cache is None:
        return sections.withColumn("embedding", F.lit(None).cast("array<float>"))
    known = cache.select("content_hash", "embedding") if cache is not None else sections.sparkSession.createDataFrame([], "content_hash string, embedding array<float>")
    if embed is not None:
        needed = sections.select("content_hash", text.embed_text(F.col("title"), F.col("summary"), F.col("content")).alias("embed_text")).dropDuplicates(["content_hash"])
        known = known.unionByName(embed(needed.join(known, "content_hash", "left_anti")))
    return sections.join(known, "content_hash", "left")


def build(spark: SparkSession, files: DataFrame, cache: DataFrame | None = None, embed: Embed | None = None) -> DataFrame:
    """Sections of files (repo, doc_path, raw) with file_hash, roles and embeddings."""
    files = hashed(files)
    rows = cut(documents.sections(files), "sections")
    rows = with_embeddings(with_roles(rows), cache, embed)
    return rows.join(files.select("repo", "doc_path", "file_hash"), ["repo", "doc_path"])


def adjacency(rows: DataFrame, top_n: int = 5, min_score: float = 0.6) -> DataFrame:
    """source, id, kind, score: each section's neighbours in the tree, and, for sections with embeddings, the nearest to it."""
    near = structural_neighbors(rows).withColumn("score", F.lit(None).cast("double"))
    if "embedding" not in rows.columns or not rows.filter("embedding IS NOT NULL").limit(1).count():
        return near
    close = similarity.semantic_neighbors(rows, rows, top_n, min_score)
    return near.unionByName(close.select(F.col("id").alias("source"), F.col("other").alias("id"), F.lit("semantic").alias("kind"), "score"))


def _tags(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.explode(F.transform("tags", lambda t: F.lower(t))).alias("tag"))


def _save_stats(store: Store, repo: str, stats: dict, tags: DataFrame, most: int = 0) -> None:
    now = tags.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    store.save_side("corpus_stats", repo, store.spark.createDataFrame([stats | {"most_tags": max(most, now)}]))


#: Terms of all texts, with repeats, from which on postings are moved in parts.
MANY_TERMS = 2_000_000


def save_search(store: Store, repo: str, rows: DataFrame) -> None:
    """Writes what a search reads: postings in blocks, their numbers, statistics and tags. Texts are taken apart once, and numbers
    are counted from the postings that were written.

    rows: a section each; with a column ``key``, postings and tags name sections by it. It is unique and sorts as ids do, and is shorter."""
    rows = rows.withColumn("id", F.col("key")) if "key" in rows.columns else rows
    termed = cut(index.terms(rows), "terms")
    stats = index.search_stats(termed)
    many = sum(stats[f"sum_{f}"] for f in index.FIELDS[:3]) >= MANY_TERMS
    posted = index.blocked_postings(termed, index.averages(stats))
    posted = cut(posted.withColumn("part", bucket_of("term", PARTS)), "postings", by="part") if many else cut(posted, "postings")
    discard(termed)
    store.save_side("postings", repo, posted)
    discard(posted)
    posted = store.load("postings", repo)
    # of a repo without a term there are no postings
    posted = index.blocked_postings(index.terms(rows).limit(0), index.averages(stats)) if posted is None else posted
    for name, table in (("tags", _tags(rows)), ("term_counts", index.term_counts(posted)), ("level_counts", index.level_counts(posted))):
        store.save_side(name, repo, table)
    _save_stats(store, repo, stats, _tags(rows))


#: Mean lengths may drift so far from those that blocks were cut by; then blocks are cut anew.
MOST_DRIFT = 1.25


def amend_search(store: Store, repo: str, docs: DataFrame, before: DataFrame, after: DataFrame) -> None:
    """Brings what a search reads up to date, from the sections of changed documents (doc_path) before and after.

    Postings and tags get the new rows; those of before are dead from then on. Numbers get the differences. So what is written
    follows the change. When too many differences have gathered, a table is written whole again."""
    old = store.load("corpus_stats", repo).first()
    gone, new = cut(index.terms(before), "gone"), cut(index.terms(after), "new")
    stats = index.search_stats(new, old, gone)
    ratios = [stats[f"avg_{f}"] / old[f"base_{f}"] if old[f"base_{f}"] else 0.0 for f in index.FIELDS[:3]]
    if not all(1 / MOST_DRIFT <= r <= MOST_DRIFT for r in ratios):
        save_search(store, repo, store.load("sections", repo))
        return
    base = index.averages({f"avg_{f}": old[f"base_{f}"] for f in index.FIELDS[:3]})
    added = cut(index.blocked_postings(new, base), "added")
    signed = added.withColumn("sign", F.lit(1)).unionByName(index.blocked_postings(gone, base).withColumn("sign", F.lit(-1)))
    signed = cut(signed.select("term", "level", "own", "sign"), "signed")
    store.amend("postings", repo, added, docs)
    store.amend("tags", repo, _tags(after), docs)
    store.amend("term_counts", repo, index.term_counts(signed, F.col("sign")))
    store.amend("level_counts", repo, index.level_counts(signed, F.col("sign")))
    _save_stats(store, repo, stats, _tags(after), old["most_tags"])
    for x in (gone, new, added, signed):
        discard(x)


def derive(store: Store, repo: str, changes: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> None:
    """Writes all tables that come from a repo's sections. ``changes``: documents (doc_path) and their sections before and after, where the
    tables stood for the sections of before; then postings, their numbers, tags and links are amended, and only tables that hold
    sections against each other are made anew."""
    rows = store.load("sections", repo)
    if changes is None:
        save_search(store, repo, rows)
        store.save_side("links", repo, index.links(rows).drop("repo"))
    else:
        amend_search(store, repo, *changes)
        store.amend("links", repo, index.links(changes[2]).drop("repo"), changes[0])
    for name, table in (("glossary", mining.glossary(rows)), ("boilerplate", mining.boilerplate(rows)), ("duplicates", similarity.near_duplicate_clusters(rows)), ("related", adjacency(rows))):
        store.save_side(name, repo, table)
    store.mark_derived(repo)


def replace_documents(store: Store, repo: str, built: DataFrame, gone: DataFrame) -> None:
    """Replaces documents in the sections (``built``: new rows, a table that is written; ``gone``: doc_path) and in all that is derived from them.

    If the derived tables do not stand for the sections there are, because an earlier run failed between the two, they are all made anew."""
    docs = cut(gone.select("doc_path").unionByName(built.select("doc_path")).distinct(), "docs")
    old = store.load("sections", repo)
    current = old is not None and store.is_derived(repo)
    before = cut(old.join(docs, "doc_path", "left_semi"), "before") if current else None
    store.save_incremental(repo, built, gone)
    derive(store, repo, (docs, before, built) if current else None)


def index_folder(spark: SparkSession, folder: str, repo: str, store: Store, incremental: bool = True, scope: tuple[str, ...] = (), embed: Embed | None = None, **scan) -> dict[str, int]:
    """Indexes a folder. Incrementally, only new and changed documents are split, and documents that are gone are removed;
    with a ``scope`` of paths, documents outside it are left as they are."""
    files = hashed(documents.scan(spark, folder, repo, only=scope, **scan))
    old = store.load("sections", repo)
    if not scope:
        store.save_side("roots", repo, spark.createDataFrame([(folder.rstrip("/"),)], "folder string"))
    if old is None or not incremental or not old.limit(1).count():
        store.save(build(spark, files, embed=embed))
        changes = {"new": files.count()}
    else:
        then = old.select("doc_path", "file_hash").distinct()
        if scope:
            near = F.lit(False)
            for p in scope:
                near = near | (F.col("doc_path") == p.rstrip("/")) | F.startswith("doc_path", F.lit(p.rstrip("/") + "/"))
            then = then.filter(near)
        status = cut(detect_changes(then, files.select("doc_path", "file_hash")), "changes")
        changes = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        if set(changes) <= {"same"}:
            return changes
        cache = old.filter("embedding IS NOT NULL").select("content_hash", "embedding").dropDuplicates(["content_hash"])
        fresh = files.drop("file_hash").join(status.filter("status IN ('new', 'changed')").select("doc_path"), "doc_path", "left_semi")
        replace_documents(store, repo, cut(build(spark, fresh, cut(cache, "cache"), embed), "built"), status.filter("status = 'deleted'").select("doc_path"))
        return changes
    derive(store, repo)
    return changes


def index_file(spark: SparkSession, path: str, store: Store, embed: Embed | None = None) -> dict[str, int]:
    """Indexes one file anew, in the repo whose folder it lies in; of several the innermost. LookupError if there is none."""
    roots = store.load("roots")
    owner = None
    if roots is not None:
        owner = roots.filter(F.startswith(F.lit(path), F.concat("folder", F.lit("/")))).orderBy(F.desc(F.length("folder")), "repo").first()
    if owner is None:
        raise LookupError(f"no repo holds {path}")
    return index_folder(spark, owner["folder"], owner["repo"], store, scope=(path[len(owner["folder"]) + 1 :],), embed=embed)


def tune(store: Store, events: DataFrame) -> DataFrame:
    """``telemetry.tune_weights`` from where the store's weights stand; the new ones are kept. events: repo, confidence, semantic_used."""
    now = store.weights()
    spark = events.sparkSession
    known = spark.createDataFrame(list(now.items()), "repo string, weight double")
    tuned = cut(telemetry.tune_weights(events.join(known, "repo", "left")), "tuned")
    store.keep_weights({r["repo"]: r["weight"] for r in tuned.filter("status LIKE 'semantic_%'").collect()})  # as many as there are repos
    return tuned
