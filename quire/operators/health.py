"""Freshness against a snapshot of files, change detection, integrity, diffs and the health radar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("freshness", "link_integrity", "orphan_health", "embedding_coverage", "role_coverage", "drift_health")


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_path, status (changed, new, deleted, same) from (doc_path, file_hash) then and now."""
    met = old.select("doc_path", F.col("file_hash").alias("o")).join(new.select("doc_path", F.col("file_hash").alias("n")), "doc_path", "full_outer")
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed").otherwise("same")
    return met.select("doc_path", status.alias("status"))


def _with_files(sections: DataFrame, files: DataFrame) -> DataFrame:
    """Sections beside the bytes that their range now holds. files: doc_path, content, file_hash, and the hash at index time in sections."""
    met = sections.join(files.select("doc_path", F.col("content").alias("now"), F.col("file_hash").alias("now_hash")), "doc_path", "left")
    piece = F.decode(F.col("now").cast("binary").substr(F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int")), "UTF-8")
    return met.withColumn("range_hash", F.when(F.col("byte_end") > F.col("byte_start"), F.sha2(piece, 256)))


def freshness(sections: DataFrame, files: DataFrame) -> DataFrame:
    """id, level, freshness: stale_index where the file or the range's text is gone, edited_uncommitted where only the rest of the file differs."""
    met = _with_files(sections, files)
    bucket = (
        F.when(F.col("now").isNull(), "stale_index")
        .when((F.col("byte_end") > F.col("byte_start")) & ~F.col("range_hash").eqNullSafe(F.col("content_hash")), "stale_index")
        .when(F.col("file_hash") != F.col("now_hash"), "edited_uncommitted")
        .otherwise("fresh")
    )
    return met.select("id", "doc_path", "level", bucket.alias("freshness"))


def recent_changes(fresh: DataFrame) -> DataFrame:
    """Sections that are not fresh, roots left out."""
    return fresh.filter("freshness <> 'fresh' AND level <> 0").select("id", "doc_path", "freshness")


def freshness_counts(fresh: DataFrame) -> DataFrame:
    return fresh.agg(*[F.count_if(F.col("freshness") == b).alias(b) for b in ("fresh", "edited_uncommitted", "stale_index")])


def verify_index(sections: DataFrame, files: DataFrame) -> DataFrame:
    """One row: clean, drift and missing sections; empty ranges count nowhere."""
    met = _with_files(sections, files)
    range_ = F.col("byte_end") > F.col("byte_start")
    return met.agg(F.count_if(F.col("now").isNull()).alias("missing"), F.count_if(F.col("now").isNotNull() & range_ & F.col("range_hash").eqNullSafe(F.col("content_hash"))).alias("clean"), F.count_if(F.col("now").isNotNull() & range_ & ~F.col("range_hash").eqNullSafe(F.col("content_hash"))).alias("drift"))


def section_diff(sections: DataFrame, files: DataFrame, ids: list[str]) -> DataFrame:
    """id, changed, diff (unified) of the sections asked for."""

    @F.pandas_udf("string")
    def unified(a, b):
        import difflib

        return a.combine(b, lambda x, y: "".join(difflib.unified_diff((x or "").splitlines(True), (y or "").splitlines(True), "indexed", "current")))

    met = _with_files(sections.filter(F.col("id").isin(*ids)), files)
    piece = F.decode(F.col("now").cast("binary").substr(F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int")), "UTF-8")
    return met.select("id", (~F.col("range_hash").eqNullSafe(F.col("content_hash"))).alias("changed"), unified(F.col("content"), piece).alias("diff"))


def stale_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_path, source, state: pages (doc_path, content, file_hash map as source_hashes) whose front matter names sources that are missing, modified or untracked."""
    block = F.regexp_extract("content", r"(?s)\A---\n.*?\nsources:[ \t]*\n((?:[ \t]+-[ \t]+[^\n]+\n)+)", 1)
    named = pages.select("doc_path", "source_hashes", F.explode(F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")).alias("x")).select("doc_path", "source_hashes", F.trim(F.regexp_replace("x", r"^\s*-\s*", "")).alias("source"))
    met = named.join(sources.select(F.col("doc_path").alias("source"), F.col("file_hash").alias("now")), "source", "left").withColumn("then", F.col("source_hashes")[F.col("source")])
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "untracked").when(F.col("then") != F.col("now"), "modified").otherwise("current")
    return met.select("doc_path", "source", state.alias("state")).filter("state <> 'current'")


def radar(counts: DataFrame) -> DataFrame:
    """axis, score for one row of counts: fresh, edited, stale, broken_links, orphans, embedded, sections, unknown_roles, drift_alarm (null: never measured)."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    n, seen = F.col("sections"), F.col("fresh") + F.col("edited") + F.col("stale")
    share = lambda x: F.when(n <= 0, 100.0).otherwise(clamp(x))
    scores = (
        F.when(seen > 0, clamp(100.0 * F.col("fresh") / seen)),
        share(100.0 - 1000.0 * F.col("broken_links") / n),
        share(100.0 - 200.0 * F.col("orphans") / n),
        share(100.0 * F.col("embedded") / n),
        share(100.0 * (n - F.col("unknown_roles")) / n),
        F.when(F.col("drift_alarm").isNotNull(), F.when(F.col("drift_alarm"), 0.0).otherwise(100.0)),
    )
    each = F.array(*[F.struct(F.lit(a).alias("axis"), F.round(s, 1).alias("score")) for a, s in zip(AXES, scores, strict=True)])
    return counts.select(F.explode(each).alias("x")).select("x.axis", "x.score")


def doc_health(sections: DataFrame, files: DataFrame, links: DataFrame, termed: DataFrame | None = None, drift: DataFrame | None = None) -> DataFrame:
    """One row: how a repo stands. sections with role and embedding, files as for ``freshness``, its links, and the row of ``canary_drift`` if one was taken.

    section_count, doc_count, role_distribution (map), fresh, edited_uncommitted, stale_index, broken_links, orphans, embedded,
    n_sections, avg_title, avg_summary, avg_content, df_size, has_canary, max_drift, alarm."""
    from ..plans import index
    from . import links as graph

    counts = sections.agg(F.count("*").alias("section_count"), F.countDistinct("doc_path").alias("doc_count"), F.count("embedding").alias("embedded"))
    roles = sections.groupBy(F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.count("*").alias("n"))
    roles = roles.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "n")))).alias("role_distribution"))  # as many as there are roles
    broken = graph.broken_links(sections, links).agg(F.count("*").alias("broken_links"))
    orphans = graph.orphan_sections(sections, links).agg(F.count("*").alias("orphans"))
    termed = index.terms(sections) if termed is None else termed
    terms = index.term_df(termed).agg(F.count("*").alias("df_size"))
    if drift is None:
        drift = sections.sparkSession.sql("SELECT false AS has_canary, CAST(NULL AS double) AS max_drift, CAST(NULL AS boolean) AS alarm")
    out = counts
    for one in (roles, freshness_counts(freshness(sections, files)), broken, orphans, index.corpus_stats(termed), terms, drift.select("has_canary", "max_drift", "alarm")):
        out = out.crossJoin(one)  # one row each
    return out


def radar_counts(health: DataFrame) -> DataFrame:
    """The row that ``radar`` takes, from that of ``doc_health``."""
    unknown = F.coalesce(F.col("role_distribution")["unknown"], F.lit(0))
    return health.select("fresh", F.col("edited_uncommitted").alias("edited"), F.col("stale_index").alias("stale"), "broken_links", "orphans", "embedded", F.col("section_count").alias("sections"), unknown.alias("unknown_roles"), F.col("alarm").alias("drift_alarm"))


def grade(axes: DataFrame) -> DataFrame:
    """One row: the mean of the axes that have a score, and its letter."""
    letter = F.when(F.col("composite") >= 90, "A").when(F.col("composite") >= 80, "B").when(F.col("composite") >= 70, "C").when(F.col("composite") >= 60, "D").otherwise("F")
    return axes.agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("composite")).select("composite", letter.alias("grade"))


def diff_radar(before: DataFrame, after: DataFrame, threshold: float = 3.0) -> DataFrame:
    """axis, delta and what it means."""
    met = before.select("axis", F.col("score").alias("b")).join(after.select("axis", F.col("score").alias("a")), "axis", "full_outer")
    delta = F.round(F.col("a") - F.col("b"), 1)
    change = F.when(delta.isNull(), "missing").when(delta <= -threshold, "regression").when(delta >= threshold, "improvement").otherwise("steady")
    return met.select("axis", F.col("b").alias("before"), F.col("a").alias("after"), delta.alias("delta"), change.alias("change"))
