"""What surrounds a section: its description, its context within a budget, and related sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text
from ..scratch import cut
from . import links, sections, similarity
from .components import components


def describe(rows: DataFrame, section_id: str) -> DataFrame:
    """One row: the section, its path from the root, and its neighbours."""
    way = sections.section_path(rows, section_id)
    crumbs = way.agg(F.array_join(F.reverse(F.sort_array(F.collect_list(F.struct("depth", "title")))["title"]), " > ").alias("path"))
    own = rows.filter(F.col("id") == section_id)
    document = own.select("doc_path").first()
    near = sections.neighbors(rows.filter(F.col("doc_path") == (document[0] if document else ""))).filter(F.col("id") == section_id).drop("parent_id")
    return own.select("id", "title", "level", "doc_path", "parent_id", "summary", sections.byte_length().alias("byte_length")).join(near, "id").crossJoin(crumbs)  # one row each


def context(rows: DataFrame, section_id: str, max_tokens: int = 2000, include_children: bool = True, include_related: bool = False) -> DataFrame:
    """ord, kind, id, content: the section, its ancestors, its children and siblings, as far as the tokens go (four bytes each)."""
    own = rows.filter(F.col("id") == section_id)
    place = own.select("doc_path", "parent_id").first()
    if place is None:
        return own.select(F.lit(None).cast("int").alias("ord"), F.lit("section").alias("kind"), "id", "content")
    told = lambda at, kind, k: [F.col(at).cast("long").alias("at") if isinstance(at, str) else F.lit(at).cast("long").alias("at"), "id", F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.col("title" if kind == "ancestor" else "content").alias("body")]
    # ancestors mostly lie in the section's own document; the whole table is labelled only where one of that document's parents does not
    kin = rows.filter(F.col("doc_path") == place["doc_path"])
    there = kin.select(F.col("id").alias("there"))
    strangers = kin.filter("parent_id <> ''").join(there, F.col("parent_id") == F.col("there"), "left_anti")
    kin = rows if strangers.limit(1).count() else kin
    up = sections.section_path(kin, section_id).filter("depth > 0").select(*told("depth", "ancestor", 1))
    parts = [own.select(*told(0, "section", 0)), up]
    if include_children:
        parts.append(rows.filter(F.col("parent_id") == section_id).select(*told("seq", "child", 2)))
    if include_related and place["parent_id"]:
        parts.append(rows.filter((F.col("parent_id") == place["parent_id"]) & (F.col("id") != section_id)).select(*told("seq", "sibling", 3)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # a context is a few rows around one section, so one task may order them
    order = W.orderBy("k", "at", "id")
    used = F.sum(F.ceil(F.octet_length("body") / 4)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return every.withColumns({"ord": F.row_number().over(order), "used": used}).filter((F.col("used") <= max_tokens) | (F.col("ord") == 1)).select("ord", "kind", "id", F.col("body").alias("content"))


def related(rows: DataFrame, section_id: str, embedded: DataFrame | None = None, mode: str = "both", top_n: int = 5, min_score: float = 0.6, max_per_kind: int = 10) -> DataFrame:
    """id, kind, score: sections beside one in the tree, and, with embeddings (id, embedding), the nearest to it."""
    out = None
    if mode in ("both", "structural"):
        own = rows.filter(F.col("id") == section_id)
        parent = own.select("parent_id").first()
        family = [section_id, parent[0]] if parent and parent[0] else [section_id]
        near = rows.filter(F.col("id").isin(*family) | F.col("parent_id").isin(*family))
        out = sections.structural_neighbors(near, max_per_kind).filter(F.col("source") == section_id).select("id", "kind", F.lit(None).cast("double").alias("score"))
    if mode in ("both", "semantic") and embedded is not None:
        close = similarity.semantic_neighbors(embedded, embedded.filter(F.col("id") == section_id), top_n, min_score).select(F.col("other").alias("id"), F.lit("semantic").alias("kind"), "score")
        out = close if out is None else out.unionByName(close)
    return out


def similar_clusters(rows: DataFrame, link_table: DataFrame, max_clusters: int = 50, **bounds) -> DataFrame:
    """canonical_id, members, max_score, avg_score, verdict: groups of similar sections, the best first.

    The canonical one is that of the most linked document, then the longest."""
    near = bounds.pop("near", 0.92)
    members, pairs = similarity.similar_classes(rows, **bounds)
    # sections that are alike are in one group, if they are linked at all, so classes are grouped, and their sizes weigh the pairs
    linked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    joined = components(pairs.select("a", "b")).withColumnRenamed("node", "key")
    group = cut(linked.join(joined, "key", "left").select("key", F.coalesce("component", "key").alias("component")), "groups")
    inbound = links.inbound_counts(rows, link_table)
    named = members.join(group, "key").select("component", "id", "doc_path", sections.byte_length().alias("bytes")).join(inbound, "doc_path")
    rank = F.struct((F.col("inbound") * 100.0 + F.col("bytes") * 0.001).alias("r"), "id")
    per = named.groupBy("component").agg(F.max(rank)["id"].alias("canonical_id"), F.count("*").alias("members"), F.countDistinct(paths.dirname(F.col("doc_path"))).alias("folders"))
    many = F.when(F.col("a") == F.col("b"), F.expr("n_a * (n_a - 1) DIV 2")).otherwise(F.col("n_a") * F.col("n_b")).cast("decimal(20,0)")
    weighed = pairs.join(group.withColumnRenamed("key", "a"), "a").select("component", "score", many.alias("many"), (F.round(F.col("score") * 10000).cast("decimal(10,0)") * many).alias("points"))
    scores = weighed.groupBy("component").agg(F.max("score").alias("max_score"), F.round(F.sum("points").cast("double") / F.sum("many").cast("double") / 10000, 4).alias("avg_score"))
    verdict = F.when(F.col("max_score") >= near, "near_duplicate").when(F.col("folders") > 1, "parallel_tutorial").otherwise("overlapping_topic")
    return per.join(scores, "component").select("canonical_id", "members", "max_score", "avg_score", verdict.alias("verdict")).orderBy(F.desc("max_score"), F.desc("members"), "canonical_id").limit(max_clusters)


def with_summaries(rows: DataFrame, summarize=None, least_chars: int = 20) -> DataFrame:
    """Sections with summaries: the title's, or, for short ones, what a function of (id, title, content) to (id, summary) says."""
    made = rows.withColumn("summary", F.when(F.col("summary") != "", F.col("summary")).otherwise(text.summary(F.col("title"), F.col("level"))))
    if summarize is None:
        return made
    said = summarize(made.filter(F.length("summary") < least_chars).select("id", "title", "content")).select("id", F.col("summary").alias("said"))
    return made.join(said, "id", "left").withColumn("summary", F.coalesce(F.nullif("said", F.lit("")), "summary")).drop("said")
