"""The link graph: what points where, what is broken or unreachable, and what an edit would touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text
from ..scratch import cut
from .ranks import running

MAX_IMPACT, MANY_BACKLINKS, MAX_CHAIN = 50, 3, 50
# The parts of a change's risk, and its levels.
RISK_WEIGHTS = {"volume": 0.15, "blast": 0.30, "backlinks": 0.20, "tutorial": 0.20, "role": 0.15}
RISK_LEVELS = ((0.25, "low"), (0.50, "medium"), (0.75, "high"))
HIGH_STAKES = ("tutorial", "reference", "concept", "guide")


def _looks_like_file() -> Column:
    return ~(F.contains("file_part", F.lit(":")) & ~F.startswith("file_part", F.lit(".")))


def backlinks(links: DataFrame, doc_path: str) -> DataFrame:
    """Sections that link to a document, each link once."""
    target = links.sparkSession.range(1).select(paths.normpath(F.lit(doc_path.lstrip("/"))).alias("t"))
    hits = links.join(F.broadcast(target), F.col("resolved") == F.col("t"))  # one row
    return hits.select("source_doc", "source_section", "source_section_id", F.col("href").alias("link")).distinct()


def anchor_keys(sections: DataFrame) -> DataFrame:
    """doc_path, key: what an anchor may call a section of a document by."""
    slug = F.lower(paths.slug_of(F.col("id")))
    keys = F.array(slug, paths.leaf_of(slug), text.slugify(F.col("title")))
    return sections.select("doc_path", F.explode(keys).alias("key")).distinct()


def broken_links(sections: DataFrame, links: DataFrame) -> DataFrame:
    """Internal links that lead nowhere, and why: anchor_not_found, file_not_found or section_not_found."""
    inside = links.filter("NOT is_external").withColumn("place", F.when(F.col("file_part") == "", F.col("source_doc")).otherwise(F.col("resolved")))
    inside = inside.filter(((F.col("file_part") == "") & (F.col("anchor") != "")) | ((F.col("file_part") != "") & _looks_like_file()))
    docs = sections.select(F.col("doc_path").alias("place")).distinct().withColumn("there", F.lit(True))
    keys = anchor_keys(sections).select(F.col("doc_path").alias("place"), F.col("key").alias("wanted")).withColumn("known", F.lit(True))
    met = inside.withColumn("wanted", F.lower(F.trim("anchor"))).join(docs, "place", "left").join(keys, ["place", "wanted"], "left")
    lost = (F.col("anchor") != "") & F.col("known").isNull()
    reason = F.when((F.col("file_part") == "") & lost, "anchor_not_found").when((F.col("file_part") != "") & F.col("there").isNull(), "file_not_found").when((F.col("file_part") != "") & lost, "section_not_found")
    return met.withColumn("reason", reason).filter("reason IS NOT NULL").select("source_doc", "source_section_id", F.col("href").alias("target"), "reason")


def orphan_sections(sections: DataFrame, links: DataFrame, include_same_doc: bool = False) -> DataFrame:
    """Sections, other than roots, of documents that nothing links to."""
    pointed = links.filter("NOT is_external AND resolved IS NOT NULL").select("source_doc", F.col("resolved").alias("doc_path"))
    if include_same_doc:
        pointed = pointed.unionByName(links.filter("NOT is_external AND file_part = ''").select("source_doc", F.col("source_doc").alias("doc_path")))
    else:
        pointed = pointed.filter("doc_path <> source_doc")
    return sections.filter("level <> 0 AND doc_path <> ''").join(pointed.select("doc_path").distinct(), "doc_path", "left_anti").select("id", "title", "doc_path", "level")


def inbound_counts(sections: DataFrame, links: DataFrame) -> DataFrame:
    """doc_path, inbound: internal links to every document, none included."""
    hits = links.filter(F.col("resolved").isNotNull() & _looks_like_file()).groupBy(F.col("resolved").alias("doc_path")).agg(F.count("*").alias("inbound"))
    return sections.select("doc_path").distinct().join(hits, "doc_path", "left").select("doc_path", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def wiki_stats(sections: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts for a repo."""
    inbound = inbound_counts(sections, links).agg(F.count("*").alias("page_count"), F.sum("inbound").alias("internal_links"), F.count_if(F.col("inbound") == 0).alias("orphan_pages"))
    tags = sections.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("tag_count"))
    per = sections.groupBy("doc_path").agg(F.count("*").alias("n")).agg(F.sum("n").alias("section_count"), F.min("n").alias("min_sections"), F.max("n").alias("max_sections"), F.round(F.avg("n"), 1).alias("avg_sections"))
    return inbound.crossJoin(tags).crossJoin(per)  # one row each


def most_linked(sections: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    return inbound_counts(sections, links).filter("inbound > 0").orderBy(F.desc("inbound"), "doc_path").limit(k)


def impact_each(links: DataFrame, sources: DataFrame, max_depth: int = 3, most: int | None = MAX_IMPACT) -> DataFrame:
    """source, depth, doc_path, section_id, via, link_kind: for each of many sources (source, doc_path, slug) the documents from which
    its document can be reached, by how far away. All sources walk together: one join of their frontiers with the links a level.

    A document counts where it is met first, through its first link. As in the listing that users see, each of the direct
    and the further documents of a source stops at ``most``; None gives them all. A source without links has no rows."""
    # links are resolved once, not once a level
    into = cut(links.filter("resolved IS NOT NULL AND resolved <> source_doc").select("resolved", "source_doc", "source_section_id", "seq", "ref_at", "anchor"), "into")
    frontier = sources.select("source", F.col("doc_path").alias("doc"), F.when(F.coalesce("slug", F.lit("")) != "", paths.leaf_of(F.lower("slug"))).alias("leaf"))
    seen, out = frontier.select("source", "doc"), None
    for depth in range(1, max(1, max_depth) + 1):
        known = seen.select(F.col("source").alias("s_source"), F.col("doc").alias("s_doc"))
        met = into.join(frontier, F.col("resolved") == F.col("doc")).join(known, (F.col("source") == F.col("s_source")) & (F.col("source_doc") == F.col("s_doc")), "left_anti")
        first = F.row_number().over(W.partitionBy("source", "source_doc").orderBy("seq", "ref_at", "resolved"))
        kind = F.when(F.col("leaf").isNotNull() & (F.col("anchor") != "") & F.contains(F.lower("anchor"), F.col("leaf")), "anchor").otherwise("doc")
        step = met.withColumn("rn", first).filter("rn = 1").select("source", F.lit(depth).alias("depth"), F.col("source_doc").alias("doc_path"), F.col("source_section_id").alias("section_id"), F.col("resolved").alias("via"), kind.alias("link_kind"))
        if most:
            step = step.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy("doc_path"))).filter(F.col("rn") <= most).drop("rn")
        step = cut(step, "impact")
        out = step if out is None else out.unionByName(step)
        frontier = step.select("source", F.col("doc_path").alias("doc"), F.lit(None).cast("string").alias("leaf"))
        seen = seen.unionByName(frontier.select("source", "doc"))
    if not most:
        return out
    place = F.row_number().over(W.partitionBy("source", F.col("depth") == 1).orderBy("depth", "doc_path"))
    return out.withColumn("rn", place).filter(F.col("rn") <= most).drop("rn")


def _place(section_id: str) -> tuple[str, str]:
    """Document and slug of a section's id."""
    return section_id.split("::")[-2], section_id.split("::")[-1].rsplit("#", 1)[0]


def impact(links: DataFrame, doc_path: str, slug: str = "", max_depth: int = 3, most: int | None = MAX_IMPACT) -> DataFrame:
    """``impact_each`` of one document."""
    one = links.sparkSession.range(1).select(F.lit(0).alias("source"), F.lit(doc_path).alias("doc_path"), F.lit(slug).alias("slug"))  # a row whose size the optimizer knows
    return impact_each(links, one, max_depth, most).drop("source")


def blast_radius_each(sections: DataFrame, links: DataFrame, sources: DataFrame, max_depth: int = 3, tutorial_count: int = 0, most: int | None = MAX_IMPACT) -> DataFrame:
    """A row for each source (source, doc_path, slug): how many documents and sections an edit of it touches, and a score of 0 to 1.

    most: where the listing stops that the score is made of, as users know it; None counts all documents."""
    hit = impact_each(links, sources, max_depth, most)
    names = ("direct", "transitive", "anchors", "docs_affected", "sections_affected")
    counts = hit.groupBy("source").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"), F.count_if((F.col("depth") == 1) & (F.col("link_kind") == "anchor")).alias("anchors"), F.countDistinct("doc_path").alias("docs_affected"), F.countDistinct("section_id").alias("sections_affected"))
    every = sources.select("source").join(counts, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    total = sections.agg(F.count("*").alias("total"))
    weighted = 2.0 * tutorial_count + 1.5 * F.col("anchors") + F.col("direct") + 0.5 * F.col("transitive")
    score = F.when(F.col("total") > 0, F.round(F.least(F.lit(1.0), weighted / F.greatest(F.lit(1.0), 0.2 * F.col("total"))), 3)).otherwise(0.0)
    return every.crossJoin(total).select("source", *names, score.alias("blast_score"))  # the total is one row


def blast_radius(sections: DataFrame, links: DataFrame, section_id: str, max_depth: int = 3, tutorial_count: int = 0, most: int | None = MAX_IMPACT) -> DataFrame:
    """``blast_radius_each`` of one section."""
    at, slug = _place(section_id)
    one = links.sparkSession.range(1).select(F.lit(0).alias("source"), F.lit(at).alias("doc_path"), F.lit(slug).alias("slug"))
    return blast_radius_each(sections, links, one, max_depth, tutorial_count, most).drop("source")


def anchor_backlinks(links: DataFrame, section_id: str) -> DataFrame:
    """Links whose anchor holds the section's own slug, from its document or another."""
    doc_path, slug = section_id.split("::")[-2], section_id.split("::")[-1].rsplit("#", 1)[0]
    place = F.when(F.col("file_part") == "", F.col("source_doc")).otherwise(F.col("resolved"))
    hits = links.filter((~F.col("is_external")) & (place == doc_path) & (F.col("anchor") != "") & F.contains(F.lower("anchor"), F.lit(slug.rsplit("/", 1)[-1].lower())))
    return hits.select("source_doc", "source_section_id", F.col("href").alias("link")).distinct()


def tutorial_edges(sections: DataFrame, sidebars: DataFrame | None = None) -> DataFrame:
    """doc, next, strategy: what a document names as its next, by front matter, inline links, contents lists, sidebars (root, at, next, as read from a site's settings), or numbered names."""
    # texts are put together only where one of the words stands that the patterns below need
    low = F.lower("content")
    told = sections.filter(F.contains(low, F.lit("next")) | F.contains(low, F.lit("toctree"))).select("doc_path").distinct()
    text_of = sections.join(told, "doc_path", "left_semi").groupBy("doc_path").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", "content")))["content"], "").alias("text"))
    docs = sections.select(F.col("doc_path").alias("there")).distinct()
    front = F.regexp_extract("text", r"(?s)\A---\n(?:.*?\n)?next:\s*[\"']?([^\"'\n]+?)[\"']?\s*\n.*?---", 1)
    inline = F.regexp_extract("text", r"(?im)^\s*(?:next|→\s*next|next\s*→)\s*[:→]?\s*(?:\[[^\]]*\]\(([^)#]+)|(\S+\.\w+))", 1)
    named = text_of.select("doc_path", F.explode(F.array(F.struct(F.lit("frontmatter").alias("strategy"), front.alias("target")), F.struct(F.lit("inline_link").alias("strategy"), inline.alias("target")))).alias("x")).filter("x.target <> ''")
    tried = named.select("doc_path", "x.strategy", F.explode(F.array(F.col("x.target"), F.concat("x.target", F.lit(".md")), F.concat("x.target", F.lit(".rst")))).alias("target"))
    edges = tried.select("doc_path", "strategy", paths.resolve(F.col("doc_path"), F.col("target")).alias("next"))
    listed = text_of.select("doc_path", F.split(F.regexp_extract("text", r"(?m)^\.\.\s+toctree::\s*\n((?:[ \t]+.*\n?|\n)+)", 1), "\n").alias("ls"))
    entries = listed.select("doc_path", F.posexplode(F.filter(F.transform("ls", lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit(":")))).alias("at", "entry"))
    entries = entries.withColumn("entry", F.when(F.regexp_like("entry", F.lit("<[^<>]+>$")), F.regexp_extract("entry", "<([^<>]+)>$", 1)).otherwise(F.col("entry")))
    found = entries.select("doc_path", "at", F.explode(F.array(F.col("entry"), F.concat("entry", F.lit(".rst")), F.concat("entry", F.lit(".md")))).alias("target")).withColumn("next", paths.resolve(F.col("doc_path"), F.col("target"))).join(docs, F.col("next") == F.col("there"), "left_semi")
    toc = found.select("doc_path", "at", "next").distinct()
    steps = toc.select(F.col("doc_path").alias("root"), "at", "next").unionByName(toc.select(F.col("doc_path").alias("root"), F.lit(-1).alias("at"), F.col("doc_path").alias("next")).distinct())
    chain = steps.withColumn("before", F.lag("next").over(W.partitionBy("root").orderBy("at", "next"))).filter("before IS NOT NULL").select(F.col("before").alias("doc_path"), F.lit("sphinx_toctree").alias("strategy"), "next")
    if sidebars is not None:
        aside = sidebars.withColumn("before", F.lag("next").over(W.partitionBy("root").orderBy("at"))).filter("before IS NOT NULL")
        chain = chain.unionByName(aside.select(F.col("before").alias("doc_path"), F.lit("vuepress_sidebar").alias("strategy"), "next"))
    numbers = docs.select(F.col("there").alias("doc_path"), F.regexp_extract(F.substring_index("there", "/", -1), r"^(\d{2,})[-_.]", 1).alias("n")).filter("n <> ''")
    # a folder may hold most documents: each gets its place, and the one behind it is found by that
    placed = cut(running(numbers.select("doc_path", F.col("n").cast("long").alias("n"), paths.dirname(F.col("doc_path")).alias("folder")), ["folder"], ["n", "doc_path"], F.lit(1), "place"), "placed")
    behind = placed.select("folder", (F.col("place") - 1).alias("place"), F.col("doc_path").alias("next"))
    numbered = placed.join(behind, ["folder", "place"]).select("doc_path", F.lit("ordered_filename").alias("strategy"), "next")
    every = edges.join(docs, F.col("next") == F.col("there"), "left_semi").unionByName(chain).unionByName(numbered)
    rank = F.array_position(F.array(*[F.lit(x) for x in ("frontmatter", "inline_link", "sphinx_toctree", "vuepress_sidebar", "ordered_filename")]), F.col("strategy"))
    best = F.row_number().over(W.partitionBy("doc_path", "strategy").orderBy("next"))
    return every.filter("next <> doc_path").withColumns({"rank": rank, "rn": best}).filter("rn = 1").select(F.col("doc_path").alias("doc"), "next", "strategy", "rank")


def tutorial_chain(edges: DataFrame, doc_path: str) -> DataFrame:
    """step, doc, strategy from a document on, by the first strategy that its start has; a loop or ``MAX_CHAIN`` ends it."""
    spark = edges.sparkSession
    start = edges.filter(F.col("doc") == doc_path).agg(F.min("rank").alias("r")).first()["r"]
    own = edges.filter(F.col("rank") == (start or 0)).select("doc", "next", "strategy")
    return spark.sql(
        """
        WITH RECURSIVE walk(step, doc, seen) AS (
          SELECT 0, {start}, array({start})
          UNION ALL
          SELECT w.step + 1, e.next, array_append(w.seen, e.next) FROM walk w JOIN {e} e ON e.doc = w.doc WHERE NOT array_contains(w.seen, e.next) AND w.step + 1 < {most}
        ) SELECT step, doc FROM walk
        """,
        e=own,
        start=doc_path,
        most=MAX_CHAIN,
    )


def delete_safe(sections: DataFrame, links: DataFrame, section_id: str, depth: int = 3, recent_days: int = 14, edges: DataFrame | None = None, edited_days_ago: int | None = None, freshness: str = "fresh") -> DataFrame:
    """One row: whether a section can be deleted, and the first reason why not."""
    doc_path = section_id.split("::")[-2]
    anchors = anchor_backlinks(links, section_id).agg(F.count("*").alias("anchor_backlinks"))
    direct = backlinks(links, doc_path).agg(F.count("*").alias("doc_backlinks"))
    further = impact(links, doc_path, "", depth, most=None).agg(F.countDistinct("doc_path").alias("transitive_backlinks"))
    chained = (edges if edges is not None else tutorial_edges(sections)).agg(F.count_if((F.col("doc") == doc_path) | (F.col("next") == doc_path)).alias("chained"))
    recent = F.lit((edited_days_ago is not None and edited_days_ago <= recent_days) or freshness == "edited_uncommitted")
    verdict = F.when(F.col("chained") > 0, "tutorial_path_blocking").when(F.col("anchor_backlinks") > 0, "anchor_referenced").when(F.col("transitive_backlinks") >= MANY_BACKLINKS, "backlinks_blocking").when(recent, "recently_edited_blocking").otherwise("safe_to_delete")
    return anchors.crossJoin(direct).crossJoin(further).crossJoin(chained).select("anchor_backlinks", "doc_backlinks", "transitive_backlinks", verdict.alias("verdict"))  # one row each


def risk_profile(sections: DataFrame, links: DataFrame, changed: list[str], edges: DataFrame | None = None) -> DataFrame:
    """One row: the parts of the risk of changing sections, their weighted sum, and its level. All changed sections walk the links together."""
    sources = links.sparkSession.createDataFrame([(i, *_place(c)) for i, c in enumerate(changed)], "source int, doc_path string, slug string")
    each = blast_radius_each(sections, links, sources)
    both = each.agg(F.avg("blast_score").alias("blast"), F.avg("direct").alias("inbound")).crossJoin(sections.agg(F.count("*").alias("total")))
    named = sections.filter(F.col("id").isin(*changed)).agg((F.count_if(F.coalesce("role", F.lit("unknown")).isin(*HIGH_STAKES)) / max(1, len(changed))).alias("role"))
    docs = [c.split("::")[-2] for c in changed]
    on = (edges if edges is not None else tutorial_edges(sections)).filter(F.col("doc").isin(*docs) | F.col("next").isin(*docs))
    hits = on.select(F.explode(F.array("doc", "next")).alias("d")).filter(F.col("d").isin(*docs)).agg((F.countDistinct("d") / max(1, len(set(docs)))).alias("tutorial"))
    parts = both.crossJoin(named).crossJoin(hits).select(F.least(F.lit(1.0), F.lit(10.0 * len(changed)) / F.greatest(F.lit(1), F.col("total"))).alias("volume"), F.least(F.lit(1.0), F.col("blast")).alias("blast"), F.least(F.lit(1.0), F.col("inbound") / 5).alias("backlinks"), "tutorial", "role")
    risk = F.round(sum((w * F.col(k) for k, w in RISK_WEIGHTS.items()), F.lit(0.0)), 4)
    level = F.lit("critical")
    for most, name in reversed(RISK_LEVELS):
        level = F.when(F.col("risk") <= most, name).otherwise(level)
    return parts.withColumn("risk", risk).withColumn("level", level).select(*[F.round(k, 4).alias(k) for k in RISK_WEIGHTS], "risk", "level")
