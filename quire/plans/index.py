"""What is derived from sections at index time: roles, terms, postings, corpus statistics, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text
from ..scratch import bounded_batches

FIELDS = ("title", "summary", "content", "ancestors")
TOP_TERMS = 5000
ROLE_ANCESTORS = 16
K1, B = 1.2, 0.75
WEIGHTS = {"title": 3.0, "summary": 1.5, "content": 1.0, "ancestors": 0.5}
#: Blocks of postings in an impact of one.
STEPS = 8


def bm25_part(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def averages(stats) -> dict[str, float]:
    """The mean length of each field, from a row of ``corpus_stats``; that of ancestors follows the title's."""
    return {f: float(stats[f"avg_{f}"] or 1.0) for f in FIELDS[:3]} | {"ancestors": float(max(stats["avg_title"], 3.0))}


def ancestor_text(sections: DataFrame) -> DataFrame:
    """Adds ``ancestors``: the slug's parts above the section's own, as words."""
    parts = F.split(paths.slug_of(F.col("id")), "/")
    above = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return sections.withColumn("ancestors", F.replace(F.array_join(above, " "), F.lit("-"), F.lit(" ")))


def terms(sections: DataFrame) -> DataFrame:
    """id and an array of terms for each field."""
    rows = sections if "ancestors" in sections.columns else ancestor_text(sections)
    return rows.select("id", *[text.tokenize(F.col(f)).alias(f) for f in FIELDS])


def corpus_stats(termed: DataFrame) -> DataFrame:
    """One row: n_sections and the mean length of title, summary and content."""
    return termed.agg(F.count("*").alias("n_sections"), *[F.coalesce(F.avg(F.size(f)), F.lit(0.0)).alias(f"avg_{f}") for f in FIELDS[:3]])


def term_df(termed: DataFrame, top: int | None = TOP_TERMS) -> DataFrame:
    """term, df: in how many sections it stands; the most common ones, ties by term."""
    each = termed.select(F.explode(F.array_distinct(F.concat(*FIELDS[:3]))).alias("term"))
    counted = each.groupBy("term").agg(F.count("*").alias("df"))
    return counted.orderBy(F.desc("df"), "term").limit(top) if top else counted


def _unique(termed: DataFrame) -> bool:
    return termed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() == 0


def _counted(batches):
    """id, term, and tf0 to dl3: the terms of each row counted where the row is."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            lists = [part[f] for f in FIELDS]
            at, terms = (pa.concat_arrays([g(x) for x in lists]) for g in (pc.list_parent_indices, pc.list_flatten))
            field = pa.concat_arrays([pa.array([i], pa.int8()).take(pa.array([0] * len(pc.list_flatten(x)), pa.int32())) for i, x in enumerate(lists)])
            ones = [pc.equal(field, i).cast(pa.int32()) for i in range(len(FIELDS))]
            found = pa.table([at, terms, *ones], ["at", "term", *[f"tf{i}" for i in range(len(FIELDS))]]).group_by(["at", "term"]).aggregate([(f"tf{i}", "sum") for i in range(len(FIELDS))])
            columns = {"id": part["id"].take(found["at"]), "term": found["term"]}
            for i, x in enumerate(lists):
                tf = found[f"tf{i}_sum"].cast(pa.int32())
                columns |= {f"tf{i}": tf, f"dl{i}": pc.if_else(pc.greater(tf, 0), pc.list_value_length(x).cast(pa.int32()).take(found["at"]), pa.scalar(None, pa.int32()))}
            yield from pa.table(columns).to_batches(max_chunksize=50_000)


def _each_counted(termed: DataFrame) -> DataFrame:
    """``_counted`` of all rows. No posting is moved for it."""
    bounded_batches(termed.sparkSession)
    return termed.select("id", *[F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in FIELDS]).mapInArrow(_counted, "id string, term string, " + ", ".join(f"tf{i} int, dl{i} int" for i in range(len(FIELDS))))


def postings(termed: DataFrame) -> DataFrame:
    """term, id, field, tf, dl: the inverted index. Only if an id stands in several rows are postings grouped across rows."""
    if _unique(termed):
        fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"tf{i}").cast("long").alias("tf"), F.col(f"dl{i}").alias("dl")) for i, f in enumerate(FIELDS)])
        return _each_counted(termed).select("term", "id", F.explode(F.filter(fields, lambda x: x["tf"] > 0)).alias("x")).select("term", "id", "x.*")
    each = [termed.select("id", F.lit(f).alias("field"), F.size(f).alias("dl"), F.explode(f).alias("term")) for f in FIELDS]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.groupBy("term", "id", "field").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def search_stats(termed: DataFrame, old=None, gone: DataFrame | None = None) -> dict[str, float]:
    """n_sections, the sum and mean of each field's terms, and base: the means that blocks of postings are cut by. With an ``old`` row and
    the terms of sections that are ``gone`` the new ones are added to what there was, and base stays."""
    def sums(t):
        return t.agg(F.count("*").alias("n_sections"), *[F.coalesce(F.sum(F.size(f)), F.lit(0)).alias(f"sum_{f}") for f in FIELDS[:3]]).first().asDict()

    out = sums(termed)
    if old is not None:
        less = sums(gone)
        out = {k: old[k] + v - less[k] for k, v in out.items()}
    out |= {f"avg_{f}": out[f"sum_{f}"] / out["n_sections"] if out["n_sections"] else 0.0 for f in FIELDS[:3]}
    return out | {f"base_{f}": out[f"avg_{f}"] if old is None else old[f"base_{f}"] for f in FIELDS[:3]}


def impact(average: dict[str, float]) -> Column:
    """What a posting adds to its section's score before the query weighs it, over all fields."""
    total = F.lit(0.0)
    for i, f in enumerate(FIELDS):
        total = total + F.when(F.col(f"tf{i}") > 0, WEIGHTS[f] * bm25_part(F.col(f"tf{i}"), F.col(f"dl{i}"), F.lit(average[f]))).otherwise(0.0)
    return total


def blocked_postings(termed: DataFrame, base: dict[str, float]) -> DataFrame:
    """term, id, level, own, and a term's number and the length of each field (tf0 to dl3): one row for a term of a section.

    level: the impact under the base means in steps of 1 / ``STEPS``; the postings of a term and level are a block, and lie together
    where they are stored. own: the term stands in a field of the section's own, so it counts in document frequencies.
    A section's terms are counted in its row; only if an id stands in several rows are they grouped across rows."""
    own = F.col("tf0") + F.col("tf1") + F.col("tf2") > 0
    numbers = [f"{k}{i}" for i in range(len(FIELDS)) for k in ("tf", "dl")]
    told = ("term", "id", F.floor(impact(base) * STEPS).cast("int").alias("level"), own.alias("own"), *numbers)
    if _unique(termed):
        return _each_counted(termed).select(*told)
    fields = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("terms")) for i, f in enumerate(FIELDS)])
    each = termed.select("id", F.explode(fields).alias("x")).select("id", "x.f", F.size("x.terms").alias("dl"), F.explode("x.terms").alias("term"))
    tf, dl = (lambda i: F.count_if(F.col("f") == i).cast("int")), (lambda i: F.max(F.when(F.col("f") == i, F.col("dl"))))
    counted = each.groupBy("term", "id").agg(*[x for i in range(len(FIELDS)) for x in (tf(i).alias(f"tf{i}"), dl(i).alias(f"dl{i}"))])
    return counted.select(*told)


def term_counts(posted: DataFrame, sign: Column | None = None) -> DataFrame:
    """term, df from blocked postings; with a sign for each, what they add and take away."""
    return posted.filter("own").groupBy("term").agg(F.sum(F.lit(1) if sign is None else sign).alias("df")).filter("df <> 0")


def level_counts(posted: DataFrame, sign: Column | None = None) -> DataFrame:
    """term, level, n: the sizes of the blocks."""
    return posted.groupBy("term", "level").agg(F.sum(F.lit(1) if sign is None else sign).alias("n")).filter("n <> 0")


def links(sections: DataFrame) -> DataFrame:
    """A row for each reference: where it stands, and where it leads. External ones and those without a file keep ``resolved`` null."""
    each = sections.select("repo", F.col("id").alias("source_section_id"), F.col("title").alias("source_section"), F.col("doc_path").alias("source_doc"), "seq", F.posexplode("references").alias("ref_at", "href"))
    # an array of one is exploded, so what a link is made of is worked out once, not again in each filter over it
    told = F.struct(paths.is_external(F.col("href")).alias("is_external"), paths.file_part(F.col("href")).alias("file_part"), paths.anchor_part(F.col("href")).alias("anchor"))
    each = each.select("*", F.explode(F.array(told)).alias("told")).select(*each.columns, "told.*")
    inside = ~F.col("is_external") & (F.col("file_part") != "")
    return each.select("*", F.explode(F.array(F.when(inside, paths.resolve(F.col("source_doc"), F.col("file_part"))))).alias("resolved"))



def roles(sections: DataFrame, depth: int = ROLE_ANCESTORS) -> DataFrame:
    """id, role, role_source: by the title, then the nearest ancestor's title, then what the text is made of.

    Ancestors are walked level by level, with one join for each; the walk ends when no section is left without a role."""
    own = sections.select("id", "parent_id", text.density_role(F.col("content")).alias("dense"), text.heading_role(F.col("title")).alias("role"))  # no text is moved
    parents = own.select(F.col("id").alias("p_id"), F.col("role").alias("p_role"), F.col("parent_id").alias("p_parent"))
    out = own.withColumn("role_source", F.when(F.col("role").isNotNull(), "heading"))
    out = out.withColumn("up", F.when(F.col("role").isNull(), F.nullif(F.col("parent_id"), F.lit(""))))
    deepest = sections.agg(F.max("level")).first()[0] or 0
    for _ in range(min(depth, deepest)):
        met = out.join(parents, out["up"] == parents["p_id"], "left")
        hit = F.col("role").isNull() & F.col("p_role").isNotNull()
        out = met.select("id", "parent_id", "dense", F.coalesce("role", "p_role").alias("role"), F.when(hit, "ancestor").otherwise(F.col("role_source")).alias("role_source"), F.when(F.coalesce("role", "p_role").isNull(), F.nullif(F.col("p_parent"), F.lit(""))).alias("up"))
    return out.select("id", F.coalesce("role", "dense", F.lit("concept")).alias("role"), F.coalesce("role_source", F.when(F.col("dense").isNotNull(), "density"), F.lit("default")).alias("role_source"))


def numbered(sections: DataFrame) -> DataFrame:
    """Sections without ``seq`` get one, by place in the document."""
    return sections.withColumn("seq", F.row_number().over(W.partitionBy("repo", "doc_path").orderBy("byte_start", "id")) - 1)
