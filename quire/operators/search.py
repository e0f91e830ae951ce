"""Ranked search: BM25 over four fields, vectors, and fusion of ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..plans import index
from ..scratch import cut

RRF_K = 60
K1, B, WEIGHTS, bm25_part = index.K1, index.B, index.WEIGHTS, index.bm25_part
# Roles that a search profile moves to the front.
PROFILES = {"install": ("how_to", "tutorial", "example"), "debug": ("troubleshooting", "faq", "example"), "explain": ("concept", "reference", "tutorial"), "api": ("api", "reference", "example")}


def query_terms(df: DataFrame, query: str) -> list[str]:
    """The query's terms, repeats included. Over a literal row the expression is worked out when the plan is made, so no job runs."""
    return df.sparkSession.sql("VALUES (1)").select(text.tokenize(F.lit(query)).alias("t")).first()["t"]


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1))


def bm25_scores(termed: DataFrame, query: str, stats: DataFrame | None = None, df: DataFrame | None = None, posted: DataFrame | None = None, written: bool = False, top: int | None = index.TOP_TERMS) -> DataFrame:
    """id, score of all sections with a term of the query. Terms that the table of common terms (``top`` of them; None: all) lacks count as standing in one section.

    written: ``termed`` is a table that is written. Without a stored inverted index only the query's terms are kept before anything is grouped, so little is moved."""
    wanted = query_terms(termed, query)
    if not wanted:
        return termed.select("id", F.lit(0.0).alias("score")).limit(0)
    spark = termed.sparkSession
    if not written and (stats is None or df is None or posted is None):
        termed = cut(termed, "terms")  # texts are taken apart once, then read as terms
    stats = index.corpus_stats(termed) if stats is None else stats
    df = index.term_df(termed, top) if df is None else df
    asked = spark.createDataFrame([(t, wanted.count(t)) for t in dict.fromkeys(wanted)], "term string, times int")
    if posted is None:
        few = termed.select("id", *[F.size(f).alias(f"n_{f}") for f in index.FIELDS], *[F.filter(f, lambda t: t.isin(*wanted)).alias(f) for f in index.FIELDS])
        parts = [few.select("id", F.lit(f).alias("field"), F.col(f"n_{f}").alias("dl"), F.explode(f).alias("term")) for f in index.FIELDS]
        each = parts[0]
        for p in parts[1:]:
            each = each.unionByName(p)
        posted = each.groupBy("term", "id", "field", "dl").agg(F.count("*").alias("tf"))
    else:
        posted = posted.filter(F.col("term").isin(*wanted))
    s = stats.first()
    known = F.broadcast(asked.join(df.filter(F.col("term").isin(*wanted)), "term", "left").select("term", "times", F.coalesce("df", F.lit(1)).alias("df")))  # as many rows as the query has terms
    avg = {f: s[f"avg_{f}"] for f in index.FIELDS[:3]} | {"ancestors": max(s["avg_title"], 3.0)}
    average, weight = F.lit(1.0), F.lit(0.0)
    for f, w in WEIGHTS.items():
        average = F.when(F.col("field") == f, float(avg[f] or 1.0)).otherwise(average)
        weight = F.when(F.col("field") == f, w).otherwise(weight)
    part = weight * F.col("times") * idf(F.col("df"), F.lit(float(s["n_sections"]))) * bm25_part(F.col("tf"), F.col("dl"), average)
    return posted.join(known, "term").groupBy("id").agg(F.sum(part).alias("score")).filter("score > 0")


def tag_bonus(tags: Column, query: str) -> Column:
    words = query.lower().split()
    return 0.5 * F.size(F.filter(tags, lambda t: F.lower(t).isin(*words))) if words else F.lit(0.0)


def _top(scored: DataFrame, k: int | None) -> DataFrame:
    """The best k rows, or all of them in order."""
    rows = scored.orderBy(F.desc("score"), "id")
    return rows if k is None else rows.limit(k)


def _kept(scored: DataFrame, keep: DataFrame | None) -> DataFrame:
    return scored if keep is None else scored.join(keep.select("id"), "id", "left_semi")


def lexical_search(sections: DataFrame, query: str, max_results: int | None = 10, keep: DataFrame | None = None, termed: DataFrame | None = None, top: int | None = None, **stored) -> DataFrame:
    """id, title, score, best first; without a limit all sections that hold a term. stored: stats, df, posted as built at index time. top: see ``bm25_scores``.
    termed: the sections' terms as a table that is written, if there is one.

    keep: the sections that may be results, filtered before the limit. Statistics are those of all sections."""
    scores = _kept(bm25_scores(index.terms(sections) if termed is None else termed, query, written=termed is not None, top=top, **stored), keep)
    named = scores.join(sections.select("id", "title", "doc_path", *(["tags"] if "tags" in sections.columns else [])), "id")
    bonus = tag_bonus(F.col("tags"), query) if "tags" in sections.columns else F.lit(0.0)
    return _top(named.select("id", "title", "doc_path", F.round(F.col("score") + bonus, 6).alias("score")), max_results)


#: No impact is larger: every field adds less than its weight times k1 + 1.
MOST_IMPACT = sum(WEIGHTS.values()) * (K1 + 1)
#: Where rounding may hide a tie; postings that one task scores; postings above which a first look at the best blocks comes before.
SLIP, ONE_TASK, PROBE = 1e-5, 200_000, 50_000


class Searcher:
    """Searches of one repo in a store, from the postings with impacts written when it was indexed.

    Postings lie by term and by impact, in blocks of nearly equal impact. The corpus statistics are read once. Of a query's terms
    their frequency and the sizes of their blocks, and of its words how often they are tags, are looked up, and kept for later queries.
    Blocks are cut by the mean lengths of when the index was made; as these drift, so do the bounds of the blocks, by no
    more than the ratio of the means, and scores are always worked out with the present means.
    The k-th best score is at least what k sections get from one term alone. A section in a block cannot be among the
    best if the block's most, and the most of all other terms and of the tags, stay under that. Such blocks are
    not read, and all others are, so the sections found have their whole scores: the rows are those of ``lexical_search``."""

    def __init__(self, store, repo: str):
        self.store, self.repo = store, repo
        self.stats = store.load("corpus_stats", repo).first()
        self.df: dict[str, int] = {}
        self.levels: dict[str, list] = {}
        self.tags: dict[str, int] = {}
        self.average = index.averages(self.stats)
        base = index.averages({f"avg_{f}": self.stats[f"base_{f}"] for f in index.FIELDS[:3]})
        drift = [self.average[f] / base[f] for f in index.FIELDS]
        self.highest, self.lowest = max(1.0, *drift), min(1.0, *drift)
        self.schemas = {name: t.schema for name in ("postings", "sections", "tags", "term_counts", "level_counts") if (t := store.load(name, repo)) is not None}
        self.last: dict[str, int] = {}

    def _load(self, name: str, keys: list[str]) -> DataFrame:
        spark = self.store.spark
        found = self.store.load(name, self.repo, keys, self.schemas[name]) if name in self.schemas else None
        return spark.createDataFrame([], "id string, tag string") if found is None else found

    def _know(self, query: str) -> None:
        """Looks up the numbers of the query's terms and words that are not known yet."""
        terms = [t for t in dict.fromkeys(query_terms(self.store.spark.range(0), query)) if t not in self.df]
        words = [w for w in dict.fromkeys(query.lower().split()) if w not in self.tags]
        asked = {"term_counts": ("term", F.sum("df"), F.lit(0), terms), "level_counts": ("term", F.sum("n"), F.col("level"), terms), "tags": ("tag", F.count("*"), F.lit(0), words)}
        every = None
        for name, (key, number, level, keys) in asked.items():
            if keys and name in self.schemas:
                found = self._load(name, keys).filter(F.col(key).isin(*keys)).groupBy(F.lit(name).alias("of"), F.col(key).alias("key"), level.alias("level")).agg(number.alias("n"))
                every = found if every is None else every.unionByName(found)
        self.df |= dict.fromkeys(terms, 0)
        self.tags |= dict.fromkeys(words, 0)
        if every is None:
            return
        for r in every.filter("n > 0").orderBy(F.desc("level")).collect():  # for a term one row, and STEPS times MOST_IMPACT at most
            if r["of"] == "level_counts":
                self.levels.setdefault(r["key"], []).append((r["level"], r["n"]))
            else:
                (self.df if r["of"] == "term_counts" else self.tags)[r["key"]] = r["n"]

    def tag_words(self, query: str) -> list[str]:
        """Words of the query that are tags."""
        self._know(query)
        return [w for w in dict.fromkeys(query.lower().split()) if self.tags[w]]

    def weights(self, query: str) -> dict[str, float]:
        """The query's terms that have postings, and what an impact of one is worth for each. A term that stands in ancestors alone counts as in one section."""
        self._know(query)
        wanted, n = query_terms(self.store.spark.range(0), query), float(self.stats["n_sections"])
        rare = lambda df: max(0.0, math.log((n - df + 0.5) / (df + 0.5) + 1))
        found = {t: wanted.count(t) * rare(self.df[t] or 1) for t in dict.fromkeys(wanted) if t in self.levels}
        return {t: w for t, w in found.items() if w > 0}

    def _most(self, level: int) -> float:
        return (level + 1) / index.STEPS * self.highest

    def _least(self, level: int) -> float:
        return level / index.STEPS * self.lowest

    def _reaching(self, term: str, k: int) -> int | None:
        """The level down to which a term has k postings."""
        n = 0
        for level, size in self.levels.get(term, ()):
            n += size
            if n >= k:
                return level
        return None

    def needed(self, weights: dict[str, float], k: int, bonus: float = 0.0, least: float = 0.0) -> dict[str, int]:
        """The lowest level to read of each term; terms of which no block can matter are left out. least: what the k-th score is known to reach."""
        most = {t: w * (self._most(self.levels[t][0][0]) if t in self.levels else MOST_IMPACT) for t, w in weights.items()}
        least = max([least, *(w * self._least(level) for t, w in weights.items() if (level := self._reaching(t, k)) is not None)])
        out = {}
        for t, w in weights.items():
            wanted = (least - bonus - (sum(most.values()) - most[t])) / w - SLIP
            kept = [level for level, _ in self.levels[t] if self._most(level) >= wanted] if t in self.levels else [0]
            if kept:
                out[t] = kept[-1]
        return out

    def _sizes(self, needed: dict[str, int]) -> list[int]:
        """Sizes of the blocks needed, of the terms whose blocks are known."""
        return [n for t, low in needed.items() for level, n in self.levels.get(t, ()) if level >= low]

    def _scored(self, weights: dict[str, float], needed: dict[str, int], words: list[str]) -> DataFrame:
        """id, score over the blocks needed. Weights are looked up in constant maps, so all searches share one compiled plan."""
        spark = self.store.spark
        if not needed:
            return spark.createDataFrame([], "id string, score double")
        held = lambda values, t: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), t)
        posted = self._load("postings", list(needed)).filter(F.col("term").isin(*needed) & (F.col("level") >= min(needed.values())))
        posted = posted.filter(F.col("level") >= held(needed, F.col("term")))
        parts = posted.select("id", (index.impact(self.average) * held({t: weights[t] for t in needed}, F.col("term"))).alias("part"), F.lit(0.0).alias("bonus"))
        if words:
            tagged = self._load("tags", words).filter(F.col("tag").isin(*words))
            parts = parts.unionByName(tagged.select("id", F.lit(0.0).alias("part"), F.lit(0.5).alias("bonus")))
        if sum(self._sizes(needed)) + sum(self.tags[w] for w in words) <= ONE_TASK:
            parts = parts.coalesce(1)
        summed = parts.groupBy("id").agg(F.sum("part").alias("part"), F.sum("bonus").alias("bonus"))
        return summed.filter("part > 0").select("id", (F.col("part") + F.col("bonus")).alias("score"))

    def scores(self, query: str) -> DataFrame:
        """id, score of all sections with a term of the query, tags counted."""
        weights = self.weights(query)
        return self._scored(weights, {t: 0 for t in weights}, self.tag_words(query))

    def best(self, query: str, k: int) -> DataFrame:
        """id, score of the best k, and ``last``: blocks and postings of the query's known terms, and how many were read."""
        weights, words = self.weights(query), self.tag_words(query)
        bonus = 0.5 * min(len(words), self.stats["most_tags"] or 0)
        needed = self.needed(weights, k, bonus)
        if sum(self._sizes(needed)) > PROBE:
            first = {t: self._reaching(t, 4 * k) or 0 for t in needed}
            seen = _top(self._scored(weights, first, []).select("id", "score"), k).collect()  # k at most
            needed = self.needed(weights, k, bonus, seen[-1]["score"] if len(seen) == k else 0.0)
        known, read = self._sizes(dict.fromkeys(weights, 0)), self._sizes(needed)
        self.last = {"blocks": len(known), "blocks_read": len(read), "postings": sum(known), "postings_read": sum(read)}
        return _top(self._scored(weights, needed, words).select("id", F.round("score", 6).alias("score")), k)

    def search(self, query: str, max_results: int = 10) -> DataFrame:
        """id, title, doc_path, score, best first."""
        top = self.best(query, max_results).collect()  # max_results at most
        spark = self.store.spark
        paths = list(dict.fromkeys(r["id"].split("::", 1)[1].rsplit("::", 1)[0] for r in top))
        key = F.col("key" if top and "key" in self.schemas["sections"].names else "id")
        rows = self._load("sections", paths).filter(key.isin(*[r["id"] for r in top])).select(key, "id", "title", "doc_path").collect() if top else []
        named = {r[0]: r[1:] for r in rows}
        return spark.createDataFrame([(*named[r["id"]], r["score"]) for r in top], "id string, title string, doc_path string, score double")


#: Terms of sections, and scores of sections for a query, that one task groups.
TASK_GROUPS = 500_000


def lexical_search_each(sections: DataFrame, asked: DataFrame, max_results: int = 10, top: int | None = None) -> DataFrame:
    """query, id, score, rank: ``lexical_search`` for every row of a stated query set (query, text) in one plan.

    Terms are dealt out by section once, so postings and scores are grouped where they are, and ranks move only the best of a task."""
    termed = cut(index.terms(sections), "terms")
    s = index.corpus_stats(termed).first()
    times = asked.select("query", F.explode(text.tokenize(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    known = cut(times.join(index.term_df(termed, top), "term", "left").select("query", "term", "times", F.coalesce("df", F.lit(1)).alias("df")), "asked")
    # so many partitions that what a task groups does not grow with the table
    groups = s["n_sections"] * (sum(s[f"avg_{f}"] for f in index.FIELDS[:3]) + known.select("query").distinct().count())
    dealt = termed.repartition(max(termed.sparkSession.sparkContext.defaultParallelism, math.ceil(groups / TASK_GROUPS)), "id")
    field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in index.FIELDS])).alias("f")
    each = dealt.select("id", field).select("id", "f.field", F.size("f.terms").alias("dl"), F.explode("f.terms").alias("term"))
    # how the query set's terms meet the texts is left to the optimizer, which knows the size of their table
    posted = each.join(known.select("term").distinct(), "term", "left_semi").groupBy("id", "field", "dl", "term").agg(F.count("*").alias("tf"))
    avg = {f: s[f"avg_{f}"] for f in index.FIELDS[:3]} | {"ancestors": max(s["avg_title"], 3.0)}
    average, weight = F.lit(1.0), F.lit(0.0)
    for f, w in WEIGHTS.items():
        average = F.when(F.col("field") == f, float(avg[f] or 1.0)).otherwise(average)
        weight = F.when(F.col("field") == f, w).otherwise(weight)
    part = weight * F.col("times") * idf(F.col("df"), F.lit(float(s["n_sections"]))) * bm25_part(F.col("tf"), F.col("dl"), average)
    scored = posted.join(known, "term").groupBy("id", "query").agg(F.sum(part).alias("score")).filter("score > 0")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.select("query", "id", F.round("score", 6).alias("score")).withColumn("rank", place).filter(F.col("rank") <= max_results)


def holders(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """query, id: the sections whose content holds the whole text of a row of a stated query set (query, text).

    A word with white space on both sides in the text stands so in every section that holds it: only sections with the
    text's longest such word are searched for the text. Texts without such a word are looked for in every section."""
    words = F.split("text", r"\s+")
    inner = F.array_max(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))
    asked = cut(asked.select("query", "text", inner["word"].alias("word")), "asked")
    met = sections.select("id", F.explode(F.array_distinct(F.split("content", r"\s+"))).alias("word"))
    near = met.join(asked.filter("word <> ''"), "word").select("id", "query", "text")
    by_word = near.join(sections.select("id", "content"), "id")
    other = asked.filter("word IS NULL OR word = ''").join(sections.select("id", "content"), F.contains("content", "text"))
    return by_word.filter(F.contains("content", "text")).select("query", "id").unionByName(other.select("query", "id"))


def candidates(termed: DataFrame, query: str) -> DataFrame:
    """id of the sections that hold a term of the query."""
    wanted = query_terms(termed, query)
    return termed.filter(F.exists(F.concat(*index.FIELDS[:3]), lambda t: t.isin(*wanted))).select("id")


def semantic_scores(embedded: DataFrame, vector: list[float]) -> DataFrame:
    """id, score (cosine) of every row with an embedding."""
    return embedded.filter("embedding IS NOT NULL").select("id", vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])).alias("score"))


def semantic_search(embedded: DataFrame, vector: list[float], k: int = 10) -> DataFrame:
    return _top(semantic_scores(embedded, vector).select("id", F.round("score", 6).alias("score")), k)


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """id, rank. With k, the best k are found by a top-k that merges per task, and only those are numbered."""
    rows = _top(scored, k) if k else scored
    return rows.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))


def fuse(lists: list[tuple[DataFrame, float]], k: int = 10, c: int = RRF_K) -> DataFrame:
    """id, score: reciprocal rank fusion of (id, rank) lists with weights; ties go to what an earlier list names first."""
    parts = [r.select("id", (F.lit(float(w)) / (c + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("l"), "rank").alias("seen")) for i, (r, w) in enumerate(lists) if w > 0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("id").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    return fused.orderBy(F.desc("score"), "seen", "id").limit(k).select("id", F.round("score", 8).alias("score"))


def places(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, rank: the places that the rows of ``wanted`` (so few that they can be broadcast) have in the whole list.

    A row's rank is the number of rows that do not come after it, so the list is neither sorted nor gathered."""
    own = F.broadcast(scored.join(F.broadcast(wanted), "id").select(F.col("id").alias("own_id"), F.col("score").alias("own")))
    not_after = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("id") <= F.col("own_id")))
    return scored.join(own, not_after).groupBy(F.col("own_id").alias("id")).agg(F.count("*").cast("int").alias("rank"))


def hybrid_search(sections: DataFrame, embedded: DataFrame, query: str, vector: list[float] | None, weight: float = 0.5, k: int = 10, keep: DataFrame | None = None) -> DataFrame:
    """Fusion of the lexical and the vector ranking, both whole; of the sections in ``keep``, if given, and with the statistics of all.

    The k best rows of the list with the larger weight w have shares of w / (k + 60) or more. A row below place
    (k + 60) / w - 60 of both lists (weights add up to 1) has less than that from both together, so only rows above it
    in some list can be among the best k. For these the exact ranks in both lists are counted."""
    lexical = _kept(bm25_scores(index.terms(sections), query), keep)
    if vector is None:
        return _top(lexical.select("id", F.round("score", 6).alias("score")), k)
    weighted = [(lexical.withColumn("score", F.round("score", 9)), 1 - weight), (_kept(semantic_scores(embedded, vector), keep), weight)]
    lists = [(cut(scored, "ranking"), w) for scored, w in weighted if w > 0]  # a list is read three times
    most = max(w for _, w in lists)
    deep = math.ceil((k + RRF_K) * sum(w for _, w in lists) / most) - RRF_K + k
    wanted = None
    for scored, _ in lists:
        high = _top(scored, deep).select("id")
        wanted = high if wanted is None else wanted.unionByName(high)
    wanted = wanted.distinct()
    return fuse([(places(scored, wanted), w) for scored, w in lists], k)


def _lexical_by_repo(sections: DataFrame, query: str) -> DataFrame:
    """repo, id, score of the sections with a term of the query; statistics are per repo.

    Only the query's terms are kept before anything is grouped; what is joined to them has a row for each repo and term."""
    wanted = query_terms(sections, query)
    times = sections.sparkSession.createDataFrame([(t, wanted.count(t)) for t in dict.fromkeys(wanted)], "term string, times int")
    termed = cut(index.ancestor_text(sections).select("repo", "id", *[text.tokenize(F.col(f)).alias(f) for f in index.FIELDS]), "terms")
    stats = termed.groupBy("repo").agg(F.count("*").alias("n"), *[F.avg(F.size(f)).alias(f"avg_{f}") for f in index.FIELDS[:3]])
    small = termed.select("repo", "id", *[F.size(f).alias(f"n_{f}") for f in index.FIELDS], *[F.filter(f, lambda t: t.isin(*wanted)).alias(f) for f in index.FIELDS])
    parts = [small.select("repo", "id", F.lit(f).alias("field"), F.col(f"n_{f}").alias("dl"), F.explode(f).alias("term")) for f in index.FIELDS]
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    posted = each.groupBy("repo", "id", "field", "dl", "term").agg(F.count("*").alias("tf"))
    df = small.select("repo", F.explode(F.array_distinct(F.concat(*index.FIELDS[:3]))).alias("term")).groupBy("repo", "term").agg(F.count("*").alias("df"))
    met = posted.join(df, ["repo", "term"], "left").join(times, "term").join(stats, "repo")
    average, weight = F.greatest(F.col("avg_title"), F.lit(3.0)), F.lit(WEIGHTS["ancestors"])
    for f in index.FIELDS[:3]:
        average = F.when(F.col("field") == f, F.when(F.col(f"avg_{f}") > 0, F.col(f"avg_{f}")).otherwise(1.0)).otherwise(average)
        weight = F.when(F.col("field") == f, WEIGHTS[f]).otherwise(weight)
    part = weight * F.col("times") * idf(F.coalesce("df", F.lit(1)), F.col("n")) * bm25_part(F.col("tf"), F.col("dl"), average)
    return met.groupBy("repo", "id").agg(F.sum(part).alias("score")).filter("score > 0").withColumn("score", F.round("score", 9))


def group_search(sections: DataFrame, query: str, k: int = 10, filter_mode: str = "post", embedded: DataFrame | None = None, vector: list[float] | None = None, semantic_only: bool = False, semantic_weight: float = 0.5, **filters) -> DataFrame:
    """The search in each repo by itself, then fusion of the repos' lists: repo, id, score.

    Modes and filters are those of ``search_sections``: lexical, by vector (embedded: repo, id, embedding), or both fused
    within each repo; filters before ranking ("pre") or on what a repo's limit has left ("post")."""
    from .sections import filter_sections

    rows = filter_sections(sections, **filters) if filter_mode == "pre" and filters else sections
    rank = lambda name: F.row_number().over(W.partitionBy("repo").orderBy(F.desc("score"), "id")).alias(name)
    if vector is None:
        scored = _lexical_by_repo(rows, query).select("repo", "id", "score", F.lit(0).alias("list"), F.lit(0).alias("at"))
    else:
        like = vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))
        close = embedded.filter("embedding IS NOT NULL").join(rows.select("repo", "id"), ["repo", "id"], "left_semi").select("repo", "id", like.alias("score"))
        lists = [(close, 1.0)] if semantic_only else [(_lexical_by_repo(rows, query), 1 - semantic_weight), (close, semantic_weight)]
        parts = [x.select("repo", "id", rank("at"), F.lit(i).alias("list"), F.lit(float(w)).alias("w")) for i, (x, w) in enumerate(lists) if w > 0]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        fused = every.groupBy("repo", "id").agg(F.sum(F.col("w") / (RRF_K + F.col("at"))).alias("score"), F.min(F.struct("list", "at")).alias("seen"))
        scored = fused.select("repo", "id", "score", "seen.list", "seen.at")
    first = k * 5 if filters.get("role") else k
    place = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("score"), "list", "at", "id"))
    top = scored.withColumn("rank", place).filter(F.col("rank") <= first)
    if filter_mode == "post" and filters:
        kept = filter_sections(sections.join(top.select("repo", "id", "rank"), ["repo", "id"]), **filters)
        top = kept.select("repo", "id", F.row_number().over(W.partitionBy("repo").orderBy("rank")).alias("rank")).filter(F.col("rank") <= k)
    fused = top.select("repo", "id", (1.0 / (RRF_K + F.col("rank"))).alias("score"))
    return fused.orderBy(F.desc("score"), "repo", "id").limit(k).select("repo", "id", F.round("score", 8).alias("score"))


def dedupe(results: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of results (id, score) the best of each cluster (id, representative_id)."""
    named = results.join(clusters, "id", "left").withColumn("rep", F.coalesce("representative_id", "id"))
    first = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "id"))
    return named.withColumn("rn", first).filter("rn = 1").select("id", "score")


def boost_profile(results: DataFrame, profile: str) -> DataFrame:
    """Results (id, score, role) with the profile's roles first, else as they were."""
    return results.orderBy((~F.coalesce("role", F.lit("")).isin(*PROFILES[profile])).cast("int"), F.desc("score"), "id")


def confidence(results: DataFrame, query: str) -> DataFrame:
    """One row: how far ahead and how strong the first result is, and whether the first three hold an exact title or a stale one. results: id, title, score, and freshness if known."""
    rows = results if "freshness" in results.columns else results.withColumn("freshness", F.lit("fresh"))
    top = rows.orderBy(F.desc("score"), "id").limit(3).withColumn("rn", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    score = lambda k: F.coalesce(F.max(F.when(F.col("rn") == k, F.col("score"))), F.lit(0.0))
    named = F.coalesce(F.max((F.lower(F.trim("title")) == query.strip().lower()).cast("int")), F.lit(0))
    stale = F.coalesce(F.max((F.col("freshness") != "fresh").cast("int")), F.lit(0))
    one = top.agg(F.count("*").alias("n"), score(1).alias("s1"), score(2).alias("s2"), named.alias("named"), stale.alias("stale"))
    gap = F.when(F.col("s1") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("s1") - F.col("s2")) / F.col("s1")))).otherwise(0.0)
    parts = {"gap": (0.35, gap), "strength": (0.35, text.saturate(F.col("s1"), 4.0)), "identity": (0.15, F.when((F.col("named") == 1) & F.lit(bool(query.strip())), 1.0).otherwise(0.7)), "freshness": (0.15, F.when(F.col("stale") == 1, 0.6).otherwise(1.0))}
    value = F.lit(0.0)
    for w, x in parts.values():
        value = value + w * F.log(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), x)))
    return one.select(F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.exp(value), 4)).alias("confidence"), *[F.round(x, 4).alias(k) for k, (_, x) in parts.items()])


def search_sections(sections: DataFrame, query: str, max_results: int = 10, filter_mode: str = "post", profile: str | None = None, clusters: DataFrame | None = None, min_answerability: float | None = None, min_quotability: float | None = None, embedded: DataFrame | None = None, vector: list[float] | None = None, semantic_only: bool = False, semantic_weight: float = 0.5, **filters) -> DataFrame:
    """The whole search: rank, limit, filter, dedupe, reorder, gate by quality.

    filter_mode "post" filters what the limit has left, as the engine's users know it; "pre" filters before the limit, and so fills it.
    Statistics are those of all sections in both modes."""
    from .sections import filter_sections

    keep = None
    if filter_mode == "pre":
        keep = filter_sections(sections, **filters)
    elif filters.get("doc_path"):
        keep = sections.filter(F.col("doc_path") == filters["doc_path"])
    first = max_results * 5 if filters.get("role") else max_results
    if semantic_only and vector is not None:
        found = _top(_kept(semantic_scores(embedded, vector), keep).select("id", F.round("score", 6).alias("score")), first)
    elif vector is not None:
        found = hybrid_search(sections, embedded, query, vector, semantic_weight, first, keep)
    else:
        found = lexical_search(sections, query, first, keep, top=index.TOP_TERMS).select("id", "score")
    out = found.join(sections, "id")
    if filter_mode == "post":
        out = filter_sections(out, **filters)
    if clusters is not None:
        out = out.join(dedupe(out.select("id", "score"), clusters).select("id"), "id", "left_semi")
    out = out.withColumns({"answerability": text.answerability(F.col("content")), "quotability": text.quotability(F.col("content"))})
    if min_answerability is not None:
        out = out.filter(F.col("answerability") >= min_answerability)
    if min_quotability is not None:
        out = out.filter(F.col("quotability") >= min_quotability)
    out = boost_profile(out, profile) if profile and not filters.get("role") else out.orderBy(F.desc("score"), "id")
    return out.limit(max_results).select("id", "title", "doc_path", "level", "score", "answerability", "quotability")


def retrieval_metrics(ranked_: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """One row of mean nDCG, MRR and recall at k. ranked_: query, id, rank; wanted: query, id."""
    hits = wanted.join(ranked_.filter(F.col("rank") <= k), ["query", "id"], "left")
    per = hits.groupBy("query").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    mean = lambda x: F.round(F.avg(F.coalesce(x, F.lit(0.0))), 6)
    return per.agg(F.count("*").alias("n_queries"), mean(F.col("dcg") / ideal).alias("ndcg"), mean(1 / F.col("first")).alias("mrr"), mean(F.col("found") / F.col("n")).alias("recall"))
