"""URL filters: explicit host and path rules, then association rules mined with FP-growth.

Transactions are the distinct tokens of a labelled URL (scheme, host labels, path words), each URL once, plus an item
that says whether half or more of its labels are bad. Of tokens that stand in the same URLs throughout one takes part and
stands for all, and tokens in too few bad URLs take no part. FP-growth finds the combinations of up to ``RULE_ITEMS``
items that go with bad labels. Where URLs have many items, these are dealt into groups by hash, and a URL gives a
transaction for each block of up to ``RULE_ITEMS`` groups that it has items of, holding its items of those groups only:
a combination is counted whole in the block of just its own groups, and a block holds few items of a URL however long the URL
is. Rules below the support or confidence bounds are pruned, and so are rules that a shorter rule of no less
confidence already covers. Explicit rules are matched through an index by host, mined ones through an index
by each rule's rarest token, so a URL meets only rules that share it.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no explicit rule; repeated
URLs are judged once; a label without a verdict does not count; without labels, or with none that is bad, no rules are mined; an empty table gives no rows;
columns beyond the keys are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, settled, table

#: Explicit rules: host and path prefix, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label:bad"
MIN_COUNT, MIN_SUPPORT, MIN_CONFIDENCE = 10, 0.0005, 0.6
#: Items of a rule at most; items of a URL that need no groups, and about how many it has in a group where they do.
RULE_ITEMS, UNGROUPED, IN_GROUP = 3, 10, 3


def _rest(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, and words of the path."""
    scheme = F.concat(F.lit("scheme:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.split(F.lower(path_of(url)), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("path:"), x))
    return F.filter(F.array_distinct(F.concat(F.array(scheme), labels, words)), lambda x: ~x.isin("scheme:", "host:", "path:"))


def baskets_of(labelled: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Each URL's items (bad, items), and for each item the tokens it stands for (item, members)."""
    each = labelled.select("url", "bad", F.explode("tokens").alias("token"))
    # tokens with the same URLs have the same number of them, of bad ones, and the same sum of hashes
    use = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), F.sum(F.xxhash64("url").cast("decimal(38,0)")).alias("urls")).filter(F.col("b") >= least)
    groups = cut(use.groupBy("n", "b", "urls").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")), "items")  # as many as a URL has tokens
    held = each.join(groups.select(F.col("item").alias("token")), "token").groupBy("url").agg(F.collect_list("token").alias("items"))
    kept = labelled.select("url", "bad").join(held, "url", "left").select("bad", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return kept, groups.select("item", "members")


def _group(item: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(groups)).cast("int")


def blocks_of(baskets: DataFrame, groups: int, size: int = RULE_ITEMS) -> DataFrame:
    """A transaction (items) for each URL and block of up to ``size`` groups. An item carries the name of its block."""
    own = F.transform("items", lambda x: F.struct(_group(x, groups).alias("g"), x.alias("item")))
    dealt = baskets.select("bad", own.alias("own"), F.array_sort(F.array_distinct(F.transform("items", lambda x: _group(x, groups)))).alias("has"))
    sets = [F.transform("has", lambda g: F.array(g))]
    for _ in range(1, size):
        sets.append(F.flatten(F.transform(sets[-1], lambda c: F.transform(F.filter("has", lambda g: g > F.element_at(c, -1)), lambda g: F.array_append(c, g)))))
    each = dealt.select("bad", "own", F.explode(F.concat(*sets)).alias("block"))
    items = F.transform(F.filter("own", lambda x: F.array_contains("block", x["g"])), lambda x: x["item"])
    items = F.when(F.col("bad"), F.array_append(items, F.lit(BAD))).otherwise(items)
    name = F.array_join(F.col("block").cast("array<string>"), ".")
    return each.select(F.transform(items, lambda x: F.concat(name, F.lit("|"), x)).alias("items"))


def counted(sets: DataFrame, groups: int, size: int = RULE_ITEMS) -> DataFrame:
    """items, n, n_bad: combinations of up to ``size`` items, each from its own block. sets: what FP-growth has found (items, freq)."""
    cut_off = lambda x: F.substring(x, F.locate("|", x) + 1, F.length(x))
    found = sets.filter(F.size("items") <= size + 1).select(F.substring_index(F.col("items")[0], "|", 1).alias("block"), F.array_sort(F.transform("items", cut_off)).alias("items"), "freq")
    found = found.select("block", F.array_remove("items", BAD).alias("items"), F.array_contains("items", BAD).alias("bad"), "freq").filter(F.size("items").between(1, size))
    own = F.array_join(F.array_sort(F.array_distinct(F.transform("items", lambda x: _group(x, groups)))).cast("array<string>"), ".")
    return found.filter(own == F.col("block")).groupBy("items").agg(F.max(F.when(~F.col("bad"), F.col("freq"))).alias("n"), F.max(F.when(F.col("bad"), F.col("freq"))).alias("n_bad"))


def without_covered(rules: DataFrame) -> DataFrame:
    """Rules (rule_id, items, confidence, support) without those that hold all items of a shorter rule of no less confidence."""
    short = rules.select("items", "confidence").alias("a")
    long = rules.select("rule_id", "items", "confidence", F.explode("items").alias("token")).alias("b")
    within = F.size(F.array_except("a.items", "b.items")) == 0
    met = long.join(short, (F.col("b.token") == F.col("a.items")[0]) & (F.size("a.items") < F.size("b.items")) & (F.col("a.confidence") >= F.col("b.confidence")) & within)
    return rules.join(met.select("rule_id").distinct(), "rule_id", "left_anti")


def mine_rules(labelled: DataFrame, min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id, items, confidence, support, from rows with ``url``, ``tokens`` and ``bad``, one for each URL."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    schema = "rule_id long, items array<string>, confidence double, support double"
    labelled = cut(labelled.select("url", "tokens", "bad"), "labelled")
    total, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return spark.createDataFrame([], schema)
    least = math.ceil(max(min_count, min_support * total))
    baskets, members = baskets_of(labelled, least)
    baskets = cut(baskets, "baskets")
    longest = baskets.agg(F.max(F.size("items"))).first()[0]
    groups = 1 if longest <= UNGROUPED else -(-longest // IN_GROUP)
    transactions = cut(blocks_of(baskets, groups), "transactions")
    rows = transactions.count()
    if not rows:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / rows), minConfidence=min_confidence).fit(transactions)
    found = counted(model.freqItemsets, groups).filter((F.col("n_bad") >= least) & (F.col("n_bad") >= min_confidence * F.col("n")))
    found = cut(found.select(F.monotonically_increasing_id().alias("rule_id"), "items", (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / F.lit(total)).alias("support")), "found")
    whole = found.select("rule_id", F.explode("items").alias("item")).join(members, "item").groupBy("rule_id").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("items"))
    rules = found.drop("items").join(whole, "rule_id").select(F.xxhash64(F.array_join("items", "\n")).alias("rule_id"), "items", "confidence", "support")
    return without_covered(cut(rules, "rules"))


def explicit_hits(parsed: DataFrame, rules) -> DataFrame:
    """key, rule, rule_verdict: the longest explicit rule of each URL that fits one. parsed: key, host, path."""
    spark = parsed.sparkSession
    rows = [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, verdict) for r, verdict in rules]
    deepest = max(len(x[0].split(".")) for x in rows)  # a longer suffix fits no rule
    index = spark.createDataFrame(rows, "suffix string, prefix string, rule string, rule_verdict string")
    ends = F.array(*[F.substring_index("host", ".", -n) for n in range(1, deepest + 1)])
    near = parsed.select("key", "path", F.explode(F.array_distinct(ends)).alias("suffix"))
    fits = near.join(index, "suffix").filter(F.startswith("path", F.col("prefix")))
    best = fits.groupBy("key").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("b"))
    return best.select("key", "b.rule", "b.rule_verdict")


def mined_hits(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """key, mined_confidence: URLs that hold all tokens of a mined rule. tokens: key, tokens."""
    common = rules.select("rule_id", "items", "confidence", F.explode("items").alias("token"))
    counts = common.groupBy("token").agg(F.count("*").alias("n"))
    rarest = common.join(counts, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("items").alias("items"), F.first("confidence").alias("confidence"))
    near = tokens.select("key", "tokens", F.explode("tokens").alias("token")).join(rarest, "token")
    fits = near.filter(F.size(F.array_except("items", "tokens")) == 0)
    return fits.groupBy("key").agg(F.max("confidence").alias("mined_confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame | None, rules=RULES, **bounds) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, rule, verdict and mined_confidence. ``labels``: page_id and bad."""
    keyed = pages.select("page_id", "url", F.coalesce("url", F.lit("")).alias("key"))
    parsed = cut(keyed.select("key").distinct().select("key", host_of(F.col("key")).alias("host"), path_of(F.col("key")).alias("path"), tokens_of(F.col("key")).alias("tokens")), "urls")
    out = keyed.join(explicit_hits(parsed, rules), "key", "left")
    if labels is None:
        out = out.withColumn("mined_confidence", F.lit(None).cast("double"))
    else:
        votes = keyed.select("page_id", "key").join(labels.select("page_id", "bad").filter("bad IS NOT NULL"), "page_id")
        votes = votes.groupBy(F.col("key").alias("url")).agg((F.count_if("bad") * 2 >= F.count("*")).alias("bad")).withColumn("tokens", tokens_of(F.col("url")))
        mined = cut(mine_rules(votes, **bounds), "rules")
        out = out.join(mined_hits(parsed, mined), "key", "left")
    method = F.when(F.col("mined_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("rule_verdict", method).alias("verdict"), "mined_confidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return settled(spark, lambda: judge_urls(table(spark, sf_dir, "pages"), labels.filter("bad IS NOT NULL")), "judged")
