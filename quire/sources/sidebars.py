"""Sidebars from the settings files of documentation sites.

A settings file is JSON; its sidebar is a list of paths, or of groups with a link and children, nested as deep as a site likes.
The file is parsed once, as a variant. Its containers are opened level by level, and each entry keeps the way to it, so
the order of the file is the order of the ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import cut

#: Where a site keeps its settings, below its root.
SETTINGS = ".vuepress/config.json"


def entries(settings: DataFrame) -> DataFrame:
    """root, way, href: the sidebar's entries of each settings file (doc_path, text), in the order of way. root: the file's path.

    Text that is not JSON, or has no sidebar, gives no entries; so do values that are neither text, list nor group."""
    parsed = settings.select(F.col("doc_path").alias("root"), F.expr("try_parse_json(text)").alias("v"))
    sidebar = F.coalesce(F.expr("try_variant_get(v, '$.themeConfig.sidebar', 'variant')"), F.expr("try_variant_get(v, '$.sidebar', 'variant')"))
    nodes = cut(parsed.select("root", F.expr("array(0)").alias("way"), sidebar.cast("string").alias("node")).filter("node IS NOT NULL"), "nodes")
    out = None
    while True:
        # a node is a list, a group, or text; text that looks like JSON can only be meant as text where it is a leaf, which is marked
        typed = nodes.select("root", "way", "node", F.expr("try_parse_json(node)").alias("v")).withColumn("kind", F.expr("schema_of_variant(v)"))
        group = typed.filter(F.startswith("kind", F.lit("OBJECT")))
        link = F.coalesce(F.nullif(F.expr("try_variant_get(v, '$.link', 'string')"), F.lit("")), F.expr("try_variant_get(v, '$.path', 'string')"))
        linked = group.select("root", F.array_append("way", F.lit(-1)).alias("way"), link.alias("href")).filter("href IS NOT NULL")
        kids = F.coalesce(F.expr("try_variant_get(v, '$.children', 'array<variant>')"), F.expr("try_variant_get(v, '$.items', 'array<variant>')"))
        lists = typed.filter(F.startswith("kind", F.lit("ARRAY"))).select("root", "way", F.expr("try_variant_get(v, '$', 'array<variant>')").alias("kids")).unionByName(group.select("root", "way", kids.alias("kids")))
        each = lists.select("root", "way", F.posexplode("kids").alias("at", "kid")).select("root", F.array_append("way", F.col("at")).alias("way"), "kid")
        each = each.withColumn("kind", F.expr("schema_of_variant(kid)"))
        leaves = each.filter("kind = 'STRING'").select("root", "way", F.expr("try_variant_get(kid, '$', 'string')").alias("href"))
        found = linked.unionByName(leaves)
        out = found if out is None else out.unionByName(found)
        nodes = cut(each.filter(F.startswith("kind", F.lit("OBJECT")) | F.startswith("kind", F.lit("ARRAY"))).select("root", "way", F.to_json("kid").alias("node")), "nodes")
        if not nodes.limit(1).count():
            return out


def sidebars(settings: DataFrame, docs: DataFrame) -> DataFrame:
    """root, at, next: the documents of each sidebar in order, once each. docs: doc_path of what there is.

    An entry is looked for as it stands, as a Markdown file, and as the first page of a folder; entries that lead nowhere are passed over."""
    p = F.regexp_replace("href", "^/+", "")
    folder = F.regexp_replace(p, "/+$", "")
    inside = lambda name: F.when(~F.endswith(p, F.lit(".md")), F.concat(folder, F.when(folder != "", F.lit("/")).otherwise(F.lit("")), F.lit(name)))
    tries = F.array_compact(F.array(p, F.concat(p, F.lit(".md")), inside("README.md"), inside("index.md"), F.concat(folder, F.lit(".md"))))
    tried = entries(settings).select("root", "way", F.posexplode(tries).alias("choice", "next"))
    there = tried.join(docs.select(F.col("doc_path").alias("next")).distinct(), "next", "left_semi")
    chosen = there.groupBy("root", "way").agg(F.min(F.struct("choice", "next"))["next"].alias("next"))
    once = chosen.groupBy("root", "next").agg(F.min("way").alias("way"))
    return once.select("root", (F.row_number().over(W.partitionBy("root").orderBy("way")) - 1).alias("at"), "next")
