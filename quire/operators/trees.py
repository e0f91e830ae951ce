"""Labels that turn walks in the section tree into range filters.

Each section gets its root, its depth, and an interval: it enters when a walk through the tree (parents first, siblings in
order) meets it, and leaves with the last section below it. What lies below a section enters within its interval, and the
sections above it are those whose intervals hold its own. Labels come from pointers that double: after k rounds a section
knows its ancestor 2^k levels up, so a tree of any depth takes as many rounds as its depth has binary digits, each a join
by id. There is no limit of depth or rows.

Defined cases: a parent that is not there, the section itself, or null makes a root; the sections of a loop are broken
up at the smallest id, which counts as their root; ids are taken to be unique; an empty table gives no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .ranks import running

LABELS = ("id", "root", "depth", "enter", "leave")


def _up(step: DataFrame, columns: dict) -> DataFrame:
    """One doubling: ``columns`` are worked out of a row and its ancestor's (whose columns start with an a), and the pointer goes on."""
    above = step.select(*[F.col(c).alias(f"a_{c}") for c in step.columns])
    met = step.join(above, F.col("up") == F.col("a_id"), "left")
    kept = {c: F.col(c) for c in step.columns} | columns | {"up": F.col("a_up")}
    return cut(met.select(*[kept[c].alias(c) for c in step.columns]), "labels")


def _open(step: DataFrame) -> bool:
    return step.filter("up IS NOT NULL").limit(1).count() > 0


def _without_loops(edges: DataFrame) -> DataFrame:
    """id, up: as they were, but loops end at their smallest id."""
    rounds = edges.count().bit_length()
    step = edges.select("id", "up", F.col("id").alias("least"))
    for _ in range(rounds + 1):
        if not _open(step):
            return edges
        step = _up(step, {"least": F.least("least", F.coalesce("a_least", "least"))})
    # what is left hangs on loops, and points at their members; these know the least of a whole turn
    members = step.filter("up IS NOT NULL").select(F.col("up").alias("id")).distinct()
    ends = step.join(members, "id", "left_semi").filter("id = least").select(F.col("id").alias("end"))
    return edges.join(ends, F.col("id") == F.col("end"), "left").select("id", F.when(F.col("end").isNull(), F.col("up")).alias("up"))


def labels(sections: DataFrame, order: tuple[str, ...] = ("byte_start", "seq")) -> DataFrame:
    """id, root, depth, enter, leave of every section."""
    s = sections.select("id", "parent_id", *order)
    there = s.select(F.col("id").alias("up"))
    linked = s.filter((F.col("parent_id") != "") & (F.col("parent_id") != F.col("id"))).select("id", F.col("parent_id").alias("up")).join(there, "up", "left_semi")
    edges = cut(s.select("id").join(linked, "id", "left"), "edges")
    edges = cut(_without_loops(edges), "edges")

    # how many sections lie in each subtree: those less than 2^k levels down, and then those of the ones that lie 2^k down
    step = edges.withColumn("size", F.lit(1).cast("long"))
    while _open(step):
        below = step.filter("up IS NOT NULL").groupBy(F.col("up").alias("b_id")).agg(F.sum("size").alias("b_size"))
        step = cut(step.join(below, F.col("id") == F.col("b_id"), "left").withColumn("size", F.col("size") + F.coalesce("b_size", F.lit(0))).drop("b_id", "b_size"), "sizes")
        step = _up(step, {})

    # a section enters one after its parent and all that lies under earlier siblings
    sized = edges.join(step.select("id", "size"), "id").join(s.select("id", *order), "id")
    placed = running(sized.filter("up IS NOT NULL"), ["up"], [*order, "id"], F.col("size"), "upto")
    placed = placed.select("id", "up", "size", (F.col("upto") - F.col("size") + 1).alias("enter"), F.lit(1).alias("depth"))
    roots = sized.filter("up IS NULL").select("id", "up", "size", F.lit(0).cast("long").alias("enter"), F.lit(0).alias("depth"))
    step = cut(placed.unionByName(roots).withColumn("root", F.coalesce("up", "id")), "labels")
    while _open(step):
        more = lambda c: F.col(c) + F.coalesce(f"a_{c}", F.lit(0))
        step = _up(step, {"enter": more("enter"), "depth": more("depth"), "root": F.coalesce("a_root", "root")})
    return step.select("id", "root", "depth", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def _with(sections: DataFrame, section_id: str, labelled: DataFrame | None) -> DataFrame:
    """All labelled sections of the tree of one section, and that section's own labels (o_...), one row that is broadcast."""
    found = labels(sections) if labelled is None else labelled.select(*LABELS)
    own = F.broadcast(found.filter(F.col("id") == section_id).limit(1).select(*[F.col(c).alias(f"o_{c}") for c in LABELS]))
    return found.join(own, F.col("root") == F.col("o_root"))


def below(sections: DataFrame, section_id: str, max_depth: int | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """depth, id, title of all sections below one, to ``max_depth`` levels."""
    met = _with(sections, section_id, labelled).filter("enter > o_enter AND enter <= o_leave").withColumn("depth", F.col("depth") - F.col("o_depth"))
    met = met if max_depth is None else met.filter(F.col("depth") <= max_depth)
    return met.select("id", "depth").join(sections.select("id", "title"), "id").select("depth", "id", "title")


def above(sections: DataFrame, section_id: str, labelled: DataFrame | None = None) -> DataFrame:
    """depth, id, title from a section (0) up to its root."""
    met = _with(sections, section_id, labelled).filter("enter <= o_enter AND leave >= o_enter")
    return met.select("id", (F.col("o_depth") - F.col("depth")).alias("depth")).join(sections.select("id", "title"), "id").select("depth", "id", "title")
