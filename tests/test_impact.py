"""Walks of many sources at once, beside single ones and plain loops."""

import random

from quire.operators import links

SCHEMA = "resolved string, source_doc string, source_section_id string, seq int, ref_at int, anchor string"


def made(seed, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(200):
        a, b = f"d{rng.randrange(n):02d}", f"d{min(rng.randrange(n), rng.randrange(n)):02d}"
        out.append((rng.choice([b, b, b, None]), a, f"{a}::s{i % 3}", i % 3, i, rng.choice(["", "part", "other-Part"])))
    return out


def plain(rows, doc, slug, depth):
    seen, frontier, out = {doc}, {doc}, []
    for d in range(1, depth + 1):
        step = {}
        for to, at, section, seq, ref, anchor in sorted((r for r in rows if r[0] in frontier and r[0] != r[1] and r[1] not in seen), key=lambda r: (r[3], r[4], r[0])):
            kind = "anchor" if d == 1 and slug and anchor and slug in anchor.lower() else "doc"
            step.setdefault(at, (d, at, section, to, kind))
        out += step.values()
        seen |= set(step)
        frontier = set(step)
    return sorted(out)


def test_many_sources_walk_as_one_would(spark):
    rows = made(3)
    table = spark.createDataFrame(rows, SCHEMA)
    asked = [(i, f"d{i % 40:02d}", ["", "part"][i % 2]) for i in range(60)] + [(99, "nowhere", "x")]
    sources = spark.createDataFrame(asked, "source int, doc_path string, slug string")
    got = {}
    for r in links.impact_each(table, sources, 3, most=None).collect():
        got.setdefault(r["source"], []).append(tuple(r)[1:])
    for i, doc, slug in asked:
        assert sorted(got.get(i, [])) == plain(rows, doc, slug, 3), (i, doc)
    capped = links.impact_each(table, sources, 3, most=2).groupBy("source", (links.F.col("depth") == 1).alias("direct")).count().collect()
    assert max(r["count"] for r in capped) == 2
    one = sorted(tuple(r) for r in links.impact(table, "d01", "part", 3, most=2).collect())
    assert one == sorted(tuple(r)[1:] for r in links.impact_each(table, sources, 3, most=2).filter("source = 1").collect())


def test_a_thousand_changed_sections_have_one_plan(spark):
    table = spark.createDataFrame([(*r[:6],) for r in made(5, 300)], SCHEMA)
    sections = spark.createDataFrame([(i,) for i in range(500)], "n int")
    sources = spark.createDataFrame([(i, f"d{i % 300:02d}", "part") for i in range(1000)], "source int, doc_path string, slug string")
    got = links.blast_radius_each(sections, table, sources, most=None).collect()
    assert len(got) == 1000 and sum(r["direct"] for r in got) > 100
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["source"] % 300, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by_doc.values())
