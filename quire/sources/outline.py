"""From text to sections: find the headings, then cut the text at them.

Every finder gives headings as (first line, level, title); everything up to the next heading belongs to a section, and
what stands before the first heading is the document's root, of level 0. Sections of a document do not overlap, and
their byte ranges cover it.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from itertools import pairwise

ATX = re.compile(r"^(#{1,6})\s+(.+?)(?:\s+#+\s*)?$")
ADOC = re.compile(r"^(={1,6})\s+(.+?)(?:\s+=+\s*)?$")
FENCE = re.compile(r"^(`{3,}|~{3,})\s*([\w.+-]*)\s*$")
#: How a line opens that may be a heading, the line under one, or a fence.
MARKS = ("#", "=", "--", "```", "~~~")
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Heading:
    line: int
    level: int
    title: str


@dataclass
class Found:
    headings: list[Heading] = field(default_factory=list)
    blocks: list[tuple[int, int, str]] = field(default_factory=list)  # first line, line after the last, language


def slugify(text: str) -> str:
    text = re.sub(r"[^\w\s-]", "", text.lower().strip())
    return re.sub(r"-+", "-", re.sub(r"[\s_]+", "-", text)).strip("-") or "section"


class Slugs:
    """Slugs of one document: a heading's is that of its ancestors, and its own; repeats are numbered."""

    def __init__(self) -> None:
        self.times: dict[str, int] = {}
        self.path: list[tuple[int, str]] = []

    def unique(self, slug: str) -> str:
        if slug not in self.times:
            self.times[slug] = 1
            return slug
        n = self.times[slug] + 1
        while f"{slug}-{n}" in self.times:
            n += 1
        self.times[slug], self.times[f"{slug}-{n}"] = n, 1
        return f"{slug}-{n}"

    def under(self, title: str, level: int) -> str:
        self.path = [(lv, s) for lv, s in self.path if lv < level]
        own = slugify(title)
        slug = self.unique(f"{self.path[-1][1]}/{own}" if self.path else own)
        self.path.append((level, slug))
        return slug


def _bare(line: str) -> str:
    return line.rstrip("\n").rstrip("\r")


def find_markdown(lines: list[str]) -> Found:
    """Headings with number signs or underlines, outside fenced code and front matter."""
    out = Found()
    start = 0
    if lines and lines[0].strip() == "---":
        start = next((i + 1 for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
    fence: tuple[str, int, str, int] | None = None  # character, length, language, first line of the body
    before = ""
    for i in range(start, len(lines)):
        line = _bare(lines[i])
        if fence:
            inner = line.lstrip()
            run = len(inner) - len(inner.lstrip(fence[0]))
            if run >= fence[1] and not inner[run:].strip():
                out.blocks.append((fence[3], i, fence[2]))
                fence = None
        elif not line.startswith(MARKS):
            pass
        elif opened := FENCE.match(line):
            fence = opened[1][0], len(opened[1]), opened[2], i + 1
        else:
            above = before.strip()
            under = re.fullmatch(r"(=+|-{2,})\s*", line) if above and "|" not in above and i else None
            if under:
                if out.headings and out.headings[-1].line == i - 1:
                    out.headings.pop()
                out.headings.append(Heading(i - 1, 1 if under[1][0] == "=" else 2, above))
            elif atx := ATX.match(line):
                out.headings.append(Heading(i, len(atx[1]), atx[2].strip()))
        before = line
    return out


def find_asciidoc(lines: list[str]) -> Found:
    hits = ((i, ADOC.match(_bare(x))) for i, x in enumerate(lines))
    return Found([Heading(i, len(m[1]), m[2].strip()) for i, m in hits if m])


def _adorns(line: str) -> bool:
    return len(line) >= 2 and line[0] in PUNCTUATION and line == line[0] * len(line)


def find_rst(lines: list[str]) -> Found:
    """Titles with a line under them, or over and under; levels in the order in which the styles come up."""
    bare = [_bare(x) for x in lines]
    styles: dict[tuple[str, bool], int] = {}
    out = Found()
    i = 0
    while i < len(bare):
        over = bare[i : i + 3]
        if len(over) == 3 and _adorns(over[0]) and over[1].strip() and not _adorns(over[1]) and _adorns(over[2]) and over[0][0] == over[2][0] and len(over[0]) >= len(over[1].strip()):
            out.headings.append(Heading(i, styles.setdefault((over[0][0], True), len(styles) + 1), over[1].strip()))
            i += 3
        elif len(over) > 1 and over[0].strip() and not _adorns(over[0]) and _adorns(over[1]) and len(over[1]) >= len(over[0].strip()):
            out.headings.append(Heading(i, styles.setdefault((over[1][0], False), len(styles) + 1), over[0].strip()))
            i += 2
        else:
            i += 1
    return out


def _row(repo: str, doc_path: str, seq: int, title: str, level: int, slug: str, start: int, end: int, content: str, **more) -> dict:
    return {
        "repo": repo, "doc_path": doc_path, "seq": seq, "id": f"{repo}::{doc_path}::{slug}#{level}", "title": title, "level": level, "parent_id": "", "children": [],
        "byte_start": start, "byte_end": end, "content": content, "code_blocks": [], "metadata": "", "summary": "",
    } | more


def cut_at(found: Found, text: str, lines: list[str], doc_path: str, repo: str) -> list[dict]:
    stem = os.path.splitext(os.path.basename(doc_path))[0]
    slugs = Slugs()
    marks = [Heading(0, 0, stem), *found.headings]
    # bytes before the lines where something opens or ends
    places = sorted({0, len(lines), *(h.line for h in marks), *(x for b in found.blocks for x in b[:2])})
    offsets = {0: 0}
    for a, b in pairwise(places):
        offsets[b] = offsets[a] + len("".join(lines[a:b]).encode("utf-8", "surrogatepass"))
    rows = []
    for n, h in enumerate(marks):
        last = marks[n + 1].line if n + 1 < len(marks) else len(lines)
        slug = slugify(stem) if h.level == 0 else slugs.under(h.title, h.level)
        row = _row(repo, doc_path, n, h.title, h.level, slug, offsets[h.line], offsets[last], "".join(lines[h.line : last]))
        own = [b for b in found.blocks if h.line <= b[0] <= last and b[1] <= last]
        row["code_blocks"] = [{"block_id": f"{row['id']}::code#{k}", "lang": lang, "content": "".join(lines[a:b]), "byte_start": offsets[a], "byte_end": offsets[b]} for k, (a, b, lang) in enumerate(own)]
        rows.append(row)
    return rows


def paragraphs(text: str, lines: list[str], doc_path: str, repo: str) -> list[dict]:
    """Plain text: each run of lines that are not blank is a section of level 1, named by its first line."""
    slugs = Slugs()
    rows, start, at = [], None, 0
    places = [0]
    for x in lines:
        places.append(places[-1] + len(x.encode("utf-8", "surrogatepass")))
    for i, x in enumerate([*lines, ""]):
        if x.strip() and start is None:
            start = i
        elif not x.strip() and start is not None:
            title = lines[start].strip()[:80]
            rows.append(_row(repo, doc_path, at, title, 1, slugs.unique(slugify(title)), places[start], places[i], "".join(lines[start:i])))
            start, at = None, at + 1
    if not rows:
        stem = os.path.splitext(os.path.basename(doc_path))[0]
        rows = [_row(repo, doc_path, 0, stem, 0, slugify(stem), 0, places[-1], text)]
    return rows


def wire(rows: list[dict]) -> list[dict]:
    """Sets parent_id and children: the parent is the nearest section before of a lower level; level 0 starts anew."""
    open_: list[dict] = []
    for row in rows:
        open_ = [] if row["level"] == 0 else [x for x in open_ if x["level"] < row["level"]]
        row["parent_id"] = open_[-1]["id"] if open_ else ""
        row["children"] = []
        if open_:
            open_[-1]["children"].append(row["id"])
        open_.append(row)
    return rows
