"""Paths and links as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTERNAL = r"^(?:https?://|ftp://|mailto:|tel:)"

#: A part and the ``..`` behind it, where another part follows; an empty part, ``.`` or ``..``.
LEFT_AGAIN, TO_SETTLE = r"(?<![^/])(?!\.{1,2}/)[^/]+/\.\./(?=[^/])", r"(?:^|/)\.{0,2}(?:/|\z)"


def is_external(href: Column) -> Column:
    return F.regexp_like(href, F.lit(EXTERNAL))


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def normpath(path: Column) -> Column:
    """Without empty and ``.`` parts; ``..`` takes the part before it with it. An empty path is ``.``.

    Most links name a folder and leave it once or twice. Two replacements settle these, and only what then still has such parts is taken apart."""
    short = path
    for _ in range(2):
        short = F.regexp_replace(short, LEFT_AGAIN, "")
    return F.when(~F.regexp_like(short, F.lit(TO_SETTLE)), short).otherwise(_normpath(path))


def _normpath(path: Column) -> Column:
    def step(out: Column, part: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        up = (part == "..") & (F.size(out) > 0) & (last != "..")
        return F.when((part == "") | (part == "."), out).when(up, F.slice(out, 1, F.size(out) - 1)).otherwise(F.concat(out, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    rooted = F.startswith(path, F.lit("/"))
    parts = F.when(rooted, F.filter(parts, lambda x: x != "..")).otherwise(parts)
    joined = F.array_join(parts, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def resolve(source_doc: Column, target: Column) -> Column:
    """Where a link in a document leads: from the root with a leading slash, else from the document's folder."""
    from_root = F.regexp_replace(target, "^/+", "")
    folder = dirname(source_doc)
    joined = F.when(folder == "", target).otherwise(F.concat(folder, F.lit("/"), target))
    return normpath(F.when(F.startswith(target, F.lit("/")), from_root).otherwise(joined))


def file_part(href: Column) -> Column:
    return F.trim(F.substring_index(href, "#", 1))


def anchor_part(href: Column) -> Column:
    return F.when(F.contains(href, F.lit("#")), F.trim(F.regexp_replace(href, "^[^#]*#", ""))).otherwise(F.lit(""))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` crosses slashes."""
    import fnmatch

    return "(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    return F.regexp_like(path, F.lit(glob_regex(pattern)))


def slug_of(section_id: Column) -> Column:
    """The slug in ``repo::doc::slug#level``."""
    return F.substring_index(F.substring_index(section_id, "::", -1), "#", 1)


def leaf_of(slug: Column) -> Column:
    return F.substring_index(slug, "/", -1)


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """Regular expressions over relative paths for the lines of an ignore file, in order, each with whether it ignores or takes back.

    A pattern without an inner slash fits at any depth; one that ends with a slash fits folders only; what lies in a
    folder that fits is ignored with it."""
    rules = []
    for line in lines:
        line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        pattern = line[back:].removeprefix("\\")
        folder = pattern.endswith("/")
        pattern = pattern.rstrip("/")
        if not pattern:
            continue
        anywhere = "/" not in pattern
        made, i, pattern = "", 0, pattern.removeprefix("/")
        while i < len(pattern):
            rest = pattern[i:]
            if rest.startswith("**/"):
                made, i = made + "(?:.*/)?", i + 3
            elif rest == "**":
                made, i = made + ".*", i + 2
            elif rest[0] == "*":
                made, i = made + "[^/]*", i + len(rest) - len(rest.lstrip("*"))
            elif rest[0] == "?":
                made, i = made + "[^/]", i + 1
            elif rest[0] == "[" and "]" in rest[2:]:
                end = rest.index("]", 2)
                inside = rest[1:end].replace("\\", "\\\\")
                made, i = made + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", i + end + 1
            else:
                if rest[0] == "\\" and len(rest) > 1:
                    i, rest = i + 1, rest[1:]
                made, i = made + re.escape(rest[0]), i + 1
        rules.append((f"^{'(?:.*/)?' if anywhere else ''}{made}{'/.*' if folder else '(?:/.*)?'}$", not back))
    return rules


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last rule that fits a path ignores it."""
    out = F.lit(False)
    for pattern, ignores in ignore_rules(lines):
        out = F.when(F.regexp_like(path, F.lit(pattern)), F.lit(ignores)).otherwise(out)
    return out
