"""Finding files, and turning them into rows of sections."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..scratch import bounded_batches, read_small
from . import convert, openapi, outline

# The format of each file ending.
FORMATS = {
    ".md": "markdown", ".markdown": "markdown", ".mdx": "mdx", ".txt": "text", ".rst": "rst", ".adoc": "asciidoc", ".asciidoc": "asciidoc", ".asc": "asciidoc",
    ".ipynb": "notebook", ".html": "html", ".htm": "html", ".yaml": "openapi", ".yml": "openapi", ".json": "json", ".jsonc": "json", ".xml": "xml", ".svg": "xml",
    ".xhtml": "xml", ".tscn": "godot", ".tres": "godot",
}
# Folders that are passed over, and names of files that may hold secrets.
SKIPPED_FOLDERS = ("node_modules", "vendor", "venv", ".venv", "__pycache__", "dist", "build", ".git", ".tox", ".mypy_cache", ".gradle", "target")
SECRET_NAMES = (
    "*.env", ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.credentials", "*.keystore", "*.jks", "*.token", "*secret*", "id_rsa", "id_rsa.*",
    "id_ed25519", "id_ed25519.*", "id_dsa", "id_ecdsa", ".htpasswd", ".netrc", ".npmrc", ".pypirc", "credentials.json", "service-account*.json", "*.secrets",
)
MAX_FILES, MAX_BYTES = 10_000, 500 * 1024

SECTION = (
    "repo string, doc_path string, seq int, id string, title string, level int, parent_id string, children array<string>, byte_start bigint, byte_end bigint, content string, "
    "summary string, code_blocks array<struct<block_id:string,lang:string,content:string,byte_start:bigint,byte_end:bigint>>, metadata string"
)
#: What the columns that ``enrich`` adds are made of.
MADE_OF = {"content_hash": ("content",), "references": ("content",), "tags": ("content",), "summary": ("summary", "title", "level")}


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.regexp_like(name, F.lit(r"[^.]\.[^.]+$")), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise(F.lit(""))


def is_secret(path: Column) -> Column:
    low = F.lower(path)
    hits = [paths.matches_glob(x, p) for p in SECRET_NAMES for x in (F.substring_index(low, "/", -1), low)]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def wanted(path: Column, length: Column, ignore: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> Column:
    """The scan's tests of a relative path and a size."""
    folders = "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS)
    ok = ~F.regexp_like(path, F.lit(rf"(?:^|/)(?:{folders})/")) & extension(path).isin(*FORMATS) & (length <= max_bytes) & ~is_secret(path) & ~F.regexp_like(path, F.lit(r"(?:^|/)\.\.(?:/|$)"))
    for pattern in ignore:
        inside = pattern.rstrip("/")
        ok = ok & ~(paths.matches_glob(path, pattern) | paths.matches_glob(F.substring_index(path, "/", -1), pattern) | F.regexp_like(path, F.lit(rf"(?:^|/){inside.replace('.', chr(92) + '.')}/" if "*" not in inside else r"(?!)")))
    return ok


def inside(only: tuple[str, ...]) -> list[str]:
    """Relative paths without repeats, in normal form; those that lead out of the folder are dropped."""
    normal = (posixpath.normpath(p.replace(os.sep, "/").strip()) for p in only if p.strip())
    return list(dict.fromkeys(p for p in normal if not p.startswith(("/", "../")) and p != ".."))


def _escapes(root: str, relative: str) -> bool:
    """Whether a path of a local folder is a link that leads out of it."""
    real = os.path.realpath(root)
    return os.path.commonpath([real, os.path.realpath(os.path.join(root, relative))]) != real


def scan(spark: SparkSession, folder: str, repo: str, ignore: tuple[str, ...] = (), max_files: int = MAX_FILES, only: tuple[str, ...] = (), sort_by: str = "newest", follow_symlinks: bool = False) -> DataFrame:
    """repo, doc_path, raw (binary), modified: the files of a folder that are documents.

    With more than ``max_files`` the newest stay, or with ``sort_by="walk_order"`` the first by path. ``only`` limits the
    scan to relative paths, which may be folders; those outside the folder are passed over. The folder's .gitignore holds. Links out of
    a local folder are not followed unless asked for. Files are listed and chosen without their content; then only those chosen are read."""
    root = folder.rstrip("/")
    scheme, _, bare = root.partition("://") if "://" in root else ("", "", root.removeprefix("file:"))
    base = "/" + bare.partition("/")[2] if scheme and scheme != "file" else os.path.abspath("/" + bare.lstrip("/") if scheme == "file" else bare)
    local = scheme in ("", "file")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("modified"), "length")
    relative = F.regexp_replace("path", rf"^(?:[a-zA-Z]+:/*(?=/))?(?://[^/]+)?\Q{base}\E/", "")
    found = listed.withColumn("doc_path", relative).filter(wanted(F.col("doc_path"), F.col("length"), ignore))
    if rules := read_small(spark, f"{root}/.gitignore"):
        found = found.filter(~paths.ignored(F.col("doc_path"), rules.splitlines()))
    if only:
        near = F.lit(False)
        for p in inside(only):
            near = near | (F.col("doc_path") == p) | F.startswith("doc_path", F.lit(p + "/")) | F.lit(p == ".")
        found = found.filter(near)
    order = [F.desc("modified"), "doc_path"] if sort_by == "newest" else ["doc_path"]
    chosen = found.select("path", "doc_path", "modified").orderBy(*order).limit(max_files).collect()  # paths only, max_files at most
    if local and not follow_symlinks:
        chosen = [r for r in chosen if not _escapes(base, r["doc_path"])]
    schema = "repo string, doc_path string, raw binary, modified timestamp"
    if not chosen:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([(r["path"], r["doc_path"]) for r in chosen], "path string, doc_path string")
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in chosen]  # names are not patterns
    read = spark.read.format("binaryFile").load(literal)
    return read.join(F.broadcast(names), "path").select(F.lit(repo).alias("repo"), "doc_path", F.col("content").alias("raw"), F.col("modificationTime").alias("modified"))  # max_files names


def prepared(content: str, doc_path: str) -> tuple[str, str]:
    """The text that is cut and stored, and the format it then has."""
    kind = FORMATS.get(os.path.splitext(doc_path)[1].lower(), "text")
    if kind in ("openapi", "json") and not doc_path.lower().endswith(".jsonc") and openapi.looks_like(content):
        return content, "openapi"
    convert_ = {"mdx": convert.mdx, "notebook": convert.notebook, "html": convert.html}.get(kind)
    if convert_:
        return convert_(content), "markdown"
    if kind in ("json", "xml", "godot"):
        made = {"json": convert.json_tree, "xml": convert.xml, "godot": convert.godot}[kind](content, doc_path)
        return made, "markdown" if made else "nothing"
    return content, kind


def split_document(content: str, doc_path: str, repo: str) -> list[dict]:
    """The sections of one document, with parents."""
    content, kind = prepared(content, doc_path)
    lines = content.splitlines(keepends=True)
    if kind == "openapi":
        rows = openapi.sections(content, doc_path, repo)
        if not rows and (made := openapi.to_markdown(content)):
            lines = made.splitlines(keepends=True)
            rows = outline.cut_at(outline.find_markdown(lines), made, lines, doc_path, repo)
    elif kind == "text":
        rows = outline.paragraphs(content, lines, doc_path, repo)
    elif kind in ("markdown", "rst", "asciidoc"):
        find = {"markdown": outline.find_markdown, "rst": outline.find_rst, "asciidoc": outline.find_asciidoc}[kind]
        rows = outline.cut_at(find(lines), content, lines, doc_path, repo)
    else:
        rows = []
    return outline.wire(rows)


def _split(names: list[str]) -> Callable[[Iterator], Iterator]:
    """A reader of batches that gives these columns of the sections."""

    def split(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [r for x in pdf.itertuples() for r in split_document(bytes(x.raw or b"").decode("utf-8", "replace"), x.doc_path, x.repo)]
            for at in range(0, len(rows), 5000):
                yield pd.DataFrame({n: [r[n] for r in rows[at : at + 5000]] for n in names})

    return split


def sections(files: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of sections from repo, doc_path and raw. One document is handled by one call; documents spread over tasks.

    columns: those wanted, if not all; only what they are made of leaves the reader."""
    bounded_batches(files.sparkSession)
    needed = {n for c in columns for n in MADE_OF.get(c, (c,))}
    schema = {c.split()[0]: c for c in SECTION.split(", ") if not columns or c.split()[0] in needed}
    rows = files.select("repo", "doc_path", F.col("raw").cast("binary").alias("raw")).mapInPandas(_split(list(schema)), ", ".join(schema.values()))
    return enrich(rows, columns).select(*columns) if columns else enrich(rows)


def enrich(rows: DataFrame, columns: tuple[str, ...] = tuple(MADE_OF)) -> DataFrame:
    """Adds content_hash, references, tags, and a summary where there is none; with ``columns`` those of them that are named."""
    content = F.col("content")
    summary = F.when(F.col("summary") != "", F.col("summary")).otherwise(text.summary(F.col("title"), F.col("level")))
    made = {"content_hash": text.content_hash(content), "references": text.references(content), "tags": text.hashtags(content), "summary": summary}
    return rows.withColumns({c: x for c, x in made.items() if c in columns})


def plain_text_sections(docs: DataFrame) -> DataFrame:
    """The plain text reader without Python: repo, doc_path and text (one paragraph or more) to rows of sections."""
    from pyspark.sql import Window as W

    lines = docs.select("repo", "doc_path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    order = W.partitionBy("repo", "doc_path").orderBy("at")
    lines = lines.withColumns({"blank": F.trim("line") == "", "size": F.octet_length("line") + 1})
    lines = lines.withColumns({"opens": ~F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(True)), "byte": (F.sum("size").over(order) - F.col("size")).cast("long")})
    lines = lines.withColumn("para", F.sum(F.col("opens").cast("int")).over(order)).filter("NOT blank")
    paras = lines.groupBy("repo", "doc_path", "para").agg(F.min("byte").alias("byte_start"), F.sort_array(F.collect_list(F.struct("at", "line")))["line"].alias("ls"))
    paras = paras.withColumns({"content": F.array_join("ls", "\n"), "title": F.substring(F.trim(F.col("ls")[0]), 1, 80), "seq": (F.col("para") - 1).cast("int")}).withColumn("slug", text.slugify(F.col("title")))
    again = F.row_number().over(W.partitionBy("repo", "doc_path", "slug").orderBy("seq"))
    slug = F.when(again == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), again))
    return paras.select("repo", "doc_path", "seq", F.concat_ws("::", "repo", "doc_path", F.concat(slug, F.lit("#1"))).alias("id"), "title", F.lit(1).alias("level"), F.lit("").alias("parent_id"), "byte_start", (F.col("byte_start") + F.octet_length("content")).alias("byte_end"), "content")
