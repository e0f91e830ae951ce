"""Boilerplate, glossary terms, code examples and code compression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import cut
from . import search

LINE_CHARS = (8, 240)
# Fixed value: the pattern of a definition in bold.
BOLD_DEFINITION = r"(?m)^\s*\*\*([A-Za-z][A-Za-z0-9 _\-./]{1,80})\*\*\s*[—–\-:]\s+(.{4,400}?)$"
# What opens a comment line, by language.
COMMENT_MARKS = {
    "#": ("python", "py", "py3", "py2", "ipython", "sh", "bash", "zsh", "shell", "console", "fish", "yaml", "yml", "toml", "ini", "conf", "cfg", "ruby", "rb", "rake", "gemspec", "r", "perl", "pl", "elixir", "ex", "exs", "crystal", "cr", "dockerfile", "docker", "makefile", "make", "cmake", "tcl", "awk", "powershell", "ps1", "ps", "nim", "julia", "jl"),
    "//": ("javascript", "js", "jsx", "typescript", "ts", "tsx", "java", "kotlin", "kt", "scala", "groovy", "gradle", "c", "cpp", "c++", "cxx", "h", "hpp", "objective-c", "objc", "csharp", "cs", "fsharp", "fs", "go", "golang", "rust", "rs", "swift", "dart", "php", "d", "zig", "v", "vlang", "solidity", "sol", "verilog", "systemverilog", "sv"),
    "--": ("sql", "lua", "haskell", "hs", "ada", "eiffel", "vhdl"),
    ";": ("lisp", "scheme", "clojure", "clj", "cljs", "elisp", "el", "racket", "rkt", "common-lisp", "asm", "assembly", "nasm"),
    "%": ("erlang", "erl", "prolog", "matlab", "octave", "tex", "latex"),
}


def boilerplate(sections: DataFrame, min_ratio: float = 0.25, min_sections: int = 3) -> DataFrame:
    """line, n: lines that stand in a share of all sections that are not empty."""
    full = sections.filter("content <> ''")
    lines = full.select(F.explode(F.array_distinct(F.transform(F.split("content", "\n"), lambda x: F.trim(x)))).alias("line")).filter(F.length("line").between(*LINE_CHARS))
    counts = lines.groupBy("line").agg(F.count("*").alias("n"))
    least = full.agg(F.greatest(F.lit(min_sections), F.floor(F.count("*") * F.lit(min_ratio))).alias("least"))
    return counts.crossJoin(least).filter("n >= least").select("line", "n")  # least is one row


def strip_boilerplate(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """id, content, bytes_removed. Lines are matched by a join, so their number is not bounded."""
    each = sections.select("id", "content", F.posexplode(F.split("content", "\n")).alias("at", "raw")).withColumn("line", F.trim("raw"))
    kept = each.join(lines.select("line"), "line", "left_anti").groupBy("id").agg(F.regexp_replace(F.array_join(F.sort_array(F.collect_list(F.struct("at", "raw")))["raw"], "\n"), "\n{3,}", "\n\n").alias("kept"))
    met = sections.select("id", "content").join(kept, "id", "left").withColumn("kept", F.coalesce("kept", F.lit("")))
    return met.select("id", F.col("kept").alias("content"), (F.octet_length("content") - F.octet_length("kept")).cast("long").alias("bytes_removed"))


def _rst_entries(block: Column) -> Column:
    """Terms and definitions of a glossary block: the least indent opens a term."""
    lines = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    least = F.array_min(F.transform(lines, indent))
    joined = F.array_join(F.transform(lines, lambda x: F.when(indent(x) == least, F.concat(F.lit("\x00"), F.trim(x), F.lit("\x01"))).otherwise(F.concat(F.lit(" "), F.trim(x)))), "")
    return F.filter(F.split(joined, "\x00"), lambda x: x != "")


def glossary(sections: DataFrame) -> DataFrame:
    """term, definition, section_id, source: the first definition of each term, by place."""
    clean = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    base = sections.select("id", "doc_path", "seq", "content")
    hits = F.arrays_zip(F.regexp_extract_all("content", F.lit(BOLD_DEFINITION), F.lit(1)).alias("t"), F.regexp_extract_all("content", F.lit(BOLD_DEFINITION), F.lit(2)).alias("d"))
    bold = base.select("id", "doc_path", "seq", F.posexplode(hits).alias("at", "x")).select("id", "doc_path", "seq", "at", clean(F.col("x.t")).alias("term"), F.substring(clean(F.col("x.d")), 1, 400).alias("definition"), F.lit("markdown_bold").alias("source"))
    blocks = base.select("id", "doc_path", "seq", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\.\.\s+glossary::\s*\n((?:[ \t]+.*\n?|\n)+)"), F.lit(1))).alias("block"))
    rst = blocks.select("id", "doc_path", "seq", F.posexplode(_rst_entries(F.col("block"))).alias("at", "x")).select("id", "doc_path", "seq", "at", clean(F.substring_index("x", "\x01", 1)).alias("term"), F.substring(clean(F.substring_index("x", "\x01", -1)), 1, 400).alias("definition"), F.lit("rst_glossary").alias("source"))
    every = bold.unionByName(rst).filter((F.length("term") >= 2) & ((F.col("source") != "markdown_bold") | (F.length("definition") >= 4)))
    first = F.row_number().over(W.partitionBy(F.lower("term"), "source").orderBy("doc_path", "seq", "at"))
    return every.withColumn("rn", first).filter("rn = 1").select("term", "definition", F.col("id").alias("section_id"), "source")


def lookup_term(terms: DataFrame, term: str) -> DataFrame:
    return terms.filter(F.lower("term") == term.strip().lower())


def list_terms(terms: DataFrame, prefix: str = "", max_results: int = 100) -> DataFrame:
    return terms.filter(F.startswith(F.lower("term"), F.lit(prefix.lower()))).orderBy(F.lower("term"), "source").limit(max_results)


def code_blocks(sections: DataFrame) -> DataFrame:
    return sections.select("id", "title", "doc_path", F.explode("code_blocks").alias("b")).select(F.col("id").alias("section_id"), "title", "doc_path", "b.block_id", "b.lang", F.col("b.content").alias("code"))


def find_code_examples(sections: DataFrame, query: str, lang: str | None = None, max_results: int = 10) -> DataFrame:
    """block_id, section_id, lang, score, snippet: BM25 over code blocks, with statistics of the language asked for."""
    blocks = code_blocks(sections)
    if lang:
        blocks = blocks.filter(F.lower("lang") == lang.lower())
    wanted = search.query_terms(sections, query)
    t = cut(blocks.withColumn("terms", text.tokenize(F.col("code"))), "blocks")  # sections are read once, for statistics and scores
    stats = t.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg"), *[F.count_if(F.array_contains("terms", w)).alias(f"df_{i}") for i, w in enumerate(dict.fromkeys(wanted))])
    score = F.lit(0.0)
    for i, w in enumerate(dict.fromkeys(wanted)):
        tf = (F.size("terms") - F.size(F.array_remove("terms", w))).cast("double")
        score = score + wanted.count(w) * search.idf(F.greatest(F.col(f"df_{i}"), F.lit(1)), F.col("n")) * search.bm25_part(tf, F.size("terms"), F.greatest(F.col("avg"), F.lit(1.0)))
    scored = t.crossJoin(F.broadcast(stats)).withColumn("score", F.round(score, 6)).filter("score > 0")  # one row of statistics
    return scored.select("block_id", "section_id", "lang", "score", F.substring("code", 1, 400).alias("snippet")).orderBy(F.desc("score"), "block_id").limit(max_results)


def compress_code(content: str) -> str:
    """The text without blank and comment lines inside fenced code."""
    marks = {lang: mark for mark, langs in COMMENT_MARKS.items() for lang in langs}
    out, close, mark = [], None, None
    for line in content.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        if close is None:
            if opened := re.fullmatch(r"(`{3,}|~{3,})\s*([\w+\-#.]*)\s*", bare):
                close, mark = opened[1], marks.get(opened[2].lower())
            out.append(line)
        elif re.fullmatch(re.escape(close[0]) + f"{{{len(close)},}}\\s*", bare):
            close = None
            out.append(line)
        elif bare.strip() and not (mark and bare.lstrip().startswith(mark)):
            out.append(line)
    return "".join(out)


def squeezed(content: Column) -> Column:
    """``compress_code`` as a column. What a line is depends on the lines before it, so texts go through Arrow batches."""

    @F.pandas_udf("string")
    def squeeze(s):
        return s.map(lambda x: x if x is None else compress_code(x))

    return squeeze(content)


def compressed(sections: DataFrame) -> DataFrame:
    """id, content, bytes_saved. Only texts with fences leave the JVM."""
    has = F.contains("content", F.lit("```")) | F.contains("content", F.lit("~~~"))
    fenced = sections.filter(has).select("id", "content", squeezed(F.col("content")).alias("short"))
    plain = sections.filter(~has).select("id", "content", F.col("content").alias("short"))
    return fenced.unionByName(plain).select("id", F.col("short").alias("content"), F.greatest(F.lit(0), F.octet_length("content") - F.octet_length("short")).alias("bytes_saved"))
