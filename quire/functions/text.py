"""Text expressions. All are built-in functions, so they run inside generated code and need no Python on executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not indexed.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on",
    "or", "that", "the", "this", "to", "was", "were", "will", "with",
)
# Roles and the title patterns that name them, in order of precedence.
ROLE_PATTERNS = (
    ("changelog", r"^(?:change\s*log|release\s*notes?|history|what'?s\s+new|news)$"),
    ("faq", r"^(?:faq|frequently\s+asked\s+questions?|questions?\s*&?\s*answers?|q\s*&\s*a)$"),
    ("troubleshooting", r"\b(?:troubleshoot(?:ing)?|errors?|debug(?:ging)?|fix(?:es)?|known\s+issues?|problems?)\b"),
    ("tutorial", r"\b(?:tutorial|walk\s*through|quick\s*start|getting\s+started|hello\s+world|step\s+by\s+step)\b"),
    ("how_to", r"^how[\s-]+to\b"),
    ("api", r"\b(?:api|endpoint|operation|sdk\s+reference|http\s+reference)\b"),
    ("reference", r"^(?:reference|cli|configuration|config|options?|parameters?|env(?:ironment)?\s+variables?)\b"),
    ("example", r"\b(?:examples?|usage(?:\s+example)?|sample\s*(?:code)?|recipes?)\b"),
    ("other", r"^(?:misc|miscellaneous|other|notes?|appendix)\b"),
)
# Verbs that open an instruction; the second group counts for answerability only.
VERBS = "install|configure|set|run|create|update|delete|deploy|build|enable|disable|add|remove|verify|check|open|close|copy|paste|click|select|navigate|generate|sign|register|connect|export|import"
MORE_VERBS = "use|call|invoke|pass|return|ensure|launch|start|stop|restart"
# The patterns of steps, questions, definitions, bold terms, pointers elsewhere, links, addresses and tags.
STEP, QUESTION, FENCE = r"(?m)^\s*\d+[.)]\s+\S", r"(?m)\?\s*$", r"(?m)^```"
DEFINITION = r"(?i)\b(?:is|are|means|refers to|stands for|defined as|denotes|represents)\b"
BOLD_TERM = r"\*\*([A-Za-z][A-Za-z0-9 _\-./]{1,80})\*\*\s*[—–\-:]\s*\S"
SEE_ELSEWHERE = r"(?i)\b(?:see (?:above|below|the previous section|earlier|the next section)|as (?:mentioned|noted|described|shown) (?:above|earlier|previously)|as discussed (?:above|earlier))\b"
LINK, URL, HASHTAG = r"\[([^\]]+)\]\(([^\)]+)\)", r"""https?://[^\s\)"']+""", r"(?m)(?:^|\s)#([A-Za-z][A-Za-z0-9_-]*)"


def tokenize(text: Column) -> Column:
    """Lower-case terms of two characters or more, without stop words, fenced code, and the targets of links."""
    plain = x = F.coalesce(text, F.lit(""))
    x = F.regexp_replace(x, r"(?s)```.*?```|~~~.*?~~~", " ")
    x = F.regexp_replace(x, r"!?\[([^\]]+)\]\([^)]*\)", " $1 ")
    x = F.regexp_replace(x, r"""https?://([^\s)\]'"<>?#]*)[^\s)\]'"<>]*""", " $1 ")
    x = F.regexp_replace(x, r"`([^`]+)`", " $1 ")
    # without one of these marks none of the patterns fits, and none makes a mark
    marks = [F.contains(plain, F.lit(m)) for m in ("`", "~~~", "](", "://")]
    x = F.when(marks[0] | marks[1] | marks[2] | marks[3], x).otherwise(plain)
    x = F.regexp_replace(x, r"[A-Z](?:(?<=[a-z0-9][A-Z])|(?<=[A-Z][A-Z])(?=[a-z]))", " $0")
    return F.filter(F.split(F.lower(x), r"[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def slugify(text: Column) -> Column:
    x = F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\w\s-]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)[\s_]+", "-"), "-+", "-")
    x = F.regexp_replace(x, "^-+|-+$", "")
    return F.when(x == "", F.lit("section")).otherwise(x)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def references(text: Column) -> Column:
    """Targets of links, then bare URLs, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(LINK), F.lit(2)), F.regexp_extract_all(text, F.lit(URL), F.lit(0))))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(1)))


def summary(title: Column, level: Column) -> Column:
    """The title, or what kind of section it is."""
    kind = F.when(level == 0, "Root: ").when(level <= 2, "Section: ").otherwise("Subsection: ")
    return F.when(F.coalesce(F.trim(title), F.lit("")) != "", F.substring(title, 1, 120)).otherwise(F.concat(kind, F.substring(F.coalesce(title, F.lit("")), 1, 100)))


def embed_text(title: Column, summary_: Column, content: Column) -> Column:
    other = F.when(summary_ != title, summary_)
    return F.concat_ws("\n", F.when(title != "", title), F.when(other != "", other), F.when(content != "", F.substring(content, 1, 1000)))


def heading_role(title: Column) -> Column:
    """The first role whose pattern the title fits, else null."""
    out = F.lit(None).cast("string")
    for role, pattern in reversed(ROLE_PATTERNS):
        out = F.when(F.regexp_like(F.trim(title), F.lit("(?i)" + pattern)), F.lit(role)).otherwise(out)
    return out


def _ascii(pattern: str) -> str:
    """The pattern with words, white space and line ends of ASCII alone, and cases folded as RE2 does, whatever the engine's version takes them for."""
    if pattern.startswith(r"(?i)\b(?:"):  # places where no word of the pattern can start are passed over first
        starts = "".join(sorted(set(re.findall(r"(?:\(\?:|\|)(\w)", pattern))))
        pattern = pattern.replace(r"\b", rf"(?=[{starts}\u017f\u212a])\b", 1)
    for name, means in ((r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"), (r"\s", r"[\t\n\f\r ]"), (r"\S", r"[^\t\n\f\r ]")):
        pattern = pattern.replace(name, means)
    if pattern.startswith("(?i"):
        pattern = re.sub("s(?![^[]*])", "[s\u017f]", re.sub("k(?![^[]*])", "[k\u212a]", pattern))
    return f"(?d){pattern}"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_ascii(pattern)))


def density_role(text: Column) -> Column:
    """A role from how often steps, code, instructions and questions come up, else null."""
    lines, pairs = F.greatest(F.lit(1), count(text, "\n") + 1), F.floor(count(text, FENCE) / 2)
    verbs, asked = count(text, rf"(?im)^\s*(?:{VERBS})\b"), count(text, QUESTION)
    return (
        F.when((asked >= 3) & (asked / lines > 0.05), "faq")
        .when((count(text, STEP) >= 3) & (pairs >= 2), "tutorial")
        .when((verbs >= 3) & (verbs / lines > 0.05), "how_to")
        .when((pairs >= 1) & (pairs / F.greatest(F.lit(1.0), lines / 10) >= 1.0), "example")
    )


def saturate(x: Column, half: float) -> Column:
    return F.when(x > 0, 1 - F.exp(-x / half)).otherwise(F.lit(0.0))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _definitions(text: Column) -> Column:
    return count(text, DEFINITION) + count(text, BOLD_TERM)


def answerability(text: Column) -> Column:
    """0 to 1: how likely a section answers a question by itself."""
    verbs = count(text, rf"(?im)^\s*(?:{VERBS}|{MORE_VERBS})\b")
    value = (
        0.30 * saturate(_definitions(text), 2.0)
        + 0.25 * saturate(verbs, 3.0)
        + 0.20 * F.when(count(text, FENCE) >= 2, 1.0).otherwise(0.0)
        + 0.15 * saturate(count(text, STEP), 3.0)
        + 0.10 * saturate(count(text, QUESTION), 2.0)
    )
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.round(_unit(value), 4))


def quotability(text: Column, blank: float | None = 0.0) -> Column:
    """0 to 1: how well a section can be quoted; each part is rounded before it counts. blank: what a section without text gets; None: what its
    one empty line comes to, and for a null what no line does."""
    lines = F.when(text.isNull(), 0).otherwise(count(text, "\n") + 1)
    prose = F.greatest(F.lit(0), lines - F.floor(count(text, FENCE) / 2) * 5)
    parts = (
        (0.35, F.least(F.lit(1.0), prose / F.greatest(F.lit(4), lines))),
        (0.25, saturate(_definitions(text), 2.0)),
        (0.30, F.greatest(F.lit(0.0), 1 - saturate(count(text, SEE_ELSEWHERE), 1.5))),
        (0.10, saturate(lines, 8.0)),
    )
    value = F.lit(0.0)
    for weight, part in parts:
        value = value + weight * F.round(part, 4)
    # four rounded parts often add up to a half; it goes up whatever the last bits say
    scored = F.round(_unit(value + 1e-9), 4)
    return scored if blank is None else F.when(F.coalesce(text, F.lit("")) == "", blank).otherwise(scored)


def bytes_of(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def tokens_saved(raw_bytes: Column, sent_bytes: Column) -> Column:
    """Tokens at four bytes each that a short answer leaves out."""
    return F.greatest(F.lit(0), F.floor((raw_bytes - sent_bytes) / 4)).cast("long")


def title_score(title: Column, query: str) -> Column:
    """Exact or contained query, shared tokens, and a bonus for a prefix."""
    q, t = query.strip().lower(), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    terms = F.array(*[F.lit(w) for w in dict.fromkeys(q.split())])
    shared = F.size(F.array_intersect(F.split(t, r"\s+"), terms))
    base = F.when(t == q, 100).when(F.contains(t, F.lit(q)), 30).otherwise(0)
    return base + 5 * shared + F.when(F.startswith(t, F.lit(q)), 10).otherwise(0)


def strip_lines(text: Column, lines: Column) -> Column:
    """The text without lines that stand in an array once trimmed; runs of blank lines shrink."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(lines, F.trim(x)))
    return F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")
