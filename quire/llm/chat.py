"""Chat formatting with array expressions.

The turns of a conversation are collected as structs, sorted, and merged: adjacent turns of one role become one
block. A conversation is written as::

    <|im_start|>role\\nfirst text<|im_sep|>next text of the same role<|im_end|>\\n ...

Control strings inside a text or role get one backslash after their first character (``<|im_end|>`` becomes
``<\\|im_end|>``); one that has backslashes there already gets one more, so the step is undone exactly. In a role,
``%`` and line feeds are percent-coded as well, as the first line feed ends the role.

Defined cases: a null text or role is empty; a null turn sorts first; rows that tie on the turn are ordered by role,
then text, and repeated rows all stay; a null conversation id is one conversation; an empty table gives no rows;
columns beyond the four are ignored. One conversation is one output row, so its text must fit in a row, but rows are
escaped before the shuffle and collected with map-side aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common templates, without their first character.
_TAILS = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAILS, "$1$2$3")


def _role_in(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(rows: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss_mask: an element for each turn's text in order, true where the loss counts it."""
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    ).select("conv_id", F.struct("t.turn", "t.role", "t.text", _role_in(F.col("t.role")).alias("head"), escape(F.col("t.text")).alias("body")).alias("t"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.slice("turns.role", 1, F.greatest(F.size("turns") - 1, F.lit(0))))
    pieces = F.zip_with(
        "turns",
        shifted,
        lambda t, before: F.when(before.eqNullSafe(t["role"]), F.concat(F.lit(SEP), t["body"])).otherwise(
            F.concat(F.when(before.isNull(), F.lit("")).otherwise(F.lit(END + "\n")), F.lit(START), t["head"], F.lit("\n"), t["body"])
        ),
    )
    return sorted_.select(
        "conv_id",
        F.concat(F.array_join(pieces, ""), F.lit(END + "\n")).alias("formatted"),
        F.transform("turns.role", lambda r: r == F.lit(loss_role)).alias("loss_mask"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, one per original turn), loss_text: what ``formatted`` and ``loss_mask`` say."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = block.substr(F.length(head) + 2, F.length(block))
        role = _role_out(head.substr(F.lit(len(START) + 1), F.length(head)))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    turns = chats.select("conv_id", "formatted", "loss_mask", F.flatten(F.transform(blocks, turns_of)).alias("turns"))
    masked = F.zip_with("turns.text", "loss_mask", lambda x, on: F.when(on, x).otherwise(F.lit("")))
    return turns.select("conv_id", "formatted", "turns", F.array_join(masked, "").alias("loss_text"))


#: The conversation that the query adds: its texts are made of control strings.
_PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", _PROBE), (-7, 1, "assistant", _PROBE)], "conv_id long, turn long, role string, text string")
    out = read_back(format_chats(rows.unionByName(added)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_TAILS = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])"
ORACLE = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'
), w AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM r
), p AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*){_SQL_TAILS}', '\1\\\2\3', 'g'))
    + CASE WHEN before = role THEN {len(SEP)}
      ELSE {len(START) + len(END) + 2} + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*){_SQL_TAILS}', '\1\\\2\3', 'g')) END AS n
  FROM w
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
