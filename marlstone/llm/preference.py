"""Preference formatting of conversation pairs, in built-in expressions.

The longest common prefix of turns (role and text equal, null equal to null) of the chosen and the
rejected conversation is rendered once as the prompt; what follows on each side is a completion. A
completion's mask lists the spans (start and length in code points) on which loss falls: the texts and
end marks of the trained role's turns.

Null roles and texts are rendered as empty; turns without a conversation's id are one conversation, which comes last. An empty side has an empty completion; where both sides
are the same, or a side has no trained turn after the prefix, ``usable`` is false and the row stays. Turns
are ordered by number, then role and text; repeated rows are repeated turns. Extra columns are ignored.
A conversation is rendered in one row, so one of them has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .fingerprints import with_successor

START, MID, END = "<|", "|>\n", "<|end|>\n"


def conversations_of(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """id, turns: array of (role, text) in order."""
    item = F.struct(F.col(turn_col).alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    rows = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit(MID), F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, _rendered))


def mask_spans(turns: Column, trained: str) -> Column:
    """"start:length" of every trained turn's text and end mark in the rendering of ``turns``, joined by commas."""

    def add(state: Column, turn: Column) -> Column:
        head = F.char_length(F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit(MID)))
        body = F.char_length(F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END)))
        span = F.concat_ws(":", state["at"] + head, body)
        spans = F.when(turn["role"] == trained, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + head + body).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, add, lambda s: F.concat_ws(",", s["spans"]))


def format_preferences(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds prompt_turns, prompt, chosen/rejected_completion, chosen/rejected_mask and usable to rows with arrays ``chosen`` and ``rejected``."""
    differ = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: ~a.eqNullSafe(b)), True)
    shared = F.when(differ > 0, differ - 1).otherwise(F.size("chosen")).cast("int")
    rows = pairs.withColumn("prompt_turns", shared)
    rest = {side: F.slice(side, F.col("prompt_turns") + 1, F.greatest(F.size(side) - F.col("prompt_turns"), F.lit(0))) for side in ("chosen", "rejected")}
    rows = rows.withColumn("prompt", render(F.slice("chosen", F.lit(1), F.col("prompt_turns"))))
    for side, turns in rest.items():
        rows = rows.withColumn(f"{side}_completion", render(turns)).withColumn(f"{side}_mask", mask_spans(turns, trained))
    return rows.withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != "")).drop("chosen", "rejected")


def spliced_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, chosen, rejected for tables without judgements: the rejected side keeps the first half of the turns (rounded up) and goes on as the next conversation by descending id does (after the last: the first)."""
    convs = with_successor(stored(conversations_of(turns, id_col), "conversations"), id_col, ["turns"])
    half = F.ceil(F.size("turns") / 2).cast("int")
    following = F.slice("next_turns", half + 1, F.greatest(F.size("next_turns") - half, F.lit(0)))
    return convs.select(id_col, F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), half), following).alias("rejected"))


def preference_report(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    return format_preferences(spliced_pairs(turns, id_col))


ORACLE_SQL = """
WITH convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id
), following AS (
  SELECT conv_id, turns, coalesce(lead(turns) OVER (ORDER BY conv_id DESC), first_value(turns) OVER (ORDER BY conv_id DESC)) AS next_turns FROM convs
), halves AS (
  SELECT *, CAST(ceil(len(turns) / 2) AS INTEGER) AS half FROM following
), pairs AS (
  SELECT conv_id, turns AS chosen, list_concat(turns[1:half], CASE WHEN len(next_turns) > half THEN next_turns[half + 1:] ELSE [] END) AS rejected FROM halves
), shared AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1, len(chosen)) AS n FROM pairs
), rest AS (
  SELECT conv_id, n, chosen[1:n] AS p, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM shared
), drawn AS (
  SELECT conv_id, n,
    list_transform(p, lambda t: concat('<|', t.role, '|>' || chr(10), t.text, '<|end|>' || chr(10))) AS ps,
    list_transform(c, lambda t: concat('<|', t.role, '|>' || chr(10), t.text, '<|end|>' || chr(10))) AS cs,
    list_transform(r, lambda t: concat('<|', t.role, '|>' || chr(10), t.text, '<|end|>' || chr(10))) AS rs, c, r
  FROM rest
), done AS (
  SELECT conv_id, CAST(n AS INTEGER) AS prompt_turns,
    coalesce(array_to_string(ps, ''), '') AS prompt, coalesce(array_to_string(cs, ''), '') AS chosen_completion, coalesce(array_to_string(rs, ''), '') AS rejected_completion,
    coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'),
      lambda i: concat(length(coalesce(array_to_string(cs[1:i - 1], ''), '')) + length(concat('<|', c[i].role, '|>')) + 1, ':', length(coalesce(c[i].text, '')) + 8)), ','), '') AS chosen_mask,
    coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'),
      lambda i: concat(length(coalesce(array_to_string(rs[1:i - 1], ''), '')) + length(concat('<|', r[i].role, '|>')) + 1, ':', length(coalesce(r[i].text, '')) + 8)), ','), '') AS rejected_mask
  FROM drawn
)
SELECT *, chosen_mask <> '' AND rejected_mask <> '' AS usable FROM done
"""
