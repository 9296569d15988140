"""Preference formatting of chat conversations, in DataFrame functions only.

For each pair of a chosen and a rejected conversation, the turns that both begin with are the prompt and are
rendered once. What follows is rendered as two completions, each with segments that say which characters are
trained on: the text and the end mark of the assistant's turns; headers and all other roles are masked.

Rows: turns are ordered by turn number, then role and text (nulls first, null role and text count as empty);
repeated rows are one turn; rows with a null conversation id belong to no pair; a pair with a missing side has
an empty conversation there; equal conversations have empty completions; an empty table gives an empty result.
A conversation becomes one value of the result, so it has to fit in a row. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    before_role: str = "<|"
    after_role: str = "|>\n"
    end: str = "<|end|>\n"
    trained_role: str = "assistant"


def conversations(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns): the turns of each conversation in order, as structs (role, text)."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).filter("conv is not null")
    ordered = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    return rows.groupBy("conv").agg(F.transform(ordered, lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def rendered(turns: Column, template: Template) -> Column:
    """The characters of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(template.before_role), t["role"], F.lit(template.after_role), t["text"], F.lit(template.end))), "")


def segments(turns: Column, template: Template) -> Column:
    """Array of (text, trained): header and body of each turn, one after the other."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.before_role), t["role"], F.lit(template.after_role)).alias("text"), F.lit(False).alias("trained")),
                F.struct(F.concat(t["text"], F.lit(template.end)).alias("text"), (t["role"] == template.trained_role).alias("trained")),
            ),
        )
    )


def format_preferences(turns: DataFrame, pairs: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pairs: (pair_id, chosen_id, rejected_id). Returns those with n_common, prompt, and for each side its
    completion and that completion's segments."""
    whole = conversations(turns, conv_col, turn_col, role_col, text_col)
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select("pair_id", "chosen_id", "rejected_id")
    for side in ("chosen", "rejected"):
        other = whole.select(F.col("conv").alias(f"{side}_conv"), F.col("turns").alias(f"{side}_turns"))
        sides = sides.join(other, F.col(f"{side}_id") == F.col(f"{side}_conv"), "left")
        sides = sides.withColumn(f"{side}_turns", F.coalesce(f"{side}_turns", none)).drop(f"{side}_conv")
    shorter = "least(size(chosen_turns), size(rejected_turns))"
    same = F.expr(f"if({shorter} = 0, array(), transform(sequence(0, {shorter} - 1), i -> chosen_turns[i] = rejected_turns[i]))")
    sides = sides.withColumn("differs", F.array_position(same, False)).withColumn("n_common", F.when(F.col("differs") > 0, F.col("differs") - 1).otherwise(F.expr(shorter)).cast("long"))
    rest = {s: F.expr(f"slice({s}_turns, cast(n_common as int) + 1, size({s}_turns))") for s in ("chosen", "rejected")}
    return sides.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common",
        rendered(F.expr("slice(chosen_turns, 1, cast(n_common as int))"), template).alias("prompt"),
        *(c for s in rest for c in (rendered(rest[s], template).alias(s), segments(rest[s], template).alias(f"{s}_segments"))),
    )


def adjacent_pairs(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pairs of conversation 2k (chosen) and 2k + 1 (rejected), for tables without preferences of their own."""
    ids = turns.select(F.col(conv_col).cast("long").alias("conv")).filter("conv is not null")
    side = [F.min(F.when(F.pmod("conv", F.lit(2)) == k, F.col("conv"))).alias(f"{s}_id") for k, s in enumerate(("chosen", "rejected"))]
    return ids.groupBy(F.floor(F.col("conv") / 2).alias("pair_id")).agg(*side)


def mask_runs(column: str) -> Column:
    """Segments as text: flag (1 trained, 0 masked) and length in characters of each, joined by blanks."""
    return F.array_join(F.transform(column, lambda s: F.concat(F.when(s["trained"], "1x").otherwise("0x"), F.length(s["text"]))), " ")


def adjacent_preferences(turns: DataFrame) -> DataFrame:
    """The pairs of adjacent_pairs, formatted, with masks as text."""
    found = format_preferences(turns, adjacent_pairs(turns))
    return found.select("pair_id", "chosen_id", "rejected_id", "n_common", "prompt", "chosen", mask_runs("chosen_segments").alias("chosen_mask"), "rejected", mask_runs("rejected_segments").alias("rejected_mask"))


ORACLE = r"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select conv_id, conv_id // 2 as pair_id, conv_id % 2 as side, role, text,
             row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
             '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as body
      from t),
met as (select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.i, b.i) as i, coalesce(a.role = b.role and a.text = b.text, false) as same
        from (select * from n where side = 0) a full join (select * from n where side = 1) b on a.pair_id = b.pair_id and a.i = b.i),
common as (select pair_id, coalesce(min(i) filter (where not same) - 1, max(i)) as n_common from met group by pair_id),
marked as (select n.*, c.n_common, '0x' || length(head) || ' ' || case when role = 'assistant' then '1x' else '0x' end || length(body) as mask
           from n join common c on n.pair_id = c.pair_id)
select pair_id, min(conv_id) filter (where side = 0) as chosen_id, min(conv_id) filter (where side = 1) as rejected_id,
       cast(any_value(n_common) as bigint) as n_common,
       coalesce(string_agg(head || body, '' order by i) filter (where side = 0 and i <= n_common), '') as prompt,
       coalesce(string_agg(head || body, '' order by i) filter (where side = 0 and i > n_common), '') as chosen,
       coalesce(string_agg(mask, ' ' order by i) filter (where side = 0 and i > n_common), '') as chosen_mask,
       coalesce(string_agg(head || body, '' order by i) filter (where side = 1 and i > n_common), '') as rejected,
       coalesce(string_agg(mask, ' ' order by i) filter (where side = 1 and i > n_common), '') as rejected_mask
from marked group by pair_id
"""
