"""Chat formatting in budgeted, turn-aligned windows.

A conversation's turns are laid on a line by prefix sums of their tokens. The line is cut into rooms of equal length:
turns that lie inside a room share a window, a turn across a boundary gets one by itself. So each turn falls into
exactly one window, known from its prefix sum alone, and no window exceeds its room unless one turn does. A
window starts with the conversation's first system turn and with the turns before it that fit in the history
budget; both are repeats, and the loss mask leaves them out. It covers the texts of new assistant turns.

Prefix sums are taken in two levels over ranges of the order (conversation, turn), and windows are built per SEGMENT
rooms, so a conversation with most of the rows is spread over tasks.

Template: `<s>`, then per turn `[role]`, a line break, the text, `</s>` and a line break. Inside texts and roles a backslash stands
before every `\\`, `<`, `[` and `]`, so no control string can come from a text. A null text or role is empty. Equal turn numbers go by role
and text; a null turn number comes first; rows of a null conv_id are one conversation. No rows, no windows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colwright.columns import require
from colwright.llm.text import running, whole
from colwright.sources.shared import kept

BUDGET = 2048
HISTORY = 256
SEGMENT = 64
TURN = "struct<role:string,text:string,target:boolean>"
# What a formatted turn looks like, for reading it back.
PATTERN = re.compile(r"\[((?:[^\\\]]|\\.)*)\]\n((?:[^\\<]|\\.)*)</s>\n", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[\]])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(window: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window; raises if it is not one."""
    if not window.startswith("<s>"):
        raise ValueError("not a window")
    at, turns = 3, []
    while at < len(window):
        m = PATTERN.match(window, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def turn_tokens(text: Column) -> Column:
    """Default size of a turn: its words and signs, and three for the frame."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 3).cast("bigint")


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """Append start, the tokens before each turn in its conversation, and pos, the turns before it."""
    order = ["conv_id", "turn", "role", "text"]
    keyed = turns.withColumn("tie", F.monotonically_increasing_id()).withColumn("text_key", F.xxhash64("role", "text"))
    dealt = keyed.repartitionByRange("conv_id", "turn", "text_key", "tie").withColumn("part", F.spark_partition_id())
    dealt = kept(dealt, "turns")
    inner = Window.partitionBy("conv_id", "part").orderBy("turn", "text_key", "tie")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("pos", F.row_number().over(inner) - 1)
    # At most two conversations reach over the ends of a part, so this table is as long as there are parts, and no longer
    # than the conversations that have several.
    sums = dealt.groupBy("conv_id", "part").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    parts = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumns({"t0": F.sum("t").over(parts), "n0": F.sum("n").over(parts)}).filter("n0 > 0")
    offsets = offsets.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "t0", "n0")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    found = local.join(F.broadcast(offsets), same, "left")
    return found.withColumns(
        {"start": F.col("start") + F.coalesce("t0", F.lit(0)), "pos": F.col("pos") + F.coalesce("n0", F.lit(0))}
    ).select("conv_id", *order[1:], "tokens", "start", "pos")


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=turn_tokens) -> DataFrame:
    """One row per window of the conversations (conv_id, turn, role, text).

    conv_id, first_pos (number of the window's first new turn), n_new, n_repeated (system and history turns
    at its start), n_tokens, over_budget, formatted, and loss: array of (start, end), code points of `formatted`.
    """
    require(df, "conv_id", "turn", "role", "text")
    turns = df.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"))
    turns = turns.withColumn("tokens", tokens(F.col("text")))
    laid = kept(_prefix_sums(turns), "laid")

    first = F.min(F.struct("pos", "text", "tokens")).alias("s")
    system = laid.filter(F.lower("role") == "system").groupBy(F.col("conv_id").alias("c")).agg(first, F.first("role").alias("r"))
    system = system.select("c", F.col("s.pos").alias("s_pos"), F.col("s.text").alias("s_text"), F.col("s.tokens").alias("s_tokens"), F.lit("system").alias("s_role"))
    laid = laid.join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    room = F.greatest(F.lit(budget - history) - F.coalesce("s_tokens", F.lit(0)), F.lit(budget // 4)).alias("room")
    laid = laid.withColumn("room", room)
    end = F.col("start") + F.col("tokens")
    laid = laid.withColumn("k", F.floor(F.col("start") / F.col("room")))
    laid = laid.withColumn("window", 2 * F.col("k") + (F.floor((end - 1) / F.col("room")) > F.col("k")).cast("bigint"))
    segment = F.floor(F.col("k") / SEGMENT)
    near = F.col("start") + history >= (segment + 1) * SEGMENT * F.col("room")
    laid = laid.withColumn("own_segment", segment).withColumn(
        "segment", F.explode(F.when(near, F.array(segment, segment + 1)).otherwise(F.array(segment)))
    )
    by = Window.partitionBy("conv_id", "segment").orderBy("start")
    new_window = F.lag("window").over(by).eqNullSafe(F.col("window"))
    past = F.collect_list(F.struct("pos", "role", "text", "tokens")).over(by.rangeBetween(-history, -1))
    laid = laid.withColumn("opens", ~new_window).withColumn("past", F.when(F.col("opens"), past))
    own = laid.filter("segment = own_segment")
    made = own.groupBy("conv_id", "segment", "window").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text", "tokens"))).alias("new"),
        F.min_by("past", "pos").alias("past"),
        F.first("s_pos").alias("s_pos"), F.first("s_text").alias("s_text"), F.first("s_role").alias("s_role"),
        F.first("s_tokens").alias("s_tokens"),
    )
    first_pos = F.get("new", F.lit(0))["pos"]
    made = made.withColumn("past", F.filter(F.array_sort(F.coalesce("past", F.array().cast(made.schema["new"].dataType))), lambda t: ~t["pos"].eqNullSafe(F.col("s_pos"))))
    lead = F.when(F.col("s_pos") < first_pos, F.array(F.struct(F.col("s_pos").alias("pos"), F.col("s_role").alias("role"), F.col("s_text").alias("text"), F.col("s_tokens").alias("tokens"))))
    made = made.withColumn("repeated", F.concat(F.coalesce(lead, F.array().cast(made.schema["new"].dataType)), "past"))

    def frame(turn: Column) -> Column:
        return F.concat(F.lit("["), escape(turn["role"]), F.lit("]\n"), escape(turn["text"]), F.lit("</s>\n"))

    made = made.withColumn("head", F.concat(F.lit("<s>"), F.array_join(F.transform("repeated", frame), "")))

    # A frame is five characters longer than the text's end, which lies behind the role and three more.
    sizes = F.transform("new", lambda t: F.length(escape(t["role"])) + F.length(escape(t["text"])) + 8)
    laid_out = F.zip_with(
        "new", running(sizes),
        lambda t, end: F.struct(
            (F.length("head") + end - 5 - F.length(escape(t["text"]))).alias("start"),
            (F.length("head") + end - 5).alias("end"),
            (F.lower(t["role"]) == "assistant").alias("target"),
        ),
    )
    loss = F.transform(F.filter(laid_out, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    total = F.aggregate(F.concat("repeated", "new"), F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"])
    return made.select(
        "conv_id",
        first_pos.alias("first_pos"),
        F.size("new").alias("n_new"),
        F.size("repeated").alias("n_repeated"),
        total.alias("n_tokens"),
        (total > budget).alias("over_budget"),
        F.concat("head", F.array_join(F.transform("new", frame), "")).alias("formatted"),
        loss.alias("loss"),
    )
