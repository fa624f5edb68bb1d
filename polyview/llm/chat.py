"""Preference pairs as masked training texts, in DataFrame functions alone.

A pair is a chosen and a rejected conversation.  The longest common prefix of their turns (equal role and text,
turn by turn) is rendered once, as the prompt; what remains of either side is its completion.  A completion's mask
lists the code-point ranges that training counts: the text and the end mark of assistant turns, never headers or
turns of others.

Turns are compared by position.  The first position where two sides differ, or where one ends, is one minimum per pair, added
up before any shuffle; no turn meets another but the one at its own place.  Only the last step gathers a pair, into
the one row that it becomes.

Defined cases: a missing side or one that is a prefix of the other leaves an empty completion; turns count in the
order of their number, ties in that of role and text, and repeated rows of a turn count once; null roles and texts
render as empty and null turns come first; conversations without an id take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
SIDES = ["chosen", "rejected"]


def neighbours(turns: DataFrame) -> DataFrame:
    """``(pair_id, side, turn, role, text)``: conversation 2k is chosen over 2k + 1."""
    own = turns.filter(F.col("conv_id").isNotNull())
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, SIDES[0]).otherwise(SIDES[1])
    return own.select(pair.alias("pair_id"), side.alias("side"), "turn", "role", "text")


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their place from 0 within their side."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = turns.select("pair_id", "side", "turn", role.alias("role"), text.alias("text")).distinct()
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    return own.withColumn("place", F.row_number().over(order) - 1)


def prefixes(placed: DataFrame) -> DataFrame:
    """``(pair_id, shared)``: how many turns both sides begin with."""
    both = placed.groupBy("pair_id", "place").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("role", "text")).alias("lo"), F.max(F.struct("role", "text")).alias("hi")
    )
    apart = F.when((F.col("n") < 2) | (F.col("lo") != F.col("hi")), F.col("place"))
    return both.groupBy("pair_id").agg(F.coalesce(F.min(apart), F.max("place") + 1).alias("shared"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def _mask(turns: Column) -> Column:
    """Counted ranges of a completion, ``start:end`` by commas, from its turns in order."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("ranges"))

    def step(state: Column, turn: Column) -> Column:
        head = state["at"] + F.char_length(turn["role"]) + len(OPEN) + len(CLOSE)
        end = head + F.char_length(turn["text"]) + len(END)
        own = F.when(turn["role"] == "assistant", F.array(F.concat_ws(":", head.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.cast("long").alias("at"), F.concat(state["ranges"], own).alias("ranges"))

    return F.concat_ws(",", F.aggregate(turns, start, step, lambda s: s["ranges"]))


def preference_texts(turns: DataFrame) -> DataFrame:
    """One row per pair: ``prompt``, both completions with their masks, ``prompt_turns`` and the completions' turns.

    ``turns(pair_id, side, turn, role, text)`` with side ``chosen`` or ``rejected``.
    """
    placed = _placed(turns)
    cut = placed.join(prefixes(placed), "pair_id")
    part = F.when(F.col("place") >= F.col("shared"), F.col("side")).when(F.col("side") == SIDES[0], F.lit("prompt"))
    # the prompt's turns come from one side only, the other's are the same
    row = F.struct("place", "role", "text")
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("part") == name, row))).alias(name)
    gathered = cut.withColumn("part", part).groupBy("pair_id").agg(of("prompt"), *[of(s) for s in SIDES])
    text = lambda name: F.array_join(F.transform(name, lambda t: rendered(t["role"], t["text"])), "")
    out = [F.col("pair_id"), text("prompt").alias("prompt")]
    for s in SIDES:
        out += [text(s).alias(s), _mask(F.col(s)).alias(f"{s}_mask")]
    sizes = [F.size(p).cast("long").alias(f"{p}_turns") for p in ("prompt", *SIDES)]
    return gathered.select(*out, *sizes)
