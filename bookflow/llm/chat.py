"""Chat formatting: collapse cumulative snapshots of conversations, then render the maximal ones.

A logger that writes a conversation after every turn leaves many that begin a longer one. Every turn gets the rolling hash of
all turns up to it: a sum of hashes of (place, role, text), kept in four 32-bit lanes, which is order-dependent through the
place and can be summed in blocks. A conversation goes if its whole hash is a proper prefix hash of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import free_name
from bookflow.operators.scan import prefix_sum
from bookflow.settings import stage

TURNS_IN_BLOCK = 12                  # as a power of two: turn numbers that are scanned in one task
OPENING, CLOSING = "<|im_start|>", "<|im_end|>"
LANES = ("a", "b", "c", "d")


def prefix_hashes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """k (a conversation's key), conv_id, n (turns so far) and the lanes of the rolling hash, for every turn.

    Only hashes of the texts are moved. Null roles and texts differ from empty ones. Turns are ordered by number, nulls
    first, equal numbers by the hash of role and text, so that repeated rows are turns of their own.
    """
    said = [F.col(role).isNull(), F.col(role), F.col(text).isNull(), F.col(text)]
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("null")).alias("k"), F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("bigint").alias("t"), F.xxhash64(F.lit("x"), *said).alias("x"), F.xxhash64(F.lit("y"), *said).alias("y"))
    block = F.coalesce(F.shiftright("t", TURNS_IN_BLOCK), F.lit(-(1 << 52)))
    order = [F.col("t").asc_nulls_first(), "x", "y"]
    placed = stage(prefix_sum(rows, ["k"], order, block, place=F.lit(1)), "turn-places")
    low, high = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda h: F.shiftrightunsigned(h, 32))
    x, y = F.xxhash64("place", "x"), F.xxhash64("y", "place")
    own = dict(zip(LANES, (low(x), high(x), low(y), high(y)), strict=True))
    block = F.shiftright("place", TURNS_IN_BLOCK)
    summed = prefix_sum(placed, ["k"], ["place"], block, **own)
    return summed.select("k", "conv_id", (F.col("place") + 1).alias("n"), *[(F.col(c) + own[c]).alias(c) for c in LANES])


def maximal(prefixes: DataFrame) -> DataFrame:
    """k, n_turns of the conversations that begin no longer one; of equal ones the smallest id stays (null is the smallest).

    Prefixes are counted before they meet the conversations: a first turn shared by a third of all is one row. A
    whole conversation is as frequent as its prefix unless a longer one begins with it.
    """
    shared = prefixes.groupBy("n", *LANES).agg(F.count("*").alias("prefixes"))
    whole = prefixes.groupBy("k").agg(F.max_by(F.struct("conv_id", "n", *LANES), "n").alias("w")).select("k", "w.*")
    whole = whole.groupBy("n", *LANES).agg(F.count("*").alias("same"), F.min(F.struct("conv_id", "k")).alias("first"))
    longer = shared.join(whole.select("n", *LANES, "same"), ["n", *LANES]).where(F.col("prefixes") > F.col("same"))
    return whole.join(longer.select("n", *LANES), ["n", *LANES], "left_anti").select("first.k", F.col("n").alias("n_turns"))


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           opening: str = OPENING, closing: str = CLOSING) -> DataFrame:
    """The turns of maximal conversations with ``rendered`` (the turn in the chat template) and ``n_turns``.

    One row per turn: a conversation is its pieces in turn order, so none needs to fit a task. A null role is
    ``unknown``, a null text empty; the template's marks inside a text are broken by a space. All columns of the
    input stay, of clashing names the new ones win; an empty table stays empty. Repeated conversations are one;
    a repeated row of one conversation is a turn of its own; rows without conv_id form one conversation.
    """
    kept = maximal(prefix_hashes(turns, conv_id, turn, role, text))
    own = turns.drop(*[c for c in turns.columns if c.lower() in ("rendered", "n_turns")])
    key = free_name(own, "_k")[0]
    broken = F.coalesce(F.col(text), F.lit(""))
    for mark in (opening, closing):
        broken = F.replace(broken, F.lit(mark), F.lit(f"{mark[:1]} {mark[1:]}"))
    piece = F.concat(F.lit(opening), F.lower(F.trim(F.coalesce(F.col(role), F.lit("unknown")))), F.lit("\n"), broken, F.lit(f"{closing}\n"))
    keyed = own.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("null")))
    return (keyed.join(kept.withColumnRenamed("k", key), key).withColumn("rendered", piece)
            .select(*own.columns, "rendered", "n_turns"))
