"""Chat formatting by collapse of cumulative snapshots, in DataFrame functions only.

A log often holds a conversation many times, each time a few turns longer. Every turn gets a
digest of its place, role and text; a running sum of these (two lanes of 60 bits in exact
decimals) is the hash of the prefix that ends there. A conversation whose full hash is the hash of
a proper prefix of another is a snapshot of it: an anti-join on (length, hash) drops it. Only the
digests are shuffled for that; the texts are shuffled once, for the conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _lane(code: Column, at: int) -> Column:
    return F.conv(F.substring(code, at, 15), 16, 10).cast("decimal(38,0)")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn(
        "code", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    )


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, last): the hash of the first n turns, for every n."""
    order = Window.partitionBy("conv_id").orderBy("turn", "code")
    placed = _turns(conversations).select("conv_id", "turn", "code").withColumn("n", F.row_number().over(order).cast("bigint"))
    own = placed.withColumn("own", F.sha2(F.concat_ws(":", "n", "code").cast("binary"), 256))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.select(
        "conv_id", "n", F.sum(_lane(F.col("own"), 1)).over(running).alias("h1"), F.sum(_lane(F.col("own"), 16)).over(running).alias("h2"),
        F.lead("n").over(order).isNull().alias("last"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no proper prefix of another; of equal ones the least conv_id."""
    hashes = prefix_hashes(conversations)
    full = hashes.filter("last").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = hashes.filter("not last").select("n", "h1", "h2").distinct()
    return full.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def format_chats(conversations: DataFrame, open_mark: str = "<|im_start|>", close_mark: str = "<|im_end|>") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, chat (its turns in a chat template).

    Turns are ordered by turn (nulls first); equal turn numbers by a digest of role and text, so
    repeated rows stay turns of their own. Null roles and texts are empty. Rows without conv_id
    form one conversation. An empty table gives an empty one; other columns are ignored.
    """
    stay = maximal_conversations(conversations).withColumnRenamed("conv_id", "stay_id")
    turns = _turns(conversations)
    kept = turns.join(stay, F.col("conv_id").eqNullSafe(F.col("stay_id"))).select("conv_id", "n_turns", "turn", "code", "role", "text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "code", "role", "text")))
    said = lambda x: F.concat(F.lit(open_mark), x["role"], F.lit("\n"), x["text"], F.lit(f"{close_mark}\n"))
    return kept.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.array_join(F.transform(ordered, said), "").alias("chat"))
