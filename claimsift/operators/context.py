"""The last turns of a conversation up to each turn, as a chat context.

A conversation may be long, so its turns are cut into chunks. Each chunk is one
window group; the turns just before it are handed over from the chunk tails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CONTEXT_TURNS = 6
CHUNK_TURNS = 10_000


def chat_context(conversations: DataFrame, turns: int = CONTEXT_TURNS, chunk: int = CHUNK_TURNS) -> DataFrame:
    """Rows with ``context``: the last ``turns`` turns as role and content."""
    role = F.when(F.col("role") == "user", F.lit("user")).otherwise(F.lit("assistant"))
    message = F.struct(role.alias("role"), F.col("text").alias("content"))
    number = F.coalesce(F.floor(F.col("turn") / F.lit(chunk)), F.lit(-1))
    rows = conversations.withColumns({"_m": message, "_chunk": number, "_conv": F.to_json(F.struct("conv_id"))})
    within = Window.partitionBy("_conv", "_chunk").orderBy("turn", "role", "text")
    last = within.rowsBetween(1 - turns, 0)
    local = rows.withColumn("_local", F.collect_list("_m").over(last))
    across = Window.partitionBy("_conv").orderBy("_chunk")
    tails = (
        local.groupBy("_conv", "_chunk")
        .agg(F.max_by("_local", F.struct("turn", "role", "text")).alias("_tail"))
        .withColumn("_before", F.flatten(F.collect_list("_tail").over(across.rowsBetween(1 - turns, -1))))
        .select("_conv", "_chunk", "_before")
    )
    joined = local.join(tails, ["_conv", "_chunk"])
    both = F.concat("_before", "_local")
    first = F.greatest(F.size(both) - F.lit(turns - 1), F.lit(1))
    return joined.withColumn("context", F.slice(both, first, F.lit(turns))).drop("_m", "_conv", "_chunk", "_local", "_before")
