"""Chat formatting with collapse of cumulative snapshots.

Chats are often logged again after each turn. A rolling hash over turns names every prefix of every conversation; a
conversation whose whole hash names a proper prefix of a longer one is a snapshot and goes, and of equal conversations
the one with the smallest conv_id stays. What stays is rendered.

The rolling hash is an exclusive or of 2 x 64 hash bits of (position, role, text), so it is a prefix aggregate: positions
and hashes are computed in blocks of turns and carried over block totals, so a very long conversation is spread over
tasks until its one rendered row is put together.

Defined results: turns are ordered by turn (nulls first), role, text; null role is "unknown", null text is empty;
repeated rows are repeated turns; rows with a null conv_id belong to no conversation and are ignored; an empty table
gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinlink.llm.common import materialise

#: Turn numbers of a block.
BLOCK = 1024


def prefix_hashes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, role, text, position (from 1), h1, h2: hashes of the conversation up to and with this turn."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    inner = W.partitionBy("conv_id", "_block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    over = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "_block").agg(F.count("*").alias("_n")).select("conv_id", "_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_at", F.row_number().over(inner)).join(before, ["conv_id", "_block"])
    placed = placed.withColumn("position", F.col("_before") + F.col("_at"))
    marks = {f"h{k}": F.xxhash64(F.lit(k), "position", "role", "text") for k in (1, 2)}
    marked = placed.select("conv_id", "_block", "position", "role", "text", *[h.alias(c) for c, h in marks.items()])
    whole = marked.groupBy("conv_id", "_block").agg(*[F.expr(f"bit_xor({c})").alias(c) for c in marks])
    carried = whole.select("conv_id", "_block", *[F.coalesce(F.expr(f"bit_xor({c})").over(over), F.lit(0)).alias(f"_{c}") for c in marks])
    rolling = W.partitionBy("conv_id", "_block").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    local = marked.select("conv_id", "_block", "position", "role", "text", *[F.expr(f"bit_xor({c})").over(rolling).alias(c) for c in marks])
    return local.join(carried, ["conv_id", "_block"]).select("conv_id", "position", "role", "text", *[F.col(c).bitwiseXOR(F.col(f"_{c}")).alias(c) for c in marks])


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another one."""
    size = hashed.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    last = hashed.select("conv_id", "position", "h1", "h2").join(size, "conv_id")
    full = last.where("position = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = last.where("position < n_turns").select(F.col("position").alias("n_turns"), "h1", "h2").distinct()
    return full.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(hashed: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each kept conversation with its turns as marked text."""
    turn = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    rows = hashed.select("conv_id", "position", turn.alias("t")).join(kept, "conv_id")
    gathered = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("position", "t"))).alias("ts"))
    return gathered.select("conv_id", "n_turns", "n_copies", F.concat_ws("", "ts.t").alias("rendered"))


def format_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered of the maximal conversations. The hashes are a table, as three steps read them."""
    hashed = materialise(prefix_hashes(turns, block), "chat")
    return render(hashed, maximal(hashed))
