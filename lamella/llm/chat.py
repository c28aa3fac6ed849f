"""Cumulative-snapshot collapse: logged conversations that are prefixes of longer ones go before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.graph import cut

#: Turns of a conversation are numbered and hashed in runs of this many, so that none needs a whole conversation.
RUN = 256
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _hashed(conversations: DataFrame) -> DataFrame:
    """Rows of non-null conv_id with c1, c2 (128 bits of role and text) and t1 (of turn); nulls apart from all values."""
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", "role", "text", F.xxhash64(*parts).alias("c1"), F.xxhash64(F.lit("second"), *parts).alias("c2"), F.xxhash64(F.col("turn").isNull(), "turn").alias("t1")
    )


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, t1, c1, c2, position, n_turns, x1, x2): distinct turns numbered from 0, with the rolling hash of all so far.

    Order: turn (null first), then role and text. Repeated rows count once; rows of null conv_id are left out; a null
    role or text differs from an empty one. The rolling hash is the XOR of two 64-bit hashes of (position, role, text):
    it is kept up run by run, and the runs' totals are added afterwards. Only hashes of role and text are shuffled; the
    values themselves are looked at where turns of one number differ.
    """
    rows = _hashed(conversations)
    t = rows.select("conv_id", "turn", "t1", "c1", "c2").distinct()
    tied = cut(t.groupBy("conv_id", "t1").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", "t1"))
    if tied.isEmpty():
        t = t.withColumn("tie", F.lit(0))
    else:
        among = Window.partitionBy("conv_id", "t1").orderBy(F.asc_nulls_first("role"), F.asc_nulls_first("text"))
        ties = rows.join(tied, ["conv_id", "t1"], "left_semi").select("conv_id", "t1", "role", "text", "c1", "c2").distinct()
        ties = ties.withColumn("tie", F.row_number().over(among)).drop("role", "text")
        t = t.join(ties, ["conv_id", "t1", "c1", "c2"], "left").withColumn("tie", F.coalesce("tie", F.lit(0)))
    t = t.withColumn("run", F.floor(F.coalesce("turn", F.lit(-1)) / RUN))
    run = Window.partitionBy("conv_id", "run").orderBy(F.asc_nulls_first("turn"), "tie")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    t = t.withColumn("n", F.row_number().over(run)).drop("turn", "tie")
    size = t.groupBy("conv_id", "run").agg(F.count("*").alias("size"))
    size = size.select("conv_id", "run", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(whole).alias("n_turns"))
    t = t.join(size, ["conv_id", "run"]).withColumn("position", F.col("base") + F.col("n") - 1).drop("base")
    h = [F.xxhash64("position", "c1", "c2"), F.xxhash64(F.lit("second"), "position", "c1", "c2")]
    so_far = Window.partitionBy("conv_id", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.bit_xor(h[i]).over(so_far).alias(f"y{i + 1}") for i in (0, 1)])
    total = t.groupBy("conv_id", "run").agg(F.max_by("y1", "n").alias("h1"), F.max_by("y2", "n").alias("h2"))
    total = total.select("conv_id", "run", *[F.coalesce(F.bit_xor(f"h{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    t = t.join(total, ["conv_id", "run"])
    return t.select("conv_id", "t1", "c1", "c2", "position", "n_turns", F.col("y1").bitwiseXOR(F.col("b1")).alias("x1"), F.col("y2").bitwiseXOR(F.col("b2")).alias("x2"))


def maximal(numbered: DataFrame) -> DataFrame:
    """(conv_id) of conversations that are no proper prefix of another; of equal ones the smallest conv_id."""
    prefix = numbered.select("conv_id", "n_turns", (F.col("position") + 1).alias("length"), "x1", "x2")
    whole = prefix.where("length = n_turns").groupBy("length", "x1", "x2").agg(F.min("conv_id").alias("conv_id"))
    longer = prefix.where("length < n_turns").select("length", "x1", "x2").distinct()
    return whole.join(longer, ["length", "x1", "x2"], "left_anti").select("conv_id")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template. Marks of the template inside a role or text are broken up; nulls read as unknown/empty."""
    safe = lambda c, d: F.replace(F.coalesce(c, F.lit(d)), F.lit("<|"), F.lit("< |"))
    head, mid, tail = TEMPLATE
    return F.concat(F.lit(head), F.lower(F.trim(safe(role, "unknown"))), F.lit(mid), safe(text, ""), F.lit(tail))


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, position, rendered): the rendered turns of the maximal conversations, a row each.

    Turns stay rows, so that a conversation of any length never has to fit one task.
    """
    numbered = cut(turns(conversations))
    kept = numbered.join(maximal(numbered), "conv_id", "left_semi").select("conv_id", "t1", "c1", "c2", "n_turns", "position")
    key = ["conv_id", "t1", "c1", "c2"]
    met = _hashed(conversations).join(kept, key)
    return met.dropDuplicates(key).select("conv_id", "n_turns", "position", rendered(F.col("role"), F.col("text")).alias("rendered"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): as above with the turns of each conversation joined, for lengths that fit a row."""
    parts = format_turns(conversations).groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("position", "rendered"))).alias("p"))
    return parts.select("conv_id", "n_turns", F.array_join("p.rendered", "").alias("rendered"))
