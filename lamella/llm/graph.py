"""Connected components by alternating star contractions, and the session helpers that it needs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import checkpointed as cut


def bounded_batches(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """Sets the session's limit on the bytes of an Arrow batch, so that 10,000 very long texts never meet in one."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def unused(columns: list[str], name: str, ends: tuple[str, ...] = ("",)) -> str:
    """``name`` with so many underscores before it that with none of ``ends`` it is one of ``columns``, in any case."""
    taken = {c.lower() for c in columns}
    while any(f"{name}{e}".lower() in taken for e in ends):
        name = f"_{name}"
    return name


def whole_keys(batches, column: int = 0, most: int = 32 << 20):
    """Lists of Arrow batches of about ``most`` bytes, none of which ends inside a key; rows come in the keys' order."""
    held, n = [], 0
    for b in batches:
        if n > most:
            rest = int(np.searchsorted(b.column(column).to_numpy(), held[-1].column(column)[-1].as_py(), "right"))
            if rest < len(b):
                yield [*held, b.slice(0, rest)]
                held, n, b = [], 0, b.slice(rest)
        if len(b):
            held.append(b)
            n += b.nbytes
    if held:
        yield held


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge.

    ``edges`` has columns u and v of one orderable type. Nulls and loops are ignored, repeats are allowed. A node of
    very high degree only ever meets its minimum (an aggregate with map-side partial results) and an equi-join that
    AQE may split. Ends when a round changes nothing; rounds grow with the logarithm of the longest path.
    """
    e = cut(_tidy(edges.select("u", "v")))
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = cut(_star(_star(both, "large"), "small"))
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    low = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low)


def _tidy(e: DataFrame) -> DataFrame:
    """Larger end first, no loops, no repeats."""
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(e: DataFrame, kind: str) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = e.join(low, "u")
    if kind == "large":
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return _tidy(out)


def _state(e: DataFrame):
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]
