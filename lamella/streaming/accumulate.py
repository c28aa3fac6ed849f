"""Streaming forms of the incremental contracts: score moments, and early stopping per run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import metrics
from lamella.session import shared_folder


def streamed(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def gene_scores(pairs: DataFrame, *keys: str) -> DataFrame:
    """Scores over all pairs so far; for complete mode. The state is one row of sums for each key."""
    return metrics.gene_scores(pairs.groupBy(*keys).agg(*metrics.moments()), *keys)


def early_stopping(runs: DataFrame, tasks: list[str], bounds: dict[str, float], patience: int, minimum: int, gains: dict[str, float] | None = None) -> DataFrame:
    """State of every run of a stream (run, epoch, a loss for each task): best epoch so far and the epoch it stopped at (-1: it goes on).

    The rule is that of ``operators.sampling.early_stopping``. Rows of one run may come in any order within a trigger; an
    epoch that does not advance on earlier triggers fails.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    n, gains = len(tasks), gains or {}

    def advance(key, frames: Iterator, state):
        import pandas as pd

        held = state.get if state.exists else (-1, 0, -1, -1, *[float("nan")] * 2 * n)
        best_epoch, stale, stopped, last = held[:4]
        best, first = list(held[4 : 4 + n]), list(held[4 + n :])
        for _, x in pd.concat(list(frames)).sort_values("epoch").iterrows():
            epoch, loss = int(x["epoch"]), [float(x[t]) for t in tasks]
            if epoch <= last:
                raise ValueError(f"epoch {epoch} of run {key[0]} does not advance")
            if best_epoch < 0:
                ok, first = True, loss
            else:
                worse = [v - min(b, f) for v, b, f in zip(loss, best, first, strict=True)]
                fine = all(w < bounds[t] if bounds[t] > 0 else w <= 0 for t, w in zip(tasks, worse, strict=True))
                ok = stopped < 0 and fine and any(b - v > gains.get(t, 0.0) for t, b, v in zip(tasks, best, loss, strict=True))
            best, best_epoch, stale = (loss, epoch, 0) if ok else (best, best_epoch, stale + 1)
            if stopped < 0 and stale >= patience and epoch >= minimum:
                stopped = epoch
            last = epoch
        state.update((best_epoch, stale, stopped, last, *best, *first))
        yield pd.DataFrame({"run": [key[0]], "best_epoch": [best_epoch], "stopped": [stopped]})

    state = "best_epoch long, stale long, stopped long, last long, " + ", ".join(f"{k}_{i} double" for k in ("best", "first") for i in range(n))
    return runs.groupBy("run").applyInPandasWithState(advance, "run long, best_epoch long, stopped long", state, "update", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, into Parquet of the shared folder, and returns the rows of its last output.

    Mode "complete" leaves the last trigger's table. Mode "update" leaves every trigger's rows, numbered by ``trigger``.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int):
        batch.withColumn("trigger", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{'last' if mode == 'complete' else f'batch-{number}'}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/last" if mode == "complete" else f"{folder}/batch-*")
    return out.drop("trigger") if mode == "complete" else out
