"""Streams over the event table; their last state must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.plans.registry import query
from lamella.plans.sampling_queries import POLICY, stopping_sql
from lamella.streaming import accumulate


@query(
    """SELECT event_type, round(CASE WHEN max(y) > min(y) AND max(p) > min(p) THEN corr(p, y) END, 5) + 0.0 AS pcc, round(avg(abs(p-y)), 5) + 0.0 AS mae
       FROM (SELECT event_type, CAST(value AS DOUBLE) AS y, CAST(value AS DOUBLE) + user_id % 17 AS p FROM events) GROUP BY 1"""
)
def streamed_scores(spark, sf_dir):
    """Scores of predictions accumulated over a stream of events."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A file source takes a folder and picks its files by name.
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    pairs = events.select("event_type", F.col("value").cast("double").alias("y"), (F.col("value").cast("double") + F.col("user_id") % 17).alias("p"))
    out = accumulate.drained(accumulate.gene_scores(pairs, "event_type"), "complete")
    return out.select("event_type", (F.round("pcc", 5) + F.lit(0.0)).alias("pcc"), (F.round("mae", 5) + F.lit(0.0)).alias("mae"))


@query(stopping_sql("runs AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, CAST(value AS DOUBLE)*1000 AS hd16, CAST(event_id % 101 AS DOUBLE) AS spot55 FROM events)").replace("AND epoch >= 4 ", "").replace("SELECT run, best_epoch, stopped FROM f", "SELECT f.run, b.event_id AS best_epoch, coalesce(s.event_id, -1) AS stopped FROM f").replace("USING (run, epoch)", """USING (run, epoch)
  JOIN (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) b ON b.run = f.run AND b.k = f.best_epoch
  LEFT JOIN (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) s ON s.run = f.run AND s.k = f.stopped"""))
def streamed_early_stopping(spark, sf_dir):
    """Early stopping kept up over a stream of events: a run a user, its epochs the event ids."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    runs = events.select(F.col("user_id").alias("run"), F.col("event_id").cast("long").alias("epoch"), (F.col("value").cast("double") * 1000).alias("hd16"), (F.col("event_id") % 101).cast("double").alias("spot55"))
    out = accumulate.drained(accumulate.early_stopping(runs, ["hd16", "spot55"], **POLICY | {"minimum": 0}), "update")
    return out.groupBy("run").agg(F.max_by("best_epoch", "trigger").alias("best_epoch"), F.max_by("stopped", "trigger").alias("stopped"))
