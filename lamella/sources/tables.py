"""Sources and sinks with fixed schemas: counts, matrices, positions, features, masks, and writers that never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lamella.operators.tasks import dealt

NATIVE = StructType([StructField("section_id", LongType()), StructField("y", LongType()), StructField("x", LongType()), StructField("gene_id", LongType()), StructField("umi", LongType())])
POSITIONS = StructType(
    [StructField("barcode", StringType()), StructField("in_tissue", IntegerType()), StructField("pxl_row_in_fullres", DoubleType()), StructField("pxl_col_in_fullres", DoubleType()), StructField("qc_pass", IntegerType())]
)
METADATA = StructType([StructField("section_id", LongType()), StructField("spot_pitch", DoubleType()), StructField("nrows", LongType()), StructField("ncols", LongType())])
FEATURES = StructType([StructField("feature_idx", LongType()), StructField("gene_id", StringType()), StructField("feature_type", StringType()), StructField("probe", BooleanType())])


def native_counts(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """Exported sparse counts. A count outside the capture, negative or missing fails while it is read."""
    from lamella.operators.counts import checked

    inside = F.col("y").between(0, rows - 1) & F.col("x").between(0, cols - 1)
    df = spark.read.schema(NATIVE).parquet(path)
    return checked(df.withColumn("y", F.when(inside, F.col("y")).otherwise(F.raise_error(F.lit("a count lies outside the capture")).cast("long"))))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Spot positions CSV (with or without qc_pass): spots in tissue that passed. Flags other than 0 and 1 fail."""
    header = spark.read.option("header", True).csv(path).columns
    df = spark.read.csv(path, header=True, schema=StructType([f for f in POSITIONS if f.name in header]), enforceSchema=False, mode="FAILFAST")
    if "qc_pass" not in header:
        df = df.withColumn("qc_pass", F.lit(1))
    flag = lambda c: F.when(c.isin(0, 1), c).otherwise(F.raise_error(F.lit("a flag is neither 0 nor 1")).cast("int"))
    return df.where((flag(F.col("in_tissue")) == 1) & (flag(F.coalesce("qc_pass", F.lit(1))) == 1))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Capture metadata (JSON lines): the pitch must be 2 um and both sides at least 128 pixels."""
    ok = (F.col("spot_pitch") == 2) & (F.least("nrows", "ncols") >= 128)
    df = spark.read.schema(METADATA).option("mode", "FAILFAST").json(path)
    return df.withColumn("section_id", F.when(ok, F.col("section_id")).otherwise(F.raise_error(F.lit("a capture has another pitch or is too small")).cast("long")))


def tissue_parents(mask: DataFrame, rows: int, cols: int) -> DataFrame:
    """(section_id, py, px) of flagged 16 um parents of ``mask`` (section_id, py, px, flag).

    A flagged parent that is repeated, negative or not wholly inside the capture fails; none is clipped.
    """
    kept = mask.where("flag").select("section_id", "py", "px")
    n = kept.groupBy("section_id", "py", "px").agg(F.count("*").alias("_n"))
    fine = (F.col("_n") == 1) & (F.col("py") >= 0) & (F.col("px") >= 0) & ((F.col("py") + 1) * 8 <= rows) & ((F.col("px") + 1) * 8 <= cols)
    return n.select("section_id", F.when(fine, F.col("py")).otherwise(F.raise_error(F.lit("a tissue parent is repeated or not whole")).cast("long")).alias("py"), "px")


def measurable(features: DataFrame, probes_only: bool) -> DataFrame:
    """Gene features that can be measured: all of them, or those of the probe set. Repeated ids fail."""
    kept = features.where("feature_type = 'Gene Expression'" + (" AND probe" if probes_only else ""))
    n = F.count("*").over(Window.partitionBy("gene_id"))
    return kept.withColumn("gene_id", F.when(n == 1, F.col("gene_id")).otherwise(F.raise_error(F.concat(F.lit("repeated gene: "), "gene_id")).cast(kept.schema["gene_id"].dataType)))


def csc_matrix(data: DataFrame, indptr: DataFrame) -> DataFrame:
    """Compressed columns to (row, col, value): ``data`` (k, row, value) by position, ``indptr`` (col, start), columns from 0 without gaps, with one last end.

    A column's entries are the positions from its start to the next one. Starts are joined as ranges of blocks of 4,096
    positions, so that a column of any length spreads over tasks.
    """
    size = 4096.0
    # A column ends where the next one starts; columns are numbered without gaps, so that they meet by an equi-join.
    following = indptr.select((F.col("col") - 1).alias("col"), F.col("start").alias("stop"))
    spans = indptr.join(dealt(following), "col").where("stop > start").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    return data.withColumn("block", F.floor(F.col("k") / size)).join(dealt(spans), "block").where("k >= start AND k < stop").select("row", "col", "value")


def matched(matrix: DataFrame, places: DataFrame, key: str = "barcode") -> DataFrame:
    """Matrix rows with their place; a barcode without one fails."""
    joined = matrix.join(places.withColumn("_known", F.lit(True)), key, "left")
    return joined.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no position for "), F.col(key).cast("string"))).cast(matrix.schema[key].dataType))).drop("_known")


def looked_up(wanted: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a table for requested keys, all of which must exist: nothing is filled with zero."""
    joined = wanted.select(*key).join(table.withColumn("_known", F.lit(True)), key, "left")
    first = key[0]
    return joined.withColumn(first, F.when(F.col("_known"), F.col(first)).otherwise(F.raise_error(F.lit("a requested key is missing")).cast(wanted.schema[first].dataType))).drop("_known")


def write_new(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet to a path that must not exist yet."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def write_equal(df: DataFrame, path: str) -> bool:
    """Writes a new table, or verifies that the one at the path holds the same rows. False if they differ."""
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    try:
        there = spark.read.schema(df.schema).parquet(path)
    except AnalysisException:
        write_new(df, path)
        return True
    return there.exceptAll(df).isEmpty() and df.exceptAll(there).isEmpty()


def write_observed(observed: DataFrame, truth: DataFrame, path: str) -> None:
    """Observations and truth under separate paths, the truth marked by its role, so that no model input leads to it."""
    write_new(observed, f"{path}/observed", "section_id")
    write_new(truth.withColumn("role", F.lit("evaluation_only_measured_8um")), f"{path}/truth", "section_id")


def write_report(report: DataFrame, path: str) -> None:
    """JSON report, a row a line."""
    report.coalesce(1).write.mode("errorifexists").json(path)
