"""Stores of native counts by 256-pixel block, of feature rows in parts, and of frozen owner maps, with the checks that guard them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.operators import counts as count_operators
from lamella.operators import ranks
from lamella.operators.checks import guarded
from lamella.operators.geometry import down
from lamella.operators.tasks import dealt
from lamella.sources.tables import write_new

SIDE, FOV = 256, 128
BLOCK = ["section_id", "block_y", "block_x"]
#: Folders of a store at most; where it has more rows of blocks, neighbours share one.
FOLDERS = 512


def write_counts(counts: DataFrame, panel: DataFrame, blocks: DataFrame, path: str) -> None:
    """Stores counts (section_id, y, x, gene_id, umi) of panel genes in the listed blocks (section_id, block_y, block_x).

    ``<path>/counts``: (section_id, block_y, block_x, local_linear, gene_index, count), sorted by block. Every row of blocks
    of a section has its folder, so that a reader opens the rows of blocks it asks for; where that would be more than
    ``FOLDERS``, rows of blocks that follow each other share one, as thousands of small files cost more than their content.
    ``<path>/index``: folder and entries of every block and where they start. A count that 16 bits cannot hold fails the write; the
    path must be new.
    """
    whole = (F.col("umi") >= 0) & (F.col("umi") <= 65535) & (F.col("umi") == F.floor(F.col("umi").cast("double")))
    listed = _in_folders(blocks.select(*BLOCK).distinct())
    kept = counts.join(F.broadcast(panel.select("gene_id", F.col("pos").alias("gene_index"))), "gene_id")  # a panel is a bounded list of genes
    kept = kept.withColumn("block_y", down("y", SIDE)).withColumn("block_x", down("x", SIDE)).join(listed, BLOCK)
    local = (F.col("y") - F.col("block_y") * SIDE) * SIDE + F.col("x") - F.col("block_x") * SIDE
    rows = kept.select("folder", *BLOCK, local.cast("int").alias("local_linear"), F.col("gene_index").cast("int").alias("gene_index"), guarded(F.col("umi"), F.coalesce(whole, F.lit(False)), "a count does not fit 16 bits", "long").cast("int").alias("count"))
    # Range partitions keep a row of blocks together or cut it between blocks, and never mix many rows in one task.
    ordered = rows.repartitionByRange("folder", *BLOCK).sortWithinPartitions("folder", *BLOCK, "gene_index", "local_linear")
    write_new(ordered, f"{path}/counts", "folder")
    stored = counts.sparkSession.read.parquet(f"{path}/counts").select(*BLOCK)
    size = stored.groupBy(*BLOCK).agg(F.count("*").alias("nnz"))
    index = listed.join(size, BLOCK, "left").withColumn("nnz", F.coalesce("nnz", F.lit(0)))
    index = count_operators.running(index, "nnz", ["block_y", "block_x"], ["section_id"])
    write_new(index.withColumn("stop", F.col("start") + F.col("nnz")), f"{path}/index")


def _in_folders(listed: DataFrame) -> DataFrame:
    """Listed blocks with the folder of their row of blocks; folders are numbered in the order of sections and rows."""
    rows = ranks.ranked(listed.select("section_id", "block_y").distinct(), ["section_id", "block_y"], name="folder")
    each = -(-rows.count() // FOLDERS) or 1
    return listed.join(rows.withColumn("folder", F.floor(F.col("folder") / float(each)).cast("int")), ["section_id", "block_y"]).select(*BLOCK, "folder")


def read_counts(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """Stored counts (section_id, y, x, gene_index, count) of the blocks asked for, all of which must be listed in the store.

    The blocks' folders are the partition column, so that Spark prunes what it reads by them while the query runs.
    """
    index = spark.read.parquet(f"{path}/index").select(*BLOCK, "folder")
    asked = blocks.select(*BLOCK).distinct().join(index, BLOCK, "left")
    asked = asked.withColumn("folder", guarded(F.col("folder"), F.col("folder").isNotNull(), "a block is not in the store", "int"))
    rows = spark.read.parquet(f"{path}/counts").join(asked, ["folder", *BLOCK])
    return rows.select("section_id", (F.col("block_y") * SIDE + F.floor(F.col("local_linear") / float(SIDE))).alias("y"), (F.col("block_x") * SIDE + F.col("local_linear") % SIDE).alias("x"), "gene_index", "count")


def blocks_of(fields: DataFrame, fov: int = FOV) -> DataFrame:
    """Fields (section_id, .., y0, x0) with every block that they touch."""
    out = fields
    for v, c in (("y0", "block_y"), ("x0", "block_x")):
        out = out.withColumn(c, F.explode(F.sequence(down(v, SIDE), F.floor((F.col(v) + fov - 1) / float(SIDE)).cast("long"))))
    return out


def field_counts(spark: SparkSession, path: str, fields: DataFrame, fov: int = FOV) -> DataFrame:
    """Stored counts of every field at field-local (ly, lx): (fields' columns, ly, lx, gene_index, count). Fields open their blocks only."""
    placed = blocks_of(fields, fov)
    rows = read_counts(spark, path, placed).withColumn("block_y", down("y", SIDE)).withColumn("block_x", down("x", SIDE))
    met = rows.join(placed, BLOCK)
    inside = F.col("y").between(F.col("y0"), F.col("y0") + fov - 1) & F.col("x").between(F.col("x0"), F.col("x0") + fov - 1)
    return met.where(inside).select(*fields.columns, (F.col("y") - F.col("y0")).alias("ly"), (F.col("x") - F.col("x0")).alias("lx"), "gene_index", "count")


def gated(store: DataFrame, requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of a store partitioned by section for requested fields (section_id, role, protocol_id, field_id), which must all be authorized.

    ``manifest``: (section_id, role, protocol_id, fields), one row for each section's role. A request of another role or
    protocol, or beyond the section's fields, fails before any of the store is read: the requests are the side that
    decides which partitions are read.
    """
    limit = manifest.select("section_id", "role", "protocol_id", F.col("fields").alias("_limit"))
    met = requests.join(limit, ["section_id", "role", "protocol_id"], "left")
    fine = F.coalesce(F.col("field_id").between(0, F.col("_limit") - 1), F.lit(False))
    asked = met.select(guarded(F.col("section_id"), fine, "a field lies outside its section, role or protocol", dict(requests.dtypes)["section_id"]).alias("section_id"), *[c for c in requests.columns if c != "section_id"])
    return store.join(asked, ["section_id", "field_id"])


def feature_rows(requests: DataFrame, parts: DataFrame, rows: DataFrame, pools: DataFrame) -> DataFrame:
    """Feature rows of requested fields (section_id, field_id, y0, x0) from parts that each hold a range of a section's fields.

    ``parts``: (section_id, part_id, start, stop); ``rows``: (section_id, part_id, local, py0, px0, ..) with local counted from
    the part's start; ``pools``: (section_id, fields). The parts of a section must start at 0, follow each other without gap
    or overlap and end with its fields; a requested field must lie in one of them, with the same origin. Anything else fails.
    """
    line = Window.partitionBy("section_id").orderBy("start", "stop")  # a section has a few parts
    first = F.coalesce(F.lag("stop").over(line), F.lit(0))
    last = F.lead("start").over(line).isNull()
    checked = parts.join(pools, "section_id").withColumn("_first", first).withColumn("_last", last)
    fine = (F.col("start") == F.col("_first")) & (F.col("stop") > F.col("start")) & (~F.col("_last") | (F.col("stop") == F.col("fields")))
    checked = checked.select("section_id", "part_id", guarded(F.col("start"), fine, "parts leave a gap, overlap or end elsewhere", "long").alias("start"), "stop")
    inside = (F.col("r.section_id") == F.col("p.section_id")) & (F.col("field_id") >= F.col("start")) & (F.col("field_id") < F.col("stop"))
    placed = requests.alias("r").join(checked.alias("p"), inside, "left").select("r.*", "part_id", "start")
    placed = placed.withColumn("local", guarded(F.col("field_id") - F.col("start"), F.col("start").isNotNull(), "a field lies outside all parts", "long")).drop("start")
    met = placed.join(rows, ["section_id", "part_id", "local"], "left")
    same = F.coalesce((F.col("y0") == F.col("py0")) & (F.col("x0") == F.col("px0")), F.lit(False))
    return met.withColumn("y0", guarded(F.col("y0"), same, "a feature row is missing or has another origin", "long")).drop("part_id", "local", "py0", "px0")


def layout_digest(owners: DataFrame, *key: str) -> DataFrame:
    """(key, digest, pixels): version of every field's owner map, from 64-bit hashes of its owned pixels, whatever their order."""
    h = [F.xxhash64(F.lit(i), "ly", "lx", "parent_id") for i in (1, 2)]
    n = owners.groupBy(*key).agg(*[F.bit_xor(c).alias(f"_h{i}") for i, c in enumerate(h)], F.count("*").alias("pixels"))
    return n.select(*key, F.sha2(F.concat_ws(":", "_h0", "_h1", F.col("pixels").cast("string")), 256).alias("digest"), "pixels")


def square_owners(fields: DataFrame, fov: int = FOV) -> DataFrame:
    """Fields with the owners of their pixels in 16 um squares, numbered by row: (.., ly, lx, parent_id)."""
    n = F.sequence(F.lit(0).cast("long"), F.lit(fov - 1).cast("long"))
    at = fields.withColumn("ly", F.explode(n)).withColumn("lx", F.explode(n))
    return at.withColumn("parent_id", down("ly", 8) * (fov // 8) + down("lx", 8))


def frozen_owners(requests: DataFrame, layouts: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner maps of validation fields: (section_id, field_id, task, ly, lx, parent_id).

    ``requests``: (section_id, field_id, task, y0, x0); task "HD16" is computed, "Spot55" comes from the store.
    ``layouts``: (section_id, field_id, role, y0, x0, digest) and ``owners``: (section_id, field_id, ly, lx, parent_id) are
    the frozen store. A request for another task, of a field that is not stored as validation, that starts elsewhere, or
    whose owners no longer have the stored digest fails.
    """
    at = ["section_id", "field_id"]
    known = layouts.select(*at, "role", F.col("y0").alias("_y"), F.col("x0").alias("_x"), F.col("digest").alias("_digest"))
    met = requests.join(known, at, "left")
    fine = (F.col("role") == "validation") & (F.col("y0") == F.col("_y")) & (F.col("x0") == F.col("_x")) & F.col("task").isin("HD16", "Spot55")
    # The check is part of what splits requests by task, so that none is dropped before it was looked at.
    met = met.withColumn("task", guarded(F.col("task"), F.coalesce(fine, F.lit(False)), "a layout is not this field's validation layout", "string"))
    computed = square_owners(met.where("task = 'HD16'").select(*at, "task"))
    stored = met.where("task = 'Spot55'").select(*at, "task", "_digest").join(dealt(layout_digest(owners, *at)), at, "left")
    stored = stored.select(guarded(F.col("section_id"), F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False)), "a stored layout has changed", "long").alias("section_id"), "field_id", "task")
    return computed.unionByName(stored.join(dealt(owners), at).select(*computed.columns))
