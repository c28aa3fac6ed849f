"""Queries over sources: matrices, positions, features, panels and user manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.operators import counts, geometry, metrics
from lamella.plans.count_queries import F4, F8, N, PAIRS, _uniform_pairs
from lamella.plans.fixture import native_counts, table
from lamella.plans.registry import query, r6
from lamella.sources import tables

CSC = "e AS (SELECT l_orderkey % 97 AS row, l_partkey % 61 AS col, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {CSC} SELECT row, col, value FROM e")
def csc_matrix(spark, sf_dir):
    """Compresses a matrix by columns and reads it back."""
    e = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("row"), (F.col("l_partkey") % 61).alias("col")).agg(F.sum("l_quantity").cast("long").alias("value"))
    size = e.groupBy("col").agg(F.count("*").alias("n"))
    before = Window.orderBy("col").rowsBetween(Window.unboundedPreceding, -1)  # 61 columns
    start = size.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    indptr = start.select("col", "start").unionByName(start.agg((F.max("col") + 1).alias("col"), F.sum("n").alias("start")))
    data = e.join(F.broadcast(start), "col").withColumn("k", F.col("start") + F.row_number().over(Window.partitionBy("col").orderBy("row")) - 1)
    return tables.csc_matrix(data.select("k", "row", "value"), indptr)


@query("SELECT c_custkey AS barcode, c_nationkey AS place, round(c_acctbal, 2) AS value FROM customer WHERE c_custkey % 3 <> 0 AND coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 7 > 0 AS INT) END, 1) = 1")
def tissue_positions(spark, sf_dir):
    """Spots in tissue that passed quality control; a missing flag passes."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("barcode"), F.col("c_nationkey").alias("place"), F.round("c_acctbal", 2).alias("value"), (F.col("c_custkey") % 3 != 0).cast("int").alias("in_tissue"), F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 7 > 0).cast("int")).alias("qc_pass"))
    kept = c.where((F.col("in_tissue") == 1) & (F.coalesce("qc_pass", F.lit(1)) == 1))
    return tables.matched(kept.select("barcode", "value"), c.select("barcode", "place"))


@query("SELECT p_partkey AS feature_idx, 'g' || p_partkey AS gene_id FROM part WHERE p_size % 4 <> 0 AND p_partkey % 3 = 0")
def measurable_features(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_idx"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene_id"), F.when(F.col("p_size") % 4 == 0, "Antibody").otherwise("Gene Expression").alias("feature_type"), (F.col("p_partkey") % 3 == 0).alias("probe"))
    return tables.measurable(f, True).select("feature_idx", "gene_id")


C8 = f"c8 AS (SELECT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx, gene_id, CAST(SUM(umi) AS BIGINT) AS umi FROM native_counts GROUP BY 1,2,3,4)"


@query(N.rstrip() + f",\n{C8}, q AS (SELECT DISTINCT section_id, qy, qx FROM c8 WHERE (qy + qx) % 4 = 0) SELECT q.section_id, q.qy, q.qx, g AS gene_id, coalesce(umi, 0) AS umi FROM q CROSS JOIN (SELECT DISTINCT gene_id AS g FROM native_counts WHERE gene_id < 4) LEFT JOIN c8 ON c8.section_id = q.section_id AND c8.qy = q.qy AND c8.qx = q.qx AND c8.gene_id = g")
def requested_cells(spark, sf_dir):
    """Counts at requested cells and genes, zeros included."""
    native = native_counts(spark, sf_dir)
    c8 = counts.squares(native, 4)
    cells = c8.select("section_id", "qy", "qx").distinct().where("(qy + qx) % 4 = 0")
    return counts.at_cells(c8, cells, native.select("gene_id").distinct().where("gene_id < 4"))


@query(N.rstrip() + f",\n{C8} SELECT section_id, qy, qx, count(*) AS genes, CAST(sum(umi) AS BIGINT) AS umi FROM c8 WHERE qy % 2 = 0 GROUP BY 1,2,3")
def checked_lookup(spark, sf_dir):
    c8 = counts.squares(native_counts(spark, sf_dir), 4).groupBy("section_id", "qy", "qx").agg(F.count("*").alias("genes"), F.sum("umi").alias("umi"))
    return tables.looked_up(c8.where("qy % 2 = 0"), c8, ["section_id", "qy", "qx"])


@query(N.rstrip() + f",\np AS (SELECT section_id, {F8.format('y')} AS parent_id, gene_id, CAST(sum(umi) AS BIGINT) AS umi FROM native_counts GROUP BY 1,2,3) SELECT section_id, parent_id, gene_id, CASE WHEN parent_id % 5 <> 0 AND gene_id < 14 THEN umi ELSE 0 END AS umi, parent_id % 5 <> 0 AND gene_id < 14 AS usable FROM p")
def masked_counts(spark, sf_dir):
    """Counts of invalid parents and unavailable genes are masked, not dropped."""
    p = native_counts(spark, sf_dir).groupBy("section_id", geometry.down("y", 8).alias("parent_id"), "gene_id").agg(F.sum("umi").alias("umi"))
    parents = p.select("section_id", "parent_id").distinct().withColumn("valid", F.col("parent_id") % 5 != 0)
    available = p.select("section_id", "gene_id").distinct().withColumn("available", F.col("gene_id") < 14)
    return counts.masked(p, parents, available)


@query(N.rstrip() + f""",\np AS (SELECT section_id, {F8.format('y')} AS py, {F8.format('x')} AS px, gene_id, CAST(sum(umi) AS DOUBLE) AS d FROM native_counts GROUP BY 1,2,3,4)
SELECT section_id, py, px, gene_id, round(ln(1 + 1e4*d/sum(d) OVER (PARTITION BY section_id, py, px)), 6) + 0.0 AS cp10k, round(ln(1 + d/64), 6) + 0.0 AS log_density FROM p""")
def normalised_counts(spark, sf_dir):
    """Counts per 10,000 of the parent, and densities, as log1p."""
    p = counts.squares(native_counts(spark, sf_dir), 8, ("py", "px")).withColumn("d", F.col("umi").cast("double"))
    total = F.sum("d").over(Window.partitionBy("section_id", "py", "px"))
    return p.select("section_id", "py", "px", "gene_id", r6(F.log1p(1e4 * metrics.safe(F.col("d"), total))).alias("cp10k"), r6(F.log1p(F.col("d") / 64)).alias("log_density"))


@query(PAIRS + "SELECT section_id, round(sum(y*greatest(-2, least(2, 2*tanh((y-p)/2)))), 4) + 0.0 AS bounded FROM pairs GROUP BY 1")
def bounded_residuals(spark, sf_dir):
    b = 2 * F.tanh((F.col("y") - F.col("p")) / 2)
    return _uniform_pairs(spark, sf_dir).groupBy("section_id").agg((F.round(F.sum(F.col("y") * b), 4) + F.lit(0.0)).alias("bounded"))


@query(N.rstrip() + ",\no AS (SELECT section_id, gene_id, row_number() OVER (PARTITION BY section_id ORDER BY gene_id) AS k FROM (SELECT DISTINCT section_id, gene_id FROM native_counts)) SELECT section_id, sha256(string_agg(CAST(gene_id AS VARCHAR), ',' ORDER BY k)) AS digest FROM o GROUP BY 1")
def identity_digest(spark, sf_dir):
    """Digest of a section's ordered gene ids (a bounded list of genes)."""
    ids = native_counts(spark, sf_dir).select("section_id", "gene_id").distinct()
    return ids.groupBy("section_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("gene_id")).cast("array<string>"), ","), 256).alias("digest"))
