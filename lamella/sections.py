"""Workflows over whole sections: spot matrices to centres and support, prepared fields, predictions that are written and checked."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella import jobs
from lamella.operators import audit, checks, counts, geometry, image, metrics, neighbors
from lamella.operators.geometry import down
from lamella.operators.ranks import ranked
from lamella.operators.tasks import dealt, spread
from lamella.session import checkpointed
from lamella.sources import tables

CELL = ["section_id", "qy", "qx"]
PARENT = ["section_id", "py", "px", "gene_id"]
#: Folders of a written grid at most; sections share them, as thousands of small files cost more than their content.
FOLDERS = 512
#: Counts of 16 um parents that one task takes, and spots that one task turns into their pixels or cells.
EACH, SPOTS = 250_000, 5_000


class SpotSection(NamedTuple):
    """A section of spots: ``spots`` (section_id, spot_id, barcode, cy, cx), ``counts`` (section_id, spot_id, gene_id, umi), ``queries`` (section_id, qy, qx)."""

    spots: DataFrame
    counts: DataFrame
    queries: DataFrame


def unique(rows: DataFrame, key: list[str], message: str) -> DataFrame:
    """Rows whose key must not repeat."""
    n = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    kind = dict(rows.dtypes)[key[0]]
    return rows.join(dealt(n), key).withColumn(key[0], checks.guarded(F.col(key[0]), F.col("_n") == 1, message, kind)).drop("_n")


def spot_centres(barcodes: DataFrame, positions: DataFrame, transform: list[list[float]], capture: tuple[int, int], diameter: float = 55.0) -> DataFrame:
    """(section_id, spot_id, barcode, col, cy, cx): spots in tissue that passed, in the order of the matrix columns.

    ``barcodes``: (section_id, col, barcode); ``positions``: (section_id, barcode, in_tissue, qc_pass, pxl_row, pxl_col), which
    must cover every barcode once; flags are 0 or 1. Pixels go back through the registration to the 2 um grid; a centre lies
    at twice its place and 1 um. A retained circle that leaves the capture or a repeated centre fails.
    """
    at = ["section_id", "barcode"]
    places, asked = unique(positions, at, "a position is repeated"), unique(barcodes, at, "a barcode is repeated")
    flag = lambda c: checks.guarded(F.col(c), F.coalesce(F.col(c).isin(0, 1), F.lit(False)), "a flag is neither 0 nor 1", "int")
    known = F.col("_known").isNotNull()
    met = asked.join(dealt(places.withColumn("_known", F.lit(True))), at, "left")
    # A barcode without a position passes the filter, which would drop it before it is looked at, and fails at its place.
    met = met.select("section_id", "col", "barcode", *[F.when(known, F.col(c)).otherwise(1).alias(c) for c in ("in_tissue", "qc_pass")], "pxl_row", "pxl_col", "_known")
    kept = met.where((flag("in_tissue") == 1) & (flag("qc_pass") == 1))
    # An expression that is not deterministic: later filters and joins on the centre are not pushed below this check.
    fine = known & (F.monotonically_increasing_id() >= 0)
    kept = kept.withColumn("pxl_row", checks.guarded(F.col("pxl_row"), fine, "a barcode has no position", "double"))
    col, row = geometry.project(geometry.invert(transform), F.col("pxl_col"), F.col("pxl_row"))
    out = kept.withColumn("cy", row * 2 + 1).withColumn("cx", col * 2 + 1)
    r = diameter / 2
    inside = (F.col("cy") >= r) & (F.col("cx") >= r) & (F.col("cy") + r <= 2.0 * capture[0]) & (F.col("cx") + r <= 2.0 * capture[1])
    out = out.withColumn("cy", checks.guarded(F.col("cy"), F.coalesce(inside, F.lit(False)), "a circle leaves the capture", "double"))
    out = unique(out, ["section_id", "cy", "cx"], "a centre is repeated")
    return ranked(out, ["col"], ["section_id"], "spot_id").select("section_id", "spot_id", "barcode", "col", "cy", "cx")


def around(spots: DataFrame) -> DataFrame:
    """Spots (section_id, .., cy, cx) dealt out before they become hundreds of pixels or cells each; those of a square of 1 mm stay together."""
    return spread(spots, spots.count(), SPOTS, "section_id", down("cy", 1024), down("cx", 1024))


def spot_support(spots: DataFrame, capture: tuple[int, int], mask: DataFrame | None = None, reach: float = 100.0) -> DataFrame:
    """(section_id, qy, qx): 8 um cells whose middle lies at most ``reach`` um from a spot, and half of whose pixels are in ``mask`` where given.

    Cells are enumerated around each spot, or, where there is a mask, its cells meet the spots of the 3 x 3 buckets around
    them; no spot is compared with cells elsewhere.
    """
    if mask is not None:
        inside = F.col("qy").between(0, capture[0] // 4 - 1) & F.col("qx").between(0, capture[1] // 4 - 1)
        cells = image.tissue_majority(mask).where(inside).select("section_id", F.struct("qy", "qx").alias("other"), (8.0 * F.col("qy") + 4).alias("oy"), (8.0 * F.col("qx") + 4).alias("ox"))
        return neighbors.within(spots.select("section_id", "cy", "cx"), cells, reach).select("section_id", "other.*").distinct()
    first = lambda c: F.greatest(F.floor((F.col(c) - reach) / 8.0), F.lit(0)).cast("long")
    last = lambda c, n: F.least(F.ceil((F.col(c) + reach) / 8.0), F.lit(n // 4)).cast("long")
    boxed = around(spots.select("section_id", "cy", "cx")).withColumn("qy", geometry.span(first("cy"), last("cy", capture[0]))).withColumn("qx", geometry.span(first("cx"), last("cx", capture[1])))
    dy, dx = 8 * F.col("qy") + 4 - F.col("cy"), 8 * F.col("qx") + 4 - F.col("cx")
    return boxed.where(dy * dy + dx * dx <= reach * reach).select(*CELL).distinct()


def spot_matrix(data: DataFrame, indptr: DataFrame, barcodes: DataFrame, genes: DataFrame, positions: DataFrame, transform: list[list[float]], capture: tuple[int, int], mask: DataFrame | None = None) -> SpotSection:
    """A section from a compressed matrix of genes by barcodes and a table of positions.

    ``data``: (k, row, value) and ``indptr``: (col, start) as ``tables.csc_matrix`` takes them, columns over all sections;
    ``genes``: (row, gene_id), unique. Counts must be whole and not negative. Barcodes keep the order of their columns.
    """
    spots = spot_centres(barcodes, positions, transform, capture)
    named = unique(genes, ["gene_id"], "a gene is repeated")
    matrix = counts.checked(tables.csc_matrix(data, indptr), "value").join(named, "row")
    observed = matrix.join(dealt(spots.select("section_id", "spot_id", "col")), "col").select("section_id", "spot_id", "gene_id", F.col("value").alias("umi"))
    return SpotSection(spots.drop("col"), observed, spot_support(spots, capture, mask))


class PreparedSquares(NamedTuple):
    """16 um sections ready for prediction: counts in the panel, availability, fields, parent slots, covered cells, and all
    counts in the field (section_id, y0, x0, field_id, py, px, gene_id, umi) whose core holds their parent, with its ``share``."""

    counts: DataFrame
    available: DataFrame
    fields: DataFrame
    slots: DataFrame
    cover: DataFrame
    placed: DataFrame


def prepare_squares(observed: DataFrame, panel: DataFrame, core_um: int = 160, n: int = 0) -> PreparedSquares:
    """Prepares 16 um counts (section_id, py, px, gene_id, umi): raw-count check, panel, field tiling, slots and stitching weights.

    Genes of the panel that a section did not measure are unavailable, not zero. Every parent lies in the core of one field;
    fields hold 16 x 16 slots, null where no parent is. Cores lie side by side, so that a parent's cells are covered by its
    field alone, at a share of 1. ``n``: number of counts where it is known, by which the placed ones are dealt out.
    """
    known = counts.checked(observed)
    inside = counts.in_panel(known, panel)
    parents = known.select("section_id", "py", "px").distinct()
    tiled = geometry.core_tiles(known, core_um)
    fields = geometry.field_ids(tiled)
    slots = geometry.field_slots(fields, parents.withColumn("parent_id", F.struct("py", "px")))
    # Fields meet parents and counts, never their cells: these are four times as many.
    origin = ["section_id", "y0", "x0"]
    held = lambda rows: (spread(rows, n, EACH, *origin) if n else rows).join(dealt(fields), origin)
    cover = children(held(geometry.core_tiles(parents, core_um))).select(*origin, "qy", "qx", "field_id", F.lit(1.0).alias("weight"))
    placed = held(tiled.select(*origin, "py", "px", "gene_id", "umi")).withColumn("share", F.lit(1.0))
    return PreparedSquares(inside.select("section_id", "py", "px", "gene_id", "pos", "umi"), counts.availability(known, panel), fields, slots, cover, placed)


def children(parents: DataFrame) -> DataFrame:
    """Rows of 16 um parents (.., py, px) once for each of their four 8 um cells (qy, qx)."""
    child = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    out = parents.withColumn("_child", child).withColumn("qy", F.col("py") * 2 + F.col("_child.a")).withColumn("qx", F.col("px") * 2 + F.col("_child.b"))
    return out.drop("_child")


class PreparedSpots(NamedTuple):
    """55 um sections ready for prediction: counts in the panel, availability, fields, owners of whole spots and neighbour pairs in fields."""

    counts: DataFrame
    available: DataFrame
    fields: DataFrame
    owners: DataFrame
    pairs: DataFrame


def prepare_spots(section: SpotSection, panel: DataFrame, valid: DataFrame, capture: tuple[int, int], core_um: int = 160, stride_um: int = 144) -> PreparedSpots:
    """Prepares a section of spots: raw-count check, panel, fields over its queries, spots with complete support, and pairs up to 110 um.

    ``valid``: (section_id, y, x) of pixels with image support. Spots with an invalid pixel own nothing; slots number the
    others. Fields are all those on the stride whose core holds a query cell. A pair belongs to every field that holds
    both circles whole.
    """
    margin, core, stride = (256 - core_um) // 4, core_um // 2, stride_um // 2
    out = section.queries
    for q, o in (("qy", "y0"), ("qx", "x0")):
        base = down(F.col(q) * 4, stride)
        out = out.withColumn("_k", F.explode(F.sequence(base - 1 - core // stride, base))).withColumn(o, F.col("_k") * stride - margin).drop("_k")
        at = F.col(q) * 4 - F.col(o) - margin
        out = out.where((at >= 0) & (at + 4 <= core))
    fields = geometry.field_ids(out)
    circle = geometry.circle_pixels(around(section.spots), 55.0, *capture).select("section_id", F.col("spot_id").alias("parent_id"), "y", "x")
    slots = jobs.supported_parents(circle, valid)
    owners = circle.join(dealt(slots), ["section_id", "parent_id"])
    whole = slots.select("section_id", F.col("parent_id").alias("spot_id"))
    points = section.spots.join(dealt(whole), ["section_id", "spot_id"]).select("section_id", F.col("spot_id").alias("id"), "cy", "cx")
    near = neighbors.pairs(points)
    ends = [points.select("section_id", F.col("id").alias(n), F.col("cy").alias(f"{n}_y"), F.col("cx").alias(f"{n}_x")) for n in ("first", "second")]
    placed = near.join(dealt(ends[0]), ["section_id", "first"]).join(dealt(ends[1]), ["section_id", "second"])
    for c, o in (("y", "y0"), ("x", "x0")):
        a, b = F.least(f"first_{c}", f"second_{c}") - 27.5, F.greatest(f"first_{c}", f"second_{c}") + 27.5
        first, last = F.ceil((b / 2 - 128 + margin) / stride), F.floor((a / 2 + margin) / stride)
        placed = placed.withColumn("_k", geometry.span(first.cast("long"), last.cast("long") + 1)).withColumn(o, F.col("_k") * stride - margin).drop("_k")
    pairs = placed.join(dealt(fields), ["section_id", "y0", "x0"]).select("section_id", "field_id", "first", "second", "d2")
    known = counts.checked(section.counts)
    return PreparedSpots(counts.in_panel(known, panel), counts.availability(known, panel), fields, owners, pairs)


def predict_section(weights: DataFrame, observed: DataFrame, cover: DataFrame, path: str) -> DataFrame:
    """Predicts 16 um sections by fields, writes the 8 um grid and a report under ``path``, and gives the report read back.

    ``weights``: (section_id, field_id, py, px, qy, qx, gene_id, weight), once each; ``observed``: (section_id, py, px, gene_id,
    umi). Where weights carry the ``umi`` of their parent and gene and the ``share`` of their cell, these are taken from there
    and no row of a cell is dealt out; ``y0`` and ``x0`` of the field may come along. Every field allocates its parents by the
    weights, cells take the mean of all fields that cover them. The written grid (folder, section_id, qy, qx, gene_id, value)
    has a section in the folder pmod(xxhash64(section_id), ``FOLDERS``). It is summed to parents again and compared with the
    counts; a section that does not come back within 1e-5 + 1e-5 * count fails. The path must be new.
    """
    if "umi" not in weights.columns:
        weights = weights.join(dealt(observed.select(*PARENT, "umi")), PARENT, "left")
    if "share" not in weights.columns:
        weights = weights.join(dealt(cover.select(*CELL, "field_id", F.col("weight").alias("share"))), [*CELL, "field_id"], "left")
    tables.write_new(predicted(weights, observed.count()), f"{path}/prediction", "folder")
    grid = weights.sparkSession.read.parquet(f"{path}/prediction")
    report = square_report(grid, observed)
    tables.write_report(report, f"{path}/report")
    done = weights.sparkSession.read.schema(report.schema).json(f"{path}/report")
    return done.withColumn("section_id", checks.guarded(F.col("section_id"), F.col("within"), "a section does not give its counts back", "long"))


def predicted(weights: DataFrame, n: int) -> DataFrame:
    """(folder, section_id, qy, qx, gene_id, value) from weights that carry umi and share, over ``n`` counts of parents.

    A parent's four cells stay one row until they are written: four weights, then four masses, are dealt out together.
    """
    at = F.col("qy") - 2 * F.col("py"), F.col("qx") - 2 * F.col("px")
    inside = F.coalesce(at[0].between(0, 1) & at[1].between(0, 1), F.lit(False))
    rows = weights.withColumn("_k", checks.guarded(at[0] * 2 + at[1], inside, "a cell lies outside its parent", "long").cast("int"))
    of = lambda k, c: F.when(F.col("_k") == k, F.col(c))
    four, keys = range(4), [c for c in ("section_id", "field_id", "y0", "x0", "py", "px", "gene_id") if c in weights.columns]
    each = [f(of(k, c)).alias(f"_{c}{k}") for c, f in (("weight", F.sum), ("share", F.max)) for k in four]
    met = rows.groupBy(*keys).agg(F.max("umi").alias("_umi"), F.count("*").alias("_n"), F.expr("bit_count(bit_or(shiftleft(1, _k)))").alias("_cells"), *each)
    total = sum((F.coalesce(f"_weight{k}", F.lit(0.0)) for k in four), F.lit(0.0))
    part = lambda k: F.when(F.coalesce("_umi", F.lit(0)) > 0, checks.guarded(F.col(f"_weight{k}") * F.col("_umi") / total, total > 0, "a count has no support", "double")).otherwise(0.0)
    once = lambda k: checks.guarded(F.col(f"_share{k}"), F.col("_n") == F.col("_cells"), "weights of a cell do not add up to 1", "double")
    # Parts of a folder grow in number with the counts, so that a task's share does not; each is written by one task.
    parts = max(1, -(-4 * n // (EACH * FOLDERS)))
    spot = F.pmod(F.xxhash64("section_id"), F.lit(FOLDERS)) * parts + F.pmod(F.xxhash64("section_id", down("py", 64), down("px", 64)), F.lit(parts))
    mass = met.select(spot.alias("_part"), *PARENT, *[(part(k) * F.col(f"_share{k}")).alias(f"_mass{k}") for k in four], *[once(k).alias(f"_share{k}") for k in four])
    mean = spread(mass, n, EACH, "_part").groupBy("_part", *PARENT).agg(*[F.sum(f"_{c}{k}").alias(f"_{c}{k}") for c in ("mass", "share") for k in four])
    value = lambda k: checks.guarded(F.col(f"_mass{k}"), F.abs(F.col(f"_share{k}") - 1) < 1e-9, "weights of a cell do not add up to 1", "double")
    cells = F.array(*[F.struct(F.lit(k // 2).alias("a"), F.lit(k % 2).alias("b"), value(k).alias("value"), F.col(f"_share{k}").isNotNull().alias("covered")) for k in four])
    grid = mean.select(F.floor(F.col("_part") / float(parts)).cast("int").alias("folder"), *PARENT, F.explode(cells).alias("c")).where("c.covered")
    return grid.select("folder", "section_id", (F.col("py") * 2 + F.col("c.a")).alias("qy"), (F.col("px") * 2 + F.col("c.b")).alias("qx"), "gene_id", "c.value")


def square_report(grid: DataFrame, observed: DataFrame) -> DataFrame:
    """By section: how far the four children of each 16 um parent of a grid are from its counts (n, errors, within)."""
    sums = grid.groupBy("section_id", down("qy", 2).alias("py"), down("qx", 2).alias("px"), "gene_id").agg(F.sum("value").alias("p"))
    pairs = observed.join(sums, ["section_id", "py", "px", "gene_id"], "full").select("section_id", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("umi", F.lit(0)).alias("y"))
    return metrics.error_report(pairs, "section_id")


def spot_report(grid: DataFrame, spots: DataFrame, observed: DataFrame, capture: tuple[int, int], cells: DataFrame | None = None) -> DataFrame:
    """By section: spots by exported support (full, partial, empty) with the share of cells covered, and errors of the full ones.

    Grids of spots are means over fields and do not conserve; the report says how far they are off. ``cells``: (section_id,
    qy, qx) that were exported, where some hold no gene and have no row in the grid.
    """
    circle = geometry.circle_pixels(spots, 55.0, *capture)
    weights = circle.groupBy("section_id", "spot_id", down("y", 4).alias("qy"), down("x", 4).alias("qx")).agg((F.count("*") / F.lit(16.0)).alias("weight"))
    support = audit.spot_support(weights, dealt((grid if cells is None else cells).select(*CELL).distinct()))
    tally = support.groupBy("section_id").agg(*[F.count_if(F.col("support") == k).alias(k) for k in ("full", "partial", "empty")], F.avg("share").alias("covered"))
    full = weights.join(dealt(support.where("support = 'full'").select("section_id", "spot_id")), ["section_id", "spot_id"])
    p = audit.spot_sums(full, grid.withColumnRenamed("value", "mass"))
    pairs = p.join(dealt(observed.withColumnRenamed("umi", "y")), ["section_id", "spot_id", "gene_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return tally.join(metrics.error_report(pairs, "section_id"), "section_id", "left")


def spot_fine_tuning_fields(prepared: PreparedSpots, boundary: int, least: int = 64, pairs: int = 2) -> DataFrame:
    """Fields of a section of spots with ``pairs`` or more neighbour pairs, by side of ``boundary`` (in pixels); straddlers go.

    Fails where a section has fewer than ``least`` fields on the left or none on the right, or where sides overlap.
    """
    n = prepared.pairs.groupBy("section_id", "field_id").agg(F.count("*").alias("n")).where(F.col("n") >= pairs)
    # The checks look at these few fields several times; pairs are formed once.
    eligible = checkpointed(prepared.fields.join(dealt(n), ["section_id", "field_id"], "left_semi").select("section_id", "y0", "x0"))
    return checks.disjoint_sides(jobs.fine_tuning_fields(eligible, boundary, least), 128)
