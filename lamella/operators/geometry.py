"""Grid, circle and field-of-view geometry as column expressions and bounded enumerations.

Axes come as (y, x). Pixel i of the 2 um grid covers [2i, 2i+2] um with its centre at 2i+1; cells are 4 pixels (8 um)
and parents 8 pixels (16 um) a side. Candidates are always enumerated around each object, never by joining all pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def down(v: Column | str, step: int) -> Column:
    """Grid index at a coarser step; rounds towards minus infinity for negative origins."""
    return F.floor((F.col(v) if isinstance(v, str) else v) / F.lit(float(step))).cast("long")


def span(start: Column, stop: Column) -> Column:
    """Rows for start..stop-1, none if empty."""
    return F.explode(F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>")))


def project(t: list[list[float]], col: Column, row: Column) -> tuple[Column, Column]:
    """Homography of (col, row, 1); raises where the denominator is too small."""
    den = F.lit(t[2][0]) * col + F.lit(t[2][1]) * row + F.lit(t[2][2])
    den = F.when(F.abs(den) > 0.99, den).otherwise(F.raise_error(F.lit("degenerate projection")).cast("double"))
    return tuple((F.lit(r[0]) * col + F.lit(r[1]) * row + F.lit(r[2])) / den for r in t[:2])


def invert(t: list[list[float]]) -> list[list[float]]:
    """Inverse of a registration, scaled so that its last entry is 1. Refuses singular or non-finite ones."""
    check_registration(t)
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    columns = [cross(t[1], t[2]), cross(t[2], t[0]), cross(t[0], t[1])]
    scale = columns[2][2]
    return [[columns[j][i] / scale for j in range(3)] for i in range(3)]


def check_registration(t: list[list[float]]) -> None:
    if len(t) != 3 or any(len(r) != 3 or not all(math.isfinite(v) for v in r) for r in t):
        raise ValueError("a registration is a finite 3 x 3 matrix")
    det = sum(t[0][i] * (t[1][(i + 1) % 3] * t[2][(i + 2) % 3] - t[1][(i + 2) % 3] * t[2][(i + 1) % 3]) for i in range(3))
    if abs(det) < 1e-12:
        raise ValueError("a registration must be invertible")


def circle_pixels(centers: DataFrame, diameter: float, rows: int, cols: int) -> DataFrame:
    """Centres (.., cy, cx in um) with the pixels (y, x) whose centre lies inside the circle."""
    r = diameter / 2
    first = lambda c, n: F.greatest(F.floor((F.col(c) - r - 1) / 2.0), F.lit(0)).cast("long")
    last = lambda c, n: F.least(F.ceil((F.col(c) + r - 1) / 2.0) + 1, F.lit(n)).cast("long")
    boxed = centers.withColumn("y", span(first("cy", rows), last("cy", rows))).withColumn("x", span(first("cx", cols), last("cx", cols)))
    dy, dx = 2 * F.col("y") + 1 - F.col("cy"), 2 * F.col("x") + 1 - F.col("cx")
    return boxed.where(dy * dy + dx * dx <= r * r)


def interior_cells(centers: DataFrame, diameter: float) -> DataFrame:
    """Centres with the 8 um cells (qy, qx) that lie wholly inside the circle."""
    r = diameter / 2
    first = lambda c: F.greatest(F.floor((F.col(c) - r) / 8.0), F.lit(0)).cast("long")
    last = lambda c: F.ceil((F.col(c) + r) / 8.0).cast("long")
    boxed = centers.withColumn("qy", span(first("cy"), last("cy"))).withColumn("qx", span(first("cx"), last("cx")))
    far = lambda q, c: F.abs(8 * F.col(q) + 4 - F.col(c)) + 4
    return boxed.where(far("qy", "cy") ** 2 + far("qx", "cx") ** 2 <= r * r)


def lattice(sections: DataFrame, rows: int, cols: int, origin_y: Column, origin_x: Column, pitch: float = 100.0, margin: float = 28.0) -> DataFrame:
    """Hexagonal lattice of spot centres (array_row, array_col, cy, cx in um) that keep ``margin`` from the edges."""
    step = pitch / 2 * math.sqrt(3)
    high, wide = 2.0 * rows, 2.0 * cols
    at = sections.withColumn("r", span(F.lit(0).cast("long"), F.lit(int(high // step) + 2).cast("long")))
    at = at.withColumn("k", span(F.lit(-1).cast("long"), F.lit(int(wide // pitch) + 2).cast("long")))
    cy = origin_y + F.col("r") * step
    cx = origin_x + F.col("k") * pitch + (F.col("r") % 2) * (pitch / 2)
    at = at.withColumn("cy", cy).withColumn("cx", cx)
    inside = (F.col("cy") >= margin) & (F.col("cy") <= high - margin) & (F.col("cx") >= margin) & (F.col("cx") <= wide - margin)
    return at.where(inside).withColumn("array_row", F.col("r")).withColumn("array_col", 2 * F.col("k") + F.col("r") % 2).drop("r", "k")


def field_lattice(fields: DataFrame, origin_y: Column, origin_x: Column, diameter: float = 55.0, pitch: float = 100.0, side_um: float = 256.0) -> DataFrame:
    """Spots of a section's hexagonal lattice whose whole circle lies in a field: (.., lattice_row, lattice_col, cy, cx in um).

    ``fields``: (section_id, field_id, y0, x0) with origins on 16 um; others fail. Rows of the lattice lie pitch * sqrt(3) / 2
    apart, each half a pitch further to the right. Candidates are enumerated around each field.
    """
    from lamella.operators.checks import guarded

    r, step = diameter / 2, pitch / 2 * math.sqrt(3)
    aligned = (F.col("y0") >= 0) & (F.col("x0") >= 0) & (F.col("y0") % 8 == 0) & (F.col("x0") % 8 == 0)
    at = fields.withColumn("y0", guarded(F.col("y0"), aligned, "a field does not start on 16 um", "long")).withColumn("_oy", origin_y).withColumn("_ox", origin_x)
    between = lambda low, high: F.explode(F.sequence(F.floor(low).cast("long"), F.ceil(high).cast("long")))
    top, left = 2.0 * F.col("y0"), 2.0 * F.col("x0")
    at = at.withColumn("lattice_row", between((top - F.col("_oy") - r) / step, (top + side_um - F.col("_oy") + r) / step))
    shift = F.col("_ox") + F.col("lattice_row") * (pitch / 2)
    at = at.withColumn("lattice_col", between((left - shift - r) / pitch, (left + side_um - shift + r) / pitch))
    at = at.withColumn("cy", F.col("_oy") + F.col("lattice_row") * step).withColumn("cx", shift + F.col("lattice_col") * pitch)
    inside = (F.col("cy") - r >= top) & (F.col("cy") + r <= top + side_um) & (F.col("cx") - r >= left) & (F.col("cx") + r <= left + side_um)
    return at.where(inside).drop("_oy", "_ox")


def core_tiles(parents: DataFrame, core_um: int = 192, fov_um: int = 256) -> DataFrame:
    """16 um parents (py, px) with the field (y0, x0 in pixels, may be negative) whose core owns them, and their slot."""
    c, side = core_um // 16, fov_um // 16
    out = parents
    for p, o in (("py", "y0"), ("px", "x0")):
        out = out.withColumn(o, (down(p, c) * c * 8 - (fov_um - core_um) // 4).cast("long"))
    slot = lambda p, o: F.col(p) - F.col(o) / F.lit(8)
    return out.withColumn("slot", (F.floor(slot("py", "y0")) * side + F.floor(slot("px", "x0"))).cast("long"))


def nearest_tiles(parents: DataFrame, rows: int, cols: int) -> DataFrame:
    """16 um parents with the field (y0, x0) at a stride of 96 pixels whose centre is nearest on each axis, the last one at the
    edge; ties take the first, parents that their field does not hold go."""
    out = parents
    for p, o, n in (("py", "y0", rows), ("px", "x0", cols)):
        last = (n - 128) // 8 * 8
        axis = sorted({*range(0, last + 1, 96), last})
        ranked = F.array(*[F.struct(F.abs(F.col(p) * 8 + 4 - (a + 64)).alias("d"), F.lit(a).cast("long").alias("a")) for a in axis])
        out = out.withColumn(o, F.array_min(ranked)["a"]).where((F.col(p) * 8 >= F.col(o)) & (F.col(p) * 8 + 8 <= F.col(o) + 128))
    return out


def single_cores(cells: DataFrame, rows: int, cols: int, core_um: int = 192, margin_um: int = 32) -> DataFrame:
    """8 um cells with the one field whose core holds them: clipped to the capture at 192/32 um, padded beyond it at 144/56."""
    if (core_um, margin_um) not in ((192, 32), (144, 56)):
        raise ValueError("cores are 192/32 or 144/56 um")
    n, out = core_um // 8, cells
    for q, o, extent in (("qy", "y0", rows), ("qx", "x0", cols)):
        at = down(q, n) * n * 4 - margin_um // 2
        out = out.withColumn(o, F.greatest(F.lit(0), F.least(F.lit((extent - 128) // 4 * 4), at)).cast("long") if core_um == 192 else at.cast("long"))
    return out.withColumn("ly", F.col("qy") - F.floor(F.col("y0") / 4.0).cast("long")).withColumn("lx", F.col("qx") - F.floor(F.col("x0") / 4.0).cast("long"))


def field_ids(tiled: DataFrame) -> DataFrame:
    """Distinct fields of each section, numbered from 0 by (y0, x0)."""
    from lamella.operators.ranks import ranked

    return ranked(tiled.select("section_id", "y0", "x0").distinct(), ["y0", "x0"], ["section_id"], "field_id")


def field_slots(fields: DataFrame, parents: DataFrame, side: int = 16) -> DataFrame:
    """All side x side parent slots of every field, with the parent that fills it (null if none)."""
    n = F.lit(side).cast("long")
    grid = fields.withColumn("sy", span(F.lit(0).cast("long"), n)).withColumn("sx", span(F.lit(0).cast("long"), n))
    grid = grid.withColumn("py", F.floor(F.col("y0") / 8.0).cast("long") + F.col("sy")).withColumn("px", F.floor(F.col("x0") / 8.0).cast("long") + F.col("sx"))
    return grid.join(parents.select("section_id", "py", "px", "parent_id"), ["section_id", "py", "px"], "left")


def covering_fields(cells: DataFrame, fields: DataFrame, core_um: int = 192, fov_um: int = 256, stride_um: int = 128) -> DataFrame:
    """8 um cells with every field whose core contains them, at weight 1 / number of such fields.

    Fields lie on a regular stride, so the candidates of a cell are enumerated and met by an equi-join. Fails on a
    cell that no field covers.
    """
    margin, core, stride = (fov_um - core_um) // 4, core_um // 2, stride_um // 2
    reach = -(-core // stride)
    out = cells
    for q, o in (("qy", "y0"), ("qx", "x0")):
        base = down(F.col(q) * 4, stride)
        out = out.withColumn(f"_{o}", F.explode(F.sequence(base - reach, base))).withColumn(o, F.col(f"_{o}") * stride - margin).drop(f"_{o}")
        at = F.col(q) * 4 - F.col(o) - margin
        out = out.where((at >= 0) & (at + 4 <= core))
    known = fields.withColumn("_field", F.lit(True))
    out = out.join(known, ["section_id", "y0", "x0"], "left")
    met = F.max("_field").over(Window.partitionBy("section_id", "qy", "qx"))
    # The check is part of the filter, which would otherwise drop an uncovered cell before it is looked at.
    kept = F.when(F.col("_field"), True).when(F.col("_met"), False).otherwise(F.raise_error(F.lit("no field covers a cell")).cast("boolean"))
    out = out.withColumn("_met", met).where(kept).drop("_field", "_met")
    n = F.count("*").over(Window.partitionBy("section_id", "qy", "qx"))
    return out.withColumn("weight", 1.0 / n)


def shifted_parents(pixels: DataFrame, phase_y_um: int, phase_x_um: int, extent: int) -> DataFrame:
    """Pixels with the 16 um parent of a grid shifted by a phase (0 or 8 um); only complete parents are kept."""
    out = pixels
    for v, p, ph in (("y", "py", phase_y_um), ("x", "px", phase_x_um)):
        out = out.withColumn(p, F.floor((F.col(v) * 2 + 1 - ph) / 16.0).cast("long"))
        out = out.where((F.col(p) >= 0) & (F.col(p) * 16 + ph + 16 <= 2 * extent))
    return out


def anchor_fields(anchors: DataFrame) -> DataFrame:
    """Nine fields around each 100 um anchor: its nearest 8 um corner and shifts of 24 um either way."""
    out = anchors
    for c, o in (("cy", "y0"), ("cx", "x0")):
        shift = F.explode(F.array(*[F.lit(s).cast("long") for s in (-12, 0, 12)]))
        out = out.withColumn(f"_{o}", shift).withColumn(o, (F.floor(F.col(c) / 8.0 + 0.5).cast("long") * 8 - 128) / F.lit(2) + F.col(f"_{o}")).withColumn(o, F.col(o).cast("long")).drop(f"_{o}")
    return out


def cell_claims(claims: DataFrame) -> DataFrame:
    """8 um cells with the spot that claims them: its id, or -2 (and no area) where several do.

    ``claims``: (section_id, y, x, spot_id), a row for each pixel inside a circle.
    """
    cell = claims.withColumn("qy", down("y", 4)).withColumn("qx", down("x", 4)).groupBy("section_id", "qy", "qx")
    out = cell.agg(F.min("spot_id").alias("low"), F.max("spot_id").alias("high"), F.count("*").alias("pixels"))
    one = F.col("low") == F.col("high")
    return out.select("section_id", "qy", "qx", F.when(one, F.col("low")).otherwise(-2).cast("long").alias("spot_id"), F.when(one, F.col("pixels")).otherwise(0).cast("long").alias("area_px"))
