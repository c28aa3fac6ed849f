"""Image measurements as tables: ``pixels`` are (section_id, py, px, r, g, b), one row a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.geometry import down, project
from lamella.operators.tasks import spread

# Optical-density vectors of hematoxylin, eosin and residual (DAB) stains, rows of the stain matrix.
STAINS = ((0.650, 0.704, 0.286), (0.072, 0.990, 0.105), (0.268, 0.570, 0.776))


def _inverse(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


def stain_density(r: Column, g: Column, b: Column) -> list[Column]:
    """Mean optical density, and hematoxylin and eosin amounts cut at 0, of 8-bit colours: density is -ln((v + 1) / 256)."""
    od = [-F.log((c.cast("double") + 1.0) / 256.0) for c in (r, g, b)]
    m = _inverse([[v / sum(x * x for x in row) ** 0.5 for v in row] for row in STAINS])
    amount = [sum((od[i] * m[i][j] for i in range(3)), F.lit(0.0)) for j in range(2)]
    return [((od[0] + od[1] + od[2]) / 3).alias("od"), F.greatest(amount[0], F.lit(0.0)).alias("h"), F.greatest(amount[1], F.lit(0.0)).alias("e")]


def full_support(cells: DataFrame, transform: list[list[float]], rows: int, cols: int, size_um: float = 8.0, y: str = "qy", x: str = "qx") -> DataFrame:
    """Cells all of whose four projected corners lie inside [-0.5, size - 0.5) of the image."""
    ok = F.lit(True)
    for a in (0, 1):
        for b in (0, 1):
            px, py = project(transform, (F.col(x) + b) * size_um, (F.col(y) + a) * size_um)
            ok = ok & (px >= -0.5) & (px < cols - 0.5) & (py >= -0.5) & (py < rows - 0.5)
    return cells.where(ok)


def mapped_bounds(transform: list[list[float]], y: Column, x: Column, size_um: float) -> list[Column]:
    """Box of the projected corners of a square that starts at (y, x)."""
    ends = [project(transform, x + b * size_um, y + a * size_um) for a in (0, 1) for b in (0, 1)]
    return [F.least(*[e[1] for e in ends]).alias("top"), F.greatest(*[e[1] for e in ends]).alias("bottom"), F.least(*[e[0] for e in ends]).alias("left"), F.greatest(*[e[0] for e in ends]).alias("right")]


def region(pixels: DataFrame, grid: DataFrame, fill: int = 255) -> DataFrame:
    """A rectangle of pixels (section_id, py, px rows in ``grid``); what the image lacks is ``fill``."""
    return grid.join(pixels, ["section_id", "py", "px"], "left").fillna(fill, ["r", "g", "b"])


def cell_density(cells: DataFrame, density: DataFrame, transform: list[list[float]], rows: int, cols: int, samples: int = 8, size_um: float = 8.0) -> DataFrame:
    """Area-integrated values of 8 um cells: midpoints on a samples x samples grid, each bilinear from four pixels.

    Values are means over the samples inside the image; ``area`` is the share of those. The samples of a cell meet the
    pixels by an equi-join, and partial sums by (cell, pixel) are what is shuffled.
    """
    n = F.sequence(F.lit(0), F.lit(samples - 1))
    at = cells.withColumn("_i", F.explode(n)).withColumn("_j", F.explode(n))
    px, py = project(transform, (F.col("qx") + (F.col("_j") + 0.5) / samples) * size_um, (F.col("qy") + (F.col("_i") + 0.5) / samples) * size_um)
    at = at.withColumn("_x", px).withColumn("_y", py).withColumn("_in", (F.col("_x") >= -0.5) & (F.col("_x") < cols - 0.5) & (F.col("_y") >= -0.5) & (F.col("_y") < rows - 0.5))
    at = at.withColumn("_y", F.greatest(F.lit(0.0), F.least(F.col("_y"), F.lit(rows - 1.0)))).withColumn("_x", F.greatest(F.lit(0.0), F.least(F.col("_x"), F.lit(cols - 1.0))))
    y0, x0 = F.floor("_y").cast("long"), F.floor("_x").cast("long")
    fy, fx = F.col("_y") - y0, F.col("_x") - x0
    corner = F.explode(F.array(*[F.struct((y0 + a).alias("py"), (x0 + b).alias("px"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)]))
    parts = at.where("_in").select("section_id", "qy", "qx", corner.alias("c")).groupBy("section_id", "qy", "qx", F.col("c.py").alias("py"), F.col("c.px").alias("px")).agg(F.sum("c.w").alias("w"))
    sums = parts.where("w > 0").join(density, ["section_id", "py", "px"]).groupBy("section_id", "qy", "qx").agg(F.sum("w").alias("n"), *[F.sum(F.col(v) * F.col("w")).alias(v) for v in ("od", "h", "e")])
    out = cells.join(sums, ["section_id", "qy", "qx"], "left").withColumn("area", F.coalesce("n", F.lit(0.0)) / samples**2)
    return out.select("section_id", "qy", "qx", "area", *[F.coalesce(F.col(v) / F.col("n"), F.lit(0.0)).alias(v) for v in ("od", "h", "e")])


def registered_colours(fields: DataFrame, pixels: DataFrame, transform: list[list[float]], rows: int, cols: int, size: int = 224, tile: int = 64) -> DataFrame:
    """Colours of every field resampled to size x size: (section_id, field_id, i, j, valid, r, g, b), colours from 0 to 1.

    ``fields``: (section_id, field_id, y0, x0), 128 pixels of 2 um a side. A sample lies at the middle of its square, goes
    through the registration and is bilinear in the image; beyond the image it is white and not valid. Fields and pixels
    meet by tiles of the image, which hold the first row and column of the next tiles too, so that all four pixels of a
    sample lie in one tile: samples are made there and never dealt out. Of a pixel table partitioned by ``ty`` and ``tx``
    only tiles that a field's box touches are read.
    """
    at = ["section_id", "ty", "tx"]
    box = mapped_bounds(transform, 2.0 * F.col("y0"), 2.0 * F.col("x0"), 256.0)
    ends = lambda a, b, n, v: [F.greatest(F.lit(0), F.least(F.lit((n - 1) // tile), F.floor((F.col(c) + d) / tile))).cast("long").alias(f"{v}_{i}") for i, (c, d) in enumerate(((a, -1), (b, 1)))]
    asked = fields.select("section_id", "field_id", "y0", "x0", *box).select("section_id", "field_id", "y0", "x0", *ends("top", "bottom", rows, "y"), *ends("left", "right", cols, "x"))
    asked = asked.withColumn("ty", F.explode(F.sequence("y_0", "y_1"))).withColumn("tx", F.explode(F.sequence("x_0", "x_1")))
    if "ty" in pixels.columns:
        pixels = pixels.join(asked.select(*at).distinct(), at, "left_semi")
    # A pixel that begins a tile belongs to the tile before as well.
    for v, p in (("ty", "py"), ("tx", "px")):
        own = down(p, tile)
        pixels = pixels.withColumn(v, F.explode(F.when(F.col(p) == own * tile, F.array(own, own - 1)).otherwise(F.array(own)))).where(f"{v} >= 0")
    place = (F.col("py") - F.col("ty") * tile) * (tile + 1) + F.col("px") - F.col("tx") * tile
    colour = [F.coalesce(F.col(c), F.lit(255)).cast("double").alias(c) for c in "rgb"]
    held = pixels.select(*at, F.struct(place.cast("int").alias("at"), *colour).alias("_pixel"))
    both = held.unionByName(asked.select(*at, F.struct("field_id", "y0", "x0", "y_0", "y_1", "x_0", "x_1").alias("_field")), allowMissingColumns=True)
    met = spread(both, fields.count() * size**2, 2_000_000, *at).groupBy(*at).agg(F.collect_list("_pixel").alias("pixels"), F.collect_list("_field").alias("fields"))
    kinds = dict(fields.dtypes)
    fields.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    schema = f"section_id {kinds['section_id']}, field_id {kinds['field_id']}, i int, j int, valid boolean, r double, g double, b double"
    return met.where(F.size("fields") > 0).mapInArrow(_tile_samples(transform, rows, cols, size, tile), schema)


def _tile_samples(transform: list[list[float]], rows: int, cols: int, size: int, tile: int):
    """A function from tiles (section_id, ty, tx, pixels, fields) to those samples of their fields that lie in them."""

    def of_fields(f, some, ty, tx, image):
        import numpy as np

        step = (np.arange(size) + 0.5) * 256 / size
        x, y = (2.0 * f[c][some][:, None] + step for c in ("x0", "y0"))
        x, y = x[:, None, :], y[:, :, None]
        den = transform[2][0] * x + transform[2][1] * y + transform[2][2]
        if (np.abs(den) <= 0.99).any():
            raise ValueError("degenerate projection")
        px, py = ((r[0] * x + r[1] * y + r[2]) / den for r in transform[:2])
        valid = (px >= -0.5) & (px < cols - 0.5) & (py >= -0.5) & (py < rows - 0.5)
        py, px = np.clip(py, 0.0, rows - 1.0), np.clip(px, 0.0, cols - 1.0)
        own = lambda v, c: np.clip(np.floor(v) // tile, f[f"{c}_0"][some][:, None, None], f[f"{c}_1"][some][:, None, None])
        k, i, j = np.nonzero((own(py, "y") == ty) & (own(px, "x") == tx))
        valid, py, px = valid[k, i, j], py[k, i, j], px[k, i, j]
        y0, x0 = np.floor(py).astype(np.int64), np.floor(px).astype(np.int64)
        fy, fx = py - y0, px - x0
        total = np.zeros((3, len(k)))
        for a in (0, 1):
            for b in (0, 1):
                ly, lx = np.minimum(y0 + a, rows - 1) - ty * tile, np.minimum(x0 + b, cols - 1) - tx * tile
                held = (ly >= 0) & (ly <= tile) & (lx >= 0) & (lx <= tile)
                total += np.where(held, image[:, np.where(held, ly * (tile + 1) + lx, 0)], 255.0) * ((fy if a else 1 - fy) * (fx if b else 1 - fx))
        return some[k], i.astype(np.int32), j.astype(np.int32), valid, *np.where(valid, total / 255.0, 1.0)

    def samples(batches):
        import numpy as np
        import pyarrow as pa

        names = ["section_id", "field_id", "i", "j", "valid", "r", "g", "b"]
        for batch in batches:
            pixels, fields = batch.column("pixels"), batch.column("fields")
            at, colours = pixels.values.field("at").to_numpy(), np.array([pixels.values.field(c).to_numpy() for c in "rgb"])
            f = {c: fields.values.field(c).to_numpy() for c in ("y0", "x0", "y_0", "y_1", "x_0", "x_1")}
            p, q = pixels.offsets.to_numpy(), fields.offsets.to_numpy()
            ty, tx = batch.column("ty").to_pylist(), batch.column("tx").to_pylist()
            waiting, n, some_ = [], 0, max(1, 2**18 // size**2)
            for t in range(batch.num_rows):
                image = np.full((3, (tile + 1) ** 2), 255.0)
                image[:, at[p[t] : p[t + 1]]] = colours[:, p[t] : p[t + 1]]
                for start in range(q[t], q[t + 1], some_):
                    part = of_fields(f, np.arange(start, min(start + some_, q[t + 1])), ty[t], tx[t], image)
                    waiting.append((np.full(len(part[0]), t), *part))
                    n += len(part[0])
                    if n >= 2**16:
                        yield made(batch, fields, waiting, names, np, pa)
                        waiting, n = [], 0
            if waiting:
                yield made(batch, fields, waiting, names, np, pa)

    def made(batch, fields, waiting, names, np, pa):
        tile_, field, *rest = (np.concatenate(c) for c in zip(*waiting))
        columns = [batch.column("section_id").take(pa.array(tile_)), fields.values.field("field_id").take(pa.array(field)), *map(pa.array, rest)]
        return pa.RecordBatch.from_arrays(columns, names)

    return samples


def quantized(share: Column) -> Column:
    """A share of 0-1 in 16 bits, rounded half to even."""
    return F.rint(share * 65535).cast("int")


def channels(density: DataFrame, field: list[str]) -> DataFrame:
    """Six channels of a cell: log1p of each density, and its log ratio to the field's area-weighted mean, cut at +-5.

    Cells without full area give 0.
    """
    w = Window.partitionBy(*field)
    out = density
    for v in ("od", "h", "e"):
        mean = F.sum(F.col(v) * F.col("area")).over(w) / F.greatest(F.sum("area").over(w), F.lit(1e-12))
        ratio = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.log((F.col(v) + 1e-6) / (mean + 1e-6))))
        full = F.col("area") >= 1
        out = out.withColumn(f"log_{v}", F.when(full, F.log1p(v)).otherwise(0.0)).withColumn(f"ratio_{v}", F.when(full, ratio).otherwise(0.0))
    return out


def pooled(values: DataFrame, step: int, value: str, valid: str, y: str = "y", x: str = "x") -> DataFrame:
    """Means over the valid members of step x step squares, and whether all of them are valid."""
    v = F.col(valid)
    return values.groupBy("section_id", down(y, step).alias(y), down(x, step).alias(x)).agg(F.avg(F.when(v, F.col(value))).alias(value), (F.bool_and(v) & (F.count("*") == step * step)).alias(valid))


def box_mean(values: DataFrame, value: str, size: int, rows: int, cols: int) -> DataFrame:
    """Mean over a size x size box around each pixel; places outside the grid count as 0.

    One axis at a time: a row goes to ``size`` places twice, instead of to size squared.
    """
    half = size // 2
    out = values.select("section_id", "y", "x", F.col(value).cast("double").alias(value))
    for axis, n in (("y", rows), ("x", cols)):
        other = "x" if axis == "y" else "y"
        moved = out.withColumn(axis, F.explode(F.sequence(F.col(axis) - half, F.col(axis) + half)))
        out = moved.where(F.col(axis).between(0, n - 1)).groupBy("section_id", axis, other).agg(F.sum(value).alias(value))
    return out.select("section_id", "y", "x", (F.col(value) / float(size * size)).alias(value))


def parent_means(pixels: DataFrame, owners: DataFrame, value: str) -> DataFrame:
    """Mean of a pixel value over each parent, and every pixel's value less its parent's mean."""
    joined = pixels.join(owners, ["section_id", "y", "x"])
    mean = F.avg(value).over(Window.partitionBy("section_id", "parent_id"))
    return joined.withColumn("mean", mean).withColumn("centred", F.col(value) - F.col("mean"))


def resized(coarse: DataFrame, fine: DataFrame, step: int, value: str, valid: str) -> DataFrame:
    """Bilinear values of coarse cells at fine pixels, over valid cells only; null where none is near.

    ``coarse``: (section_id, cy, cx, value, valid); ``fine``: (section_id, y, x). Cell centres lie at (c + 1/2) step.
    """
    v, u = (F.col("y") + 0.5) / step - 0.5, (F.col("x") + 0.5) / step - 0.5
    y0, x0 = F.floor(v).cast("long"), F.floor(u).cast("long")
    fy, fx = v - y0, u - x0
    corner = F.explode(F.array(*[F.struct((y0 + a).alias("cy"), (x0 + b).alias("cx"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)]))
    met = fine.select("section_id", "y", "x", corner.alias("c")).select("section_id", "y", "x", "c.cy", "c.cx", "c.w").join(coarse.where(valid), ["section_id", "cy", "cx"])
    return met.groupBy("section_id", "y", "x").agg((F.sum(F.col("w") * F.col(value)) / F.when(F.sum("w") > 0, F.sum("w"))).alias(value))


def token_validity(pixels: DataFrame, side: int = 128, token: int = 16) -> DataFrame:
    """Valid tokens of every field: those whose token x token pixels are all valid. A field without any fails."""
    key = ["section_id", "field_id"]
    t = pixels.groupBy(*key, down("y", token).alias("ty"), down("x", token).alias("tx")).agg((F.bool_and("valid") & (F.count("*") == token * token)).alias("valid"))
    has = F.max("valid").over(Window.partitionBy(*key))
    return t.withColumn("valid", F.when(has, F.col("valid")).otherwise(F.raise_error(F.lit("a field has no valid token")).cast("boolean")))


def tissue_majority(mask: DataFrame, least: int = 8) -> DataFrame:
    """8 um cells with at least ``least`` of their 16 pixels in tissue."""
    return mask.groupBy("section_id", down("y", 4).alias("qy"), down("x", 4).alias("qx")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("section_id", "qy", "qx")


def complete(pixels: DataFrame, step: int, names: tuple[str, str]) -> DataFrame:
    """Squares all of whose pixels are present."""
    return pixels.groupBy("section_id", down("y", step).alias(names[0]), down("x", step).alias(names[1])).agg(F.count("*").alias("n")).where(F.col("n") == step * step).drop("n")


def embedded(fields: DataFrame, embed, tokens: int = 14) -> DataFrame:
    """Hook for a user's encoder: ``embed(series of value lists) -> (features, valid)`` for a batch of fields at once."""

    def run(frames):
        for f in frames:
            features, valid = embed(f["values"])
            yield f[["section_id", "field_id"]].assign(features=features, valid=valid)

    return fields.select("section_id", "field_id", "values").mapInPandas(run, "section_id long, field_id long, features array<double>, valid boolean")


def embedded_fields(fields: DataFrame, pixels: DataFrame, embed, side: int = 128, token: int = 16) -> DataFrame:
    """``embedded`` fields with their valid image tokens: (section_id, field_id, features, valid, tokens).

    ``fields``: (section_id, field_id, values); ``pixels``: (section_id, field_id, y, x, valid) of all their pixels. ``tokens``
    lists the (ty, tx) whose pixels are all valid; a field that has none fails.
    """
    t = token_validity(pixels, side, token).where("valid").groupBy("section_id", "field_id").agg(F.array_sort(F.collect_list(F.struct("ty", "tx"))).alias("tokens"))
    return embedded(fields, embed).join(t, ["section_id", "field_id"])
