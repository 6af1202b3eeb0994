"""Voxel and world coordinates, orientation and view geometry, as column expressions.

Headers are columns: dx, dy, dz, sform_code, qform_code, quatern_b/c/d, qoffset_x/y/z and the arrays
srow_x, srow_y, srow_z of four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import clamp, fixed

AXES = ("axial", "coronal", "sagittal")

# Orientation codes that are known; all others are 'unknown'.
ORIENTATIONS = ("RAS", "LAS", "LPS", "RPS", "RSA", "LSA", "LIA", "RIA", "AIR", "PIR", "RIP", "LIP")

# Lengths of a scale bar.
SCALE_BARS = (1, 2, 5, 10, 20, 50, 100, 200)

# Names of element types by code.
TYPE_NAMES = {1: "binary", 2: "uint8", 4: "int16", 8: "int32", 16: "float32", 64: "float64", 128: "RGB24", 256: "int8", 512: "uint16", 768: "uint32", 1024: "int64", 1280: "uint64", 4096: "RGBA32"}


def _rows(prefix: str) -> list[list[Column]]:
    return [[F.col(f"{prefix}srow_{a}")[k].cast("double") for k in range(4)] for a in "xyz"]


def _rotation(prefix: str, mode: str) -> list[list[Column]]:
    """Rotation of the quaternion. 'standard' takes its real part from unit length, 'reference' from 1+b2+c2+d2, renormalised."""
    b, c, d = (F.col(f"{prefix}quatern_{x}").cast("double") for x in "bcd")
    if mode == "reference":
        a = F.sqrt(1.0 + b * b + c * c + d * d)
        b, c, d = b / a, c / a, d / a
    else:
        a = F.sqrt(F.greatest(F.lit(0.0), 1.0 - b * b - c * c - d * d))
    return [
        [a * a + b * b - c * c - d * d, 2.0 * (b * c - a * d), 2.0 * (b * d + a * c)],
        [2.0 * (b * c + a * d), a * a + c * c - b * b - d * d, 2.0 * (c * d - a * b)],
        [2.0 * (b * d - a * c), 2.0 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ]


def _steps(prefix: str, mode: str) -> list[Column]:
    steps = [F.col(f"{prefix}d{a}").cast("double") for a in "xyz"]
    if mode == "standard":
        qfac = F.when(F.col(f"{prefix}qfac") == -1, -1.0).otherwise(1.0)
        steps[2] = steps[2] * qfac
    return steps


def to_world(x: Column, y: Column, z: Column, prefix: str = "", mode: str = "reference") -> list[Column]:
    """World coordinates of a voxel: by the affine rows, else by the quaternion, else by spacing alone.

    ``mode='standard'`` follows the file format's definition of the quaternion and needs a column qfac.
    """
    v = [c.cast("double") for c in (x, y, z)]
    steps, rotation = _steps(prefix, mode), _rotation(prefix, mode)
    plain = [F.col(f"{prefix}d{a}").cast("double") * c for a, c in zip("xyz", v)]
    out = []
    for k, (row, axis) in enumerate(zip(_rows(prefix), "xyz")):
        affine = row[0] * v[0] + row[1] * v[1] + row[2] * v[2] + row[3]
        offset = F.col(f"{prefix}qoffset_{axis}").cast("double")
        if mode == "standard":
            turned = rotation[k][0] * steps[0] * v[0] + rotation[k][1] * steps[1] * v[1] + rotation[k][2] * steps[2] * v[2] + offset
        else:
            turned = steps[k] * (rotation[k][0] * v[0] + rotation[k][1] * v[1] + rotation[k][2] * v[2]) + offset
        out.append(F.when(F.col(f"{prefix}sform_code") != 0, affine).when(F.col(f"{prefix}qform_code") != 0, turned).otherwise(plain[k]))
    return out


def to_voxel(wx: Column, wy: Column, wz: Column, prefix: str = "", mode: str = "reference") -> list[Column]:
    """Voxel coordinates (not rounded) of a world point: the inverse affine if it has one, else by spacing.

    ``mode='standard'`` also inverts the quaternion, which 'reference' leaves out.
    """
    m = _rows(prefix)
    w = [c.cast("double") for c in (wx, wy, wz)]
    off = [w[k] - m[k][3] for k in range(3)]

    def cofactor(r: int, c: int) -> Column:
        a, b = [k for k in range(3) if k != r]
        p, q = [k for k in range(3) if k != c]
        value = m[a][p] * m[b][q] - m[a][q] * m[b][p]
        return value if (r + c) % 2 == 0 else -value

    det = m[0][0] * cofactor(0, 0) + m[0][1] * cofactor(0, 1) + m[0][2] * cofactor(0, 2)
    invertible = (F.col(f"{prefix}sform_code") != 0) & (F.abs(det) > 1e-10)
    safe = F.when(F.abs(det) > 1e-10, det).otherwise(1.0)
    out = []
    for k, axis in enumerate("xyz"):
        affine = (1.0 / safe) * (cofactor(0, k) * off[0] + cofactor(1, k) * off[1] + cofactor(2, k) * off[2])
        column = F.when(invertible, affine)
        if mode == "standard":
            rotation = _rotation(prefix, mode)
            moved = [w[j] - F.col(f"{prefix}qoffset_{a}").cast("double") for j, a in enumerate("xyz")]
            turned = (rotation[0][k] * moved[0] + rotation[1][k] * moved[1] + rotation[2][k] * moved[2]) / _steps(prefix, mode)[k]
            column = column.when((F.col(f"{prefix}sform_code") == 0) & (F.col(f"{prefix}qform_code") != 0), turned)
        out.append(column.otherwise(w[k] / F.col(f"{prefix}d{axis}").cast("double")))
    return out


def orientation(prefix: str = "") -> Column:
    """Orientation code of the affine rows: for each row its dominant axis (ties: the lower one) and its sign."""

    def letter(row: list[Column]) -> Column:
        a, b, c = (F.abs(v) for v in row[:3])
        pick = lambda v, up, down: F.when(v >= 0, up).otherwise(down)
        return F.when((a >= b) & (a >= c), pick(row[0], "R", "L")).when((b >= a) & (b >= c), pick(row[1], "A", "P")).otherwise(pick(row[2], "S", "I"))

    code = F.concat(*map(letter, _rows(prefix)))
    known = F.when(code.isin(*ORIENTATIONS), code).otherwise("unknown")
    return F.when(F.col(f"{prefix}sform_code") != 0, known).otherwise("RAS")


def axis_geometry(axis: Column, prefix: str = "") -> list[Column]:
    """width, height, pixel_w, pixel_h and max_index of the slices along an axis; null for an unknown axis."""
    n = {a: F.col(f"{prefix}n{a}").cast("long") for a in "xyz"}
    d = {a: F.col(f"{prefix}d{a}").cast("double") for a in "xyz"}

    def choose(axial, coronal, sagittal) -> Column:
        return F.when(axis == "axial", axial).when(axis == "coronal", coronal).when(axis == "sagittal", sagittal)

    return [
        choose(n["x"], n["x"], n["y"]).alias("width"),
        choose(n["y"], n["z"], n["z"]).alias("height"),
        choose(n["x"] * d["x"], n["x"] * d["x"], n["y"] * d["y"]).alias("pixel_w"),
        choose(n["y"] * d["y"], n["z"] * d["z"], n["z"] * d["z"]).alias("pixel_h"),
        choose(n["z"] - 1, n["y"] - 1, n["x"] - 1).alias("max_index"),
    ]


# Labels at the edges of a view, by axis and orientation; '*' is every orientation not named.
EDGE_LABELS = [
    ("axial", "RAS", "R", "L", "A", "P"), ("axial", "RPS", "R", "L", "P", "A"), ("axial", "RSA", "R", "L", "P", "A"),
    ("axial", "LAS", "L", "R", "A", "P"), ("axial", "LPS", "L", "R", "P", "A"), ("axial", "LSA", "L", "R", "P", "A"), ("axial", "*", "R", "L", "A", "P"),
    ("coronal", "RAS", "R", "L", "S", "I"), ("coronal", "RPS", "R", "L", "I", "S"), ("coronal", "RSA", "R", "L", "A", "P"),
    ("coronal", "LAS", "L", "R", "S", "I"), ("coronal", "LPS", "L", "R", "I", "S"), ("coronal", "LSA", "L", "R", "A", "P"), ("coronal", "*", "R", "L", "S", "I"),
    ("sagittal", "RAS", "A", "P", "S", "I"), ("sagittal", "RPS", "A", "P", "I", "S"), ("sagittal", "RSA", "A", "P", "S", "I"),
    ("sagittal", "LAS", "P", "A", "S", "I"), ("sagittal", "LPS", "P", "A", "I", "S"), ("sagittal", "LSA", "P", "A", "S", "I"), ("sagittal", "*", "A", "P", "S", "I"),
]


def edge_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_LABELS, "axis string, orientation string, left string, right string, top string, bottom string")


def with_edge_labels(views: DataFrame) -> DataFrame:
    """Adds left, right, top and bottom to views(axis, orientation), by a join with the table of labels."""
    labels = edge_labels(views.sparkSession)
    named = [r[1] for r in EDGE_LABELS if r[1] != "*"]
    key = F.when(F.col("orientation").isin(*named), F.col("orientation")).otherwise("*")
    return views.withColumn("_o", key).join(F.broadcast(labels.withColumnRenamed("orientation", "_o")), ["axis", "_o"], "left").drop("_o")


def scale_bar(pixel_w: Column, canvas: Column, zoom: Column) -> list[Column]:
    """Millimetres of the longest bar that fits, and its pixels on screen; infinitely many where a pixel has no size, with the sign of its zero."""
    per_pixel = pixel_w.cast("double") * zoom / canvas
    limit = F.least(F.lit(50.0), canvas * 0.35) * per_pixel
    fitting = F.array_max(F.filter(F.array(*map(F.lit, SCALE_BARS)), lambda v: v.cast("double") <= limit))
    bar = F.coalesce(fitting, F.lit(1))
    # A zero doesn't end the job, as the division would.
    pixels = F.when(per_pixel == 0, F.pow(per_pixel, F.lit(-1.0))).otherwise(bar / per_pixel)
    return [bar.alias("bar_mm"), pixels.alias("bar_px")]


def fitted_size(pixel_w: Column, pixel_h: Column, width: Column, height: Column, zoom: Column) -> list[Column]:
    """Canvas size of a view letterboxed into width x height, then zoomed, in whole pixels."""
    ratio = pixel_w.cast("double") / pixel_h
    wide = width.cast("double") / height > ratio
    w = F.when(wide, F.floor(height * ratio)).otherwise(width)
    h = F.when(wide, height).otherwise(F.floor(width / ratio))
    return [F.floor(w * zoom).cast("long").alias("canvas_w"), F.floor(h * zoom).cast("long").alias("canvas_h")]


def picked_voxel(px: Column, py: Column, left: Column, top: Column, canvas_w: Column, canvas_h: Column, width: Column, height: Column) -> list[Column]:
    """In-slice column and row (bottom row is 0) under a screen point; null outside the picture."""
    fx, fy = (px - left) / canvas_w, (py - top) / canvas_h
    inside = fx.between(0.0, 1.0) & fy.between(0.0, 1.0)
    u = clamp(F.floor(fx * width), 0, width - 1)
    v = clamp(F.floor((1.0 - fy) * height), 0, height - 1)
    return [F.when(inside, u).cast("long").alias("u"), F.when(inside, v).cast("long").alias("v")]


def crosshair(index: Column, n: Column) -> Column:
    """Place 0..1 of a slice index; a single slice is at 0."""
    return index / F.when(n - 1 == 0, F.lit(1)).otherwise(n - 1)


def frame_index(at: Column, full: Column, frame: Column) -> Column:
    """Coordinate in a frame of reduced size of a full-resolution coordinate."""
    return F.floor(at * (frame - 1) / F.greatest(F.lit(1), full - 1)).cast("long")


def dimensions_text(prefix: str = "") -> Column:
    """nx×ny×nz, and ×nt if there is more than one frame."""
    n = [F.col(f"{prefix}n{a}").cast("string") for a in "xyzt"]
    return F.concat_ws("×", n[0], n[1], n[2], F.when(F.col(f"{prefix}nt") > 1, n[3]))


def spacing_text(prefix: str = "") -> Column:
    return F.concat_ws("×", *[fixed(F.col(f"{prefix}d{a}"), 2) for a in "xyz"])


def type_name(code: Column) -> Column:
    """Name of an element type, 'unknown' for other codes."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("unknown"))
