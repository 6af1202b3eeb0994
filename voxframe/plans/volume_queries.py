"""Queries over volumes: each vector of ``embeddings`` is a volume of 8 x 4 x 2, so that no two sides can be taken for each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, intensity
from ..operators import aggregate, compare, views, voxels

#: Voxels along each side of these volumes, and their middle slices.
NX, NY, NZ = voxels.VECTOR_SIDES
_MIDDLE = {"axial": NZ // 2, "coronal": NY // 2, "sagittal": NX // 2}
_SIZE = {"axial": (NX, NY), "coronal": (NX, NZ), "sagittal": (NY, NZ)}


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.volumes_from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _six(column, places: int = 6):
    # Adding zero makes a negative zero positive.
    return F.round(column.cast("double"), places) + F.lit(0.0)


# Affine rows that vary from volume to volume: mirrored and turned ones among them, and some that are singular.
_SROW = {
    "x": ("CASE WHEN vol_id % 2 = 0 THEN 2.0 ELSE -2.0 END", "0.5", "0.0", "label * 1.0"),
    "y": ("0.0", "CASE WHEN vol_id % 3 = 0 THEN 0.0 ELSE 2.0 END", "CASE WHEN vol_id % 3 = 0 THEN 3.0 ELSE 0.0 END", "3.0"),
    "z": ("0.0", "CASE WHEN vol_id % 3 = 0 THEN -1.0 ELSE 0.25 END", "CASE WHEN vol_id % 7 = 0 THEN 0.0 ELSE 2.0 END", "-1.0"),
}
_SCALARS = {
    "dx": "1.0 + label * 0.5", "dy": "2.0", "dz": "0.5", "sform_code": "CAST(vol_id % 2 AS INT)", "qform_code": "CAST(vol_id % 4 AS INT)",
    "quatern_b": "0.125 * (label % 4)", "quatern_c": "0.25", "quatern_d": "0.5", "qoffset_x": "1.0", "qoffset_y": "-2.0", "qoffset_z": "4.0",
}


def with_header(df: DataFrame) -> DataFrame:
    rows = {f"srow_{a}": F.array(*[F.expr(e).cast("double") for e in r]) for a, r in _SROW.items()}
    return df.withColumns({c: F.expr(e).cast("int" if e.startswith("CAST") else "double") for c, e in _SCALARS.items()} | rows)


_HEADER_SQL = ", ".join(
    [f"CAST({e} AS {'INTEGER' if e.startswith('CAST') else 'DOUBLE'}) AS {c}" for c, e in _SCALARS.items()]
    + [f"CAST({e} AS DOUBLE) AS {a}{k}" for a, r in _SROW.items() for k, e in enumerate(r)]
)

VOX = f"""vox AS (
  SELECT vec_id AS vol_id, label, i, CAST(i % {NX} AS INTEGER) AS x, CAST((i // {NX}) % {NY} AS INTEGER) AS y, CAST(i // {NX * NY} AS INTEGER) AS z, v
  FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings))"""
_AXES = {"axial": ("x", "y", "z"), "coronal": ("x", "z", "y"), "sagittal": ("y", "z", "x")}


def _slice_sql(axis: str, k: int) -> str:
    u, w, n = _AXES[axis]
    return f"SELECT vol_id, label, '{axis}' AS axis, {n} AS idx, {u} AS u, {w} AS w, v FROM vox WHERE {n} = {k}"


_PREVIEW = "p AS (" + " UNION ALL ".join(_slice_sql(a, _MIDDLE[a]) for a in _AXES) + ")"
_RANGE = "r AS (SELECT vol_id, CAST(min(v) AS DOUBLE) AS lo, CASE WHEN min(v) = max(v) THEN CAST(min(v) AS DOUBLE) + 1 ELSE CAST(max(v) AS DOUBLE) END AS hi FROM vox GROUP BY vol_id)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _slices(name: str, axis: str, k: int) -> None:
    @query(name, f"WITH {VOX} SELECT vol_id, axis, idx, u, w, v FROM ({_slice_sql(axis, k)})")
    def run(spark, sf_dir):
        return voxels.slice_voxels(volumes(spark, sf_dir), axis, k)


_slices("q01_axial_slice", "axial", 1)
_slices("q02_coronal_slice", "coronal", 1)
_slices("q03_sagittal_slice", "sagittal", 6)


@query(
    "q04_preview_mid_slices",
    f"""WITH {VOX}, {_PREVIEW},
    r AS (SELECT vol_id, CAST(min(v) AS DOUBLE) AS lo, CASE WHEN min(v) = max(v) THEN CAST(min(v) AS DOUBLE) + 1 ELSE CAST(max(v) AS DOUBLE) END AS hi FROM p GROUP BY vol_id)
    SELECT vol_id, axis, idx, u, w, v, round((CAST(v AS DOUBLE) - lo) / (hi - lo), 9) AS norm FROM p JOIN r USING (vol_id)""",
)
def preview(spark, sf_dir):
    v = volumes(spark, sf_dir)
    low, high = aggregate.array_range(F.flatten(F.transform(voxels.middle_slices(), lambda s: s["part"])))
    slices = voxels.preview(v.withColumns({"lo": low, "hi": high}), "lo", "hi")
    norm = intensity.normalised(F.col("v"), F.col("lo"), F.col("hi"))
    return slices.select("vol_id", "axis", "idx", "u", "w", "v", _six(norm, 9).alias("norm"))


@query("q05_value_range", f"WITH {VOX}, {_RANGE} SELECT * FROM r")
def value_range(spark, sf_dir):
    return aggregate.value_range(voxels.voxels(volumes(spark, sf_dir)))


@query(
    "q06_strided_range",
    f"""WITH {VOX}, s AS (SELECT vol_id, min(CAST(v AS DOUBLE) * 2 + 10) AS lo, max(CAST(v AS DOUBLE) * 2 + 10) AS hi FROM vox WHERE i % 4 = 0 GROUP BY vol_id)
    SELECT vol_id, 4 AS step, lo, CASE WHEN lo = hi THEN lo + 1 ELSE hi END AS hi FROM s""",
)
def strided_range(spark, sf_dir):
    return aggregate.strided_range(volumes(spark, sf_dir), 16, 2.0, 10.0)


@query("q07_rescale", f"WITH {VOX} SELECT vol_id, x, y, z, CAST(CAST(v AS DOUBLE) * (label + 1) + label AS FLOAT) AS v FROM vox")
def rescale(spark, sf_dir):
    vox = voxels.voxels(volumes(spark, sf_dir), "label")
    return vox.select("vol_id", "x", "y", "z", intensity.rescale(F.col("v"), F.col("label") + 1, F.col("label")).alias("v"))


def _display(spark, sf_dir, window: float = 0.6, level: float = 0.5) -> DataFrame:
    """Axial slices with t, the display value 0..1."""
    low, high = aggregate.array_range(F.col(voxels.DATA))
    v = volumes(spark, sf_dir).withColumns({"lo": low, "hi": high})
    norm = intensity.normalised(F.col("v"), F.col("lo"), F.col("hi"))
    return voxels.slice_voxels(v, "axial", 1, "lo", "hi").withColumn("t", intensity.window_level(norm, window, level))


_DISPLAY = f"""{VOX}, {_RANGE}, d AS (SELECT vol_id, x AS u, y AS w,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((CAST(v AS DOUBLE) - lo) / (hi - lo) - (0.5::DOUBLE - 0.6::DOUBLE / 2)) / 0.6::DOUBLE)) AS t FROM vox JOIN r USING (vol_id) WHERE z = 1)"""


@query("q08_window_level", f"WITH {_DISPLAY} SELECT vol_id, u, w, round(t, 6) AS t FROM d")
def window_level(spark, sf_dir):
    return _display(spark, sf_dir).select("vol_id", "u", "w", _six(F.col("t")).alias("t"))


@query(
    "q09_auto_window",
    f"""WITH {VOX}, {_RANGE}, o AS (SELECT vol_id, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY vol_id ORDER BY v) AS k, count(*) OVER (PARTITION BY vol_id) AS n FROM vox),
    q AS (SELECT vol_id, max(CASE WHEN k = 1 + floor(n * 0.01::DOUBLE) THEN v END) AS p01, max(CASE WHEN k = 1 + floor(n * 0.99::DOUBLE) THEN v END) AS p99 FROM o GROUP BY vol_id)
    SELECT vol_id, p01, p99, round((p99 - p01) / (hi - lo), 9) AS win, round(((p01 + p99) / 2 - lo) / (hi - lo), 9) AS level FROM q JOIN r USING (vol_id)""",
)
def auto_window(spark, sf_dir):
    found = aggregate.auto_window(volumes(spark, sf_dir))
    return found.select("vol_id", "p01", "p99", _six(F.col("win"), 9).alias("win"), _six(F.col("level"), 9).alias("level"))


_CHANNELS = {
    "gray": ["t * 255"] * 3,
    "hot": [f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, t * 3 - {k})) * 255" for k in (0, 1, 2)],
    "cool": ["(1 - t) * 255", "t * 255", "255.0::DOUBLE"],
    "jet": [f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.5::DOUBLE - abs(t * 4 - {k}))) * 255" for k in (3, 2, 1)],
}


def _lut_sql(name: str) -> str:
    rows = ", ".join(f"({k}, {float(a[0])!r}::DOUBLE, {a[1]}, {a[2]}, {a[3]}, {float(b[0])!r}::DOUBLE, {b[1]}, {b[2]}, {b[3]})" for k, (a, b) in enumerate(zip(intensity.STOPS[name], intensity.STOPS[name][1:])))
    parts = ", ".join(f"CAST(floor({c}0 + ({c}1 - {c}0) * ((k / 255.0::DOUBLE - t0) / (t1 - t0)) + 0.5::DOUBLE) AS INTEGER) AS {c}" for c in "rgb")
    return f"""s(n, t0, r0, g0, b0, t1, r1, g1, b1) AS (VALUES {rows}),
    lut AS (SELECT k, {parts} FROM (SELECT k, s.*, row_number() OVER (PARTITION BY k ORDER BY n) AS first FROM range(256) e(k) JOIN s ON k / 255.0::DOUBLE BETWEEN t0 AND t1) WHERE first = 1)"""


def _colormap(name: str) -> None:
    if name in _CHANNELS:
        sql = "SELECT vol_id, u, w, " + ", ".join(f"CAST(floor({e} + 0.5::DOUBLE) AS INTEGER) AS {c}" for c, e in zip("rgb", _CHANNELS[name])) + f" FROM d"
        sql = f"WITH {_DISPLAY} {sql}"
    else:
        sql = f"WITH {_DISPLAY}, {_lut_sql(name)} SELECT vol_id, u, w, lut.r, lut.g, lut.b FROM d JOIN lut ON lut.k = CAST(floor(t * 255) AS BIGINT)"

    @query(f"q10_colormap_{name}" if name in _CHANNELS else f"q11_colormap_{name}_lut", sql)
    def run(spark, sf_dir):
        return intensity.apply_colormap(_display(spark, sf_dir), name).select("vol_id", "u", "w", "r", "g", "b")


for _name in intensity.MAPS:
    _colormap(_name)


def _blocks(name: str, axis: str, k: int, factor: int, level: int | None = None) -> None:
    width, height = _SIZE[axis]
    u, w, c = _AXES[axis]

    @query(name, f"WITH {VOX} SELECT vol_id, {u} // {factor} AS bx, {w} // {factor} AS by, round(CAST(CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS v FROM vox WHERE {c} = {k} AND {u} // {factor} < {max(1, width // factor)} AND {w} // {factor} < {max(1, height // factor)} GROUP BY ALL")
    def run(spark, sf_dir):
        slices = voxels.slice_voxels(volumes(spark, sf_dir), axis, k)
        size = F.lit(width), F.lit(height)
        means = aggregate.block_mean(slices, *size, factor) if level is None else aggregate.lod(slices, *size, level)
        return means.select("vol_id", "bx", "by", F.round(F.col("v").cast("double"), 6).alias("v"))


_blocks("q12_downsample2", "axial", 1, 2)
_blocks("q13_lod_level", "axial", 1, 4, 2)
_blocks("q14_downsample3_partial", "coronal", 1, 3)

_ROT = (0.5, 0.25)
_MIP = f"""{VOX}, m AS (SELECT vol_id, CAST(floor({NX // 2} + (x - {NX // 2}) * cos({_ROT[1]}::DOUBLE) + (z - {NZ // 2}) * sin({_ROT[1]}::DOUBLE) + 0.5::DOUBLE) AS INTEGER) AS px,
  CAST(floor({NY // 2} + ((y - {NY // 2}) * cos({_ROT[0]}::DOUBLE) - (-(x - {NX // 2}) * sin({_ROT[1]}::DOUBLE) + (z - {NZ // 2}) * cos({_ROT[1]}::DOUBLE)) * sin({_ROT[0]}::DOUBLE)) + 0.5::DOUBLE) AS INTEGER) AS py, v FROM vox),
  pr AS (SELECT vol_id, px, py, max(v) AS v FROM m WHERE px BETWEEN 0 AND {NX - 1} AND py BETWEEN 0 AND {NY - 1} GROUP BY ALL)"""


@query("q15_mip", f"WITH {_MIP} SELECT * FROM pr")
def mip(spark, sf_dir):
    return aggregate.volume_mip(volumes(spark, sf_dir).withColumns({c: F.lit(1.0) for c in ("dx", "dy", "dz")}), *_ROT)


@query(
    "q16_mip_background",
    f"""WITH {_MIP}, {_RANGE}, g AS (SELECT vec_id AS vol_id, CAST(p % {NX} AS INTEGER) AS px, CAST(p // {NX} AS INTEGER) AS py FROM embeddings, range({NX * NY}) t(p))
    SELECT vol_id, px, py, coalesce(CAST(pr.v AS DOUBLE), lo) AS v FROM g LEFT JOIN pr USING (vol_id, px, py) JOIN r USING (vol_id)""",
)
def mip_background(spark, sf_dir):
    return aggregate.volume_mip(volumes(spark, sf_dir).withColumns({c: F.lit(1.0) for c in ("dx", "dy", "dz")}), *_ROT, filled=True)


_TURN = """CASE WHEN sform_code <> 0 THEN {r}0 * x + {r}1 * y + {r}2 * z + {r}3 WHEN qform_code <> 0 THEN d{r} * ({m0} * x + {m1} * y + {m2} * z) + qoffset_{r} ELSE d{r} * {r} END"""
_ROTATION = [
    ("a*a+b*b-c*c-d*d", "2*(b*c-a*d)", "2*(b*d+a*c)"),
    ("2*(b*c+a*d)", "a*a+c*c-b*b-d*d", "2*(c*d-a*b)"),
    ("2*(b*d-a*c)", "2*(c*d+a*b)", "a*a+d*d-b*b-c*c"),
]
_WORLD = f"""{VOX}, h AS (SELECT *, {_HEADER_SQL.replace("x0", "x0")} FROM (SELECT vec_id AS vol_id, label FROM embeddings)),
  n AS (SELECT *, sqrt(1 + quatern_b * quatern_b + quatern_c * quatern_c + quatern_d * quatern_d) AS a FROM h),
  q AS (SELECT *, quatern_b / a AS b, quatern_c / a AS c, quatern_d / a AS d FROM n),
  wd AS (SELECT vol_id, x, y, z, {", ".join(_TURN.format(r=r, m0=f"({m[0]})", m1=f"({m[1]})", m2=f"({m[2]})") + f" AS w{r}" for r, m in zip("xyz", _ROTATION))} FROM vox JOIN q USING (vol_id))"""


def _world(spark, sf_dir) -> DataFrame:
    vox = with_header(voxels.voxels(volumes(spark, sf_dir), "label"))
    return vox.withColumns(dict(zip(("wx", "wy", "wz"), geometry.to_world(F.col("x"), F.col("y"), F.col("z")))))


@query("q17_to_world", f"WITH {_WORLD} SELECT vol_id, x, y, z, round(wx, 6) + 0 AS wx, round(wy, 6) + 0 AS wy, round(wz, 6) + 0 AS wz FROM wd")
def to_world(spark, sf_dir):
    return _world(spark, sf_dir).select("vol_id", "x", "y", "z", *[_six(F.col(c)).alias(c) for c in ("wx", "wy", "wz")])


@query(
    "q18_to_voxel",
    f"""WITH {_WORLD}, inv AS (SELECT vol_id, sform_code, dx, dy, dz, x0*(y1*z2-y2*z1) - x1*(y0*z2-y2*z0) + x2*(y0*z1-y1*z0) AS det FROM h)
    SELECT vol_id, x, y, z, CASE WHEN sform_code <> 0 AND abs(det) > 1e-10 THEN CAST(x AS DOUBLE) ELSE round(wx / dx, 6) + 0 END AS bx,
      CASE WHEN sform_code <> 0 AND abs(det) > 1e-10 THEN CAST(y AS DOUBLE) ELSE round(wy / dy, 6) + 0 END AS by,
      CASE WHEN sform_code <> 0 AND abs(det) > 1e-10 THEN CAST(z AS DOUBLE) ELSE round(wz / dz, 6) + 0 END AS bz FROM wd JOIN inv USING (vol_id)""",
)
def to_voxel(spark, sf_dir):
    back = geometry.to_voxel(F.col("wx"), F.col("wy"), F.col("wz"))
    return _world(spark, sf_dir).select("vol_id", "x", "y", "z", *[_six(c).alias(n) for c, n in zip(back, ("bx", "by", "bz"))])


_LETTER = """CASE WHEN abs({r}0) >= abs({r}1) AND abs({r}0) >= abs({r}2) THEN CASE WHEN {r}0 >= 0 THEN 'R' ELSE 'L' END
  WHEN abs({r}1) >= abs({r}0) AND abs({r}1) >= abs({r}2) THEN CASE WHEN {r}1 >= 0 THEN 'A' ELSE 'P' END ELSE CASE WHEN {r}2 >= 0 THEN 'S' ELSE 'I' END END"""
_CODES = ", ".join(f"'{o}'" for o in geometry.ORIENTATIONS)


@query(
    "q19_orientation",
    f"""WITH h AS (SELECT *, {_HEADER_SQL} FROM (SELECT vec_id AS vol_id, label FROM embeddings)),
    o AS (SELECT vol_id, sform_code, {" || ".join(f"({_LETTER.format(r=r)})" for r in "xyz")} AS code FROM h)
    SELECT vol_id, CASE WHEN sform_code = 0 THEN 'RAS' WHEN code IN ({_CODES}) THEN code ELSE 'unknown' END AS orientation FROM o""",
)
def orientation(spark, sf_dir):
    return with_header(volumes(spark, sf_dir)).select("vol_id", geometry.orientation().alias("orientation"))


def _affine(spark: SparkSession, ids: DataFrame, rows: list[list[float]]) -> DataFrame:
    header = ids.select(F.col("vol_id").alias("pair")).withColumns({c: F.lit(1.0) for c in ("dx", "dy", "dz")} | {c: F.lit(0.0) for c in ("quatern_b", "quatern_c", "quatern_d", "qoffset_x", "qoffset_y", "qoffset_z")})
    header = header.withColumns({"sform_code": F.lit(1), "qform_code": F.lit(0)})
    return header.withColumns({f"srow_{a}": F.array(*map(F.lit, r)) for a, r in zip("xyz", rows)})


_FIRST = [[2.0, 0.5, 0.0, 1.0], [0.0, 2.0, 0.0, 3.0], [0.0, 0.0, 2.0, -1.0]]
_SECOND = [[2.0, 0.0, 0.0, 2.0], [0.0, 2.0, 0.0, 2.0], [0.0, 0.0, 1.0, 0.0]]
#: The second volume's voxel for (x, y, z) of the first, by hand.
_MATCH = "CAST(floor((2 * x + 0.5::DOUBLE * y + 1 - 2) / 2 + 0.5::DOUBLE) AS INTEGER) AS bx, CAST(floor((2 * y + 3 - 2) / 2.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS by, CAST(2 * z - 1 AS INTEGER) AS bz"


@query(
    "q20_compare_left",
    f"""WITH {VOX}, a AS (SELECT vol_id AS pair, x, y, z, v, {_MATCH} FROM vox WHERE vol_id > 0)
    SELECT pair, a.x, a.y, a.z, a.v, b.v AS other FROM a LEFT JOIN vox b ON b.vol_id = a.pair - 1 AND b.x = a.bx AND b.y = a.by AND b.z = a.bz""",
)
def compare_left(spark, sf_dir):
    """Each volume beside the one before it."""
    v = volumes(spark, sf_dir)
    first = v.where("vol_id > 0").withColumn("pair", F.col("vol_id"))
    second = v.withColumn("pair", F.col("vol_id") + 1)
    return compare.compare(first, _affine(spark, v, _FIRST), second, _affine(spark, v, _SECOND))


@query(
    "q21_compare_clamped",
    f"WITH {VOX}, a AS (SELECT vol_id AS pair, x, y, z, {_MATCH} FROM vox WHERE x = 7 AND y = 3) SELECT pair, z, greatest(0, least({NX - 1}, a.bx)) AS bx, greatest(0, least({NY - 1}, a.by)) AS by, greatest(0, least({NZ - 1}, a.bz)) AS bz FROM a",
)
def compare_clamped(spark, sf_dir):
    """Slices of the other volume that a view of this one shows, the nearest where none matches."""
    v = volumes(spark, sf_dir)
    corner = voxels.voxels(v).where("x = 7 AND y = 3").select(F.col("vol_id").alias("pair"), "x", "y", "z")
    found = compare.aligned(corner, _affine(spark, v, _FIRST), _affine(spark, v, _SECOND))
    return found.select("pair", "z", *[compare.aligned_slice(F.col(f"b{a}"), F.col(f"b{a}"), F.lit(n)).cast("int").alias(f"b{a}") for a, n in zip("xyz", (NX, NY, NZ))])


@query(
    "q22_overlay_blend",
    f"""WITH {_DISPLAY}, f AS (SELECT vol_id AS pair, u, w, floor(t * 255 + 0.5::DOUBLE) AS g FROM d), s AS (SELECT vol_id + 1 AS pair, u // 2 AS u, w // 2 AS w, round(avg(t) * 255, 3) AS g FROM d GROUP BY ALL)
    SELECT f.pair, f.u, f.w, round(CASE WHEN s.g IS NULL THEN f.g ELSE f.g * (1 - 0.4::DOUBLE) + s.g * 0.4::DOUBLE END, 6) AS g FROM f LEFT JOIN s ON s.pair = f.pair AND s.u = f.u // 2 AND s.w = f.w // 2""",
)
def overlay_blend(spark, sf_dir):
    """A half-resolution picture of the volume before, stretched over each picture."""
    t = _display(spark, sf_dir)
    first = t.select(F.col("vol_id").alias("pair"), "u", "w", F.floor(F.col("t") * 255 + 0.5).alias("g"))
    second = t.groupBy((F.col("vol_id") + 1).alias("pair"), F.expr("cast(u div 2 as int)").alias("u"), F.expr("cast(w div 2 as int)").alias("w")).agg(F.round(F.avg("t") * 255, 3).alias("g"))
    mixed = compare.overlay(first, second, (NX, NY), (NX // 2, NY // 2), 0.4, ("g",))
    return mixed.select("pair", "u", "w", F.round("g", 6).alias("g"))


@query(
    "q23_point_probe",
    f"WITH {VOX}, p AS (SELECT vec_id AS vol_id, CAST(vec_id % 9 AS INTEGER) AS x, CAST(vec_id % 5 AS INTEGER) AS y, CAST(vec_id % 4 - 1 AS INTEGER) AS z FROM embeddings) SELECT p.vol_id, p.x, p.y, p.z, vox.v FROM p LEFT JOIN vox USING (vol_id, x, y, z)",
)
def point_probe(spark, sf_dir):
    v = volumes(spark, sf_dir)
    points = v.select("vol_id", *[F.expr(f"cast(vol_id % {n} as int)").alias(a) for a, n in (("x", "9"), ("y", "5"), ("z", "4 - 1"))])
    return voxels.probe(v, points)


@query(
    "q24_minimap_resample",
    f"""WITH {VOX}, g AS (SELECT CAST(x.k AS INTEGER) AS mx, CAST(y.k AS INTEGER) AS my FROM range(6) x(k), range(6) y(k))
    SELECT vol_id, mx, my, v FROM g JOIN vox ON z = 1 AND x = CAST(floor(mx * {NX} / 6.0::DOUBLE) AS INTEGER) AND y = {NY - 1} - CAST(floor(my * {NY} / 6.0::DOUBLE) AS INTEGER)""",
)
def minimap_resample(spark, sf_dir):
    return voxels.resampled(voxels.slice_voxels(volumes(spark, sf_dir), "axial", 1), F.lit(NX), F.lit(NY), 6, 6)


@query(
    "q39_volume_union_filter",
    """WITH b AS (SELECT vec_id AS vol_id, vec_id AS pos FROM embeddings UNION ALL
      SELECT vec_id + 1000000000 AS vol_id, vec_id + 1 + (SELECT max(vec_id) FROM embeddings) AS pos FROM embeddings)
    SELECT vol_id, pos - (pos > 3)::INT AS pos FROM b WHERE pos <> 3""",
)
def volume_union_filter(spark, sf_dir):
    """All volumes, all of them appended once more under other names, the one at position 3 removed."""
    first = volumes(spark, sf_dir).select("vol_id", F.col("vol_id").alias("pos"))
    more = first.withColumn("vol_id", F.col("vol_id") + 1_000_000_000)
    return voxels.remove_at(voxels.append_volume(first, more), 3)


@query("q40_flip_side_by_side", f"WITH {VOX} SELECT vol_id, u, 3 - w AS w, v, 'left' AS side FROM ({_slice_sql('axial', 0)}) UNION ALL SELECT vol_id, u, 3 - w, v, 'right' FROM ({_slice_sql('axial', 1)})")
def flip_side_by_side(spark, sf_dir):
    v = volumes(spark, sf_dir)
    first, second = (voxels.flipped(voxels.slice_clamped(v, "axial", k), F.lit(NY)).select("vol_id", "u", "w", "v") for k in (0, 9))
    return compare.side_by_side(first, second)


@query("q41_nifti_roundtrip", f"WITH {VOX} SELECT vol_id, x, y, z, CAST(CAST(v AS DOUBLE) * 2 + 10 AS FLOAT) AS v FROM vox")
def nifti_roundtrip(spark, sf_dir):
    """Volumes written as NIfTI bytes, each other one big-endian and each third one version 2, and decoded again."""
    from ..session import ship_package
    from ..sources import nifti, nifti_header

    ship_package(spark)

    def write(batches):
        import numpy as np
        import pandas as pd

        for rows in batches:
            out = []
            for vol, data in zip(rows["vol_id"], rows["data"]):
                order, version = "<>"[vol % 2], 2 if vol % 3 == 0 else 1
                head = nifti_header.write_header((NX, NY, NZ), 16, version, order, scl_slope=2.0, scl_inter=10.0)
                out.append((str(vol), head + np.asarray(data).astype(order + "f4").tobytes()))
            yield pd.DataFrame(out, columns=["path", "content"])

    files = volumes(spark, sf_dir).select("vol_id", "data").mapInPandas(write, "path string, content binary")
    slabs = nifti.decode_files(files).select(F.col("path").cast("long").alias("vol_id"), "nx", "z", F.posexplode("data").alias("i", "v"))
    return slabs.select("vol_id", F.expr("cast(i % nx as int)").alias("x"), F.expr("cast(i div nx as int)").alias("y"), "z", "v")


@query("q42_preview_payload", f"WITH {VOX}, {_PREVIEW}, r AS (SELECT vol_id, min(v) AS lo, max(v) AS hi FROM p GROUP BY vol_id) SELECT vol_id, lo, hi, w * {NX} + u AS i, v FROM p JOIN r USING (vol_id) WHERE axis = 'coronal'")
def preview_payload(spark, sf_dir):
    """Previews encoded to their binary form and decoded again; the coronal slices are shown."""
    from ..sources import preview_codec

    slices = voxels.preview(volumes(spark, sf_dir))
    bound = slices.groupBy("vol_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ordered = slices.groupBy("vol_id").pivot("axis", list(_AXES)).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "u", "v"))), lambda p: p["v"]))
    previews = ordered.join(bound, "vol_id").select(F.col("vol_id").cast("string").alias("path"), F.to_json(F.struct("vol_id")).alias("header"), "lo", "hi", F.array(*[F.lit(2)] * 3).alias("idx"), *_AXES)
    back = preview_codec.decode_previews(preview_codec.encode_previews(previews))
    return back.select(F.get_json_object("header", "$.vol_id").cast("long").alias("vol_id"), "lo", "hi", F.posexplode("coronal").alias("i", "v"))


@query(
    "q51_thumbnail",
    f"""WITH {VOX}, {_PREVIEW}, r AS (SELECT vol_id, CAST(min(v) AS DOUBLE) AS lo, CASE WHEN min(v) = max(v) THEN CAST(min(v) AS DOUBLE) + 1 ELSE CAST(max(v) AS DOUBLE) END AS hi FROM p GROUP BY vol_id),
    d AS (SELECT vol_id, u, w, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CAST(v AS DOUBLE) - lo) / (hi - lo))) AS t FROM p JOIN r USING (vol_id) WHERE axis = 'axial'),
    c AS (SELECT vol_id, u, w, {", ".join(f"CAST(floor({e} + 0.5::DOUBLE) AS INTEGER) AS {c}" for c, e in zip("rgb", _CHANNELS["hot"]))} FROM d)
    SELECT vol_id, CAST(x.k AS INTEGER) AS mx, CAST(y.k AS INTEGER) AS my, r, g, b FROM c JOIN range(10) x(k) ON CAST(floor(x.k * {NX} / 10.0::DOUBLE) AS INTEGER) = u JOIN range(10) y(k) ON {NY - 1} - CAST(floor(y.k * {NY} / 10.0::DOUBLE) AS INTEGER) = w""",
)
def thumbnail(spark, sf_dir):
    return views.thumbnail(volumes(spark, sf_dir), "hot", size=10)


@query(
    "q52_lod_picture",
    f"""WITH {VOX}, m AS (SELECT vol_id, x // 2 AS bu, y // 2 AS bw, CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS v FROM vox WHERE z = 1 GROUP BY ALL)
    SELECT vol_id, {NX // 2} AS nx, {NY // 2} AS ny, 1 AS nz, CAST(bu + {NX // 2} * bw AS INTEGER) AS i, v FROM m""",
)
def lod_picture(spark, sf_dir):
    return views.lod_picture(volumes(spark, sf_dir), 1).select("vol_id", "nx", "ny", "nz", F.posexplode("data").alias("i", "v"))


def _hex_float(v: str) -> str:
    """SQL for the hexadecimal digits of a number's four bytes as a float, lowest byte first: sign, exponent and mantissa by arithmetic."""
    size = f"abs(CAST({v} AS DOUBLE))"
    # The exponent is that of the power of two at or below the size; below 2**-126 the mantissa has no leading one.
    e = f"greatest(-126, CAST(floor(log2({size})) AS INTEGER) + CASE WHEN pow(2.0::DOUBLE, floor(log2({size})) + 1) <= {size} THEN 1 WHEN pow(2.0::DOUBLE, floor(log2({size}))) > {size} THEN -1 ELSE 0 END)"
    bits = f"CASE WHEN {v} = 0 THEN 0 ELSE CAST(CASE WHEN {size} < pow(2.0::DOUBLE, -126) THEN {size} / pow(2.0::DOUBLE, -149) ELSE ({e} + 127) * 8388608::DOUBLE + ({size} / pow(2.0::DOUBLE, {e}) - 1) * 8388608::DOUBLE END AS BIGINT) END + CASE WHEN {v} < 0 THEN 2147483648 ELSE 0 END"
    return "(" + " || ".join(f"printf('%02X', ({bits}) // {256**k} % 256)" for k in range(4)) + ")"


@query(
    "q53_slice_bytes",
    f"""WITH {VOX}, f AS (SELECT vol_id, y, z, {_hex_float('v')} AS h FROM vox WHERE x = 3)
    SELECT vol_id, CAST(3 AS INTEGER) AS idx, string_agg(h, '' ORDER BY z, y) AS payload, 'sagittal' AS axis FROM f GROUP BY vol_id""",
)
def slice_bytes(spark, sf_dir):
    found = views.slice_bytes(voxels.slice_voxels(volumes(spark, sf_dir), "sagittal", 3))
    return found.select("vol_id", "idx", F.hex("payload").alias("payload"), "axis")
