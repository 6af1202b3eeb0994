"""Queries over volumes as slabs: the vectors of one label in ``embeddings`` are the slabs of a volume, which so grows with the table.

A slab is the first 63 numbers of a vector, 9 across and 7 down, so no side equals another and none is a power of two. The volumes are
written as files slab by slab, in three element types and both byte orders, every other one gzipped, and read by the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import compare, slabwise, views
from ..session import new_path, ship_package
from ..sources import decoded, gzip_index, nifti, nifti_header, nifti_udtf
from . import stream_queries

NX, NY = 9, 7
PERCENTS = (0.0, 0.01, 0.5, 0.9, 1.0)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(f"size(embedding) >= {NX * NY} AND label IS NOT NULL")
    return rows.select("label", "vec_id", F.slice("embedding", 1, NX * NY).alias("data"))


def files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the volumes, one file for each label, written once for each session and table."""
    held = spark.sparkContext.__dict__.setdefault("_voxframe_labels", {})
    if sf_dir not in held:
        nifti.register(spark)
        line = Window.partitionBy("label")
        slabs = _vectors(spark, sf_dir).select(
            F.concat(F.lit("label-"), "label", F.when(F.col("label") % 2 == 1, ".nii.gz").otherwise(".nii")).alias("name"),
            F.lit(NX).alias("nx"), F.lit(NY).alias("ny"), F.count("*").over(line).cast("int").alias("nz"),
            (F.row_number().over(line.orderBy("vec_id")) - 1).alias("z"),
            F.when(F.col("label") % 3 == 0, 64).otherwise(16).alias("datatype"), F.when(F.col("label") % 4 < 2, "<").otherwise(">").alias("order"),
            (1.0 + F.col("label")).alias("dx"), "data",
        )
        folder = new_path(spark, "labels")
        slabs.repartition("name").sortWithinPartitions("name", "z").write.format("nifti").mode("append").save(folder)
        held[sf_dir] = folder
    return held[sf_dir]


def _label() -> Column:
    return F.regexp_extract("path", r"label-(-?\d+)\.nii", 1).cast("int")


def _slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slabs of the files, each volume named by its label."""
    rows = nifti.read_volumes(spark, files(spark, sf_dir))
    return rows.withColumn("vol_id", _label()).select(*slabwise.SLAB)


VOX = f"""vox AS (
  SELECT label AS vol_id, CAST(i % {NX} AS INTEGER) AS x, CAST(i // {NX} AS INTEGER) AS y, CAST(z AS INTEGER) AS z, v FROM (
    SELECT label, z, unnest(range({NX * NY})) AS i, unnest(embedding[1:{NX * NY}]) AS v
    FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z FROM embeddings WHERE len(embedding) >= {NX * NY} AND label IS NOT NULL)))"""


@query("q64_sink_coronal", f"WITH {VOX} SELECT vol_id, x, y, z, v FROM vox WHERE y = 3 AND x >= 2")
def sink_coronal(spark, sf_dir):
    """Volumes written slab by slab, and a plane across all slabs read back: of a plain file the bytes of these rows only."""
    vox = nifti.read_volumes(spark, files(spark, sf_dir), "voxels", y="3", x="2:")
    return vox.select(_label().alias("vol_id"), "x", "y", "z", "v")


@query("q65_slab_slices", f"WITH {VOX} SELECT vol_id, 'coronal' AS axis, 5 AS idx, x AS u, z AS w, v FROM vox WHERE y = 5 UNION ALL SELECT vol_id, 'sagittal', 8, y, z, v FROM vox WHERE x = 8 UNION ALL SELECT vol_id, 'axial', 2, x, y, v FROM vox WHERE z = 2")
def slab_slices(spark, sf_dir):
    slabs = _slabs(spark, sf_dir)
    found = [slabwise.slice_voxels(slabs, axis, k) for axis, k in (("coronal", 5), ("sagittal", 8), ("axial", 2))]
    return found[0].unionByName(found[1]).unionByName(found[2]).drop("t")


@query(
    "q66_exact_percentiles",
    f"""WITH {VOX}, o AS (SELECT vol_id, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY vol_id ORDER BY v) AS k, count(*) OVER (PARTITION BY vol_id) AS n FROM vox),
    p AS (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in PERCENTS)}]) AS p)
    SELECT vol_id, p, n, v FROM o JOIN p ON k = 1 + least(n - 1, CAST(floor(n * p) AS BIGINT))""",
)
def exact_percentiles(spark, sf_dir):
    """Order statistics of all voxels of each volume, by two radix passes over the slabs."""
    return slabwise.percentiles(_slabs(spark, sf_dir), PERCENTS).drop("t")


#: Affine rows of a volume and of the one that it is compared to: mirrored and sheared, with a turn between the second and third axis.
_FIRST = [[1.0, 0.5, 0.0, 1.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 2.0]]
_SECOND = [[-1.0, 0.0, 0.0, 8.0], [0.0, 0.0, 0.25, 0.0], [0.0, 2.0, 0.0, 0.0]]
_MATCH = "CAST(floor(8 - (x + 0.5::DOUBLE * y + 1) + 0.5::DOUBLE) AS INTEGER) AS bx, CAST(floor((z + 2) / 2.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS by, CAST(4 * y AS INTEGER) AS bz"


def _headers(slabs: DataFrame, rows: list[list[float]]) -> DataFrame:
    sizes = slabs.select("vol_id", "nx", "ny", "nz").distinct()
    plain = {c: F.lit(1.0) for c in ("dx", "dy", "dz")} | {c: F.lit(0.0) for c in ("quatern_b", "quatern_c", "quatern_d", "qoffset_x", "qoffset_y", "qoffset_z")}
    return sizes.withColumns(plain | {"sform_code": F.lit(1), "qform_code": F.lit(0)} | {f"srow_{a}": F.array(*map(F.lit, r)) for a, r in zip("xyz", rows)})


@query(
    "q67_brick_compare",
    f"""WITH {VOX}, a AS (SELECT vol_id, x, y, z, v, {_MATCH} FROM vox)
    SELECT a.vol_id, a.x, a.y, a.z, a.v, b.v AS other FROM a LEFT JOIN vox b ON b.vol_id = a.vol_id - 1 AND b.x = a.bx AND b.y = a.by AND b.z = a.bz""",
)
def brick_compare(spark, sf_dir):
    """Each label's volume beside that of the label before it, through world coordinates, in bricks of four voxels a side."""
    slabs = _slabs(spark, sf_dir)
    before = slabs.withColumn("vol_id", F.col("vol_id") + 1)
    compared = slabwise.compare(slabs, _headers(slabs, _FIRST), before, _headers(before, _SECOND), edge=4)
    return slabwise.brick_voxels(compared).drop("t")


def _level_sql(level: int) -> str:
    w, h = (max(1, n >> level) for n in (NX, NY))
    return f"SELECT vol_id, z, {level} AS level, x // {1 << level} AS bx, y // {1 << level} AS by, CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS v FROM vox WHERE x // {1 << level} < {w} AND y // {1 << level} < {h} GROUP BY ALL"


@query("q68_pyramid", f"WITH {VOX} " + " UNION ALL ".join(_level_sql(k) for k in range(4)))
def pyramid(spark, sf_dir):
    """Four levels of detail of every slab, in one pass; at the last one a block is larger than the slab."""
    flat = slabwise.pyramid(_slabs(spark, sf_dir), 3).select("vol_id", "z", "level", "nx", F.posexplode("data").alias("i", "v"))
    return flat.select("vol_id", "z", "level", F.expr("cast(i % nx as int)").alias("bx"), F.expr("cast(i div nx as int)").alias("by"), "v")


_TURN = (0.5, 0.25)


@query(
    "q72_projected_pictures",
    f"""WITH {VOX}, n AS (SELECT vol_id, max(z) + 1 AS nz, CAST(min(v) AS DOUBLE) AS lo FROM vox GROUP BY vol_id),
    s AS (SELECT *, CAST(greatest(1, floor(least({min(NX, NY)}, nz) / 80.0::DOUBLE)) AS INTEGER) AS step FROM n),
    m AS (SELECT vol_id, v, x - {NX / 2}::DOUBLE AS cx, (y - {NY / 2}::DOUBLE) AS cy, (z - nz / 2.0::DOUBLE) AS cz FROM vox JOIN s USING (vol_id) WHERE x % step = 0 AND y % step = 0 AND z % step = 0),
    p AS (SELECT vol_id, v, CAST(floor({NX / 2}::DOUBLE + (cx * cos({_TURN[1]}::DOUBLE) + cz * sin({_TURN[1]}::DOUBLE)) + 0.5::DOUBLE) AS INTEGER) AS px,
      CAST(floor({NY / 2}::DOUBLE + (cy * cos({_TURN[0]}::DOUBLE) - (-cx * sin({_TURN[1]}::DOUBLE) + cz * cos({_TURN[1]}::DOUBLE)) * sin({_TURN[0]}::DOUBLE)) + 0.5::DOUBLE) AS INTEGER) AS py FROM m),
    g AS (SELECT vol_id, lo, CAST(k % {NX} AS INTEGER) AS px, CAST(k // {NX} AS INTEGER) AS py FROM n, range({NX * NY}) t(k))
    SELECT g.vol_id, g.px, g.py, coalesce(CAST(max(p.v) AS DOUBLE), any_value(g.lo)) AS v FROM g LEFT JOIN p ON p.vol_id = g.vol_id AND p.px = g.px AND p.py = g.py GROUP BY ALL""",
)
def projected_pictures(spark, sf_dir):
    """A turned projection of each volume as a whole picture, drawn from its slabs."""
    slabs = _slabs(spark, sf_dir)
    sizes = slabs.select("vol_id", "nx", "ny").distinct()
    drawn = slabwise.projection(slabs, sizes.select("vol_id", *[F.lit(1.0).alias(c) for c in ("dx", "dy", "dz")]), *_TURN)
    flat = slabwise.pictures(drawn, sizes, slabwise.value_range(slabs)).select("vol_id", "nx", F.posexplode("data").alias("p", "v"))
    return flat.select("vol_id", F.expr("cast(p % nx as int)").alias("px"), F.expr("cast(p div nx as int)").alias("py"), "v")


@query("q69_catalog_scan", f"WITH {VOX} SELECT vol_id, z, count(*) AS n, max(v) AS v FROM vox WHERE vol_id % 3 = 0 AND z BETWEEN 1 AND 4 GROUP BY ALL")
def catalog_scan(spark, sf_dir):
    """Only files of one element type are opened, as the catalog's headers tell which they are, and only some of their slabs are read."""
    chosen = nifti.catalog(spark, files(spark, sf_dir)).where("datatype = 64 AND dx >= 1")
    slabs = nifti.read_listed(chosen, z=(1, 5))
    return slabs.select(_label().alias("vol_id"), "z", F.size("data").cast("long").alias("n"), F.array_max("data").alias("v"))


@query("q73_gzip_stretches", f"WITH {VOX} SELECT vol_id, z, count(*) AS n, min(v) AS v FROM vox WHERE vol_id % 2 = 1 AND z >= 3 GROUP BY ALL")
def gzip_stretches(spark, sf_dir):
    """The gzipped volumes, each read in several stretches by an index of places where inflating can begin."""
    paths = nifti.catalog(spark, files(spark, sf_dir)).where("path LIKE '%.gz'")
    slabs = gzip_index.read_indexed(gzip_index.gzip_index(paths, span=16_384), z=(3, 1 << 30))
    return slabs.select(_label().alias("vol_id"), "z", F.size("data").cast("long").alias("n"), F.array_min("data").alias("v"))


_COUNTED = {"all": "true", "strided": "(x + {nx} * (y + {ny} * z)) % greatest(1, {n} * nz // 50000) = 0", "middle": "z = nz // 2 OR y = {my} OR x = {mx}", "axial": "z = nz // 2"}


@query(
    "q74_range_modes",
    f"WITH {VOX}, n AS (SELECT *, max(z) OVER (PARTITION BY vol_id) + 1 AS nz FROM vox) "
    + " UNION ALL ".join(f"SELECT vol_id, '{m}' AS mode, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM n WHERE {w.format(nx=NX, ny=NY, n=NX * NY, my=NY // 2, mx=NX // 2)} GROUP BY vol_id" for m, w in _COUNTED.items()),
)
def range_modes(spark, sf_dir):
    """The value range of each volume by each of the rules that viewers have for it."""
    slabs = _slabs(spark, sf_dir)
    parts = [slabwise.value_range(slabs, False, m).select("vol_id", F.lit(m).alias("mode"), "lo", "hi") for m in slabwise.RANGE_MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "q75_slab_probe",
    f"WITH {VOX}, p AS (SELECT vec_id, label AS vol_id, CAST(vec_id % 11 - 1 AS INTEGER) AS x, CAST(vec_id % 8 AS INTEGER) AS y, CAST(vec_id % 13 AS INTEGER) AS z FROM embeddings WHERE label IS NOT NULL) SELECT vol_id, p.x, p.y, p.z, vox.v FROM p LEFT JOIN vox USING (vol_id, x, y, z)",
)
def slab_probe(spark, sf_dir):
    """Single voxels at many points, some outside."""
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label IS NOT NULL")
    at = [F.expr(f"cast({e} as int)").alias(a) for a, e in (("x", "vec_id % 11 - 1"), ("y", "vec_id % 8"), ("z", "vec_id % 13"))]
    return slabwise.probe(_slabs(spark, sf_dir), points.select(F.col("label").alias("vol_id"), F.lit(0).alias("t"), *at)).drop("t")


@query("q76_observed_load", f"WITH {VOX} SELECT count(DISTINCT (vol_id, z)) AS slabs, count(*) AS voxels, 4 * count(*) AS bytes, min(z) AS first_z, max(z) AS last_z FROM vox")
def observed_load(spark, sf_dir):
    """What a load of all volumes reads, counted while another result is made of it."""
    slabs, seen = views.observed(_slabs(spark, sf_dir))
    slabwise.value_range(slabs).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "slabs long, voxels long, bytes long, first_z int, last_z int")


@query("q77_stream_of_volumes", f"WITH {VOX} SELECT vol_id, z, count(*) AS n, max(v) AS v FROM vox GROUP BY ALL")
def stream_of_volumes(spark, sf_dir):
    """The files read as a stream, until it has taken each of them once."""
    stream = spark.readStream.format("nifti").option("view", "slabs").load(files(spark, sf_dir))
    rows = stream_queries.finished(stream.select("path", "z", F.size("data").cast("long").alias("n"), F.array_max("data").alias("v")))
    return rows.select(_label().alias("vol_id"), "z", "n", "v")


@query(
    "q78_overlay_pictures",
    f"""WITH {VOX}, b AS (SELECT vol_id + 1 AS vol_id, x // 2 AS bx, y // 2 AS by, CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS v FROM vox WHERE z = 2 AND x // 2 < {NX // 2} AND y // 2 < {NY // 2} GROUP BY ALL)
    SELECT a.vol_id, a.x, a.y, round(CASE WHEN b.v IS NULL THEN CAST(a.v AS DOUBLE) ELSE CAST(a.v AS DOUBLE) * (1 - 0.4::DOUBLE) + CAST(b.v AS DOUBLE) * 0.4::DOUBLE END, 9) AS v
    FROM (SELECT * FROM vox WHERE z = 2) a LEFT JOIN b ON b.vol_id = a.vol_id AND b.bx = CAST(floor((a.x + 0.5::DOUBLE) * {NX // 2} / {NX}) AS INTEGER) AND b.by = CAST(floor((a.y + 0.5::DOUBLE) * {NY // 2} / {NY}) AS INTEGER)""",
)
def overlay_pictures(spark, sf_dir):
    """A slice of each volume under the one before it at half the resolution, as arrays."""
    slices = _slabs(spark, sf_dir).where("z = 2")
    half = slabwise.pyramid(slices, 1).where("level = 1")
    mixed = compare.overlay_pictures(slices.withColumnRenamed("vol_id", "pair"), half.withColumn("pair", F.col("vol_id") + 1), 0.4)
    flat = mixed.select(F.col("pair").alias("vol_id"), "nx", F.posexplode("data").alias("i", "v"))
    return flat.select("vol_id", F.expr("cast(i % nx as int)").alias("x"), F.expr("cast(i div nx as int)").alias("y"), F.round("v", 9).alias("v"))


_MIDDLE = f"SELECT vol_id, 'axial' AS axis, nz // 2 AS idx, x AS u, y AS w, v FROM n WHERE z = nz // 2 UNION ALL SELECT vol_id, 'coronal', {NY // 2}, x, z, v FROM n WHERE y = {NY // 2} UNION ALL SELECT vol_id, 'sagittal', {NX // 2}, y, z, v FROM n WHERE x = {NX // 2}"


@query("q79_slab_preview", f"WITH {VOX}, n AS (SELECT *, max(z) OVER (PARTITION BY vol_id) + 1 AS nz FROM vox) {_MIDDLE}")
def slab_preview(spark, sf_dir):
    """The three middle slices of each volume in one pass over its slabs."""
    return slabwise.preview(_slabs(spark, sf_dir)).drop("t")


@query("q81_decoded_table", f"WITH {VOX} SELECT vol_id, z, sum(CAST(x + y AS BIGINT)) AS n, max(v) AS v FROM vox WHERE z IN (1, 7) GROUP BY ALL")
def decoded_table(spark, sf_dir):
    """Slabs of all volumes from a table of decoded ones, filled in two steps: the second adds the volumes that it lacks."""
    folder, path = new_path(spark, "decoded"), files(spark, sf_dir)
    listed = nifti.catalog(spark, path)
    table = decoded.keep(nifti.read_listed(listed.where("datatype = 16")), folder)
    table = decoded.keep(nifti.read_listed(decoded.missing(listed, table)), folder, "append")
    flat = nifti.slab_voxels(table.where("z IN (1, 7)"))
    return flat.groupBy(_label().alias("vol_id"), "z").agg(F.sum((F.col("x") + F.col("y")).cast("long")).alias("n"), F.max("v").alias("v"))


#: What becomes of a vector's file, by vec_id modulo 8; the others are whole.
DAMAGE = {1: "cut", 3: "no magic", 4: "colours", 5: "empty", 6: "another kind"}


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each vector as a NIfTI file in bytes, many of them damaged as DAMAGE says."""
    head = nifti_header.write_header((NX, NY, 1), 16)
    colours = nifti_header.write_header((NX, NY, 1), 128)
    ship_package(spark)

    def write(batches):
        import numpy as np
        import pandas as pd

        for rows in batches:
            out = []
            for vec, data in zip(rows["vec_id"], rows["data"]):
                kind = DAMAGE.get(vec % 8)
                raw = head + np.asarray(data, "<f4").tobytes()
                raw = {"cut": raw[:-1], "no magic": raw[:344] + b"xyz" + raw[347:], "colours": colours + raw[len(head) :], "empty": None, "another kind": b"not a volume"}.get(kind, raw)
                out.append((str(vec), raw))
            yield pd.DataFrame(out, columns=["path", "content"])

    return _vectors(spark, sf_dir).select("vec_id", "data").mapInPandas(write, "path string, content binary")


_BAD = f"vec_id % 8 IN ({', '.join(map(str, DAMAGE))})"
_ROWS = f"(SELECT * FROM embeddings WHERE len(embedding) >= {NX * NY} AND label IS NOT NULL)"


@query(
    "q70_damaged_files",
    f"""SELECT vec_id, CASE WHEN {_BAD} THEN NULL ELSE 1 END AS nz, CASE WHEN {_BAD} THEN NULL ELSE list_max(embedding[1:{NX * NY}]) END AS v, {_BAD} AS damaged FROM {_ROWS}""",
)
def damaged_files(spark, sf_dir):
    """Files that can't be read are reported beside the rows of all others."""
    rows = nifti.decode_files(_contents(spark, sf_dir), damaged="report")
    return rows.select(F.col("path").cast("long").alias("vec_id"), "nz", F.array_max("data").alias("v"), F.col("error").isNotNull().alias("damaged"))


@query(
    "q71_voxel_function",
    f"""SELECT vec_id, CAST(i % {NX} AS INTEGER) AS x, CAST(i // {NX} AS INTEGER) AS y, v, false AS damaged FROM (SELECT vec_id, unnest(range({NX * NY})) AS i, unnest(embedding[1:{NX * NY}]) AS v FROM {_ROWS} WHERE NOT {_BAD})
    UNION ALL SELECT vec_id, NULL, NULL, NULL, true FROM {_ROWS} WHERE {_BAD}""",
)
def voxel_function(spark, sf_dir):
    """Voxels of binary content in SQL, by a table function."""
    nifti_udtf.register(spark)
    return spark.sql("SELECT CAST(path AS LONG) AS vec_id, x, y, v, error IS NOT NULL AS damaged FROM nifti_voxels(TABLE(SELECT path, content FROM {files}))", files=_contents(spark, sf_dir))
