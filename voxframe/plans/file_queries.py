"""Queries over NIfTI files: a volume of 90 x 91 x 92 for each row of ``region``, written by Spark and read by the format.

The five files differ in element type and byte order, and every other one is gzipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, slabwise
from ..session import new_path
from ..sources import nifti, nifti_header

SHAPE = (90, 91, 92)
#: Element code and byte order by r_regionkey modulo 5: int16, uint16, float32, uint8, int32.
TYPES = ((4, "<"), (512, ">"), (16, ">"), (2, "<"), (8, ">"))
#: Sides that make a projection take every other voxel.
MIP_SIDE = 160

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _by_type(values: list) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr("cast(r_regionkey % 5 + 1 as int)"))


def files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the files, written once for each session and table."""
    held = spark.sparkContext.__dict__.setdefault("_voxframe_volumes", {})
    if sf_dir not in held:
        nx, ny, nz = SHAPE
        region = spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("r_regionkey", F.col("r_regionkey").cast("int"))
        voxel = lambda i: (i % nx + 3 * (F.floor(i / nx) % ny) + 7 * F.floor(i / (nx * ny)) + 11 * F.col("r_regionkey")) % 113
        volumes = region.select(
            F.concat(F.lit("v"), "r_regionkey", F.when(F.col("r_regionkey") % 2 == 1, ".nii.gz").otherwise(".nii")).alias("name"),
            *[F.lit(n).alias(c) for c, n in zip(("nx", "ny", "nz"), SHAPE)],
            _by_type([t for t, _ in TYPES]).alias("datatype"),
            _by_type([o for _, o in TYPES]).alias("order"),
            (0.5 * (F.col("r_regionkey") + 1)).alias("scl_slope"),
            (-F.col("r_regionkey")).cast("double").alias("scl_inter"),
            F.transform(F.sequence(F.lit(0), F.lit(nx * ny * nz - 1)), lambda i: voxel(i).cast("int")).alias("data"),
        )
        folder = new_path(spark, "volumes")
        # One volume to a task, and one to a batch.
        nifti.write_files(volumes.repartition("name"), folder)
        held[sf_dir] = folder
    return held[sf_dir]


def _read(spark: SparkSession, sf_dir: str, view: str, **options) -> DataFrame:
    rows = nifti.read_volumes(spark, files(spark, sf_dir), view, **options)
    return rows.withColumn("r_regionkey", F.regexp_extract("path", r"v(\d+)\.nii", 1).cast("int"))


_VALUE = "CAST(CAST((x + 3 * y + 7 * z + 11 * r_regionkey) % 113 AS DOUBLE) * (0.5 * (r_regionkey + 1)) - r_regionkey AS FLOAT)"
_GRID = f"(SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z FROM range({SHAPE[0]}) a(x), range({SHAPE[1]}) b(y), range({SHAPE[2]}) c(z))"


@query("q58_nifti_slab", f"SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, x, y, z, {_VALUE} AS v FROM region, {_GRID} WHERE z = 41")
def nifti_slab(spark, sf_dir):
    """One slab of each file: the reader reads, or inflates, no more than it needs."""
    return _read(spark, sf_dir, "voxels", z="41", t="0").select("r_regionkey", "x", "y", "z", "v")


@query(
    "q59_nifti_header",
    f"""SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, {", ".join(f"{n} AS n{a}" for a, n in zip("xyz", SHAPE))}, 1 AS nt,
    list_extract([{", ".join(str(t) for t, _ in TYPES)}], CAST(r_regionkey % 5 + 1 AS INTEGER)) AS datatype, list_extract([{", ".join(str(o == "<").lower() for _, o in TYPES)}], CAST(r_regionkey % 5 + 1 AS INTEGER)) AS little_endian,
    CAST(0.5 * (r_regionkey + 1) AS DOUBLE) AS scl_slope, CAST(-r_regionkey AS DOUBLE) AS scl_inter, 'RAS' AS orientation FROM region""",
)
def nifti_header_rows(spark, sf_dir):
    """Headers as JSON, read back field by field."""
    kinds = {"nx": "int", "ny": "int", "nz": "int", "nt": "int", "datatype": "int", "little_endian": "boolean", "scl_slope": "double", "scl_inter": "double", "orientation": "string"}
    text = nifti_header.header_json(_read(spark, sf_dir, "header").drop("r_regionkey"))
    fields = F.from_json("json", ", ".join(f"{c} {t}" for c, t in kinds.items()))
    return text.select(F.regexp_extract("path", r"v(\d+)\.nii", 1).cast("int").alias("r_regionkey"), fields.alias("h")).select("r_regionkey", "h.*")


@query(
    "q60_strided_mip",
    f"""WITH g AS (SELECT CAST(2 * a AS INTEGER) AS x, CAST(2 * b AS INTEGER) AS y, CAST(2 * c AS INTEGER) AS z FROM range({MIP_SIDE // 2}) t(a), range({MIP_SIDE // 2}) u(b), range({MIP_SIDE // 2}) v(c))
    SELECT CAST(r_regionkey AS INTEGER) AS vol_id, x AS px, y AS py, max(CAST((x * 31 + y * 17 + z * 7 + r_regionkey) % 1009 AS FLOAT)) AS v FROM region, g GROUP BY ALL""",
)
def strided_mip(spark, sf_dir):
    """Projection of volumes whose sides are twice the samples that one takes: every other voxel counts."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("int").alias("vol_id"))
    headers = regions.select("vol_id", *[F.lit(1.0).alias(c) for c in ("dx", "dy", "dz")])
    value = lambda i: (i % MIP_SIDE * 31 + F.floor(i / MIP_SIDE) * 17 + F.col("z") * 7 + F.col("vol_id")) % 1009
    slabs = regions.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(MIP_SIDE - 1)))).repartition("vol_id", "z")
    data = F.transform(F.sequence(F.lit(0), F.lit(MIP_SIDE**2 - 1)), lambda i: value(i).cast("float"))
    slabs = slabs.select("vol_id", F.lit(0).alias("t"), "z", *[F.lit(MIP_SIDE).alias(c) for c in ("nx", "ny", "nz")], data.alias("data"))
    return slabwise.projection(slabs, headers).drop("t")


@query(
    "q61_strided_window",
    f"""WITH v AS (SELECT r_regionkey, x + {SHAPE[0]} * (y + {SHAPE[1]} * z) AS i, CAST({_VALUE} AS DOUBLE) AS v FROM region, {_GRID}),
    r AS (SELECT r_regionkey, min(v) AS lo, max(v) AS hi FROM v GROUP BY r_regionkey),
    s AS (SELECT r_regionkey, list(v ORDER BY v) AS s FROM v WHERE i % {SHAPE[0] * SHAPE[1] * SHAPE[2] // aggregate.CONTRAST_SAMPLES} = 0 GROUP BY r_regionkey),
    q AS (SELECT r_regionkey, s[1 + CAST(floor(len(s) * 0.01::DOUBLE) AS BIGINT)] AS p01, s[1 + CAST(floor(len(s) * 0.99::DOUBLE) AS BIGINT)] AS p99 FROM s)
    SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, p01, p99, round((p99 - p01) / (hi - lo), 9) AS win, round(((p01 + p99) / 2 - lo) / (hi - lo), 9) AS level FROM q JOIN r USING (r_regionkey)""",
)
def strided_window(spark, sf_dir):
    """Contrast of whole volumes from files, of every 75th voxel."""
    found = slabwise.auto_window(slabwise.of_files(nifti.read_volumes(spark, files(spark, sf_dir))))
    return found.select(F.regexp_extract("vol_id", r"v(\d+)\.nii", 1).cast("int").alias("r_regionkey"), "p01", "p99", F.round("win", 9).alias("win"), F.round("level", 9).alias("level"))
