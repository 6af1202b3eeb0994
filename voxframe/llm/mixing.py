"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions alone.

Each source's documents, in the order of a hash, are cut into blocks of ``block_bytes`` of text. In a cycle
of M block slots a source with m blocks has weight m/M; its i-th block is released at slot
floor(i*M/m) and due at slot ceil((i+1)*M/m). Taking the released block with the earliest deadline, slot
by slot (of equal deadlines the first source by name, those of one block a cycle last), meets all deadlines,
so at every point each source's share is off its weight by less than one block. Cycles repeat until a source runs short. From there on the
sources' remaining blocks make up the cycle, so the schedule is worked out once for each run of like cycles.
No document is dropped or repeated.

All sources with the same m have the same windows, so they are one class and the fold that finds a cycle's
order looks at classes: there are at most sqrt(2*M) of them, however many sources there are. The class of
one block a cycle, where a long tail of sources lies, is always due last and takes the slots that the others
leave, without a step of its own. The schedule has a row for each block of each run's first cycle, so never
more rows than there are blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import checkpointed, table

BLOCK_BYTES = 8192
#: Slots of a cycle that weights are rounded to; each source has one at least.
CYCLE = 100
#: Documents in one bucket of the prefix sums, about.
BUCKET_ROWS = 4096
#: Rows of the schedule, or of its cycles, up to which they are broadcast; beyond that the joins shuffle.
BROADCAST_ROWS = 100_000


def _all_rows():
    """One group of all rows, for tables with a row for each source."""
    return Window.partitionBy(F.lit(0))


def tempered_weights(sizes: DataFrame, temperature: float = 0.5, cycle: int = CYCLE) -> DataFrame:
    """(source, weight) from (source, bytes): slots in proportion to bytes to the power of ``temperature``."""
    part = F.pow(F.greatest(F.col("bytes"), F.lit(1)).cast("double"), F.lit(temperature))
    share = sizes.withColumn("part", part).withColumn("share", F.col("part") / F.sum("part").over(_all_rows()))
    return share.select("source", F.greatest(F.lit(1), F.round(F.col("share") * cycle).cast("int")).alias("weight"))


def _earliest_deadline_first(classes: Column, slots: Column) -> Column:
    """The order of one cycle's blocks, an array of (m, k, slot), from classes (m > 1, names) and M; the k-th block of a
    class is block k div c of its source number k % c, c being the number of its names.

    Each step takes the block that is due first of those released; where none is, time moves on to the next release.
    """

    def take(state: Column, _: Column) -> Column:
        def next_block(d: Column, at: Column) -> Column:
            k, c = F.element_at(state["done"], at + 1), F.size(d["names"])
            i = F.floor(k / c)
            left, release, due = i < d["m"], F.floor(i * slots / d["m"]), F.ceil((i + 1) * slots / d["m"])
            # What isn't released yet ranks after all that is, by its release.
            late = release > state["slot"]
            name = F.element_at(d["names"], (k % c + 1).cast("int"))
            return F.struct((~left).alias("none"), F.when(late, release).otherwise(-1).alias("wait"), due.alias("due"), name.alias("name"), at.alias("at"), k.alias("k"))

        first = F.array_min(F.transform(classes, next_block))
        # Of several that wait for the same release the fold takes the first due once time is there.
        slot = F.greatest(state["slot"], first["wait"])
        done = F.transform(state["done"], lambda n, at: F.when(at == first["at"], n + 1).otherwise(n))
        chosen = F.struct(F.element_at(classes, first["at"] + 1)["m"].alias("m"), first["k"].alias("k"), slot.alias("slot"))
        return F.struct((slot + 1).alias("slot"), done.alias("done"), F.array_append(state["out"], chosen).alias("out"))

    empty = F.expr("cast(array() as array<struct<m:int,k:int,slot:bigint>>)")
    start = F.struct(F.lit(0).cast("bigint").alias("slot"), F.transform(classes, lambda d: F.lit(0)).alias("done"), empty.alias("out"))
    steps = F.aggregate(classes, F.lit(0), lambda n, d: n + d["m"] * F.size(d["names"]))
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, take, lambda state: state["out"])).otherwise(empty)


def runs_of_cycles(stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of like cycles, (run, from_cycle, to_cycle, slots, base), and (run, source, m) of the sources that are left in each.

    ``base`` is the position of the run's first slot. The second table has a row for each block at the most.
    """
    full = F.expr("blocks div weight")
    ends = stock.select("source", "blocks", "weight", F.when(F.expr("blocks % weight = 0"), full - 1).otherwise(full).alias("last_cycle"))
    points = ends.select(F.explode(F.array(F.lit(0).cast("long"), full, F.col("last_cycle") + 1)).alias("from_cycle")).distinct()
    line = _all_rows().orderBy("from_cycle")
    points = points.withColumns({"to_cycle": F.lead("from_cycle").over(line), "run": F.row_number().over(line)}).where("to_cycle IS NOT NULL")
    # A source's last cycle begins a run; it is left in this run and all before.
    last = ends.join(points.select(F.col("from_cycle").alias("last_cycle"), F.col("run").alias("last_run")), "last_cycle", "left")
    # Where all its cycles are full, its last cycle lies in the run that ends with it.
    until = points.select(F.col("to_cycle").alias("next_cycle"), F.col("run").alias("run_before"))
    last = last.withColumn("next_cycle", F.col("last_cycle") + 1).join(until, "next_cycle", "left").withColumn("last_run", F.coalesce("last_run", "run_before"))
    left = last.withColumn("run", F.explode(F.sequence(F.lit(1), F.col("last_run")))).join(points.select("run", "from_cycle"), "run")
    left = left.select("run", "source", F.least(F.col("weight").cast("long"), F.col("blocks") - F.col("from_cycle") * F.col("weight")).cast("int").alias("m"))
    left = checkpointed(left)
    slots = left.groupBy("run").agg(F.sum("m").alias("slots"))
    before = _all_rows().orderBy("from_cycle").rowsBetween(Window.unboundedPreceding, -1)
    runs = points.join(slots, "run").withColumn("base", F.coalesce(F.sum((F.col("to_cycle") - F.col("from_cycle")) * F.col("slots")).over(before), F.lit(0)))
    return checkpointed(runs), left


def schedule(stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of like cycles and, for each block of a cycle of a run, its slot, from (source, blocks, weight).

    The first table is that of :func:`runs_of_cycles`, the second has run, source, i (the block's number
    within its cycle) and slot.
    """
    runs, left = runs_of_cycles(stock)
    named = left.where("m > 1").groupBy("run", "m").agg(F.array_sort(F.collect_list("source")).alias("names"))
    classes = named.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("m", "names"))).alias("classes"))
    none = F.expr("cast(array() as array<struct<m:int,names:array<string>>>)")
    cycles = runs.select("run", "slots").join(classes, "run", "left").withColumn("classes", F.coalesce("classes", none))
    ordered = checkpointed(cycles.select("run", "slots", "classes", _earliest_deadline_first(F.col("classes"), F.col("slots")).alias("out")))
    heavy = ordered.select("run", "classes", F.inline("out"))
    names = F.element_at(F.filter("classes", lambda d: d["m"] == F.col("m")), 1)["names"]
    heavy = heavy.withColumn("names", names).select("run", F.element_at("names", (F.col("k") % F.size("names") + 1).cast("int")).alias("source"), F.expr("cast(k div size(names) as int)").alias("i"), "slot")
    # Blocks of the sources that have one a cycle fill the slots that are left, by name.
    free = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1), F.transform("out", lambda o: o["slot"]))
    free = ordered.select("run", F.posexplode(free).alias("k", "slot"))
    tail = left.where("m = 1").withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("source")) - 1)
    return runs, heavy.unionByName(tail.join(free, ["run", "k"]).select("run", "source", F.lit(0).alias("i"), "slot"))


def _small(rows: DataFrame, count: int) -> DataFrame:
    """The rows, to be broadcast if they are few."""
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


def mix(docs: DataFrame, weights: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with their place in the mixture.

    ``weights`` has (source, weight), whole slots of a cycle; sources missing there get one slot, and
    without it weights are tempered by the square root of the sources' bytes. Returns ``row`` (a struct of
    ``columns``, by default all), ``source`` (null: the empty name), ``source_block``, ``mix_block`` (the
    position of the block, gapless from 0 but for blocks that lie wholly inside one long text) and
    ``at`` (bytes of the source before the row), which orders the rows of a block. Null and empty texts
    count as one byte. Within a source documents are ordered by the first 60 bits of the MD5 of their doc_id
    (null: the empty text), then by doc_id, then by two hashes of the text and one of the row's other columns (but maps), so
    a task that is run again puts each row where it was, however its input was dealt; only rows that are alike may change
    places. Rows are neither dropped nor repeated; an empty table gives none.
    """
    digest = F.substring(F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")), 1, 15)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and not re.search("map<|variant", f.dataType.simpleString())]
    rows = docs.select(
        F.struct(*(columns or docs.columns)).alias("row"),
        F.array(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.xxhash64(*hashed)).alias("tie"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"),
        F.greatest(F.lit(1), F.coalesce(F.octet_length(docs["text"]), F.lit(1))).cast("long").alias("size"),
        docs["doc_id"].alias("id"),
        F.conv(digest, 16, 10).cast("long").alias("h"),
    )
    buckets = max(1, docs.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.expr(f"shiftrightunsigned(h, 30) * {buckets} div {1 << 30}"))
    totals = checkpointed(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bytes")))
    sizes = totals.groupBy("source").agg(F.sum("bytes").alias("bytes"))
    if weights is None:
        weights = tempered_weights(sizes)
    given = weights.select(F.coalesce("source", F.lit("")).alias("source"), "weight").groupBy("source").agg(F.max("weight").alias("weight"))
    stock = sizes.join(given, "source", "left").select(
        "source", F.ceil(F.col("bytes") / block_bytes).cast("long").alias("blocks"), F.greatest(F.lit(1), F.coalesce("weight", F.lit(1))).cast("int").alias("weight")
    )
    stock = checkpointed(stock)
    runs, slots = schedule(stock)
    cycles = runs.select("run", F.explode(F.expr("sequence(from_cycle, to_cycle - 1)")).alias("cycle"), (F.col("base") - F.col("from_cycle") * F.col("slots")).alias("base"), F.col("slots"))
    number = runs.agg(F.coalesce(F.sum(F.expr("to_cycle - from_cycle")), F.lit(0))).first()[0]
    cycles = _small(cycles.select("cycle", "run", (F.col("base") + F.col("cycle") * F.col("slots")).alias("first")), number)
    slots = checkpointed(slots)
    slots = _small(slots, slots.count())
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).join(stock, "source").select("source", "bucket", "before", "weight")
    inner = Window.partitionBy("source", "bucket").orderBy("h", "id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inner)).join(bases, ["source", "bucket"])
    placed = placed.withColumn("at", F.col("before") + F.col("upto") - F.col("size")).withColumn("source_block", F.expr(f"at div {block_bytes}"))
    placed = placed.withColumn("cycle", F.expr("source_block div weight")).withColumn("i", F.expr("cast(source_block % weight as int)"))
    found = placed.join(cycles, "cycle").join(slots, ["run", "source", "i"])
    return found.select("row", "source", "source_block", (F.col("first") + F.col("slot")).alias("mix_block"), "at")


def in_mixed_order(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in the order of the mixture: partitions by ranges of blocks, each sorted.

    Written as files, the order is that of their numbers and of the rows in each; :func:`file_order` reads it back.
    Nulls, repeated rows and empty tables are as in :func:`mix`: every row is there once.
    """
    mixed = mix(docs)
    return mixed.repartitionByRange("mix_block").sortWithinPartitions("mix_block", "source", "at").select("row.*")


def file_order(docs: DataFrame) -> tuple[Column, Column]:
    """The number of the Parquet file that a row of ``docs`` was read from, in the order of writing, and its place in that file.

    Spark deals files to tasks by their size, so rows don't come back in the order in which they were written;
    the files' metadata has it still. ``docs`` has to be a table that is read from such files.
    """
    metadata = docs.metadataColumn("_metadata")
    number = F.regexp_extract(metadata["file_name"], r"^part-(\d+)", 1).cast("long")
    piece = F.coalesce(F.regexp_extract(metadata["file_name"], r"-c(\d+)\.", 1).try_cast("long"), F.lit(0))
    return number * (1 << 20) + piece, metadata["row_index"]


def op7(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), columns=["doc_id"]).select("row.doc_id", "source", "source_block", "mix_block", "at")


OP7_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(source, '') AS source, greatest(1, coalesce(strlen(text), 1)) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
stock AS (
  SELECT source, CAST(ceil(sum(size) / {float(BLOCK_BYTES)}) AS BIGINT) AS blocks,
         greatest(1, CAST(round(sqrt(CAST(sum(size) AS DOUBLE)) / sum(sqrt(CAST(sum(size) AS DOUBLE))) OVER () * {CYCLE}) AS BIGINT)) AS weight
  FROM rows GROUP BY source),
demand AS (
  SELECT cycle, source, weight, least(weight, blocks - cycle * weight) AS m, sum(least(weight, blocks - cycle * weight)) OVER (PARTITION BY cycle) AS slots
  FROM stock JOIN (SELECT unnest(range((SELECT max(blocks) FROM stock))) AS cycle) ON blocks > cycle * weight),
cycles AS (SELECT cycle, coalesce(sum(any_value(slots)) OVER (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM demand GROUP BY cycle),
jobs AS (SELECT cycle, source, cycle * weight + i AS block, m, (i * slots) // m AS release, ((i + 1) * slots + m - 1) // m AS due FROM (SELECT *, unnest(range(m)) AS i FROM demand)),
edf(cycle, slot, todo, taken) AS (
  SELECT cycle, 0, list({{'source': source, 'block': block, 'release': release}} ORDER BY due, m = 1, source, block), CAST(NULL AS STRUCT(source VARCHAR, block BIGINT, release BIGINT)) FROM jobs GROUP BY cycle
  UNION ALL
  SELECT cycle, slot + 1, list_filter(todo, lambda j: j <> next), next
  FROM (SELECT cycle, slot, todo, list_filter(todo, lambda j: j.release <= slot)[1] AS next FROM edf WHERE len(todo) > 0)),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS "at" FROM rows)
SELECT doc_id, p.source, "at" // {BLOCK_BYTES} AS source_block, CAST(base + slot - 1 AS BIGINT) AS mix_block, "at"
FROM placed p JOIN edf ON taken.source = p.source AND taken.block = "at" // {BLOCK_BYTES} JOIN cycles USING (cycle)
"""
