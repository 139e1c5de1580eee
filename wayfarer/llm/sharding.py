"""Proportional stratified interleaving: every shard holds the mixture of the sources.

Rows of a source are put in a seeded random order; row r of n gets the fraction (r - 1/2) / n.  Sorting all
rows by fraction interleaves the sources in proportion, so cutting that order into equal runs gives shards
whose counts differ by at most one and in which each source has its share.

Neither ranking gathers a source or the corpus in one task.  Both are two-level: rows fall into cells (by
leading hash bits within a source, then by leading bits of the fraction), cell counts are aggregated with
map-side partials and prefix-summed, first over blocks of BLOCK cells and then inside each block, and only rows of
one cell are ordered together.  The number of cells follows the row count, so a cell stays near ``cell_rows`` rows
whatever the source's share; rows that repeat as a whole very often are told apart by their place in the input.  Texts
are reduced to size and checksum before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_evenly, pick, shared_dir, written

SEED = 20240607
#: Cells whose counts are summed together: the sums over blocks are one row for about BLOCK * cell_rows rows.
BLOCK = 1024


def starts_of(counts: DataFrame, cell: str, start: str, by: list[str]) -> DataFrame:
    """counts (by, cell, c) with the sum of c of all smaller cells as ``start``, by blocks of cells."""
    before = lambda *keys: Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = (Window.unboundedPreceding, -1)
    counts = counts.withColumn("block", F.floor(F.col(cell) / F.lit(BLOCK)))
    blocks = counts.groupBy(*by, "block").agg(F.sum("c").alias("bc"))
    blocks = blocks.withColumn("block_start", F.coalesce(F.sum("bc").over(before(*by).orderBy("block").rowsBetween(*upto)), F.lit(0))).drop("bc")
    inside = F.coalesce(F.sum("c").over(before(*by, "block").orderBy(cell).rowsBetween(*upto)), F.lit(0))
    return counts.withColumn("inside", inside).join(blocks, [*by, "block"]).select(*by, cell, (F.col("block_start") + F.col("inside")).alias(start))


def proportional_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", overhead: int = 16, seed: int = SEED, cell_rows: int = 256) -> DataFrame:
    """Rows (doc_id, source, size, text_crc32, position, shard, slot), one per input row.

    Null texts have size ``overhead`` and the checksum of no bytes; a null source is a source of its own;
    repeated rows keep a place each; an empty table gives no rows; other columns are ignored.  The order depends on the
    rows and the seed alone; only where one row repeats as a thousandth of the table do its copies also count by place.
    """
    folder = shared_dir(docs.sparkSession)
    utf8 = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id",
        "source",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("origin"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = rows.withColumn("mix", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"))
    rows = written(rows, "rows", folder)
    total = rows.count()
    cells = max(1, -(-total // cell_rows))
    # At most a thousand hashes belong to a thousandth of the rows each.
    often = rows.groupBy("mix").agg(F.count("*").alias("c")).where((F.col("c") * 1000 >= total) & (F.col("c") > cell_rows)).select("mix", F.lit(True).alias("often"))
    rows = rows.join(F.broadcast(often), "mix", "left").withColumn("mix", F.when(F.col("often"), F.xxhash64("mix", "place")).otherwise(F.col("mix"))).drop("often", "place")
    # Leading bits of the unsigned hash; a source of m rows spreads over about m / cell_rows of its own cells.
    per_source = rows.groupBy("origin").agg(F.count("*").alias("n"))
    per_source = written(per_source.withColumn("n_cells", F.ceil(F.col("n") / F.lit(float(cell_rows)))), "sources", folder)
    keyed = joined_evenly(rows, per_source, "origin", "n", total)
    uniform = (F.shiftrightunsigned("mix", 11)).cast("double") / F.lit(float(1 << 53))
    keyed = keyed.withColumn("cell", F.floor(uniform * F.col("n_cells")))
    starts = starts_of(keyed.groupBy("origin", "cell").agg(F.count("*").alias("c")), "cell", "start", ["origin"])
    unsigned = F.col("mix").bitwiseXOR(F.lit(-(1 << 63)))
    inside = Window.partitionBy("origin", "cell").orderBy(unsigned, "doc_id", "size", "text_crc32")
    ranked = keyed.withColumn("r", F.row_number().over(inside)).join(starts, ["origin", "cell"])
    # The fraction (2 rank - 1) / (2 n), scaled to the runs in exact arithmetic.
    ranked = ranked.select("doc_id", "source", "origin", "size", "text_crc32", "mix", (2 * (F.col("start") + F.col("r")) - 1).alias("num"), (2 * F.col("n")).alias("den"))
    run = F.expr(f"cast((cast(num as decimal(20,0)) * cast({cells} as decimal(18,0))) div cast(den as decimal(20,0)) as bigint)")
    ranked = ranked.withColumn("fraction", F.col("num") / F.col("den")).withColumn("run", run)
    runs = starts_of(ranked.groupBy("run").agg(F.count("*").alias("c")), "run", "run_start", [])
    order = Window.partitionBy("run").orderBy("fraction", "origin", "mix", "doc_id", "size", "text_crc32")
    placed = ranked.withColumn("k", F.row_number().over(order)).join(runs, "run").withColumn("position", F.col("run_start") + F.col("k") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((position * cast({shards} as decimal(20,0))) div {max(total, 1)} as int)"))
    first = F.expr(f"cast((shard * cast({max(total, 1)} as decimal(20,0)) + {shards - 1}) div {shards} as bigint)")
    return placed.withColumn("slot", F.col("position") - first).select("doc_id", "source", "size", "text_crc32", F.col("position").cast("long").alias("position"), "shard", F.col("slot").cast("long").alias("slot"))
