"""Sharding along a Hilbert curve over quantised metadata.

Each dimension is quantised to 2**bits cells, the cells' Hilbert index orders the rows, and the order is cut into runs
of equal row counts (law `rows`: counts at most one apart). Neighbours on the curve are neighbours in every dimension,
so each run spans a small box and min/max statistics prune files on several columns at once. Rows of one cell order by
(text_crc32, doc_id), so equal texts of one cell stand together.

A number's cell is its logarithm; a value's cell is the share of rows with lesser values, so that frequent values lie
apart and order is kept, whatever the number of values.

Only the small columns are sorted, by sampled ranges of the whole key (doc_id included, so that no key is hot). A
row's rank is its place in its partition plus the rows of the partitions before, a sum over partitions, not rows.

Defined cases: a null text has size 1 and CRC 0; null dimensions take cell 0; repeated rows are ranked one by one;
null doc_ids sort first; an empty table gives an empty result; fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.llm.common import BROADCAST, checkpoint, hot_keys, lookup_join, shuffle_partitions


#: Values, and bytes of each, that are put in order on the driver.
FEW, SHORT = 1000, 1024


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of rows of cells (n, dims), each below 2**bits (Skilling 2004), vectorised."""
    x = np.array(cells, dtype=np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the excess work
        q = np.uint64(1 << b)
        p = q - one
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        t ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def by_magnitude(value: Column, bits: int) -> Column:
    """Cells by powers of the square root of two, which keep the order of sizes."""
    cell = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(1.0))) * 2)
    return F.least(F.greatest(F.coalesce(cell, F.lit(0)), F.lit(0)), F.lit(2**bits - 1)).cast("int")


def by_share(rows: DataFrame, column: str, bits: int, cell: str, few: int = FEW, limit: int = BROADCAST) -> DataFrame:
    """rows with a column `cell`: the cells that the rows with a lesser value of `column` fill, of 2**bits; null has 0.

    Up to `few` short values are put in order on the driver, more by ranges, so that no task sees them all. The cells of
    the values are broadcast if they take at most `limit` bytes, else joined by shuffle, frequent values apart."""
    counts = rows.select(F.col(column).cast("string").alias("_value")).where("_value is not null").groupBy("_value").agg(F.count("*").alias("_n"), F.octet_length("_value").alias("_bytes"))
    found = counts.select(F.when(F.col("_bytes") <= SHORT, F.col("_value")).alias("_value"), "_n").limit(few + 1).collect()
    if len(found) <= few and all(r["_value"] is not None for r in found):
        total, size, cells = sum(r["_n"] for r in found), 0, []
        before = 0
        for r in sorted(found, key=lambda r: r["_value"].encode()):
            cells.append((r["_value"], before * 2**bits // total))
            before += r["_n"]
        cells = rows.sparkSession.createDataFrame(cells, "_value string, _cell int")
    else:
        cells, size = _by_range(counts, bits)
    keyed = rows.withColumn("_value", F.col(column).cast("string"))
    if size <= limit:
        joined = keyed.join(F.broadcast(cells), "_value", "left")
    else:
        joined = lookup_join(keyed, checkpoint(cells), "_value", hot_keys(keyed, "_value"))
    return joined.select(*rows.columns, F.coalesce("_cell", F.lit(0)).alias(cell))


def _by_range(counts: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """((_value, _cell), their bytes) of any number of values (_value, _n, _bytes)."""
    placed = checkpoint(counts.repartitionByRange(shuffle_partitions(counts.sparkSession), "_value").sortWithinPartitions("_value").withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    parts = {r["_part"]: (r["n"], r["size"]) for r in placed.groupBy("_part").agg(F.sum("_n").alias("n"), F.sum(F.col("_bytes") + 24).alias("size")).collect()}
    total, starts = 0, []
    for part in sorted(parts):
        starts.append((part, total))
        total += parts[part][0]
    offsets = counts.sparkSession.createDataFrame(starts, "_part long, _start long")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.expr(f"cast((_before + _start) * {2**bits} div {max(total, 1)} as int)")
    return placed.withColumn("_before", before).join(F.broadcast(offsets), "_part").select("_value", share.alias("_cell")), sum(size for _, size in parts.values())


def hilbert_shards(rows: DataFrame, dims: list[Column], bits: int, shards: int, ties: list[str]) -> DataFrame:
    """rows with hilbert (the curve index), rank (0-based in curve order), shard and slot (0-based in the shard)."""
    names = [f"_d{i}" for i in range(len(dims))]

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    keep = rows.columns
    keyed = rows.select("*", *(d.alias(n) for d, n in zip(dims, names)))
    keyed = keyed.select(*keep, curve(F.struct(*names)).alias("hilbert"))
    key = ["hilbert", *ties]
    placed = keyed.repartitionByRange(shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    #: The id holds the partition above bit 33 and the row's place in it below.
    placed = checkpoint(placed.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    total, starts = 0, []
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).select(*keep, "hilbert", "rank", "shard", "slot")
