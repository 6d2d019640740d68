"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells.  Every shard owns ``virtual_nodes`` points
on it, and a key belongs to the first point clockwise from its cell.  A shard
takes at most its capacity; the keys of a cell that find it full go on
clockwise to the next point of another shard that has room.  Keys are served
in ring order and, within a cell, in hash order.

With load factor 1 the capacities add up to the number of rows (the first
``n mod shards`` shards hold one more), so shard counts differ by one at most:
the law ``rows``.  A factor above 1 leaves room and moves fewer keys when a
shard is added; the counts then stay below factor times the mean.

Spark counts the keys per cell; the walk round the ring needs those counts
only (one number a cell, a fixed number of cells).  It yields, for each cell,
which ranks go to which shard and slot, and Spark ranks the keys in each cell.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcripta.llm.common import table, text_of
from transcripta.session import cut_lineage

CELLS = 4096
VIRTUAL_NODES = 32
SHARDS = 24


def ring_points(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order.

    A shard's points depend on its number alone, so more shards leave them
    where they are.
    """
    def place(shard: int, v: int) -> tuple[int, bytes]:
        h = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=16).digest()
        return int.from_bytes(h[:8], "big") % cells, h

    points = [(*place(s, v), s) for s in range(shards) for v in range(virtual_nodes)]
    return [(c, s) for c, _, s in sorted(points)]


def capacities(rows: int, shards: int, factor: float = 1.0) -> list[int]:
    if factor <= 1.0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(factor * rows / shards)] * shards


def fill_ring(counts: dict[int, int], shards: int, factor: float = 1.0, virtual_nodes: int = VIRTUAL_NODES,
              cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """Walk the cells in ring order and give their keys to shards.

    Returns (cell, first rank, end rank, shard, first slot): keys of the cell
    with a rank in [first, end) go to the shard, from that slot on.  At most
    one row per cell and shard.
    """
    points = ring_points(shards, virtual_nodes, cells)
    room = capacities(sum(counts.values()), shards, factor)
    used, out, at = [0] * shards, [], 0
    for cell in range(cells):
        while at < len(points) and points[at][0] < cell:
            at += 1
        todo, rank, step = counts.get(cell, 0), 0, 0
        while todo:
            shard = points[(at + step) % len(points)][1]
            n = min(todo, room[shard] - used[shard])
            if n:
                out.append((cell, rank, rank + n, shard, used[shard]))
                used[shard], rank, todo = used[shard] + n, rank + n, todo - n
            step += 1
    return out


def ring_cell(key: str, cells: int = CELLS):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(cells)).cast("int")


def shard_rows(rows: DataFrame, key: str, shards: int, factor: float = 1.0, order: tuple = (),
               virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard).

    ``order`` names columns that put rows of equal key in a fixed order; rows
    alike in all of them are interchangeable.  A null key hashes like any
    other value.  An empty table gives an empty table.
    """
    spark = rows.sparkSession
    ranked = rows.withColumn("__cell", ring_cell(key, cells))
    counts = {r[0]: r[1] for r in ranked.groupBy("__cell").count().collect()}  # a row per cell
    walk = spark.createDataFrame(fill_ring(counts, shards, factor, virtual_nodes, cells) or [(-1, 0, 0, 0, 0)],
                                 "__c int, __first long, __end long, shard int, __slot long")
    inside = Window.partitionBy("__cell").orderBy(F.xxhash64(F.col(key), F.lit(1)), key, *order)
    ranked = ranked.withColumn("__rank", (F.row_number().over(inside) - 1).cast("long"))
    # at most one row per cell and shard, whatever the table holds
    out = ranked.join(F.broadcast(walk), (F.col("__cell") == F.col("__c")) & (F.col("__rank") >= F.col("__first"))
                      & (F.col("__rank") < F.col("__end")))
    return (out.withColumn("slot", F.col("__slot") + F.col("__rank") - F.col("__first"))
            .drop("__cell", "__c", "__rank", "__first", "__end", "__slot"))


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at most one apart over 24 shards.  Null texts have size 8 and the crc of no bytes."""
    body = text_of().cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = cut_lineage(rows, "ring-rows")  # three numbers a document: the texts are read once
    out = shard_rows(rows, "doc_id", SHARDS, order=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
