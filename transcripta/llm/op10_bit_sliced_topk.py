"""Exact top-k inner products on a bit-sliced index.

Vectors are cut into blocks.  A block's index holds, for every attribute
(component) and every bit of its quantised value, one bitmap over the rows.
A query is a weight per attribute; each weight in signed binary digits says
which slices are added at which power of two (a negative digit adds the
complement and a constant).  Carry-save adders on whole bitmaps add them, so
the scores of a block arise as bitmaps too, most significant slice last.

The best k rows are found from the most significant slice down: rows certainly
in, rows still tied, until at most k are left; rows tied at the border are
taken by smaller id.  Blocks give k rows a query, and Spark ranks those.

Blocks have a bounded number of rows; query blocks meet index blocks by keys.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcripta.llm.common import table
from transcripta.session import cut_lineage

BLOCK_ROWS = 1 << 16
QUERIES_AT_ONCE = 192
SCALE = 256


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, v`` with v = floor(scale * x), x as double.

    Rows with a null id, a null or empty vector, or a null or non-finite component are left out.
    """
    e = F.col("__e")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("__e"))
            .filter(F.col("vec_id").isNotNull() & (F.size("__e") > 0) & finite)
            .select("vec_id", F.size("__e").alias("dim"), F.transform(e, lambda x: F.floor(x * float(scale))).alias("v")))


def build_index(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slices (n_slices, words), attribute of each slice, lowest value of each attribute) of (rows, dim) integers."""
    low = values.min(0)
    up = values - low
    bits = np.array([max(1, int(x).bit_length()) for x in up.max(0)])
    words = (len(values) + 63) // 64
    slices = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for d in range(values.shape[1]):
        for b in range(bits[d]):
            packed = np.packbits(((up[:, d] >> b) & 1).astype(np.uint8), bitorder="little")
            slices[at, :len(packed)] = packed
            at += 1
    return slices.view(np.uint64), bits, low


def signed_digits(x: int) -> list[tuple[int, int]]:
    """(power, +1 or -1) of the non-adjacent form of an integer."""
    out, power = [], 0
    while x:
        if x & 1:
            digit = 2 - (x & 3)
            out.append((power, digit))
            x -= digit
        x >>= 1
        power += 1
    return out


def score_slices(slices: np.ndarray, flipped: np.ndarray, bits: np.ndarray, low: np.ndarray, query: np.ndarray):
    """(score bitmaps, least significant first, and the constant to add to them)."""
    first = np.cumsum(bits) - bits
    todo: dict[int, tuple[list[int], list[int]]] = {}
    constant = int((query.astype(object) * low.astype(object)).sum())
    for d, q in enumerate(query.tolist()):
        for power, digit in signed_digits(q):
            for b in range(int(bits[d])):
                todo.setdefault(power + b, ([], []))[digit < 0].append(int(first[d]) + b)
            if digit < 0:
                constant -= ((1 << int(bits[d])) - 1) << power
    out, carried, p = [], [], 0
    while p <= max(todo, default=-1) or carried:
        plus, minus = todo.get(p, ([], []))
        rows = np.concatenate([slices[plus], flipped[minus], *carried]) if plus or minus or carried else np.zeros((1, slices.shape[1]), np.uint64)
        carried = []
        while len(rows) > 1:
            k = len(rows) // 3
            if k:  # full adders, k at a time
                a, b, c, rest = rows[:k], rows[k:2 * k], rows[2 * k:3 * k], rows[3 * k:]
                half = a ^ b
                carried.append((a & b) | (half & c))
                half ^= c
                rows = np.concatenate((half, rest)) if len(rest) else half
            else:
                carried.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        out.append(rows[0])
        p += 1
    return out, constant


def _rows_of(bitmap: np.ndarray, most: int) -> list[int]:
    """The first ``most`` rows set in a bitmap."""
    out: list[int] = []
    for w in np.flatnonzero(bitmap):
        x = int(bitmap[w])
        while x and len(out) < most:
            out.append(64 * int(w) + (x & -x).bit_length() - 1)
            x &= x - 1
        if len(out) >= most:
            break
    return out


def top_rows(score: list[np.ndarray], valid: np.ndarray, k: int) -> list[int]:
    """Rows of the k highest scores among ``valid``; the lowest row numbers of those tied at the border."""
    sure, tied = np.zeros_like(valid), valid
    for s in reversed(score):
        more = sure | (tied & s)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            tied = tied & s
        else:
            sure, tied = more, tied & ~s
            if n == k:
                return _rows_of(sure, k)
    rows = _rows_of(sure, k)
    return rows + _rows_of(tied, k - len(rows))


def _index_block(pdf):
    import pandas as pd
    pdf = pdf.sort_values("vec_id", kind="stable")
    values = np.array(pdf["v"].tolist(), np.int64)
    slices, bits, low = build_index(values)
    return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "block": int(pdf["block"].iloc[0]), "n_rows": len(pdf),
                          "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "slices": slices.tobytes(),
                          "bits": bits.tolist(), "low": low.tolist()}])


def bit_sliced_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of quantised vectors: one row per block of about ``block_rows`` vectors of one dimension."""
    blocks = max(1, math.ceil(vectors.count() / block_rows))
    return (vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
            .groupBy("dim", "block").applyInPandas(
                _index_block, "dim int, block int, n_rows int, ids binary, slices binary, bits array<int>, low array<long>"))


def _search(k: int, skip_own: bool):
    def run(key, index, queries):
        import pandas as pd
        out = []
        if len(index) and len(queries):
            row = index.iloc[0]
            ids, n = np.frombuffer(row["ids"], np.int64), int(row["n_rows"])
            bits, low = np.array(row["bits"], np.int64), np.array(row["low"], np.int64)
            slices = np.frombuffer(row["slices"], np.uint64).reshape(int(bits.sum()), -1)
            flipped = ~slices
            valid = np.full(slices.shape[1], ~np.uint64(0))
            if n % 64:
                valid[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
            for query_id, v in zip(queries["query_id"], queries["v"]):
                score, constant = score_slices(slices, flipped, bits, low, np.array(v, np.int64))
                allowed = valid
                lo, hi = np.searchsorted(ids, [query_id, query_id + 1]) if skip_own else (0, 0)
                if hi > lo:
                    allowed = valid.copy()
                    for r in range(lo, hi):
                        allowed[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
                for r in top_rows(score, allowed, k):
                    value = sum(((int(s[r >> 6]) >> (r & 63)) & 1) << p for p, s in enumerate(score))
                    out.append((query_id, int(ids[r]), constant + value))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = 5, skip_own: bool = True,
          queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest scores per query, ties to the smaller id.

    ``queries``: quantised ``vec_id, dim, v``; queries that are alike count once.
    A query meets the vectors of its dimension; with ``skip_own`` those of its own id are left out.
    """
    queries = queries.distinct()
    parts = max(1, math.ceil(queries.count() / queries_at_once))
    q = queries.select(F.col("vec_id").alias("query_id"), "dim", "v",
                       F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)).cast("int").alias("part"))
    # every block of queries with every block of the index, by key
    last = index.agg(F.max("block")).first()[0] or 0
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    each = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = each.groupBy("dim", "block", "part").cogroup(q.groupBy("dim", "block", "part")).applyInPandas(
        _search(k, skip_own), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    index = cut_lineage(bit_sliced_index(vectors), "bit-slices")
    return top_k(index, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH q AS (
  SELECT vec_id, v, len(v) AS dim FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0))
SELECT query_id, "rank"::INTEGER AS "rank", vec_id, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank" FROM (
    SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, a.dim + 1), lambda i: a.v[i] * b.v[i])) AS score
    FROM q a JOIN q b ON a.vec_id <> b.vec_id AND a.dim = b.dim WHERE a.vec_id % 50 = 0)) WHERE "rank" <= 5"""
