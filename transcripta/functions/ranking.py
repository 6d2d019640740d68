"""Global ranks without a single-partition window.

``Window.orderBy(...)`` with no partition key moves every row into one
task.  For large inputs the rank is computed distributed instead: range
partition on the order key, fix the range of each row in a written column,
count rows per range, then number the rows of each range from its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcripta.session import cut_lineage


def global_row_number(df: DataFrame, order_cols: list, out: str = "rn",
                      n_parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Add a 1-based row number over the total order ``order_cols``.

    Returns ``(numbered, persisted)``; call ``persisted.unpersist()`` when
    the result has been consumed.  ``order_cols`` must make the order total
    (add a key column as the last one).
    """
    spark = df.sparkSession
    k = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [c if not isinstance(c, str) else F.col(c) for c in order_cols]
    # the range is written as a column before the offsets are counted: later plans may merge partitions
    rp = cut_lineage(df.repartitionByRange(k, *cols).withColumn("_range", F.spark_partition_id()), "ranked")
    counts = rp.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    ahead = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*cols)).cast("long")
    numbered = (rp.withColumn(out, inside).join(F.broadcast(counts.select("_range", ahead.alias("_ahead"))), "_range")
                .withColumn(out, F.col(out) + F.col("_ahead")).select(*df.columns, out))
    return numbered, rp


def keyed_running_sum(df: DataFrame, key: str, order_cols: list, value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over the key's rows up to and with the row, in the order of ``order_cols``.

    Rows are cut into ranges of (key, order), which is written as a column; a
    window sees one key's rows of one range, or the ranges of one key, so a key
    on all rows is spread over all tasks.  The order must be total within a key.
    """
    k = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = cut_lineage(df.withColumn("_add", value).repartitionByRange(k, F.col(key), *cols)
                         .withColumn("_range", F.spark_partition_id()), "running")
    totals = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(F.sum("_add").alias("_t"))
    upto = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ahead = totals.select("_key", "_at", (F.sum("_t").over(upto) - F.col("_t")).alias("_ahead"))
    inside = Window.partitionBy(key, "_range").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn(out, F.sum("_add").over(inside))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at"))
    return summed.join(ahead, same).withColumn(out, F.col(out) + F.col("_ahead")).select(*df.columns, out)


def value_slice(v: Column, per_doubling: int = 256) -> Column:
    """A whole number that grows with v: so many slices per power of two on either side of 0, the infinities by themselves."""
    size = F.when(F.abs(v) == float("inf"), F.lit(1 << 30)).otherwise(F.floor((F.log2(F.abs(v)) + 1100) * per_doubling) + 1)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("int") * size.cast("int")).cast("int")


def ranked_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, _c, _upto, _n``: each distinct value of a key, its rows, the rows up to it and the key's rows.

    Equal values are counted before the shuffle.  A key's values are cut into
    slices by size, so a window sees the slices of a key (their number is
    fixed) or the distinct values of one slice, never a key's rows.  Nulls and
    NaN are left out.
    """
    v = F.col(value)
    each = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    each = cut_lineage(each.withColumn("_s", value_slice(v)), "values")
    upto = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    slices = each.groupBy(key, "_s").agg(F.sum("_c").alias("_t"))
    slices = slices.select(key, "_s", (F.sum("_t").over(upto) - F.col("_t")).alias("_before"),
                           F.sum("_t").over(Window.partitionBy(key)).alias("_n"))
    inside = Window.partitionBy(key, "_s").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (each.withColumn("_in", F.sum("_c").over(inside)).join(slices, [key, "_s"])
            .select(key, value, "_c", (F.col("_before") + F.col("_in")).alias("_upto"), "_n"))


def keyed_quantile(df: DataFrame, key: str, value: str, p: float, out: str = "q") -> DataFrame:
    """``key, out``: the exact quantile of each key's values, interpolated between neighbours."""
    at = (F.col("_n") - 1) * F.lit(float(p))
    low, high = F.floor(at) + 1, F.ceil(at) + 1
    first = F.col("_upto") - F.col("_c") + 1

    def of(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= F.col("_upto")), F.col(value)))

    got = ranked_values(df, key, value).groupBy(key).agg(of(low).alias("_lo"), of(high).alias("_hi"), F.first(at - F.floor(at)).alias("_f"))
    between = F.col("_lo") * (1 - F.col("_f")) + F.col("_hi") * F.col("_f")
    return got.select(key, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias(out))


def keyed_trim(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """``key, lo, hi``: the values of a key whose average rank is neither among the lowest nor the highest ``share`` of its rows.

    Ranks grow with the values, so the kept ones are all those from ``lo`` to ``hi``.
    """
    rank = F.col("_upto") - (F.col("_c") - 1) / 2.0
    least = F.floor(F.col("_n") * share) + 1
    kept = ranked_values(df, key, value).filter((rank >= least) & (rank <= F.col("_n") + 1 - least))
    return kept.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def bh_distributed(df: DataFrame, p_col: str, out_col: str = "FDR") -> DataFrame:
    """Benjamini-Hochberg over one large test family without a global window.

    Equal p-values have equal rates, so they are counted first.  The distinct
    values are cut into slices by size (a fixed number of them, whatever the
    data); running counts and minima go over the slices, then inside each.
    Rows without a p-value get a null rate.
    """
    p = F.col(p_col)
    each = df.filter(p.isNotNull()).groupBy(p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # 4096 even slices down to 1/64, 64 per power of two below, one for 0
    of = (F.when(F.col("_p") <= 0, F.lit(-100_000)).when(F.col("_p") > 1 / 64, F.floor(F.col("_p") * 4096))
          .otherwise(F.floor(F.log2("_p") * 64))).cast("int")
    each = cut_lineage(each.withColumn("_s", of), "bh-values")
    upto = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    slices = each.groupBy("_s").agg(F.sum("_n").alias("_c"))
    slices = slices.select("_s", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"),
                           F.sum("_c").over(Window.partitionBy()).alias("_m"))
    inside = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    rated = each.join(slices, "_s").withColumn(
        "_q", F.col("_p") * F.col("_m") / (F.col("_before") + F.sum("_n").over(inside)))
    above = Window.orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = rated.groupBy("_s").agg(F.min("_q").alias("_least")).select("_s", F.min("_least").over(above).alias("_later"))
    rest = Window.partitionBy("_s").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rate = rated.join(later, "_s").select(
        "_p", F.least(F.lit(1.0), F.min("_q").over(rest), F.col("_later")).alias(out_col))
    return df.join(rate, p == F.col("_p"), "left").drop("_p")
