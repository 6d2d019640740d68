"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def nan_to_null(c: Column) -> Column:
    """NaN -> null, so that max/min/avg skip it like R's ``na.rm``."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def parse_list(values) -> list[str] | None:
    """Accept a list or comma separated text; trim items; empty -> None."""
    if values is None:
        return None
    if isinstance(values, str):
        values = values.split(",")
    out = [str(v).strip() for v in values if str(v).strip() != ""]
    return out or None


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column; ``+ 0.0`` folds -0.0 into 0.0."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_numeric(df: DataFrame, digits: int = 4,
                  wider: Iterable[str] = ("logFC", "logCPM"), wider_digits: int = 5,
                  pvalue_cols: Iterable[str] = ("PValue", "FDR")) -> DataFrame:
    """Display rounding of a DEG-like table.

    Numeric columns are rounded to ``digits``; ``wider`` columns to
    ``wider_digits``; p-value columns become ``%.5e`` text.
    """
    wider, pvalue_cols = set(wider), set(pvalue_cols)
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in pvalue_cols and isinstance(f.dataType, _NUMERIC):
            cols.append(F.when(c.isNull(), None)
                        .otherwise(F.format_string("%.5e", c.cast("double"))).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            d = wider_digits if f.name in wider else digits
            cols.append((F.round(c.cast("double"), d) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def with_key_stats(df: DataFrame, keys, *aggs) -> DataFrame:
    """Attach per-key aggregates to every row: ``groupBy(keys).agg(...)``
    joined back on the keys.

    Preferred over a window partitioned by the key: the aggregate is
    combined map-side, and the join back is either broadcast (one row per
    key, e.g. per gene) or a sort-merge join that AQE splits when one key
    is hot, whereas a window must put every row of a key into one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(df.groupBy(*keys).agg(*aggs), keys)
