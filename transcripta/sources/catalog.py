"""Run discovery over catalog or file listings, and run loading.

A listing is any DataFrame of names (``SHOW TABLES`` output, a file
listing, ...).  Every step is a column expression or a small aggregate, so a
listing of millions of names is handled like any other table; only a
single scalar (the newest time) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.functions.columns import parse_list

TIME_TOKEN = r"^\d{8}t\d{6}z$"
TIME_FORMAT = "yyyyMMdd't'HHmmss'z'"

# fixed values: table-name prefixes per role (case-insensitive)
ROLE_PREFIXES = {
    "expression": ("normcounts", "expression_table"),
    "deg": ("exacttest", "gene_table", "gene_metadata"),
    "samples": ("coldata", "sample_table", "sample_metadata"),
}


def src_match_tables(listing: DataFrame, user: str | None, table_pattern: str,
                     database: str = "database", name: str = "name") -> DataFrame:
    """Per matching database, the first (by name) table matching a regex.

    Databases must end with ``_<lower(user)>`` (any database if ``user`` is
    empty); the label is the database name without that suffix.  Raises if
    nothing matches (checked with a one-row probe).
    """
    db = F.col(database)
    df = listing
    if user:
        suffix = "_" + user.lower()
        df = df.filter(F.endswith(db, F.lit(suffix)))
        label = F.expr(f"substring({database}, 1, length({database}) - {len(suffix)})")
    else:
        label = db
    out = (df.filter(F.col(name).rlike(table_pattern))
           .groupBy(db.alias(database)).agg(F.min(name).alias(name))
           .withColumn("label", label))
    if out.limit(1).count() == 0:
        raise ValueError(f"no table matches {table_pattern!r} for user {user!r}")
    return out.select(database, "label", name)


def time_token(name: Column) -> Column:
    """The unique ``YYYYMMDDtHHMMSSz`` part of a ``_``-separated name, else null."""
    toks = F.filter(F.split(name, "_"), lambda t: t.rlike(TIME_TOKEN))
    return F.when(F.size(toks) == 1, toks.getItem(0))


def src_latest_run(listing: DataFrame, name: str = "name", per_role: bool = False) -> DataFrame:
    """Add ``time_str``, ``time`` and ``is_latest`` to a listing of names.

    ``is_latest`` compares with the maximum time over the whole listing
    (or per role with ``per_role``).  The caller keeps the latest rows, or
    all rows when no name carries a time (see ``latest_or_all``).
    """
    ts = F.col("time_str")
    # zone-free timestamp; the guard keeps invalid dates null under ANSI
    parsed = F.when(F.try_to_timestamp(ts, F.lit(TIME_FORMAT)).isNotNull(),
                    F.to_timestamp_ntz(ts, F.lit(TIME_FORMAT)))
    df = (listing.withColumn("time_str", time_token(F.col(name)))
          .withColumn("time", parsed))
    if per_role:
        df = df.withColumn("role", src_role(F.col(name)))
        mx = df.groupBy("role").agg(F.max("time").alias("_mx"))
        df = df.join(mx, "role", "left")  # one row per role: AQE broadcasts it
        return (df.withColumn("is_latest", F.coalesce(F.col("time") == F.col("_mx"), F.lit(False)))
                .drop("_mx"))
    # the newest time travels as text: a Python datetime literal would come
    # back as a zone-aware timestamp and shift under a non-UTC session
    latest = df.agg(F.max("time").cast("string")).first()[0]
    if latest is None:
        return df.withColumn("is_latest", F.lit(False))
    return df.withColumn("is_latest", F.coalesce(F.col("time") == F.lit(latest).cast("timestamp_ntz"),
                                                  F.lit(False)))


def latest_or_all(flagged: DataFrame) -> DataFrame:
    """Rows flagged latest, or every row when none has a time."""
    if flagged.filter(F.col("is_latest")).limit(1).count() == 0:
        return flagged
    return flagged.filter(F.col("is_latest"))


def src_role(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for role, prefixes in reversed(list(ROLE_PREFIXES.items())):
        pat = "^(" + "|".join(prefixes) + ")"
        out = F.when(low.rlike(pat), F.lit(role)).otherwise(out)
    return out


def src_table_roles(listing: DataFrame, name: str = "name") -> DataFrame:
    """Add the role (expression / deg / samples, else null) of each name."""
    return listing.withColumn("role", src_role(F.col(name)))


def src_normalise_columns(df: DataFrame) -> DataFrame:
    """``genes`` -> ``GeneSymbol``; drop the stray ``_c0`` index column."""
    if "genes" in df.columns:
        df = df.withColumnRenamed("genes", "GeneSymbol")
    if "_c0" in df.columns:
        df = df.drop("_c0")
    return df


def src_load_run(spark: SparkSession, listing: DataFrame, name: str = "name",
                 reader: Callable[[str], DataFrame] | None = None,
                 gene_col: str = "GeneSymbol", per_role: bool = False) -> dict[str, DataFrame]:
    """Load the newest run: first expression, DEG and sample table by name.

    Returns lazy DataFrames {"expression", "deg", "samples"}; without a
    sample table a pseudo sample table is derived from the expression
    columns (``tab_coldata_random``).  ``per_role`` takes the newest table of
    each role instead of one global newest time.  Nothing is collected
    except the few chosen table names.
    """
    from transcripta.operators.reshape import tab_coldata_random
    read = reader or spark.read.table
    flagged = src_latest_run(listing, name, per_role=per_role)
    if "role" not in flagged.columns:
        flagged = flagged.withColumn("role", src_role(F.col(name)))
    chosen = (latest_or_all(flagged)
              .filter(F.col("role").isNotNull())
              .groupBy("role").agg(F.min(name).alias(name)).collect())
    names = {r["role"]: r[name] for r in chosen}
    if "expression" not in names:
        raise ValueError("the selected run has no expression table")
    out = {"expression": src_normalise_columns(read(names["expression"]))}
    if "deg" in names:
        out["deg"] = src_normalise_columns(read(names["deg"]))
    if "samples" in names:
        out["samples"] = read(names["samples"])
    else:
        out["samples"] = tab_coldata_random(out["expression"], gene_col)
    return out


def src_store_runs(spark: SparkSession, database: str, path: str, frames: dict[str, DataFrame], run: str = "run") -> DataFrame:
    """Store the tables of several runs and return the catalog's listing ``(name)`` of the database.

    ``frames`` maps a table prefix to rows of all runs with a ``run`` column
    (time token).  A frame is written once, partitioned by run, by the
    tasks that made it: no task holds a run.  Every run
    becomes the catalog table ``<prefix>_<run>`` over its folder.  The driver
    sees the runs' tokens only.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for prefix, df in frames.items():
        df.write.mode("overwrite").partitionBy(run).parquet(f"{path}/{prefix}")
        stored = spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/{prefix}").select(F.col(run).cast("string"))
        for (token,) in stored.distinct().collect():
            spark.sql(f"CREATE TABLE `{database}`.`{prefix}_{token}` USING parquet LOCATION '{path}/{prefix}/{run}={token}'")
    return spark.sql(f"SHOW TABLES IN `{database}`").select(F.col("tableName").alias("name"))


def src_expr_query(long_df: DataFrame, main_codes=None, sub_codes=None, normalizations=None,
                   main: str = "main_code", sub: str = "sub_code",
                   norm: str = "normalization") -> DataFrame:
    """Filter a long expression table by code lists (list or comma text).

    Plain ``isin`` predicates: on a Parquet/Delta table they reach the scan
    as pushed filters, and partition pruning applies when the table is
    partitioned by ``normalization``.
    """
    cond = F.lit(True)
    for col, vals in ((main, main_codes), (sub, sub_codes), (norm, normalizations)):
        lst = parse_list(vals)
        if lst is not None:
            cond = cond & F.col(col).isin(lst)
    return long_df.filter(cond)
