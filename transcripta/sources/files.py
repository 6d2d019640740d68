"""File sources (GTF, GCT) and sinks (CSV / Parquet)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GTF_SCHEMA = T.StructType([
    T.StructField("seqname", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("score", T.StringType()),
    T.StructField("strand", T.StringType()),
    T.StructField("frame", T.StringType()),
    T.StructField("attribute", T.StringType()),
])


def src_read_gtf(spark: SparkSession, groups: dict[str, str | list[str]]) -> DataFrame:
    """Read headerless, ``#``-commented GTF files; one path, glob or folder (or
    a list of them) per group label.  Each group is one scan that carries its
    label, so no label depends on how a path is written; a file named by two
    groups is read for both."""
    def one(label: str, paths: str | list[str]) -> DataFrame:
        return (spark.read.option("sep", "\t").option("comment", "#").option("quote", "").option("header", "false")
                .schema(GTF_SCHEMA).csv([paths] if isinstance(paths, str) else list(paths))
                .select(*GTF_SCHEMA.fieldNames(), F.lit(label).alias("group")))
    return reduce(DataFrame.unionAll, [one(g, p) for g, p in groups.items()])


def src_read_gct(spark: SparkSession, path: str, gene_col: str = "Description") -> DataFrame:
    """Read a GCT panel into long form ``(gene, tissue, value)``.

    GCT: line 1 version (``#1.2``), line 2 dimensions, line 3 header.  The
    header (three lines) is read once; data lines are recognised by content
    (not by position), so every file split is parsed independently.
    """
    head = [r.value for r in spark.read.text(path).limit(3).collect()]
    header = head[2].split("\t")
    tissues = header[2:]
    lines = spark.read.text(path)
    is_meta = (F.col("value").rlike(r"^#\d") | F.col("value").rlike(r"^\d+\t\d+\s*$")
               | F.startswith(F.col("value"), F.lit(header[0] + "\t" + header[1])))
    parts = F.split(F.col("value"), "\t")
    data = lines.filter(~is_meta).select(parts.alias("p"))
    gi = 1 if gene_col == header[1] else 0
    cells = data.select(
        F.col("p").getItem(gi).alias("gene"),
        F.posexplode(F.slice(F.col("p"), 3, len(tissues))).alias("i", "txt"))
    tissue_arr = F.array(*[F.lit(t) for t in tissues])
    return cells.select("gene", F.element_at(tissue_arr, F.col("i") + 1).alias("tissue"),
                        F.col("txt").try_cast("double").alias("value"))


def sink_csv(df: DataFrame, path: str, partition_by: list[str] | None = None,
             fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write a result table (CSV with header, or Parquet), optionally
    partitioned (e.g. one folder per module)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)
    return path


def write_gtf(df: DataFrame, path: str, comment: str = "#!transcripta gtf") -> str:
    """Write a 9-column frame as GTF text with one comment line."""
    spark = df.sparkSession
    body = df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in GTF_SCHEMA.fieldNames()])
                     .alias("value"))
    spark.createDataFrame([(comment,)], "value string").unionByName(body).write.mode(
        "overwrite").text(path)
    return path


def write_gct(panel_long: DataFrame, path: str, tissues: list[str]) -> str:
    """Write a long panel ``(gene, tissue, value)`` as a GCT file set."""
    spark = panel_long.sparkSession
    wide = panel_long.groupBy("gene").pivot("tissue", tissues).agg(F.max("value"))
    n = wide.count()
    head = spark.createDataFrame(
        [("#1.2", 0), (f"{n}\t{len(tissues)}", 1), ("\t".join(["Name", "Description"] + tissues), 2)],
        "value string, o int")
    body = wide.select(F.concat_ws("\t", F.concat(F.lit("ID_"), F.col("gene")), F.col("gene"),
                                   *[F.coalesce(F.col(t).cast("string"), F.lit("NA")) for t in tissues])
                       .alias("value"), F.lit(3).alias("o"))
    head.unionByName(body).orderBy("o").coalesce(1).select("value").write.mode("overwrite").text(path)
    return path
