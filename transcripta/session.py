"""Session helpers: sensible defaults and a checkpoint directory.

Library code never picks a machine-local folder on a cluster: the checkpoint
directory is read from ``spark.checkpoint.dir``.  Only local sessions (tests,
bench, smoke runs) fall back to a folder below their warehouse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "transcripta") -> SparkSession:
    """A session configured the way tests and the bench expect."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder, set on the SparkContext if it is not yet.

    It is read from ``spark.checkpoint.dir`` and must be shared by all nodes.
    When it is unset, a local session gets a folder below its warehouse (which
    the user chose); any other session is refused.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative operators need a "
                "shared checkpoint folder on a cluster")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Functions that run in workers are pickled by name, so the workers must be
    able to import them; a driver-only ``sys.path`` entry is not enough.
    """
    import os
    import pathlib
    import zipfile
    sc = spark.sparkContext
    if getattr(sc, "_transcripta_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    if not os.path.isdir(root):  # already imported from a shipped archive
        return
    path = os.path.join(sc._temp_dir, "transcripta_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    sc._transcripta_shipped = True


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing the frame as Parquet into the shared
    checkpoint folder and reading it back.

    Unlike ``Dataset.checkpoint`` (which keeps the original logical plan
    attached, so plans of iterative loops nest round after round), the
    re-read table has a fresh plan of one scan; the files survive executor
    loss.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint directory for written tables."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
