"""Session settings and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "jobsieve", cores: str = "*") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on: one time zone, adaptive skew handling, whole unions.

    Spark 4.1 can pair up the wrong partitions when both sides of a union report one
    partitioning, and then repeats or loses rows; that shortcut is switched off.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, as in
    tests, may fall back to a temporary folder: on a cluster that folder would
    be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    kept = getattr(shared_folder, "_local", None)
    if kept is None:
        kept = shared_folder._local = tempfile.mkdtemp(prefix="jobsieve-ckpt-")
    return kept


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    The table cuts the lineage like a checkpoint does, survives a lost executor, and
    keeps columns apart, so a later read takes only the columns it needs and knows the
    size of what it reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cuts/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(table: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for ``table``, once nothing reads it any more.

    Only the table that ``cut`` returned knows its folder; for any other nothing happens.
    """
    path = getattr(table, "cut_path", None)
    if path is None:
        return
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
