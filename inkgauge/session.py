"""Session helpers: table access, worker code shipping, reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkgauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small tables, much work per row
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


TEXT_TABLES = ("chunks", "candidates", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; text tables in fewer parts than the cluster has cores are spread over these.

    Work on texts is bound by CPU, and a file of one row group is one task
    however many cores wait. Tables of many parts stay as they are read.
    """
    ship_code(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return  # workers inherit the path; those of a cluster may not
    if getattr(sc, "_inkgauge_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="inkgauge")) / "inkgauge_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "inkgauge").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(out))
    sc._inkgauge_shipped = True


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder of the session.

    The folder is the one the session has set, else ``shared_folder()``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. Without one, a temporary folder on a local master and an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all machines share")
    return tempfile.mkdtemp(prefix="inkgauge-ckpt")
