"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure the session has a checkpoint directory on shared storage.

    The directory the cluster names in ``spark.checkpoint.dir`` is used as it
    is. Only a local session that names none gets a temporary one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fleetlens-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder on the storage that all executors share."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/fleetlens-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written to shared storage once and read from there.

    For a step that several results build on: it is computed one time, survives
    the loss of executors, and is read back by column.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = 8, app: str = "fleetlens") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, for functions that run in their Python workers.

    The package is zipped once per context and distributed by Spark, so that
    nothing has to be installed on the executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fleetlens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # Spark's file server reads it as long as the context lives
    folder = Path(tempfile.mkdtemp(prefix="fleetlens-code-")).resolve()
    path = folder / f"fleetlens-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._fleetlens_shipped = True
