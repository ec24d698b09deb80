"""Session settings shared by tests, bench and queries."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("roomscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; a temporary one only where none is named (local tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="roomscope-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later stages survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, where each later use reads only the columns it needs. It stays as long as that folder's other files."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once, through the driver's file server; they need no path of their own."""
    sc, folder = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_roomscope_shipped", False) or not folder.is_dir():
        return
    made = Path(tempfile.mkdtemp(prefix="roomscope-")) / "roomscope.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(folder.rglob("*.py")):
            z.write(f, f.relative_to(folder.parent))
    sc.addPyFile(str(made))
    sc._roomscope_shipped = True
