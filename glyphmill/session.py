"""Sessions, the folder that a session's machines share, and how Python workers come by this package."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", app: str = "glyphmill", **conf: str) -> SparkSession:
    """A local session as tests and the benchmark use it; on a cluster the caller brings the session."""
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with the package sent to its workers unless they already find it on their path."""
    context = spark.sparkContext
    found = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if os.path.realpath(ROOT.parent) in found or getattr(context, "_glyphmill_sent", False):
        return spark
    where = Path(context._temp_dir) / f"{ROOT.name}.zip"  # the driver's; Spark sends it on
    with zipfile.ZipFile(where, "w") as bundle:
        for path in sorted(ROOT.rglob("*.py")):
            bundle.write(path, path.relative_to(ROOT.parent))
        for path in sorted(ROOT.parent.glob("corpus_pipeline.py")):
            bundle.write(path, path.name)
    context.addPyFile(str(where))
    context._glyphmill_sent = True
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder of spark.checkpoint.dir; only where that is unset (a local test) a folder of our own."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(where)
    return where


class Folder:
    """A folder of tables in the shared folder, for what one query writes and reads again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The rows as a table that is read from here on; its schema is known, so reading it costs no job."""
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def remove(self, *names: str) -> None:
        """Deletes these tables, or the whole folder where none is named."""
        context = self.spark.sparkContext
        for name in names or ("",):
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def freed(self) -> None:
        """Lets Spark's cleaner drop the shuffle files of finished steps, which it does once the driver has collected its garbage.
        Python's goes first: its DataFrames lie in cycles and keep the JVM's, with their plans and shuffles."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
