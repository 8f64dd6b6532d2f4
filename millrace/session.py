"""Sessions, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: JSON objects may name a key twice; the last value counts.
VARIANT = ("spark.sql.variant.allowDuplicateKeys", "true")


def session(name: str = "millrace", **conf: str) -> SparkSession:
    """A session with what the operators rely on; sizes and the master stay the cluster's business."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config(*VARIANT)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """spark, with the runtime settings that JSON ingest needs."""
    spark.conf.set(*VARIANT)
    return spark


def checkpoint_root(spark: SparkSession) -> None:
    """Sets the checkpoint folder that the session names, if none is set yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            own = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            folder = f"file://{own}"
        sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder of the cluster."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for files in the shared folder, which are removed when the driver ends."""
    sc = spark.sparkContext
    checkpoint_root(spark)
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/millrace-{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone by then
            pass

    atexit.register(remove)
    return path


def sealed(df: DataFrame) -> DataFrame:
    """df behind a filter that lets all pass and that nothing can be moved across. Without it the
    optimizer merges what follows with long expressions below, which would then stand there several
    times over; planning takes minutes, and so might the query."""
    return df.withColumn("_sealed", F.rand(0)).where("_sealed >= 0").drop("_sealed")


def shipped(spark: SparkSession) -> SparkSession:
    """spark, whose executors can import this package wherever the driver was started."""
    sc = spark.sparkContext
    if not getattr(sc, "_millrace_shipped", False):
        import os
        import zipfile

        here = os.path.dirname(os.path.abspath(__file__))
        held = tempfile.mkdtemp(prefix="millrace-code-")
        atexit.register(shutil.rmtree, held, ignore_errors=True)
        with zipfile.ZipFile(f"{held}/millrace_code.zip", "w") as out:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("millrace", os.path.relpath(path, here)))
        sc.addPyFile(f"{held}/millrace_code.zip")
        sc._millrace_shipped = True
    return spark
