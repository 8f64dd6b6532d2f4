"""What the operators share: scratch space, document keys and Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text that one call of a numpy kernel takes on; a longer document is taken whole.
SLICE_BYTES = 1 << 20
#: A list of at most so many rows may be broadcast.
BROADCAST_ROWS = 1_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where the session names none and driver
    and executors are one machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if root is None and held.isDefined():
        root = held.get()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
    if held.isEmpty():
        sc.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage is cut."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/millrace-tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may be gone by then
        pass


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A long that names a row: its id, or for a null id a hash of its text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.lit("no id"), F.col(text)))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive parts of batch with at most `limit` bytes of text each, or one row."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < n:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
