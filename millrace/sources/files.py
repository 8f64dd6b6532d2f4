"""Small files of the driver on any storage: plain paths locally, URIs by Hadoop's file systems."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def is_uri(path: str | Path) -> bool:
    return "://" in str(path) or str(path).startswith("file:")


def joined(folder: str | Path, name: str) -> str:
    """A path below a folder; the slashes of a URI stay as they are."""
    return f"{str(folder).rstrip('/')}/{name}" if is_uri(folder) else str(Path(folder) / name)


def _hadoop(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{path} needs a session")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(path: str | Path) -> str:
    if not is_uri(path):
        return Path(path).read_text(encoding="utf-8")
    jvm, at, system = _hadoop(str(path))
    if not system.exists(at):
        raise FileNotFoundError(path)
    stream = system.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(text: str, path: str | Path) -> None:
    """Writes beside the place and moves, so that a file is whole or not there."""
    if is_uri(path):
        jvm, at, system = _hadoop(str(path))
        beside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{os.getpid()}.tmp")
        stream = system.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if system.exists(at):
            system.delete(at, False)
        if not system.rename(beside, at):
            raise OSError(f"{path} could not be written")
        return
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{os.getpid()}.tmp")
    try:
        beside.write_bytes(text.encode())
        os.replace(beside, path)
    finally:
        beside.unlink(missing_ok=True)
