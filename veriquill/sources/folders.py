"""Folders that the driver and all executors share, and small files in them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a single machine may do without, with a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "veriquill")
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written under another name and then renamed, by whatever file system the path is on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    system = place.getFileSystem(conf)
    stream = system.create(part, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
        stream.hflush()
    finally:
        stream.close()
    if system.exists(place):
        system.delete(place, False)
    if not system.rename(part, place):
        raise OSError(f"cannot rename {part} to {path}")
