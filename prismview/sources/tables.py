"""Where the engine's tables live, and small files there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session whose tasks run on this machine may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-views-')}"


def state_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_base(spark)}/views-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _hadoop(spark, path)
    return fs.exists(place)


def dropped(spark: SparkSession, path: str) -> None:
    fs, place = _hadoop(spark, path)
    fs.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all: written beside its place and renamed."""
    fs, place = _hadoop(spark, path)
    _, beside = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"cannot rename to {path}")


def read_texts(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """The small files of a folder, by name."""
    fs, place = _hadoop(spark, folder)
    if not fs.exists(place):
        return []
    names = sorted(f.getPath().toString() for f in fs.listStatus(place) if f.getPath().getName().endswith(suffix))
    return ["\n".join(r[0] for r in spark.read.text(n).collect()) for n in names]
