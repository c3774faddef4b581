"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the broadcast that spares wide rows a shuffle: 2^20 numbers at most, whatever the input.
SLOTS = 1 << 20


#: Folders made since the start, so that those of a finished step can be dropped.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/prismview-{uuid.uuid4().hex}"
    fs, folder = _place(spark, path)
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    _made.append(path)
    return path


def _place(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


@contextmanager
def scratch_dropped(spark: SparkSession):
    """Folders that are made inside are removed at its end; what is kept must have been written elsewhere by then."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            fs, folder = _place(spark, _made.pop())
            fs.delete(folder, True)


@contextmanager
def with_conf(spark: SparkSession, **values):
    """What runs inside has these settings, ``__`` standing for a dot."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str = "t", folder: str | None = None, batch_rows: int = 1000) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and lost executors cost no recomputation.

    Python gets ``batch_rows`` rows at most at once, as whole texts make rows large. The shuffle files go when the table is
    there, else they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}"
    with with_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=batch_rows, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict = {}


def held(kind: str, make):
    """What a Python worker remembers from task to task; only one operator's memory at a time."""
    if kind not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[kind] = make()
    return _held[kind]


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _slotted(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with its keys' slots, and the slots that some of ``keys`` fall in."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    return df.withColumn("_slot", slot), F.broadcast(keys.select(slot.alias("_slot")).distinct())


def in_slots(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``keys``, and others that share a slot with one; nothing is shuffled."""
    slotted, slots = _slotted(df, keys, key)
    return slotted.join(slots, "_slot", "left_semi").drop("_slot")


def rows_with(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``keys``. Most other rows go before the shuffle, by their slot."""
    return in_slots(df, keys, key).join(keys.select(key), key, "left_semi")


def rows_without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among ``keys``; only rows of their slots are shuffled."""
    slotted, slots = _slotted(df, keys, key)
    doubtful = slotted.join(slots, "_slot", "left_semi").join(keys.select(key), key, "left_anti")
    return slotted.join(slots, "_slot", "left_anti").unionByName(doubtful).drop("_slot")


def parted(df: DataFrame, key: str, by: str, crowded: DataFrame, parts: int) -> DataFrame:
    """``df`` with ``_part``: rows of ``crowded`` keys are dealt into ``parts`` parts by ``by``, also those that share a slot with one; others are part 0."""
    if parts <= 1:
        return df.withColumn("_part", F.lit(0))
    _, slots = _slotted(df, crowded, key)
    hot = df.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(SLOTS))).join(slots.withColumn("_hot", F.lit(True)), "_slot", "left")
    return hot.withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).otherwise(0)).drop("_slot", "_hot")


def split_join(many: DataFrame, one: DataFrame, key: str, by: str, crowded: DataFrame, most: int, rows: int) -> DataFrame:
    """Inner join of ``many`` with ``one`` (a row a key) in which no task meets more than about ``rows`` rows of a key.

    ``crowded``: keys with more rows than that, ``most``: rows of the largest. Their rows are dealt into
    parts by ``by``, and their row of ``one`` goes to each part; so do those that share a slot with them.
    """
    if most <= rows:
        return many.join(one, key)
    parts = -(-most // rows)
    _, slots = _slotted(many, crowded, key)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    one = one.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(SLOTS))).join(slots.withColumn("_hot", F.lit(True)), "_slot", "left").withColumn("_part", F.explode(every)).drop("_slot", "_hot")
    return parted(many, key, by, crowded, parts).join(one, [key, "_part"]).drop("_part")
