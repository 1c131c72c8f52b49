"""Shared plumbing of the training-data operators: scratch tables, ids and text access."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bounds what a Python worker gets at once: texts are large rows. Smaller settings stay as they are."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Caches of Python workers by step. Workers outlive a step and would hold them, idle, through all later ones.
CACHES: dict[str, dict] = {}


def release(*own: str) -> None:
    """Empties the caches of other steps than `own` and hands free memory back to the system."""
    import ctypes

    import pyarrow as pa

    for name, cache in CACHES.items():
        if name not in own:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run, *own: str):
    """`run`, over the batches of a partition, which leaves no memory of this or other steps behind but `own` caches."""

    def outer(batches):
        release(*own)
        yield from run(batches)
        release(*own)

    return outer


#: Least seconds between two sweeps.
SWEEP = 4.0
_SWEPT = [0.0]


def sweep(spark: SparkSession, every: float = SWEEP) -> None:
    """Collects the driver's garbage: only then are shuffle files, broadcasts and records of cut lineage given back."""
    if time.monotonic() - _SWEPT[0] >= every:
        gc.collect()
        release(*CACHES)
        spark.sparkContext._jvm.System.gc()
        _SWEPT[0] = time.monotonic()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share. A session without spark.checkpoint.dir gets a local one, for tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/gaugeworks-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        sweep(self.spark)
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table that no later result reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def whole(text_col: str):
    """A text, with null as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def row_keys(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with two hash columns over whole rows, and their names: rows that agree in them (128 bits) are repeats of one row."""
    names = [n + "_" * max(map(len, df.columns)) for n in ("_ka", "_kb")]  # names that no column has
    cols = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    return df.withColumns({n: F.xxhash64(F.lit(k), nulls, *cols) for k, n in enumerate(names)}), names


def without_rows(df: DataFrame, keys: list[str], lost: DataFrame, again: DataFrame) -> DataFrame:
    """df, which has row_keys `keys`, without the rows of `lost` and with one row for each key of `again`; both are written tables of keys."""
    # Always by sort-merge: the plan is the same at every size, and its hot side can be split.
    drop = lambda some, how: df.join(some.withColumnsRenamed({k: k + "r" for k in keys}).hint("merge"), [df[k] == F.col(k + "r") for k in keys], how)
    out = drop(lost, "left_anti")
    if not again.isEmpty():
        out = drop(lost.unionByName(again), "left_anti").unionByName(drop(again, "left_semi").dropDuplicates(keys))
    return out.drop(*keys)
