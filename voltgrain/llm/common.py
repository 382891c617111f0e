"""What the operators of this subpackage share: tables, the shared folder, packed arrays."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space. bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="voltgrain-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, which goes
    when Python ends, if all runs on this machine; on a cluster that would lose data, so it is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def unused(name: str, *tables: DataFrame) -> str:
    """name, made longer until none of the tables has such a column (Spark ignores case)."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voltgrain/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts the lineage and outlives any executor."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """written(), and the table's path, for dropped()."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of new_path() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidied(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of jobs whose results are written: it does when the driver's garbage is collected, which a
    job of many steps may not live to see, while its disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def text_bytes(col: str | Column) -> Column:
    """A text in UTF-8; null gives none."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("binary"), F.lit(b""))


def n_blocks(docs: DataFrame, text_col: str, block_bytes: int) -> int:
    """How many blocks of about block_bytes of text the table makes."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def release() -> None:
    """Give free memory back to the system: a Python worker lives on after its task and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): spreads integers over the whole range."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
