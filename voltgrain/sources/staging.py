"""Folders for what a job writes to read again."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own() -> str:
    path = tempfile.mkdtemp(prefix="voltgrain-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. Where that is unset, below a folder of our own
    if all runs on this machine; on a cluster that would lose data, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own()
    return f"{base.rstrip('/')}/staging/{name}-{uuid.uuid4().hex}"
