"""The shared folder in which jobs put tables for other jobs to read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"
_local_root: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only for local sessions."""
    named = spark.conf.get(_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors can reach")
    app = spark.conf.get("spark.app.id")
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="profitloom-")
    return _local_root[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has written to; earlier results are never overwritten."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
