"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from profitloom import storage

_shipped: set[str] = set()
#: Size of the Arrow batches between the JVM and tasks in Python, where the session keeps Spark's default.
ARROW_BYTES = 8 << 20
_ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python once an application, so that tasks can import it.

    Batches of texts are kept small on the way there, however long the texts are.
    """
    if _ARROW_KEY not in spark.conf.getAll:
        spark.conf.set(_ARROW_KEY, str(ARROW_BYTES))
    app = spark.conf.get("spark.app.id")
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="profitloom-code-"), f"profitloom-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in package.rglob("*.py"):
            bundle.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def stored(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts lineage, survives lost executors."""
    folder = storage.new_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def batches(source: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes; one longer row is a batch of its own."""
    for batch in source:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            while part.num_rows > 1 and part.nbytes > 2 * limit:
                half = part.num_rows // 2
                yield part.slice(0, half)
                part = part.slice(half)
            yield part
        batch = part = None
    # The worker lives on between tasks; what Arrow holds back goes to the system.
    pa.default_memory_pool().release_unused()


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )
