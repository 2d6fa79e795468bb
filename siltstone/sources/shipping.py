"""This package on the executors, however the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Settings whose defaults let a batch of long texts fill a task's memory, and what replaces these defaults.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608"),
}

#: Settings whose defaults measure a task's share by its compressed bytes, which rows of numbers outgrow thirtyfold in memory, and what replaces these defaults.
SHARES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "8388608"),
    "spark.sql.files.maxPartitionBytes": ("134217728b", "33554432"),
}


def replaced(spark: SparkSession, settings: dict[str, tuple[str, str]]) -> None:
    """Replace these settings' defaults. A setting that the session has made itself stays."""
    for key, (default, ours) in settings.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def share(spark: SparkSession) -> None:
    """Bound what a task reads of files and shuffles; needed by what holds a row a key in memory."""
    replaced(spark, SHARES)


def ship(spark: SparkSession) -> None:
    """Send the package's code with the session's tasks, once for each context, and bound the batches they get.

    Needed by what runs Python on executors. A setting that the session has made itself stays.
    """
    replaced(spark, BATCHES)
    context = spark.sparkContext
    if getattr(context, "_siltstone_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone.zip"
    with zipfile.ZipFile(path, "w") as held:
        for file in sorted(root.rglob("*.py")):
            held.write(file, f"siltstone/{file.relative_to(root)}")
    context.addPyFile(str(path))  # served to executors by the driver
    context._siltstone_shipped = True
