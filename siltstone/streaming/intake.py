"""Streams (an addition; the batch forms are authoritative): intake without duplicates, sessions, status checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.sources.shipping import ship
from siltstone.operators.orchestration import TRANSITIONS


def read(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive under path, or of the one file that path is."""
    held = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return held.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return held.parquet(path)


def first_seen(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows whose key hasn't come within the watermark: a recording that is sent twice is taken once."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, events of each session that ended by the watermark."""
    held = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events"))
    return held.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def illegal_changes(stream: DataFrame) -> DataFrame:
    """call_id, old, new of status changes that aren't legal, by the order of ts within each trigger. State: the last status."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        bad = []
        for new in rows["status"]:
            if old is not None and new != old and new not in TRANSITIONS.get(old, ()):
                bad.append((key[0], old, new))
            old = new
        state.update((old,))
        yield pd.DataFrame(bad, columns=["call_id", "old", "new"])

    ship(stream.sparkSession)
    return stream.groupBy("call_id").applyInPandasWithState(step, "call_id long, old string, new string", "status string", "append", "NoTimeout")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run what is there through the stream and stop: exactly once, by the checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def settings(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    """Settings for the streams that start meanwhile, which keep those they start with; after that the session has its own again."""
    old = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch(spark: SparkSession) -> str:
    """A path of its own in the folder that driver and executors share; a temporary one only where that is unset and they're one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='siltstone-')).rstrip('/')}/streams/{uuid.uuid4().hex}"


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives for what is there, as a table."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    write(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
