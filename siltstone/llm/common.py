"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every word-counting operator here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; a temporary one only where that is unset.

    Without the setting only a session whose executors live in the driver may go on: on a cluster they'd not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses. It lies in the application's own folder, which goes when Python ends."""
    own = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}"
    if own not in _FOLDERS:
        _FOLDERS.add(own)
        atexit.register(_leave, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def _leave(spark: SparkSession, path: str) -> None:
    """Delete the application's folder, if its session still runs."""
    if spark.sparkContext._jsc is not None:
        drop_path(spark, path)


def narrow(df: DataFrame) -> DataFrame:
    """df in an eighth of the shuffle partitions, sixteen at least: for rows of a few dozen bytes, whose files would be tiny."""
    return df.coalesce(max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again. Lost executors lose nothing of it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() returned, once all that is made of them is written itself."""
    for df in tables:
        drop_path(df.sparkSession, df._siltstone_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def words_of(text: str | Column) -> Column:
    """Words of a text, as an array; null text has none."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: str | Column) -> Column:
    """Number of words of a text; null text has none."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document's label may not be learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, marked: DataFrame, sample: int, chars: int) -> list[tuple[int, str]]:
    """(label, text) of up to sample documents of labels 0 and 1 each, of 1 to chars characters, by a hash of the id.

    marked: doc_id, label; a row per id. The documents are read once for both labels.
    """
    order = F.xxhash64("doc_id")
    ids = reduce(DataFrame.unionByName, [marked.filter(F.col("label") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, chars))
    held = texts.join(F.broadcast(ids), "doc_id")  # at most 2 * sample ids
    place = F.row_number().over(W.partitionBy("label").orderBy(order, "doc_id", "text"))
    held = held.withColumn("place", place).filter(F.col("place") <= sample)
    return [tuple(r) for r in held.orderBy("label", "place").select("label", "text").collect()]
