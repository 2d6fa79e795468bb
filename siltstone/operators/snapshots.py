"""Tables on plain files that change by whole versions: any writer may die at any point, readers never see half a version.

A version is one pointer file, written whole under another name and then given its number by a single step that fails if
the number is taken: a rename without overwriting where the file system has that (HDFS and its like), a hard link on a local
one. Until that step nothing that a reader or another writer looks at has changed, so a writer that dies leaves no
more than directories and drafts that no pointer names; ``sweep`` deletes them. A commit names the version that it
builds on and is refused if that isn't the last one any more.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Files:
    """The few operations of Hadoop's file systems that the stores need."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.at(path).getFileSystem(self.conf)
        self.none = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> dict[str, float]:
        """Names in a folder, with the seconds at which each was last changed; none if it isn't there."""
        if not self.system.exists(self.at(path)):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.system.listStatus(self.at(path))}

    def read(self, path: str) -> str:
        stream = self.system.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        out = self.system.create(self.at(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, draft: str, path: str) -> bool:
        """Give a draft its name, unless that is taken: one step, which happens whole or not at all."""
        self.system.mkdirs(self.at(path).getParent())
        try:
            if self.system.getUri().getScheme() == "file":
                local = lambda p: self.jvm.java.io.File(self.at(p).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(path), local(draft))
            else:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf).rename(self.at(draft), self.at(path), self.none)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self.system.delete(self.at(path), True)


class VersionedStore:
    """Tables as directories of their own and numbered pointers that say which directory each has; a commit is one new pointer.

    A commit of several tables shows all of them or none; tables that it doesn't name stay as they are. A commit that takes
    longer than ``lease`` seconds gives up, so that ``sweep`` may delete what is older than twice that.
    """

    def __init__(self, spark: SparkSession, path: str, lease: float = 86_400.0):
        self.spark, self.path, self.lease = spark, path.rstrip("/"), lease
        self.files = Files(spark, self.path)

    def version(self) -> int:
        """The last committed version; 0 if there's none."""
        return max((int(n) for n in self.files.names(f"{self.path}/pointers") if n.isdigit()), default=0)

    def entries(self, version: int | None = None) -> dict[str, str]:
        """Directory by table."""
        version = self.version() if version is None else version
        return json.loads(self.files.read(f"{self.path}/pointers/{version}")) if version else {}

    def read(self, version: int | None = None, name: str = "data") -> DataFrame | None:
        """A table as of a version; None if there's none."""
        found = self.entries(version).get(name)
        return self.spark.read.parquet(f"{self.path}/{found}") if found else None

    def commit(self, df: DataFrame, base: int, name: str = "data") -> bool:
        """Write df as the version after base; False if that exists by now. Any other failure is raised."""
        return self.commit_all({name: df}, base)

    def commit_all(self, tables: dict[str, DataFrame], base: int) -> bool:
        """Write these tables as one version after base."""
        began = time.time()
        if self.version() != base:
            return False
        fresh = {}
        for name, df in tables.items():
            fresh[name] = f"data-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{fresh[name]}")
        return self._show(fresh, base, began)

    def _show(self, fresh: dict[str, str], base: int, began: float, folders: Iterable[str] = ()) -> bool:
        folders = set(folders) or set(fresh.values())
        late = time.time() - began > self.lease
        if not late and self._claim(base + 1, {**self.entries(base), **fresh}):
            return True
        for folder in folders:
            self.files.delete(f"{self.path}/{folder}")
        if late:
            raise TimeoutError(f"a commit took longer than its lease of {self.lease} seconds")
        return False

    def _claim(self, version: int, entries: dict[str, str]) -> bool:
        """Show a version; False if another commit has it."""
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        self.files.write(draft, json.dumps(entries, sort_keys=True))
        won = self.files.publish(draft, f"{self.path}/pointers/{version}")
        self.files.delete(draft)
        return won

    def expire(self, keep: int) -> list[int]:
        """Forget all versions but the last keep (one at least); their directories go with the next sweep."""
        old = sorted(int(n) for n in self.files.names(f"{self.path}/pointers") if n.isdigit())[: -max(keep, 1)]
        for version in old:
            self.files.delete(f"{self.path}/pointers/{version}")
        return old

    def sweep(self, now: float | None = None) -> list[str]:
        """Delete what no pointer names and no live writer can still be at; what was deleted."""
        now = time.time() if now is None else now
        before = now - 2 * self.lease
        old = [n for n, at in self.files.names(self.path).items() if n.startswith("data-") and at <= before]
        drafts = [f"drafts/{n}" for n, at in self.files.names(f"{self.path}/drafts").items() if at <= before]
        # Pointers are read after the listing: what they name by now stays.
        named = {d.split("/")[0] for n in self.files.names(f"{self.path}/pointers") if n.isdigit() for d in self.entries(int(n)).values()}
        gone = sorted({*old} - named) + sorted(drafts)
        for name in gone:
            self.files.delete(f"{self.path}/{name}")
        return gone


class KeyedStore(VersionedStore):
    """A table of one row a key, dealt by a hash of the key to buckets; a bucket is one file, sorted by key, with Bloom filters.

    A lookup reads the buckets of the keys asked for, and in them the row groups that may hold these; a write rewrites the
    buckets that its keys fall in, and its pointer names the others' files as they are. The number of buckets is fixed when the
    store is made: choose it so that a bucket is as large as a task may read.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], schema: StructType, buckets: int = 64, lease: float = 86_400.0):
        super().__init__(spark, path, lease)
        self.key, self.schema, self.buckets = key, schema, buckets

    def bucket(self, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*[v.cast(self.schema[c].dataType) for v, c in zip(values, self.key)]), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of these keys: at most all buckets, so few numbers."""
        return [r[0] for r in keys.select(self.bucket(*[F.col(c) for c in self.key])).distinct().collect()]

    def rows(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of these buckets, or of all."""
        entries = self.entries(version)
        paths = [f"{self.path}/{d}" for n, d in sorted(entries.items()) if buckets is None or int(n) in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def find(self, *values, version: int | None = None) -> DataFrame:
        """The row of one key, or none: one file."""
        at = self.spark.range(1).select(self.bucket(*[F.lit(v) for v in values])).first()[0]
        found = self.rows([at], version)
        for c, v in zip(self.key, values):
            found = found.filter(F.col(c) == F.lit(v))
        return found

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """keys with the stored row of each and found, from the buckets that they fall in."""
        held = self.rows(self.touched(keys), version).withColumn("_found", F.lit(True))
        return keys.join(held, [*self.key], "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")

    def merge(self, fresh: DataFrame, order: str, base: int | None = None) -> bool:
        """Write new rows over those of equal keys, the last by order of each; False if another commit came first."""

        def last(old: DataFrame) -> DataFrame:
            both = old.withColumn("_new", F.lit(0)).unionByName(fresh.select(*self.schema.names).withColumn("_new", F.lit(1)))
            return both.groupBy(*self.key).agg(F.max_by(F.struct(*self.schema.names), F.struct("_new", order)).alias("_row")).select("_row.*")

        return self._rewrite(fresh, last, base)

    def insert(self, fresh: DataFrame, base: int | None = None) -> bool:
        """Write the rows whose keys aren't there, the first by all values of each; the others stay. False if another commit came first."""

        def first(old: DataFrame) -> DataFrame:
            new = fresh.select(*self.schema.names).join(old.select(*self.key), [*self.key], "left_anti")
            one = new.groupBy(*self.key).agg(F.min(F.struct(*self.schema.names)).alias("_row")).select("_row.*")
            return old.unionByName(one)

        return self._rewrite(fresh, first, base)

    def _rewrite(self, fresh: DataFrame, change: Callable[[DataFrame], DataFrame], base: int | None) -> bool:
        """Replace the buckets that fresh touches by what change makes of their rows."""
        began = time.time()
        base = self.version() if base is None else base
        if self.version() != base:
            return False
        touched = self.touched(fresh)
        if not touched:
            return True
        folder = f"data-{uuid.uuid4().hex}"
        changed = change(self.rows(touched, base)).withColumn("_bucket", self.bucket(*[F.col(c) for c in self.key]))
        writer = changed.repartition(len(touched), "_bucket").sortWithinPartitions("_bucket", *self.key).write.partitionBy("_bucket")
        for c in self.key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.path}/{folder}")
        return self._show({str(b): f"{folder}/_bucket={b}" for b in touched}, base, began, [folder])
