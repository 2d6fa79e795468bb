"""Keyed reads and writes: lookups, idempotent inserts, chains of revision-checked updates, caches. Stores on files are in ``snapshots``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.snapshots import KeyedStore, VersionedStore  # noqa: F401  both belong to this module's interface
from siltstone.sources.shipping import ship


def same(columns: tuple[str, ...], left: str = "s", right: str = "i") -> Column:
    """Whether two rows (by alias) agree; nulls agree."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def find(stored: DataFrame, key: str, value) -> DataFrame:
    """The row of one key, or none. The filter reaches the files, so only parts that may hold the key are read."""
    return stored.filter(F.col(key) == F.lit(value))


def lookup(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """keys with the stored row of each (null columns if there's none) and found. A key that is asked for twice is there twice."""
    held = stored.withColumn("_found", F.lit(True))
    return keys.join(held, key, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def get(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """lookup, with an error instead of a missing row."""
    return lookup(stored, keys, key).withColumn("error", F.when(~F.col("found"), "not_found"))


def in_turn(incoming: DataFrame, key: str, order: str | None) -> DataFrame:
    """incoming with _nth, a row's turn among those of its key: by order, ties and rows without an order by all values."""
    rest = [c for c in incoming.columns if c not in (key, order)]
    by = [order, *rest] if order else rest or [key]
    return incoming.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*by)))


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: str, values: tuple[str, ...], order: str | None = None) -> DataFrame:
    """key, outcome of every incoming row: inserted, unchanged (an equal row is there), or conflict (another one is).

    Rows of one key are taken in turn, so one new key is inserted once, and the rows after it meet what it inserted.
    """
    turns = in_turn(incoming, key, order)
    first = turns.filter("_nth = 1")
    held = turns.alias("i").join(stored.alias("s"), F.col(f"i.{key}") == F.col(f"s.{key}"), "left").join(first.alias("f"), F.col(f"i.{key}") == F.col(f"f.{key}"), "left")
    fresh = F.col(f"s.{key}").isNull()
    met = F.when(fresh, same(values, "f", "i")).otherwise(same(values))
    outcome = F.when(fresh & (F.coalesce(F.col("i._nth"), F.lit(1)) == 1), "inserted").when(met, "unchanged").otherwise("conflict")
    return held.select(F.col(f"i.{key}").alias(key), outcome.alias("outcome"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The store after idempotent inserts: what it had, and the first row of each key that it lacked, at revision 1."""
    fresh = in_turn(incoming, key, order).filter("_nth = 1").join(stored.select(key), key, "left_anti").withColumn("revision", F.lit(1))
    return stored.unionByName(fresh.select(stored.columns))


def canonical(values: tuple[str, ...], schema, alias: str) -> Column:
    """Text that is the same for two rows if and only if all values are: nulls agree, and so do 0.0 and -0.0, or two nans. Values take the types of schema."""

    def plain(c: str) -> Column:
        kind = schema[c].dataType
        held = F.col(f"{alias}.{c}").cast(kind)
        name = kind.typeName()
        return held + 0.0 if name in ("double", "float") else held.cast("string") if name.startswith("timestamp") else held

    return F.to_json(F.struct(*[plain(c).alias(f"c{k}") for k, c in enumerate(values)]), {"ignoreNullFields": "false"})


def decided(stored: DataFrame, incoming: DataFrame, key: str, values: tuple[str, ...], order: str | None = None) -> DataFrame:
    """key, _nth (the row's turn), outcome, revision (after it) of updates that expect a revision: an equal value keeps it, a new one raises it by one.

    Rows of one key are taken in turn and each meets the revision and value that those before it made, so updates may
    build on each other within a batch: (expects 1, b), (expects 2, c) both hold on a stored revision 1. An update that
    expects no revision (null) conflicts; one of a key that isn't stored is missing, whatever came before it.

    A key with one row is decided by built-in expressions. Rows of other keys are sorted by key and turn and folded as they
    stream by; a task holds a batch and the state of one key, however many rows that has.
    """
    turns = in_turn(incoming, key, order).withColumn("_of", F.count("*").over(W.partitionBy(key)))
    held = turns.alias("i").join(stored.alias("s"), F.col(f"i.{key}") == F.col(f"s.{key}"), "left")
    there, meets = F.col(f"s.{key}").isNotNull(), F.coalesce(F.col("s.revision") == F.col("i.expected_revision"), F.lit(False))
    kind = stored.schema["revision"].dataType
    outcome = F.when(~there, "missing").when(~meets, "revision_conflict").when(same(values), "unchanged").otherwise("updated")
    once = held.filter(F.col("i._of") == 1).select(F.col(f"i.{key}").alias(key), F.col("i._nth").alias("_nth"), outcome.alias("outcome"), (F.col("s.revision") + F.when(outcome == "updated", 1).otherwise(0)).cast(kind).alias("revision"))
    several = held.filter(F.coalesce(F.col("i._of") > 1, F.lit(True))).select(
        F.col(f"i.{key}").alias("key"), F.col("i._nth").alias("nth"), F.col("i.expected_revision").cast("long").alias("expects"), canonical(values, stored.schema, "i").alias("new"),
        there.alias("there"), F.col("s.revision").cast("long").alias("revision"), canonical(values, stored.schema, "s").alias("old"),
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, revision, value = object(), None, None
        for batch in batches:
            keys, turns, expects, new, there, stored_revision, old = (c.to_pylist() for c in batch.columns)
            outcomes, revisions = [], []
            for i, k in enumerate(keys):
                if turns[i] == 1 or k != last:
                    last, revision, value = k, stored_revision[i], old[i]
                if not there[i]:
                    outcomes.append("missing")
                elif expects[i] is None or expects[i] != revision:
                    outcomes.append("revision_conflict")
                elif new[i] == value:
                    outcomes.append("unchanged")
                else:
                    outcomes.append("updated")
                    revision, value = revision + 1, new[i]
                revisions.append(revision)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(outcomes, pa.string()), pa.array(revisions, pa.int64())], names=["key", "nth", "outcome", "revision"])

    ship(stored.sparkSession)
    dealt = several.repartition("key").sortWithinPartitions("key", "nth")
    name = incoming.schema[key].dataType.simpleString()
    folded = dealt.mapInArrow(fold, f"key {name}, nth int, outcome string, revision long").select(F.col("key").alias(key), F.col("nth").alias("_nth"), "outcome", F.col("revision").cast(kind).alias("revision"))
    return once.unionByName(folded)


def update(stored: DataFrame, incoming: DataFrame, key: str, values: tuple[str, ...], order: str | None = None) -> DataFrame:
    """key, outcome, revision (after the row's turn) of every update; see ``decided``."""
    return decided(stored, incoming, key, values, order).select(key, "outcome", "revision")


def updated(stored: DataFrame, incoming: DataFrame, key: str, values: tuple[str, ...], order: str | None = None) -> DataFrame:
    """The store after all updates: each row with the values of its last update that held, and its revision."""
    last = decided(stored, incoming, key, values, order).filter("outcome = 'updated'").groupBy(key).agg(F.max_by(F.struct("_nth", "revision"), "_nth").alias("_last"))
    last = last.select(key, F.col("_last._nth").alias("_nth"), F.col("_last.revision").alias("_revision"))
    fresh = in_turn(incoming, key, order).join(last, [key, "_nth"]).select(F.col(key), "_revision", F.struct(*values).alias("_fresh"))
    held = stored.join(fresh, key, "left")
    now = lambda c: F.when(F.col("_revision").isNotNull(), F.col("_revision" if c == "revision" else f"_fresh.{c}").cast(stored.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return held.select(*[now(c) if c in (*values, "revision") else F.col(c) for c in stored.columns])


def cache_write(cache: DataFrame, fresh: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The cache after new entries: the last by order of each key. An entry of the cache itself comes before any new one."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.select(cache.columns).withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*cache.columns), F.struct("_new", order))
    return both.groupBy(*keys).agg(last.alias("_row")).select("_row.*")


def cache_stats(cache: DataFrame) -> DataFrame:
    """stage, entries."""
    return cache.groupBy("stage").agg(F.count("*").alias("entries"))
