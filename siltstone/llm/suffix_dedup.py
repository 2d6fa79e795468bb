"""Exact substring deduplication by suffix arrays: every byte covered by a long string that also starts earlier goes.

A string is ``length`` bytes; it starts earlier in a smaller doc_id or, in the same document, at an earlier byte. To
spread the strings of a corpus over many suffix arrays, each string is dealt by its anchor: of the ``ANCHOR``-byte
substrings in it, the one with the smallest hash (the leftmost of equals). Equal strings have equal anchors, so they
meet. Neighbouring strings mostly share their anchor; such a run of strings is one stretch of text, at most
``2 * length - ANCHOR`` bytes long.

1. Each task lists the stretches of its documents: the anchor's hash, a digest of the whole stretch, its place.
   Stretches equal within a batch of rows are collapsed at once: all but the first repeat it wholly. What's left is
   packed by anchor and shuffled, without texts.
2. Stretches with equal digests are collapsed in the same way. A string that two different stretches share has at
   least half of its bytes beside the anchor on one side; so a stretch is open if, with its anchor, it shares the hash
   of that many bytes to the left, or to the right, with another one. Any other is settled.
3. The texts of open stretches are fetched by document and dealt by anchor. There they are joined into texts whose
   suffix array is built by linear grouping (``suffix_array``); strings that are equal are neighbours in it, and all
   but the first of them repeat.
4. Repeated stretches and strings meet their document, are merged into runs, and are removed.

An anchor may be hot (a passage in a third of all documents, with as many different surroundings). One with over
``hot`` different stretches isn't sent to one suffix array: its strings are counted one by one, by a 128-bit hash of
their bytes, which is pre-aggregated in each task and finds the same repeats. Anchors and documents are dealt to
buckets, each of about a thousandth of the corpus but between ``BUCKET_BYTES`` of text; a task
holds one bucket at a time, and the packed stretches of about ``TASK_BYTES`` of text.

Digests have 64 bits and are compared only between stretches whose anchors' hashes (64 bits) are equal.

Defined results: a null text counts as empty; a text shorter than ``length`` loses nothing; a text of any length is
processed whole; rows that repeat a doc_id are ordered by the MD5 of their texts, and equal rows are copies of which
one stays whole; rows with a null doc_id come after all others, whatever ids these have; an empty table gives no rows;
other columns of the input are ignored by ``find`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.shipping import ship
from siltstone.llm.common import cut
from siltstone.llm.suffix_array import suffix_array

LENGTH, ANCHOR = 100, 40
HOT = 1024
#: Least and most text of a bucket, and of what one task gets of them.
BUCKET_BYTES, TASK_BYTES = (2 << 20, 256 << 20), 64 << 20
#: Bytes of text handled at once, and bytes of stretches in one suffix array.
SLICE, ARRAY_BYTES = 1 << 17, 1 << 16
#: Bytes of text whose stretches are collapsed and packed together.
LISTED_BYTES = 6 << 20
#: Strings of a stretch that its packed count can hold.
MOST_STRINGS = (1 << 16) - 1
PACKED = "bucket int, kind int, data binary"
#: Kinds of packed rows: stretches by anchor; runs of repeated bytes, open stretches and strings of hot anchors, by document.
STRETCH, RUN, OPEN, STRING = 0, 1, 2, 3

FIELDS = {
    STRETCH: (("key", "<u8"), ("digest", "<u8"), ("left", "<u4"), ("right", "<u4"), ("doc", "<i8"), ("at", "<i4"), ("count", "<u2")),
    RUN: (("doc", "<i8"), ("at", "<i4"), ("end", "<i4")),
    OPEN: (("doc", "<i8"), ("at", "<i4"), ("count", "<u2"), ("hot", "u1"), ("key", "<u8")),
    STRING: (("hash", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("at", "<i4")),
}


def pack(kind: int, columns: dict[str, np.ndarray]) -> bytes:
    """Columns as one compressed block: plane by plane, so that bytes that hardly vary lie together."""
    parts = [np.ascontiguousarray(columns[name].astype(t)).view(np.uint8).reshape(len(columns[name]), -1).T.tobytes() for name, t in FIELDS[kind]]
    n = len(columns[FIELDS[kind][0][0]])
    return n.to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(kind: int, blocks: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of several blocks."""
    held: dict[str, list[np.ndarray]] = {name: [np.zeros(0, t)] for name, t in FIELDS[kind]}
    for block in blocks:
        n, raw, at = int.from_bytes(block[:4], "little"), np.frombuffer(zstandard.ZstdDecompressor().decompress(block[4:]), np.uint8), 0
        for name, t in FIELDS[kind]:
            width = np.dtype(t).itemsize
            held[name].append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(t))
            at += n * width
    return {name: np.concatenate(x) for name, x in held.items()}


def unzipped(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def dealt(kind: int, columns: dict[str, np.ndarray], by: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, block) by bucket number."""
    if not len(by):
        return
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    for part in np.split(order, cuts):
        yield int(by[part[0]]), kind, pack(kind, {k: v[part] for k, v in columns.items()})


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "kind", "data"])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(33))


def doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
    return up, down


class Rolling:
    """Hashes of any ranges of a text, by prefix sums of a polynomial modulo 2^64 over scrambled bytes."""

    def __init__(self, text: np.ndarray, base: int):
        self.up, self.down = _powers(base, max(SLICE + 4 * LENGTH, 1 << len(text).bit_length()))
        scrambled = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))[text]
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(scrambled * self.up[: len(text)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def stretches(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of documents text[starts:ends]: key, digest, left, right, document number, first string's first byte, number of strings.

    left and right: hashes of the anchor with half of a string's other bytes before or after it; 0 if no string has them.
    """
    n, width = len(text), length - anchor + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none, none
    first = Rolling(text, BASES[0])
    at = np.arange(n - anchor + 1)
    hashed = first.of(at, at + anchor)
    least = (hashed & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:  # the least of 2, 4, 8, ... in a row
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchors = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by string
    counts = np.maximum(ends - starts - length + 1, 0)
    total = int(counts.sum())
    if not total:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none, none
    doc = np.repeat(np.arange(len(starts)), counts)
    string = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    anchors = anchors[string]
    new = np.ones(total, bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, total))
    a = string[begin]
    digest = Rolling(text, BASES[1]).of(a, a + count + (length - 1))
    p, half = anchors[begin], -(-(length - anchor) // 2)
    before, behind = a <= p - half, a + count + (length - 1) >= p + anchor + half
    left, right = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
    left[before] = first.of(p[before] - half, p[before] + anchor) >> np.uint64(32) | np.uint64(1)
    right[behind] = first.of(p[behind], p[behind] + anchor + half) >> np.uint64(32) | np.uint64(1)
    return hashed[p], digest, left, right, doc[begin], a, count


def merged(doc: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [at, end) of documents, with those that overlap or touch made one."""
    if not len(doc):
        return doc, at, end
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order].astype(np.int64), end[order].astype(np.int64)
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    base = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * base) - number * base  # within a document, as its numbers lie above all before
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], at[first], reach[last]


def _later(columns: dict[str, np.ndarray], keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order by keys, document and place; which of the ordered rows follow one with equal keys."""
    order = np.lexsort((columns["at"], columns["doc"], *(columns[k] for k in reversed(keys))))
    after = np.zeros(len(order), bool)
    if len(order):
        after[1:] = np.logical_and.reduce([columns[k][order][1:] == columns[k][order][:-1] for k in keys])
    return order, after


def _times(x: np.ndarray) -> np.ndarray:
    """How often each value occurs."""
    if not len(x):
        return np.zeros(0, np.int64)
    _, number, many = np.unique(x, return_inverse=True, return_counts=True)
    return many[number]


def _listing(length: int, anchor: int, anchors: int, buckets: int):
    """Step 1."""

    def emitted(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, digest, left, right, doc, at, count = (np.concatenate(x) for x in zip(*parts))
        columns = {"key": key, "digest": digest, "left": left, "right": right, "doc": doc, "at": at, "count": count}
        order, after = _later(columns, ("key", "digest"))
        again, first = order[after], order[~after]
        rows = list(dealt(STRETCH, {k: v[first] for k, v in columns.items()}, (key[first] % np.uint64(anchors)).astype(np.int32)))
        d, s, e = merged(doc[again], at[again], at[again] + count[again] + (length - 1))
        rows += dealt(RUN, {"doc": d, "at": s, "end": e}, doc_bucket(d, buckets))
        return batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[int, int, bytes]] = []
        size = listed = 0

        def flush() -> None:
            nonlocal size, listed
            if held:
                text = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
                ends = np.cumsum([len(b) for _, _, b in held])
                starts = ends - [len(b) for _, _, b in held]
                key, digest, left, right, doc, a, count = stretches(text, starts, ends, length, anchor)
                offset = np.array([o for _, o, _ in held]) - starts
                parts.append((key, digest, left.astype(np.uint32), right.astype(np.uint32), np.array([i for i, _, _ in held], np.int64)[doc], (a + offset[doc]).astype(np.int32), count.astype(np.int32)))
                listed += size
            held.clear()
            size = 0

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tolist()
            texts = batch.column(1)
            for i, doc in enumerate(ids):
                data = texts[i].as_py()
                for at in range(0, max(len(data) - length + 1, 0), SLICE):
                    piece = data[at : at + SLICE + length - 1]
                    if size + len(piece) > SLICE + length - 1:
                        flush()
                        if listed >= LISTED_BYTES:
                            yield emitted(parts)
                            parts.clear()
                            listed = 0
                    held.append((doc, at, piece))
                    size += len(piece)
        flush()
        if parts:
            yield emitted(parts)

    return run


def _settling(length: int, buckets: int, hot: int):
    """Step 2."""

    def settle(blocks: list[bytes]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Runs, and open stretches, of the anchors in one bucket."""
        columns = unpack(STRETCH, blocks)
        order, after = _later(columns, ("key", "digest"))
        again, first = order[after], order[~after]
        d, s, e = merged(columns["doc"][again], columns["at"][again], columns["at"][again] + columns["count"][again].astype(np.int64) + (length - 1))
        columns = {k: v[first] for k, v in columns.items()}
        open_ = np.zeros(len(first), bool)
        for side in ("left", "right"):
            beside = columns[side].astype(np.uint64)
            open_ |= (beside > 0) & (_times(mixed(columns["key"] + beside * np.uint64(0x9E3779B97F4A7C15))) > 1)
        columns = {k: columns[k][open_] for k in ("doc", "at", "count", "key")}
        columns["hot"] = _times(columns["key"]) > hot
        return {"doc": d, "at": s, "end": e}, columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            rows = []
            for bucket, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == STRETCH:
                    held.setdefault(bucket, []).append(data)
                else:
                    rows.append((bucket, kind, data))
            if rows:
                yield batch_of(rows)
        found = [settle(held.pop(bucket)) for bucket in sorted(held)]
        if not found:
            return
        rows = []
        for kind, parts in zip((RUN, OPEN), zip(*found)):
            columns = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            rows += dealt(kind, columns, doc_bucket(columns["doc"].astype(np.int64), buckets))
        if rows:
            yield batch_of(rows)

    return run


def _fetching(length: int, strings: int):
    """Step 3, by bucket of documents: open stretches' texts (kind 0), and strings of hot anchors, packed."""

    def run(docs: pa.Table, blocks: pa.Table) -> pa.Table:
        columns = unpack(OPEN, blocks.column("data").to_pylist())
        texts = {i: t for i, t in zip(docs.column("doc").to_pylist(), docs.column("data").to_pylist())} if len(columns["doc"]) else {}
        order = np.argsort(columns["doc"], kind="stable")
        out: list[tuple] = []
        strung: list[tuple] = []
        last, text = None, b""
        for doc, at, count, hot, key in zip(*(columns[k][order].tolist() for k in ("doc", "at", "count", "hot", "key"))):
            if doc != last:
                last, text = doc, unzipped(texts[doc])
            piece = text[at : at + count + length - 1]
            if not hot:
                out.append((0, key - (1 << 64) if key >> 63 else key, piece, doc, at))
                continue
            for i in range(count):
                h = hashlib.blake2b(piece[i : i + length], digest_size=16).digest()
                strung.append((int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little"), doc, at + i))
        if strung:
            held = {name: np.array(c, t) for (name, t), c in zip(FIELDS[STRING], zip(*strung))}
            out += [(STRING, bucket, data, 0, 0) for bucket, _, data in dealt(STRING, held, (held["hash"] % np.uint64(strings)).astype(np.int32))]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], names=["kind", "key", "text", "doc", "at"])

    return run


def repeated(pieces: list[tuple[bytes, int, int]], length: int) -> list[tuple[int, int, int]]:
    """(document, first byte, end) of strings that start earlier in another of the pieces (text, document, place)."""
    symbols: list[int] = []
    of: list[int] = []  # by place in the joined text: the piece whose string starts here, else -1
    for k, (text, _, _) in enumerate(pieces):
        symbols += [b + 2 for b in text]
        symbols.append(1)
        strings = len(text) - length + 1
        of += [k] * strings + [-1] * length
    begins, at = [], 0
    for text, _, _ in pieces:
        begins.append(at)
        at += len(text) + 1
    out = []
    last = b""
    held: list[tuple[int, int]] = []

    def close() -> None:
        if len(held) > 1:
            first = min(held)
            out.extend((d, s, s + length) for d, s in held if (d, s) != first)

    for i in suffix_array(symbols):
        k = of[i]
        if k < 0:
            continue
        text, doc, place = pieces[k]
        o = i - begins[k]
        string = text[o : o + length]
        if string != last:
            close()
            held.clear()
            last = string
        held.append((doc, place + o))
    close()
    return out


def _sorting(length: int, buckets: int):
    """Step 3, by anchor: suffix arrays over open stretches, and counts of hot anchors' strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key: dict[int, list[tuple[bytes, int, int]]] = {}
        strings: list[bytes] = []
        for batch in batches:
            for kind, key, text, doc, at in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == STRING:
                    strings.append(text)
                else:
                    by_key.setdefault(key, []).append((text, doc, at))
        found: list[tuple[int, int, int]] = []
        pieces: list[tuple[bytes, int, int]] = []
        size = 0
        for key in sorted(by_key):
            pieces += by_key[key]
            size += sum(len(x[0]) for x in by_key.pop(key))
            if size >= ARRAY_BYTES:
                found += repeated(pieces, length)
                pieces, size = [], 0
        found += repeated(pieces, length)
        doc, at, end = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        columns = unpack(STRING, strings)
        order, after = _later(columns, ("hash", "more"))
        again = order[after]
        doc, at = np.concatenate([doc, columns["doc"][again]]), np.concatenate([at, columns["at"][again]])
        end = np.concatenate([end, columns["at"][again].astype(np.int64) + length])
        d, s, e = merged(doc, at, end)
        rows = list(dealt(RUN, {"doc": d, "at": s, "end": e}, doc_bucket(d, buckets)))
        if rows:
            yield batch_of(rows)

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, doc, text: doc is a number of its own for each row, in the order of doc_id, nulls last.

    Distinct ids are their own numbers. Else rows are counted by id, text and input partition, and get consecutive
    numbers from running sums of these counts: by ranges of ids, then inside each range, without any text.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    once = held.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).isEmpty()
    if once:
        return held.withColumn("doc", F.col("doc_id"))
    held = cut(held.select("*", F.md5(F.col("text").cast("binary")).alias("key"), F.spark_partition_id().alias("part")), "rows")
    by = ("doc_id", "key", "part")
    order = [F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("part")]
    counts = held.groupBy(*by).agg(F.count("*").alias("n")).repartitionByRange(*order)
    counts = cut(counts.withColumn("range", F.spark_partition_id()), "counts")
    ranges = counts.groupBy("range").agg(F.sum("n").alias("total"))  # a row a partition
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", before("total", W.orderBy("range")).alias("begin"))
    base = counts.withColumn("inside", before("n", W.partitionBy("range").orderBy(*order))).join(ranges, "range")
    base = base.select(*[F.col(c).alias(f"_{c}") for c in by], (F.col("begin") + F.col("inside")).alias("base"))
    place = F.row_number().over(W.partitionBy(*by).orderBy("key")) - 1  # rows of a group are equal
    met = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part"))
    return cut(held.withColumn("place", place).join(base, met).select("doc_id", "text", (F.col("base") + F.col("place")).cast("long").alias("doc")), "numbered")


def runs(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, bucket_bytes: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(zipped documents by bucket, packed runs of repeated bytes by bucket, number of buckets). docs: see numbered()."""
    spark = docs.sparkSession
    ship(spark)
    if length - anchor + 1 > MOST_STRINGS:
        raise ValueError(f"a stretch holds {MOST_STRINGS} strings at most, so length - anchor can't exceed {MOST_STRINGS - 1}")
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    least, most = BUCKET_BYTES
    buckets = max(1, -(-total // (bucket_bytes or min(max(total // 1000, least), most))))
    wide = max(min(buckets, -(-total // TASK_BYTES)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    data = F.encode("text", "UTF-8")
    listed = docs.filter(F.octet_length("text") >= length).select("doc", data.alias("data")).mapInArrow(_listing(length, anchor, buckets, buckets), PACKED)
    settled = cut(listed.repartition(wide, "bucket", "kind").mapInArrow(_settling(length, buckets, hot), PACKED), "settled")

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            doc = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data = pa.array([tool.compress(x.as_py()) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc_bucket(doc, buckets), pa.int32()), batch.column(0), batch.column(1), data], names=["bucket", "doc_id", "doc", "data"])

    packed = docs.select("doc_id", "doc", data.alias("data")).mapInArrow(zipped, "bucket int, doc_id long, doc long, data binary")
    by_bucket = lambda df: df.groupBy("bucket")
    opened = by_bucket(packed.filter(F.col("bucket").isNotNull())).cogroup(by_bucket(settled.filter(F.col("kind") == OPEN))).applyInArrow(_fetching(length, buckets), "kind int, key long, text binary, doc long, at int")
    sorted_ = opened.repartition(wide, "kind", "key").mapInArrow(_sorting(length, buckets), PACKED)
    return packed, settled.filter(F.col("kind") == RUN).unionByName(cut(sorted_, "sorted")), buckets


def _cut_runs(found: dict[str, np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """Merged runs by document."""
    doc, at, end = merged(found["doc"], found["at"], found["end"])
    out: dict[int, list[tuple[int, int]]] = {}
    for d, s, e in zip(doc.tolist(), at.tolist(), end.tolist()):
        out.setdefault(d, []).append((s, e))
    return out


def _left(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in gone:
        parts.append(data[at:s])
        at = e
    parts.append(data[at:])
    return b"".join(parts)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def find(docs: DataFrame, **options) -> DataFrame:
    """RESULT, one row per document."""
    packed, gone, _ = runs(numbered(docs), **options)

    def report(own: pa.Table, blocks: pa.Table) -> pa.Table:
        held = _cut_runs(unpack(RUN, blocks.column("data").to_pylist()))
        rows = []
        for doc_id, doc, data in zip(*(own.column(c).to_pylist() for c in ("doc_id", "doc", "data"))):
            text, spans = unzipped(data), held.get(doc, [])
            rows.append((doc_id, len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_left(text, spans)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return packed.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(report, RESULT)


def remove(docs: DataFrame, **options) -> DataFrame:
    """The documents without the repeated bytes, and without documents of which nothing is left. Columns of docs.

    Characters that lose some of their bytes are dropped; n_chars, if there's such a column, is counted again.
    """
    names = docs.columns
    own = numbered(docs)
    packed, gone, _ = runs(own, **options)

    def rewrite(own: pa.Table, blocks: pa.Table) -> pa.Table:
        held = _cut_runs(unpack(RUN, blocks.column("data").to_pylist()))
        rows = []
        for doc_id, doc, data in zip(*(own.column(c).to_pylist() for c in ("doc_id", "doc", "data"))):
            text = unzipped(data)
            rows.append((doc_id, hashlib.sha256(text).hexdigest(), _left(text, held.get(doc, [])).decode("utf-8", "ignore"), doc in held))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["_id", "_hash", "_kept", "_cut"])

    shape = "_id long, _hash string, _kept string, _cut boolean"
    kept = packed.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(rewrite, shape)
    kept = kept.filter(~F.col("_cut") | (F.col("_kept") != ""))
    # Rows with one id and equal texts differ in their other columns at most; each keeps what its place among them left.
    place = lambda *by: F.row_number().over(W.partitionBy("_id", "_hash").orderBy(*by))
    # The input's columns stay in a struct, so that their names can't meet those used here.
    of = lambda c: F.col("_row").getField(c)
    rest = [of(c) for c in names if c not in ("doc_id", "text", "n_chars")]
    other = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("_hash"))
    other = other.withColumn("_place", place(F.to_json(F.struct(F.lit(0).alias("k"), *[c.alias(f"c{k}") for k, c in enumerate(rest)]))))
    kept = kept.withColumn("_place", place("_cut", "_kept")).withColumnRenamed("_id", "_id2").withColumnRenamed("_hash", "_hash2").withColumnRenamed("_place", "_place2")
    out = other.join(kept, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")) & (F.col("_place") == F.col("_place2")))
    columns = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return out.select(*[columns.get(c, of(c)).alias(c) for c in names])
