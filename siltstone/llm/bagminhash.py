"""Near-duplicate documents by BagMinHash signatures of word shingles, banded, and verified by multiset overlap.

A document is the multiset of its ``SHINGLE``-word shingles (lower-cased words between ASCII white space; a text of
fewer words is one shingle). Two documents are linked if the weighted Jaccard similarity of their multisets is at
least ``threshold``; classes are the connected components of links.

Signature: a shingle of weight w spans the discretised weights 1 to w. They're covered by a hierarchy of intervals,
(0, 1], (1, 2], (2, 4], (4, 8] and so on, each with a Poisson process of its own, seeded by shingle and interval, whose
rate is the interval's length in each of the signature's components. Points come in order of time until no component
can improve; a point of the topmost interval falls in the lower or upper half by a fair bit, again and again, and one
above w is dropped. The earliest point of each component is kept, so two signatures agree in a component with
probability equal to the weighted Jaccard similarity, and one costs about m log m points whatever a text's length.

Exact copies are collapsed before anything else is joined. Of what's left, documents that agree in a band of
``ROWS`` components are candidates, and every candidate pair is verified on the texts, however large its bucket. A
band's bucket of up to ``SMALL`` texts lists its pairs. A larger one is put in order of size and dealt into blocks of
at most ``BLOCK`` texts; two blocks whose sizes can hold a similar pair are a cell, and a cell counts its overlaps by
products of 0/1 matrices over the shingles it holds. A pair belongs to the first band that it agrees in, or to the list
of pairs if it meets in a small bucket, so it counts once. A cell returns each text's number of links and a spanning
forest of them, so what is written is linear in a bucket's size; the comparisons in a bucket are all its pairs that
sizes allow. Components are found by alternating large and small stars. Only banding can miss a link: at similarity s,
two documents agree in no band with probability (1 - s^ROWS)^BANDS, 3e-7 at the threshold.

Defined results: a null, empty or blank text is a class of its own, with its own doc_id; copies and repeated rows are
in one class; the class is named by its smallest doc_id; a class of null doc_ids alone has a null name; a text of any
length is read whole; an empty table gives no rows; other columns are ignored by ``classes`` and kept by ``keep``.
Classes are of texts: rows that repeat a doc_id with different texts may be in different classes, each of which keeps a
row. ``keep`` keeps the row of the smallest doc_id of each class (null ids come last; of one id's texts the one of the
smallest MD5; of rows equal in both the one whose other columns come first as JSON), and all rows without words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.shipping import ship
from siltstone.llm.common import WORD, cut, drop, drop_path, narrow, shared_path
from siltstone.llm.suffix_dedup import Rolling, mixed

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 21, 3
#: Texts of a bucket whose pairs are listed; texts of a block of a larger one, and shingles of a block (its last text may exceed them).
SMALL, BLOCK, BLOCK_SIZE = 16, 1000, 400_000
#: Shingles of a matrix; pairs a text up to which a cell compares them one by one.
STRIP, FEW = 4096, 4
SLICE = 1 << 17
SKETCH = "doc_id long, text_key binary, node binary, bands array<long>"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x8EBC6AF09C88C6E3
_MIX = np.array([0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xD6E8FEB86659FD93, 0xA3B195354A39B70D], np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, shingle hash and weight of every distinct shingle, by document."""
    text = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    solid = np.concatenate([[False], ~_SPACE[text], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none.view(np.uint64), none
    words = Rolling(text, _BASE).of(starts, ends)
    doc = np.searchsorted(begins, starts, side="right") - 1
    n = len(words)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    of = np.concatenate([doc, np.full(SHINGLE, -1)])
    code, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SHINGLE):
        own = of[k : k + n] == doc
        whole &= own
        code += np.where(own, padded[k : k + n], np.uint64(0)) * _MIX[k]
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    count = np.bincount(doc, minlength=len(texts))
    keep = whole | first & (count[doc] < SHINGLE)
    doc, code = doc[keep], mixed(code[keep])
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return doc[at], code[at], np.diff(np.append(at, len(doc)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740992.0


def signatures(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m: the earliest point of each component; rows of documents without shingles are 0."""
    out = np.zeros((n_docs, m), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo = np.flatnonzero(total > 0)
    slack = 3.0
    while len(todo):
        limit = np.zeros(n_docs)
        limit[todo] = (np.log(m) + slack) / total[todo]
        own = limit[doc] > 0
        keys, times, points = _points(doc[own], code[own], weight[own], limit, m)
        order = np.lexsort((times, keys))
        keys, points = keys[order], points[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        keys, points = keys[new], points[new]
        full = np.bincount(keys // m, minlength=n_docs) == m
        good = full[keys // m]
        out.reshape(-1)[keys[good]] = points[good]
        todo = todo[~full[todo]]
        slack *= 2.5
    return out


def _points(doc, code, weight, limit, m) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All points up to each document's limit of time: document * m + component, time, identity."""
    keys, times, points = [], [], []
    top = int(weight.max()).bit_length() + 1 if len(weight) else 0
    for level in range(top):
        low, high = (0, 1) if not level else (1 << (level - 1), 1 << level)
        on = weight > low
        if not on.any():
            break
        d, w = doc[on], weight[on]
        seed = mixed(code[on] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        rate = float(m * (high - low))
        t, k = np.zeros(len(d)), 0
        end = limit[d]
        while len(d):
            k += 1
            point = mixed(seed + np.uint64(k * 0xD1342543DE82EF95 % (1 << 64)))
            t = t - np.log(_uniform(point)) / rate
            early = t <= end
            d, w, seed, t, end, point = d[early], w[early], seed[early], t[early], end[early], point[early]
            where = mixed(point + np.uint64(1))
            component = (where >> np.uint64(32)) % np.uint64(m)
            # The interval's halves, quarters and so on by the low bits: the first bit is the upper or lower half.
            bits = level - 1 if level else 0
            inside = low + (where & np.uint64((1 << bits) - 1)).astype(np.int64) < w
            keys.append(d[inside] * m + component[inside].astype(np.int64))
            times.append(t[inside])
            points.append(point[inside])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(keys), np.concatenate(times), np.concatenate(points)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Hash of each band of rows components, the band's number included."""
    n, m = signature.shape
    out = np.zeros((n, m // rows), np.uint64)
    for k in range(rows):
        out = mixed(out + signature[:, k : m // rows * rows : rows])
    return mixed(out + np.arange(1, m // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def plain(text: str | None) -> bytes:
    """A text's words, as shingles see them."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())


def sketch(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """SKETCH, one row per document. text_key: its text's MD5; node: what texts of equal words share, null for one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keys = batch.columns
            at = 0
            while at < batch.num_rows:
                held, size, first = [], 0, at
                while at < batch.num_rows and (not held or size < SLICE):
                    held.append(plain(texts[at].as_py()))
                    size += len(held[-1])
                    at += 1
                doc, code, weight = shingles(held)
                found = bands(signatures(doc, code, weight, len(held), n_bands * rows), rows)
                nodes = [hashlib.blake2b(t, digest_size=16).digest() if t else None for t in held]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * n_bands, pa.int32()), pa.array(found.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), keys.slice(first, at - first), pa.array(nodes, pa.binary()), lists], names=["doc_id", "text_key", "node", "bands"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text")).alias("text_key")).mapInArrow(run, SKETCH)


def text_key(text: Column) -> Column:
    """The MD5 of a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (codes in order, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) of nodes that are similar enough. texts: node, zipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            bags: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            good = []
            for i in range(batch.num_rows):
                for node, data in ((a[i], x[i]), (b[i], y[i])):
                    if node not in bags:
                        if len(bags) >= 1000:
                            bags.clear()
                        bags[node] = shingles([unzip(data)])[1:]
                if a[i] not in bags:
                    bags[a[i]] = shingles([unzip(x[i])])[1:]
                good.append(similarity(bags[a[i]], bags[b[i]]) >= threshold - 1e-12)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = texts.select(F.col("node").alias("a"), F.col("zipped").alias("x"))
    second = texts.select(F.col("node").alias("b"), F.col("zipped").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def zipped(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, zipped, size (its shingles): one text of each of these nodes (distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1).compress
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            texts = [plain(t.as_py()) for t in batch.column(0)]
            names = [hashlib.blake2b(t, digest_size=16).digest() if t else None for t in texts]
            # Copies in one batch are sent once.
            rows = {n: t for n, t in zip(names, texts) if n}
            size = pa.array([max(1, t.count(b" ") + 2 - SHINGLE) for t in rows.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([tool(t) for t in rows.values()], pa.binary()), size], names=["node", "zipped", "size"])

    every = docs.select(F.col("text").cast("string")).mapInArrow(run, "node binary, zipped binary, size long")
    return every.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of the edges (a, b), the smallest node that it's connected to. Alternating stars."""
    spark = edges.sparkSession
    last, path = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        fresh = shared_path(spark, "stars")
        narrow(small.filter(F.col("a") != F.col("b")).distinct()).write.parquet(fresh)
        edges = spark.read.schema(small.schema).parquet(fresh)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if path:
            drop_path(spark, path)
        path = fresh
        if now == last:
            break
        last = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def overlaps(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """rows x cols: shingles in common, with weights, of these documents. doc, code, weight: as shingles returns them."""
    of = np.repeat(np.arange(len(doc)), weight)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(weight) - weight, weight)
    # A shingle of weight w is w elements, so that common weight is a count.
    _, element, count = np.unique(mixed(code[of] + nth.astype(np.uint64) * _MIX[0]), return_inverse=True, return_counts=True)
    shared = count > 1
    on = shared[element]
    element, owner = (np.cumsum(shared) - 1)[element[on]], doc[of[on]]
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    n = int(doc.max()) + 1 if len(doc) else 0
    row, col = np.full(n, -1), np.full(n, -1)
    row[rows], col[cols] = np.arange(len(rows)), np.arange(len(cols))
    out = np.zeros((len(rows), len(cols)))
    for at in range(0, int(shared.sum()), STRIP):
        lo, hi = np.searchsorted(element, [at, at + STRIP])
        x, y = np.zeros((len(rows), STRIP), np.float32), np.zeros((len(cols), STRIP), np.float32)
        for held, place in ((x, row[owner[lo:hi]]), (y, col[owner[lo:hi]])):
            held[place[place >= 0], element[lo:hi][place >= 0] - at] = 1
        out += x @ y.T
    return out


def linked(texts: list[bytes], rows: np.ndarray, cols: np.ndarray, todo: np.ndarray, threshold: float) -> np.ndarray:
    """rows x cols: those pairs of todo that are similar enough. rows, cols: numbers of texts."""
    doc, code, weight = shingles(texts)
    size = np.bincount(doc, weights=weight, minlength=len(texts))
    small, big = np.minimum.outer(size[rows], size[cols]), np.maximum.outer(size[rows], size[cols])
    todo = todo & (small >= (threshold - 1e-9) * big)
    out = np.zeros(todo.shape, bool)
    x, y = np.flatnonzero(todo.any(1)), np.flatnonzero(todo.any(0))
    if todo.sum() <= FEW * (len(x) + len(y)):
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        bag = lambda i: (code[at[i] : at[i + 1]], weight[at[i] : at[i + 1]])
        for i, j in zip(*np.nonzero(todo)):
            out[i, j] = similarity(bag(rows[i]), bag(cols[j])) >= threshold - 1e-12
        return out
    both = overlaps(doc, code, weight, rows[x], cols[y])
    out[np.ix_(x, y)] = both / (np.add.outer(size[rows[x]], size[cols[y]]) - both) >= threshold - 1e-12
    return out & todo


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric matrix of links connects, and no more than that takes."""
    fresh, out = near.any(1), []
    while fresh.any():
        stack = [int(np.argmax(fresh))]
        fresh[stack[0]] = False
        while stack:
            i = stack.pop()
            found = np.flatnonzero(near[i] & fresh)
            fresh[found] = False
            out += [(i, int(j)) for j in found]
            stack += found.tolist()
    return out


def cell_links(cells: DataFrame, threshold: float) -> DataFrame:
    """a, b, n: edges that connect what a cell's links connect (n is 0), and links of a by cell (b is null).

    cells: band, i, j (the cell), block, node, zipped, bands, large (those of its bands whose buckets are large).
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        unzip = zstandard.ZstdDecompressor().decompress
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        nodes, block = table.column("node").to_pylist(), table.column("block").to_numpy()
        codes = np.array(table.column("bands").to_pylist(), np.int64)
        large = np.isin(codes, np.unique(np.concatenate([np.array(x, np.int64) for x in table.column("large").to_pylist()])))
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        own = int(np.flatnonzero((codes == band).all(0))[0])
        # Pairs that agree in an earlier band are that band's; those that meet in a small bucket are listed.
        todo = np.triu(np.ones((len(rows), len(cols)), bool), 1) if i == j else np.ones((len(rows), len(cols)), bool)
        for k in range(codes.shape[1]):
            if k != own:
                same = codes[rows, k][:, None] == codes[cols, k][None]
                todo &= ~(same if k < own else same & ~large[rows, k][:, None])
        near = np.zeros((len(nodes), len(nodes)), bool)
        if todo.any():
            near[np.ix_(rows, cols)] = linked([unzip(z) for z in table.column("zipped").to_pylist()], rows, cols, todo, threshold)
            near |= near.T
        edges, n = forest(near), near.sum(1)
        some = np.flatnonzero(n)
        a = [nodes[x] for x, _ in edges] + [nodes[x] for x in some]
        b = [nodes[y] for _, y in edges] + [None] * len(some)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array([0] * len(edges) + n[some].tolist(), pa.int64())})

    return cells.groupBy("band", "i", "j").applyInArrow(run, "a binary, b binary, n long")


def links(nodes: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(node, n_links; node, root) of all nodes with any link. nodes: node, bands; distinct."""
    spark = nodes.sparkSession
    rows = nodes.select("node", F.explode("bands").alias("band"))
    shared = cut(rows.join(rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "band"), "shared")  # band, node, n
    texts = cut(zipped(docs, shared.select("node").distinct()), "texts")
    few = shared.filter(F.col("n") <= SMALL)
    pairs = few.select("band", F.col("node").alias("a")).join(few.select("band", F.col("node").alias("b")), "band").filter("a < b")
    pairs = cut(narrow(pairs.select("a", "b").distinct()), "pairs")
    found = cut(verified(pairs, texts, threshold), "links")
    drop(pairs)
    edges = found
    degree = found.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n"))
    many = shared.filter(F.col("n") > SMALL).select("band", "node")
    if not many.limit(1).isEmpty():
        unit = BLOCK_SIZE // BLOCK
        before = F.sum(F.col("size") + unit).over(W.partitionBy("band").orderBy("size", "node").rowsBetween(W.unboundedPreceding, -1))
        placed = many.join(texts.select("node", "size"), "node").withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_SIZE).cast("long"))
        placed = cut(narrow(placed), "blocks")
        sizes = placed.groupBy("band", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
        other = sizes.select("band", F.col("block").alias("j"), F.col("least").alias("from"))
        cells = sizes.withColumnRenamed("block", "i").join(other, "band").filter((F.col("i") <= F.col("j")) & (F.col("most") >= (threshold - 1e-9) * F.col("from")))
        cells = cells.select("band", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        large = placed.groupBy("node").agg(F.collect_list("band").alias("large"))
        own = cut(texts.select("node", "zipped").join(large, "node").join(nodes, "node"), "members")
        cells = cut(narrow(cells), "cells")
        held = placed.select("band", "block", "node").join(cells, ["band", "block"]).join(own, "node")
        more = cut(cell_links(held.select("band", "i", "j", "block", "node", "zipped", "bands", "large"), threshold), "cell_links")
        drop(placed, own, cells)
        edges = edges.unionByName(more.filter("b IS NOT NULL").select("a", "b"))
        degree = degree.unionByName(more.filter("b IS NULL").select(F.col("a").alias("node"), "n"))
    drop(shared, texts)
    roots = spark.createDataFrame([], "node binary, root binary") if edges.isEmpty() else cut(narrow(components(edges)), "roots")
    return degree.groupBy("node").agg(F.sum("n").alias("n_links")), roots


def resolved(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, node of every document; node, root, n_links of every text with words)."""
    drawn = cut(sketch(docs), "sketch")
    nodes = drawn.filter("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("least"))
    degree, roots = links(nodes.select("node", "bands"), docs, threshold)
    named = nodes.select("node", "least").join(roots, "node", "left").join(degree, "node", "left")
    named = named.select("node", "least", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return drawn.select("doc_id", "text_key", "node"), cut(narrow(named), "named")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (all verified links of its text to different texts, each text once)."""
    drawn, named = resolved(docs, threshold)
    first = cut(narrow(named.groupBy("root").agg(F.min("least").alias("class_id"))), "first")  # written, so that the join with it splits
    named = named.join(first, "root").select("node", "class_id", "n_links")
    out = drawn.select("doc_id", "node").join(named, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id"))
    return out.select("doc_id", F.coalesce("class_id", alone).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, and every row without words; all columns."""
    names = docs.columns
    drawn, named = resolved(docs, threshold)
    held = drawn.filter("node IS NOT NULL").join(named.select("node", "root"), "node")
    # By root, id and text: a row each, with the number of rows that are equal in all of it.
    rows = held.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n")).alias("pick"))
    first = cut(narrow(first).select(F.col("pick.doc_id").alias("_pick_id"), F.col("pick.text_key").alias("_pick_key"), F.col("pick.n").alias("_pick_n")), "kept")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    own = own.withColumn("_key", text_key(F.col("_text")))
    same = F.col("_id").eqNullSafe(F.col("_pick_id")) & (F.col("_key") == F.col("_pick_key"))
    single = own.join(first.filter("_pick_n = 1"), same, "left_semi").select("_row")
    again = first.filter("_pick_n > 1")
    if not again.limit(1).isEmpty():
        rest = F.to_json(F.struct(*[F.col(f"_row.`{c}`") for c in names if c not in ("doc_id", "text")], F.lit(0).alias("_")))
        repeats = own.join(again, same, "left_semi").groupBy("_id", "_key").agg(F.min_by("_row", rest).alias("_row"))
        single = single.unionByName(repeats.select("_row"))
    wordless = own.filter(~F.rlike(F.coalesce("_text", F.lit("")), F.lit(WORD))).select("_row")
    return single.unionByName(wordless).select("_row.*")
