"""Exact similarity join of documents as sets of word n-grams, and the classes that its links make.

A document's set is its distinct ``SHINGLE``-word shingles (words between ASCII white space, A-Z lower-cased; fewer words
are one shingle). Two documents link if ``percent`` percent of their union are common. Equal sets are one node.

Index: shingles are put in one order for all documents, rare ones first. How rare is counted over all documents in
``BUCKETS`` buckets of shingle hashes; only the rank of a bucket, one byte, is used, so what every task gets is 4 MB at any
size. Sets that link share a shingle among their first n - ceil(percent n / 100) + 1; a shingle's index list holds the sets
that have it there, with size and position. Lists are kept in blocks by size and position, and two blocks (in short
lists: two entries) are skipped where sizes or the shingles that can follow both positions are too few for a link.

Answers: only classes are asked for, so a set's answer is the sets it isn't connected to yet. First every entry of a list is
compared with the next one alone, which is linear and connects most of a group of near copies; lists whose sets are
all connected by then are skipped whole. In the others, pairs of different classes are compared: in short lists each
pair, in long ones block by block, each pair of blocks in a task, where the overlaps of a set with all others are derived
from those of a highly similar set before it: what the index lists of the shingles that only the other has give is taken
off, what those of its own new shingles give is added. A set without such a neighbour is counted from its own lists.

Defined results: a null, empty or blank text has no shingles and is a class of its own; the class is named by its
smallest doc_id, null ids left aside (null if there's no other); copies and repeated rows are in one class; rows that repeat
an id with different texts have the class of their text each. Texts of any length are read whole, an empty table gives
no rows, other columns are ignored. Shingles are compared by 64-bit hashes.
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

from siltstone.llm.bagminhash import components
from siltstone.llm.common import cut, drop, narrow
from siltstone.llm.suffix_dedup import Rolling, mixed
from siltstone.sources.shipping import ship

SHINGLE, PERCENT = 3, 90
#: Counters of shingle hashes, in pieces that are added up apart.
BUCKETS, PIECES = 1 << 22, 64
#: Sets of a list whose pairs are listed; shingles of a block of a longer one, and what a set counts besides its own.
SHORT, BLOCK_SIZE, UNIT = 32, 400_000, 400
#: Bits of a set's parities.
PARITIES = 2048
#: Bytes of text that are hashed together.
SLICE = 1 << 17

_BASE = 0x9FB21C651E98DF25
_SPREAD = np.array([0x8F14E45FCEEA167A | 1, 0xC6A4A7935BD1E995, 0x52DCE729DA3ED7FB, 0xA24BAED4963EE407, 0xB492B66FBE98F273], np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def plain(text: str | None) -> bytes:
    """A text's words, as shingles see them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingles(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every shingle, repeats included, by document."""
    text = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    solid = np.concatenate([[False], ~_BLANK[text], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    doc = np.searchsorted(begins, starts, side="right") - 1
    words, own = Rolling(text, _BASE).of(starts, ends), np.bincount(doc, minlength=len(texts))
    left = np.cumsum(own)[doc] - np.arange(len(doc))  # words from here to the document's end
    code = np.zeros(len(words), np.uint64)
    for k in range(n):
        code[: len(code) - k] += np.where(left[: len(code) - k] > k, words[k:], np.uint64(0)) * _SPREAD[k]
    keep = (left >= n) | ((own[doc] < n) & (left == own[doc]))
    return doc[keep], mixed(code[keep] + np.minimum(left[keep], n).astype(np.uint64))


def sorted_sets(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct codes in order."""
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[new], code[new]


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """First row and words of the texts, SLICE bytes or one text at a time."""
    at = 0
    while at < len(texts):
        first, held, size = at, [], 0
        while at < len(texts) and (not held or size < SLICE):
            held.append(plain(texts[at].as_py()))
            size += len(held[-1])
            at += 1
        yield first, held


def ranks(docs: DataFrame, n: int = SHINGLE) -> np.ndarray:
    """For each bucket of hashes, how often its shingles occur over all documents: four steps a doubling. BUCKETS bytes at any size."""
    width = BUCKETS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n_waiting = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                waiting.append((shingles(texts, n)[1] & np.uint64(BUCKETS - 1)).astype(np.int32))
                n_waiting += len(waiting[-1])
                if n_waiting > BUCKETS // 4:
                    total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting, n_waiting = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for k in range(PIECES):
            own = total[k * width : (k + 1) * width]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zip_(own.tobytes())], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, sums = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(unzip(data.as_py()), np.int64)
                sums[k] = sums[k] + own if k in sums else own.copy()
        for k, own in sums.items():
            steps = np.minimum(np.floor(4 * np.log2(np.maximum(own, 1))), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["piece", "ranks"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "piece int, counts binary")
    summed = counted.repartition(PIECES, "piece").mapInArrow(add, "piece int, ranks binary")
    out = np.zeros(BUCKETS, np.uint8)
    for piece, data in summed.collect():  # PIECES rows of width bytes
        out[piece * width : (piece + 1) * width] = np.frombuffer(bytes(data), np.uint8)
    return out


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of which a linked one has at least one among its own."""
    return size + percent * size // -100 + 1


def prefixes(docs: DataFrame, rank: np.ndarray, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """doc_id, size, text_key, node (null without words), prefix: each document's set, named, and its first shingles in the common order."""
    sent = docs.sparkSession.sparkContext.broadcast(rank)  # BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        name = lambda b: hashlib.blake2b(b, digest_size=16).digest()
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                doc, code = shingles(texts, n)
                # The rank in the highest byte: numbers in order are shingles in the common order.
                doc, code = sorted_sets(doc, held[code & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(56) | code >> np.uint64(8))
                size = np.bincount(doc, minlength=len(texts))
                at = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(len(doc)) - at[doc]
                own = place < prefix_length(size, percent)[doc]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[own], minlength=len(texts)))])
                nodes = [name(code[at[i] : at[i + 1]].tobytes()) if size[i] else None for i in range(len(texts))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[own].view(np.int64)))
                columns = [batch.column(0).slice(first, len(texts)), pa.array(size, pa.int64()), pa.array([name(t) for t in texts], pa.binary()), pa.array(nodes, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "text_key", "node", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, size long, text_key binary, node binary, prefix array<long>")


def parities(doc: np.ndarray, code: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x PARITIES / 64: whether an odd number of a set's shingles fall in each of PARITIES bins, one bit a bin."""
    held = np.zeros((n_docs, PARITIES), np.uint8)
    bins = (mixed(code) >> np.uint64(40)).astype(np.int64) % PARITIES
    np.bitwise_xor.at(held, (doc, bins), 1)
    return np.packbits(held, axis=1).view(np.int64)


def texts_of(docs: DataFrame, wanted: DataFrame, n: int = SHINGLE) -> DataFrame:
    """id, zipped, parity: the words of one text of each of these (text_key, id), and its set's parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1).compress
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            texts = [plain(t.as_py()) for t in batch.column(0)]
            rows = {hashlib.blake2b(t, digest_size=16).digest(): t for t in texts if t}  # copies in a batch are sent once
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array([tool(t) for t in rows.values()], pa.binary())], names=["text_key", "zipped"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 100) for whole in batches for at in range(0, whole.num_rows, 100)):
            sets = [codes_of(z.as_py(), n) for z in batch.column("zipped")]
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            held = parities(doc, np.concatenate(sets), len(sets)) if sets else np.zeros((0, PARITIES // 64), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (PARITIES // 64), pa.int32()), pa.array(held.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "zipped", "parity"])

    every = docs.select(F.col("text").cast("string")).mapInArrow(run, "text_key binary, zipped binary")
    held = every.join(wanted, "text_key").dropDuplicates(["id"]).select("id", "zipped")
    return held.mapInArrow(mark, "id long, zipped binary, parity array<long>")


def codes_of(data: bytes, n: int = SHINGLE) -> np.ndarray:
    """The set of a zipped text."""
    return np.unique(shingles([zstandard.ZstdDecompressor().decompress(data)], n)[1])


def verified(pairs: DataFrame, texts: DataFrame, percent: int, n: int = SHINGLE) -> DataFrame:
    """Those pairs (a, b, sizes na and nb) of ids that link.

    Two sets differ in as many shingles at least as their parities differ in bits, so most pairs that don't link are dropped on
    256 bytes each; texts are fetched for the others only, whose sets are compared whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            sets, good = {}, []
            for i in range(batch.num_rows):
                u, v = (sets[k] if k in sets else sets.setdefault(k, codes_of(z, n)) for k, z in ((a[i], x[i]), (b[i], y[i])))
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda k, c, name: texts.select(F.col("id").alias(k), F.col(c).alias(name))
    marked = pairs.join(side("a", "parity", "p"), "a").join(side("b", "parity", "q"), "b")
    apart = F.aggregate(F.zip_with("p", "q", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, k: s + k)
    # Linked sets of sizes na and nb differ in (100 - percent) / (100 + percent) of na + nb shingles at most.
    likely = cut(narrow(marked.filter((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")), "likely")
    return likely.join(side("a", "zipped", "x"), "a").join(side("b", "zipped", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class Lists:
    """Index lists of sets: the places of the sets that hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        codes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(codes, kind="stable")
        self.n, self.owner = len(sets), owner[order]
        self.codes, self.starts, self.counts = np.unique(codes[order], return_index=True, return_counts=True)

    def overlaps(self, codes: np.ndarray) -> np.ndarray:
        """For each set, how many of these shingles it has."""
        if not len(codes) or not len(self.codes):
            return np.zeros(self.n, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = at[self.codes[at] == codes]
        counts = self.counts[at]
        places = np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.bincount(self.owner[places], minlength=self.n)


def answers(rows: list[np.ndarray], lists: Lists) -> Iterator[tuple[int, np.ndarray]]:
    """Place and overlaps of each row set, in an order in which similar sets follow each other; a set's answer is derived from the one before it."""
    head = np.array([[s[0], s[min(1, len(s) - 1)]] for s in rows], np.uint64).reshape(-1, 2)
    last, found = None, None
    for i in np.lexsort((head[:, 1], head[:, 0])).tolist():
        own = rows[i]
        lost = gained = own
        if last is not None:
            lost, gained = np.setdiff1d(last, own, assume_unique=True), np.setdiff1d(own, last, assume_unique=True)
        if last is not None and len(lost) + len(gained) < len(own):
            found = found - lists.overlaps(lost) + lists.overlaps(gained)
        else:
            found = lists.overlaps(own)
        last = own
        yield i, found


def new_links(rows: list[np.ndarray], cols: list[np.ndarray], row_class: np.ndarray, col_class: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (row, column) that connect classes, as few as connect all that the links between rows and columns connect."""
    size = np.array([len(s) for s in cols], np.int64)
    row_class, col_class, out = row_class.copy(), col_class.copy(), []
    for i, both in answers(rows, Lists(cols)):
        near = 100 * both >= percent * (len(rows[i]) + size - both)
        while len(todo := np.flatnonzero(near & (col_class != row_class[i]))):
            j, old = int(todo[0]), col_class[todo[0]]
            out.append((i, j))
            row_class[row_class == old] = row_class[i]
            col_class[col_class == old] = row_class[i]
    return out


def cell_links(cells: DataFrame, percent: int, n: int = SHINGLE) -> DataFrame:
    """a, b: links that connect classes, of two blocks of an index list. cells: token, i, j, block, id, root, zipped."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, ids = table.column("block").to_pylist(), table.column("id").to_numpy()
        sets = [codes_of(z, n) for z in table.column("zipped").to_pylist()]
        root = table.column("root").to_numpy()
        rows, cols = ([k for k, b in enumerate(block) if b == x] for x in (i, j))
        found = new_links([sets[k] for k in rows], [sets[k] for k in cols], root[rows], root[cols], percent)
        return pa.table({"a": pa.array([ids[rows[x]] for x, _ in found], pa.int64()), "b": pa.array([ids[cols[y]] for _, y in found], pa.int64())})

    return cells.groupBy("token", "i", "j").applyInArrow(run, "a long, b long")


def fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes may link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def reaches(a: Column, b: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes a and b may link if the first shingle in common stands at i and j (from 0)."""
    return (100 + percent) * F.least(a - i, b - j) >= percent * (a + b)


def blocks(index: DataFrame) -> DataFrame:
    """index (token, id, size, place) with block: entries of a list by size, BLOCK_SIZE shingles to a block; equal sizes that are more are dealt by a hash."""
    sizes = index.groupBy("token", "size").agg(F.count("*").alias("sets")).withColumn("weight", F.col("sets") * (F.col("size") + UNIT))
    before = F.coalesce(F.sum("weight").over(W.partitionBy("token").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"base": F.floor(before / BLOCK_SIZE), "parts": F.ceil(F.col("weight") / BLOCK_SIZE)}).select("token", "size", "base", "parts")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", "token"), F.col("parts")) + 1).otherwise(0)
    own = F.when(F.col("parts") > 1, F.col("size")).otherwise(0)
    return index.join(sizes, ["token", "size"]).withColumn("block", F.struct(F.col("base").alias("base"), own.alias("own"), part.alias("part"))).drop("base", "parts")


def roots_of(edges: DataFrame) -> DataFrame:
    """id, root of all ids of the edges, written."""
    if edges.isEmpty():
        return edges.sparkSession.createDataFrame([], "id long, root long")
    return cut(narrow(components(edges).withColumnRenamed("node", "id")), "roots")


def links(nodes: DataFrame, docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """id, root of the nodes that have any link. nodes: id, size, prefix, text_key; distinct."""
    entries = nodes.select("id", "size", F.posexplode("prefix").alias("place", "token"))
    lists = entries.groupBy("token").agg(F.count("*").cast("int").alias("sets")).filter("sets > 1")
    shared = cut(narrow(entries.join(lists, "token")), "shared")
    index = cut(narrow(blocks(shared)), "index")  # token, size, id, place, sets, block
    drop(shared)
    # Written first, so that its size is known when it's joined with the texts: these move only if it is large.
    wanted = cut(narrow(nodes.join(index.select("id").distinct(), "id", "left_semi").select("text_key", "id")), "wanted")
    texts = cut(texts_of(docs, wanted, n), "texts")
    # Every entry and the next one.
    order = W.partitionBy("token", "block").orderBy("size", "place", "id")
    near = index.select(F.col("id").alias("x"), F.lead("id").over(order).alias("y"), "size", F.lead("size").over(order).alias("size2")).filter(F.col("y").isNotNull() & fits(F.col("size"), F.col("size2"), percent))
    chain = near.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.first("size").alias("na"), F.first("size2").alias("nb"))
    chain = cut(narrow(chain), "chain")
    edges = cut(narrow(verified(chain, texts, percent, n)), "chain_links")
    # What is still apart.
    held = index.join(roots_of(edges), "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = held.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("token")
    held = cut(narrow(held.join(apart, "token", "left_semi")), "apart")
    short = held.filter(F.col("sets") <= SHORT)
    x, y = (short.select("token", *[F.col(c).alias(c + k) for c in ("id", "root", "size", "place")]) for k in "xy")
    pairs = x.join(y, "token").filter((F.col("idx") < F.col("idy")) & (F.col("rootx") != F.col("rooty")))
    pairs = pairs.filter(fits(F.col("sizex"), F.col("sizey"), percent) & reaches(F.col("sizex"), F.col("sizey"), F.col("placex"), F.col("placey"), percent))
    pairs = pairs.groupBy(F.col("idx").alias("a"), F.col("idy").alias("b")).agg(F.first("sizex").alias("na"), F.first("sizey").alias("nb")).join(chain, ["a", "b"], "left_anti")
    edges = edges.unionByName(cut(narrow(verified(pairs, texts, percent, n)), "pair_links"))
    long = held.filter(F.col("sets") > SHORT)
    if not long.isEmpty():
        each = long.groupBy("token", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("place").alias("first"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        i, j = (each.select("token", *[F.col(c).alias(c + k) for c in ("block", "least", "most", "first", "r0", "r1")]) for k in "ij")
        cells = i.join(j, "token").filter(F.col("blocki") <= F.col("blockj"))
        # Skipped: blocks of one class, blocks without sizes that fit, and blocks that lie too late in their sets.
        apart = (F.col("r0i") != F.col("r1i")) | (F.col("r0j") != F.col("r1j")) | (F.col("r0i") != F.col("r0j"))
        sizes = (100 * F.col("mosti") >= percent * F.col("leastj")) & (100 * F.col("mostj") >= percent * F.col("leasti"))
        room = (100 + percent) * F.least(F.col("mosti") - F.col("firsti"), F.col("mostj") - F.col("firstj")) >= percent * (F.col("leasti") + F.col("leastj"))
        cells = cells.filter(apart & sizes & room).select("token", F.col("blocki").alias("i"), F.col("blockj").alias("j"), F.explode(F.array_distinct(F.array("blocki", "blockj"))).alias("block"))
        cells = long.join(cells, ["token", "block"]).join(texts.select("id", "zipped"), "id").select("token", "i", "j", "block", "id", "root", "zipped")
        edges = edges.unionByName(cut(narrow(cell_links(cells, percent, n)), "cell_links"))
    drop(index, wanted, texts, chain, held)
    return roots_of(edges)


def classes(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    ship(docs.sparkSession)
    drawn = cut(prefixes(docs, ranks(docs, n), percent, n), "prefixes")
    nodes = drawn.filter("node IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.min("text_key").alias("text_key"), F.min("doc_id").alias("least"))
    # Written with its numbers, which are fixed from here on.
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    named = nodes.select("id", "node", "least").join(links(nodes, docs, percent, n), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = cut(narrow(named), "named")
    first = cut(narrow(named.groupBy("root").agg(F.min("least").alias("component_id"))), "first")
    out = drawn.select("doc_id", "size", "node").join(named.join(first, "root").select("node", "component_id"), "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", alone).alias("component_id"))
