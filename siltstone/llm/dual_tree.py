"""Hard negatives by dual-tree search: trees over anchors and over candidates, whole groups of anchors pruned at once.

A vector's components are floored at ``SCALE`` times their value, so scores are integer inner products. A node of a tree
is a ball (centre, radius) around its vectors. For two balls the inner products of what is inside lie within
|c_a| r_c + |c_c| r_a + r_a r_c of the product of the centres; if that interval misses what every anchor of a node still asks
for, neither node is looked into further. Two leaves are scored exactly, all rows at once.

Above the trees, the same test decides which parts of the table meet at all. Centres of up to ``CELLS`` cells come from a
sample of ``SAMPLE`` rows by a hash of their ids; the sample is a means of pruning only. Every row goes to its nearest
centre's cell, whose radius is measured over all of its rows; a cell of more than ``SHARD_ROWS`` rows is dealt to several
shards by a hash, and anchors to blocks of about ``BLOCK``. A block and a shard meet in one task if the interval of
a group of anchors (those of one cell) and the shard's cell leaves it a chance. What a task holds is a block and a shard.

Two rounds: the ``positives`` best rows of an anchor's label (pruned by the best in the sample from the start), then for each
of them the ``negatives`` best rows of other labels between 4/5 of its score and its score. Only a vector's smallest ids can be
among the best of equal vectors of a label, so larger ones are dropped before anything is shuffled by cell.

Defined results: rows with a null id, label, vector or component, or one that isn't finite, take no part. Labels are changed
by ``relabelled`` first. Exact repeats (id, label and vector) are one row; rows of the anchor's own id are never its
positives or negatives; an id with different rows has each of them as a row and, if divisible by ``every``, as an anchor.
Vectors of different lengths never meet. Ties go to the smaller id. A positive of a negative score has no negatives, as the
range is empty. Scores beyond a long count as the nearest long. An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import cut, drop
from siltstone.sources.shipping import ship

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
SAMPLE, CELLS, SHARD_ROWS, BLOCK = 4096, 1024, 1 << 14, 4096
#: Rows of a tree's leaf: anchors, candidates.
ANCHOR_LEAF, LEAF = 16, 256
LEAST, MOST = np.iinfo(np.int64).min + 2, np.iinfo(np.int64).max
FOUND = "anchor_id long, anchor_key long, slot int, vec_id long, score long"


def relabelled(vec_id, label):
    """The label that counts: every seventh id has the next one, modulo ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def take_part(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x: the distinct rows that take part."""
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = held.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    return held.select("vec_id", relabelled(F.col("vec_id"), F.col("label")).alias("label"), "x").distinct()


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of floored doubles."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = len(lists)
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, at most the largest long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    finite = np.finfo(np.float64).max
    whole = lambda x: np.array([[int(v) for v in row] for row in np.clip(x, -finite, finite)], object)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


def halves(x: np.ndarray) -> np.ndarray:
    """True for the half of the rows that lies further along the line between two far ones."""
    with np.errstate(all="ignore"):
        far = x[np.nan_to_num(((x - x[0]) ** 2).sum(1)).argmax()]
        other = x[np.nan_to_num(((x - far) ** 2).sum(1)).argmax()]
        along = np.nan_to_num(x @ np.nan_to_num(other - far))
    out = np.zeros(len(x), bool)
    out[np.argsort(along, kind="stable")[len(x) // 2 :]] = True
    return out


class Tree:
    """Balls over rows: order (row numbers), and by node begin, end (in order), left, right (-1: leaf), centre, radius."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        begin, end, left, right, centre, radius = [0], [len(x)], [-1], [-1], [], []
        node = 0
        while node < len(begin):
            own = self.order[begin[node] : end[node]]
            with np.errstate(all="ignore"):
                centre.append(x[own].mean(0))
                radius.append(np.sqrt(((x[own] - centre[-1]) ** 2).sum(1).max()))
            if len(own) > leaf:
                upper = halves(x[own])
                self.order[begin[node] : end[node]] = np.concatenate([own[~upper], own[upper]])
                middle = end[node] - int(upper.sum())
                left[node], right[node] = len(begin), len(begin) + 1
                begin += [begin[node], middle]
                end += [middle, end[node]]
                left += [-1, -1]
                right += [-1, -1]
            node += 1
        self.begin, self.end, self.left, self.right = begin, end, left, right
        self.centre, self.radius = np.array(centre), np.array(radius)


def intervals(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product between balls, rounding included; nan where a double can't say."""
    with np.errstate(all="ignore"):
        na, nb = np.sqrt((ca**2).sum(1)), np.sqrt((cb**2).sum(1))
        slack = na[:, None] * rb[None] + ra[:, None] * nb[None] + ra[:, None] * rb[None]
        slack = slack + 1e-9 * (slack + na[:, None] * nb[None]) + 1e-6
        middle = ca @ cb.T
        return middle - slack, middle + slack


class Search:
    """For every anchor and slot the k best candidates with need <= score <= top, of the anchor's label or of others."""

    def __init__(self, anchors, candidates, need: np.ndarray, top: np.ndarray, same: bool, k: int):
        """anchors, candidates: ids, labels, floored vectors."""
        self.a, self.c, self.same, self.k, self.top = anchors, candidates, same, k, top
        n, slots = need.shape
        self.low = need.copy()
        self.scores, self.ids = np.full((n, slots, k), LEAST), np.full((n, slots, k), -1)
        self.places = np.full((n, slots, k), -1)
        if n and len(candidates[0]):
            self.ta, self.tc = Tree(anchors[2], ANCHOR_LEAF), Tree(candidates[2], LEAF)
            self.lo, self.hi = intervals(self.ta.centre, self.ta.radius, self.tc.centre, self.tc.radius)
            self.walk()

    def walk(self) -> None:
        ta, tc, stack = self.ta, self.tc, [(0, 0)]
        while stack:
            a, c = stack.pop()
            own = ta.order[ta.begin[a] : ta.end[a]]
            live = self.low[own] <= self.top[own]
            if not live.any() or self.hi[a, c] < self.low[own][live].min() or self.lo[a, c] > self.top[own][live].max():
                continue
            if ta.left[a] < 0 and tc.left[c] < 0:
                self.score(own, tc.order[tc.begin[c] : tc.end[c]])
            elif tc.left[c] < 0 or ta.left[a] >= 0 and ta.radius[a] > tc.radius[c]:
                stack += [(ta.left[a], c), (ta.right[a], c)]
            else:  # the more promising one first
                pair = [(a, tc.left[c]), (a, tc.right[c])]
                stack += sorted(pair, key=lambda p: np.nan_to_num(self.hi[p]))

    def score(self, rows: np.ndarray, cols: np.ndarray) -> None:
        ids, labels, x = self.c
        cols = cols[np.argsort(ids[cols], kind="stable")]
        s = inner(self.a[2][rows], x[cols])
        fit = (self.a[1][rows][:, None] == labels[cols][None]) == self.same
        fit &= self.a[0][rows][:, None] != ids[cols][None]
        for slot in range(self.low.shape[1]):
            good = fit & (s >= self.low[rows, slot][:, None]) & (s <= self.top[rows, slot][:, None])
            r, c = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
            if not len(r):
                continue
            on, found = rows[r], np.where(good[np.ix_(r, c)], s[np.ix_(r, c)], LEAST)
            best = np.argsort(-found, 1, kind="stable")[:, : self.k]
            scores = np.concatenate([self.scores[on, slot], np.take_along_axis(found, best, 1)], 1)
            places = np.concatenate([self.places[on, slot], cols[c][best]], 1)
            names = np.where(scores > LEAST, ids[np.maximum(places, 0)], np.iinfo(np.int64).max)
            order = np.lexsort((names, -scores), axis=1)[:, : self.k]
            self.scores[on, slot], self.places[on, slot] = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)
            self.low[on, slot] = np.maximum(self.low[on, slot], self.scores[on, slot, -1])


class Cells:
    """Centres by length of vector, of a sample of rows, and that sample: what is sent to every task."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: list[np.ndarray], count: int):
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.centres: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        wanted, total = max(1, min(CELLS, -(-2 * count // SHARD_ROWS))), 0
        lengths = np.array([len(v) for v in x], int)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            held = np.array([x[i] for i in own], float).reshape(len(own), length)
            tree = Tree(held, max(1, -(-len(x) // wanted)))
            leaves = [k for k in range(len(tree.begin)) if tree.left[k] < 0]
            self.parts[int(length)], self.centres[int(length)], self.first[int(length)] = (ids[own], labels[own], held), np.nan_to_num(tree.centre[leaves]), total
            total += len(leaves)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell (-1 if the sample has no such length) and its distance from the centre."""
        centres = self.centres.get(x.shape[1])
        if centres is None:
            return np.full(len(x), -1), np.zeros(len(x))
        with np.errstate(all="ignore"):
            near = np.nan_to_num(x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
            return near + self.first[x.shape[1]], np.sqrt(((x - centres[near]) ** 2).sum(1))

    def floors(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """A score that each anchor's k-th best row of its label reaches at least, by the sample."""
        out = np.full(len(x), LEAST)
        held = self.parts.get(x.shape[1])
        if held is not None and len(held[0]) >= k and len(x):
            s = np.where((labels[:, None] == held[1][None]) & (ids[:, None] != held[0][None]), inner(x, held[2]), LEAST)
            # Rows of the sample may share an id with a vector each; k rows are k rows.
            out = np.sort(np.partition(s, len(held[0]) - k, 1)[:, -k:], 1)[:, 0]
        return out


def by_length(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of one length at a time, with their floored vectors."""
    lengths = np.array(batch.column(column).value_lengths().to_numpy(zero_copy_only=False), int)
    for length in np.unique(lengths):
        own = batch.filter(pa.array(lengths == length))
        yield own, matrix(own.column(column)) if length else np.zeros((own.num_rows, 0))


def placed(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows with length, cell and dist (from the cell's centre)."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)  # SAMPLE vectors and as many centres at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in by_length(batch):
                cell, dist = sent.value.of(x)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(cell, pa.int32()), pa.array(dist, pa.float64())], names=[*own.schema.names, "length", "cell", "dist"])

    return rows.mapInArrow(run, "vec_id long, label long, x array<double>, length int, cell int, dist double")


def asked(anchors: DataFrame, cells: Cells, radius: np.ndarray, shards: np.ndarray, k: int) -> DataFrame:
    """anchors (with block) with floor, cell and shard: every shard that may hold something an anchor of its group asks for.

    anchors: vec_id, label, x, key, block, home, ids, tops; tops are scores that negatives may reach, null where positives are
    asked for. radius, shards: by cell.
    """
    sent = anchors.sparkSession.sparkContext.broadcast((cells, radius, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, radius, shards = sent.value
        for batch in batches:
            for own, x in by_length(batch):
                ids, labels, home = (own.column(c).to_numpy() for c in ("vec_id", "label", "home"))
                tops = own.column("tops").to_pylist()
                positive = own.column("tops").null_count == own.num_rows
                floors = cells.floors(ids, labels, x, k) if positive else np.array([min((p - p // 5 for p in t if p >= 0), default=MOST) for t in tops], np.int64)
                most = np.full(len(x), MOST) if positive else np.array([max(t) for t in tops], np.int64)
                centres, at, cell, shard = cells.centres.get(x.shape[1]), [], [], []
                for group in np.unique(home):
                    rows = np.flatnonzero(home == group)
                    rows = rows[floors[rows] <= most[rows]]
                    if not len(rows):
                        continue
                    meets, first = np.array([-1]), 0
                    if centres is not None:
                        first = cells.first[x.shape[1]]
                        with np.errstate(all="ignore"):
                            centre = x[rows].mean(0)
                            own_radius = np.sqrt(((x[rows] - centre) ** 2).sum(1).max())
                        lo, hi = intervals(centre[None], np.array([own_radius]), centres, radius[first : first + len(centres)])
                        meets = np.flatnonzero(~(hi[0] < floors[rows].min()) & ~(lo[0] > most[rows].max())) + first
                    for c in meets:
                        for s in range(int(shards[c]) if c >= 0 else 1):
                            at.append(rows)
                            cell.append(np.full(len(rows), c))
                            shard.append(np.full(len(rows), s))
                at, cell, shard = (np.concatenate(v).astype(int) if v else np.zeros(0, int) for v in (at, cell, shard))
                for k0 in range(0, len(at), 1000):
                    part = slice(k0, k0 + 1000)
                    out = own.take(pa.array(at[part]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, x.shape[1]), pa.int32()), pa.array(floors[at[part]]), pa.array(cell[part], pa.int32()), pa.array(shard[part], pa.int32())], names=[*out.schema.names, "length", "floor", "cell", "shard"])

    return anchors.mapInArrow(run, "vec_id long, label long, x array<double>, key long, block long, home int, tops array<long>, length int, floor long, cell int, shard int")


def searched(asks: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """FOUND: for every anchor and slot the k best of all shards. candidates: vec_id, label, x, length, cell, shard."""
    names = ["block", "length", "cell", "shard"]
    asks = cut(asks, "asks")
    met = candidates.join(asks.select(*names).distinct(), names[1:]).select(*[F.col(c).alias(c) for c in names], "vec_id", "label", "x")

    def run(own: pa.Table, asks: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "anchor_key": [], "slot": [], "vec_id": [], "score": []}
        if own.num_rows and asks.num_rows:
            ids, labels, keys, floors = (asks.column(c).to_numpy() for c in ("vec_id", "label", "key", "floor"))
            tops = asks.column("tops").to_pylist()
            positive = tops[0] is None
            width = 1 if positive else max(map(len, tops))
            top = np.full((len(ids), width), MOST if positive else -1)
            need = np.full((len(ids), width), MOST)
            for i, t in enumerate(tops):
                if positive:
                    need[i] = floors[i]
                else:
                    top[i, : len(t)] = t
                    need[i, : len(t)] = [p - p // 5 if p >= 0 else MOST for p in t]
            candidates = own.column("vec_id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("x"))
            found = Search((ids, labels, matrix(asks.column("x"))), candidates, need, top, positive, k)
            i, slot, nth = np.nonzero(found.places >= 0)
            out = {"anchor_id": ids[i], "anchor_key": keys[i], "slot": slot.astype(np.int32), "vec_id": candidates[0][found.places[i, slot, nth]], "score": found.scores[i, slot, nth]}
        return pa.table({c: pa.array(v, pa.int32() if c == "slot" else pa.int64()) for c, v in out.items()})

    found = met.groupBy(*names).cogroup(asks.groupBy(*names)).applyInArrow(run, FOUND)
    rank = F.row_number().over(W.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    ship(spark)
    rows = take_part(vectors)
    best = F.row_number().over(W.partitionBy("label", "x").orderBy("vec_id"))
    few = rows.withColumn("place", best).filter(F.col("place") <= max(positives, negatives) + 1).drop("place")
    few = cut(few, "vectors")
    anchors = cut(rows.filter(F.col("vec_id") % every == 0), "anchors")
    sample = few.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE).toArrow()
    xs = [np.floor(np.array(v, float) * SCALE) for v in sample.column("x").to_pylist()]
    cells = Cells(sample.column("vec_id").to_numpy(), sample.column("label").to_numpy(), xs, few.count())
    candidates = cut(placed(few, cells), "placed")
    # By cell, of which there are CELLS and one for each further length of the sample at most.
    n_cells = sum(len(c) for c in cells.centres.values())
    radius, shards = np.zeros(n_cells), np.ones(n_cells, int)
    for cell, r, n in candidates.filter("cell >= 0").groupBy("cell").agg(F.max("dist"), F.count("*")).collect():
        radius[cell], shards[cell] = r * (1 + 1e-9), -(-n // SHARD_ROWS)
    spread = F.coalesce(F.get(F.array(*[F.lit(int(s)) for s in shards]), F.col("cell")), F.lit(1)) if n_cells else F.lit(1)
    candidates = candidates.withColumn("shard", F.when(F.col("cell") >= 0, F.pmod(F.xxhash64("vec_id"), spread)).otherwise(0).cast("int"))
    homes = cut(placed(anchors, cells), "homes")
    # Blocks: cells next to each other, up to BLOCK anchors together; a larger cell has several.
    counts, block, start = dict(homes.filter("cell >= 0").groupBy("cell").count().collect()), 0, {}
    held = 0
    for cell in range(n_cells):
        n = counts.get(cell, 0)
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        start[cell] = (block, max(1, -(-n // BLOCK)))
        held += n
        if held >= BLOCK:
            block, held = block + start[cell][1], 0
    first = lambda k, other: F.coalesce(F.get(F.array(*[F.lit(int(start[c][k])) for c in range(n_cells)]), F.col("cell")), F.lit(other)) if n_cells else F.lit(other)
    own_block = F.when(F.col("cell") >= 0, first(0, 0) + F.pmod(F.xxhash64("vec_id", "label"), first(1, 1))).otherwise(-1).cast("long")
    homes = homes.select("vec_id", "label", "x", F.xxhash64("label", "x").alias("key"), own_block.alias("block"), F.col("cell").alias("home"))
    none = F.lit(None).cast("array<long>").alias("tops")
    found = cut(searched(asked(homes.select("*", none), cells, radius, shards, positives), candidates, positives), "positives")
    each = found.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("own"))  # positives of them at most
    with_tops = homes.join(each, (F.col("vec_id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))).select("vec_id", "label", "x", "key", "block", "home", F.col("own.score").alias("tops"))
    worse = searched(asked(with_tops, cells, radius, shards, negatives), candidates, negatives)
    named = found.select("anchor_id", "anchor_key", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = worse.join(named, ["anchor_id", "anchor_key", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
