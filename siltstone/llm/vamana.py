"""Approximate nearest neighbours by a robust-pruned directed graph in every shard, searched by beams.

Equal vectors are one node, which keeps its smallest ids (one more than an answer needs, so that nothing is lost);
that step prunes before it shuffles, and no hot vector gathers in a task. Nodes are dealt to shards by a hash: to
``SHARDS`` of them, so that several tasks build, with at least ``LEAST_ROWS`` rows each; beyond ``SHARDS * shard_rows``
rows, to shards of about ``shard_rows``. A larger shard needs a wider ``beam`` for the same recall. Each shard builds its graph in one task: points are inserted in batches that double; for
each, greedy searches from the shard's medoid propose neighbours (all points that a search visits), and relaxed
pruning keeps the nearest p and drops any candidate c with alpha * d(p, c) <= d(point, c), again and again, so that
kept edges are diverse. Kept edges are added backwards, and a node that overflows is pruned in the same way.

Every query is searched in every shard by a beam search of width ``beam``; shards answer with their best nodes, whose
exact distances, in double precision on the original vectors, decide the answer. A shard's graph, its vectors and a
block of queries are all that a task holds, about 1 KB a row at 64 dimensions. Work grows with rows times
log(shard_rows) to build, and with queries times shards to search; shards grow with rows / ``shard_rows`` only.

Graphs are in single precision over rows moved to their shard's centre and scaled to its extent, so vectors may be of any
finite magnitude; where rows of a shard differ too much in it, or a query lies far from all of a shard, that shard is compared
in full.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as queries or as
candidates; neither do rows with a null vec_id. Vectors of different lengths never meet. Ties in distance go to the
smaller vec_id. Rows that repeat a vec_id with an equal vector are one row. A query with fewer candidates than k gets
them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.shipping import ship
from siltstone.llm.common import cut

SHARD_ROWS, SHARDS, LEAST_ROWS = 1 << 15, 8, 2048
DEGREE, ALPHA, BUILD_BEAM, BEAM = 32, 1.2, 64, 192
SCHEMA = "query_id long, vec_id long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] to b[i, j]; float32 in, float32 out."""
    d = b - a[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


class Graph:
    """A directed graph over the rows of x; edges[i] holds a node's neighbours, -1 where there's none."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM):
        self.x, self.degree, self.alpha = x, degree, alpha
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        order = np.random.default_rng(n).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        done, size = 1, 1
        while done < n:
            batch = order[done : done + size]
            _, _, seen = self.search(x[batch], beam, visits=True)
            fresh = np.broadcast_to(batch[None, :], (len(batch), len(batch)))[:, :64] if len(batch) <= 64 else None
            found = seen if fresh is None else np.concatenate([seen, fresh], 1)
            self.edges[batch] = self.prune(batch, found)
            self.link_back(batch)
            done += len(batch)
            size = min(size * 2, 512)

    def prune(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Of each node's candidates (-1: none), the diverse ones."""
        x = self.x
        d = distances(x[nodes], x[np.maximum(found, 0)])
        d[(found < 0) | (found == nodes[:, None])] = np.inf
        width = min(found.shape[1], 4 * self.degree)
        near = np.argsort(d, 1, kind="stable")[:, :width]
        found, d = np.take_along_axis(found, near, 1), np.take_along_axis(d, near, 1)
        same = (found[:, 1:] == found[:, :-1]) & (d[:, 1:] == d[:, :-1])
        d[:, 1:][same] = np.inf
        out = np.full((len(nodes), self.degree), -1, np.int32)
        held = x[np.maximum(found, 0)]
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            best = d.argmin(1)
            ok = np.isfinite(d[rows, best])
            if not ok.any():
                break
            out[ok, k] = found[rows, best][ok]
            to = distances(held[rows, best], held)
            d[self.alpha**2 * to <= d] = np.inf
            d[rows, best] = np.inf
        return out

    def link_back(self, nodes: np.ndarray) -> None:
        """Add the reverse of the nodes' edges; prune who overflows."""
        to = self.edges[nodes]
        ok = to >= 0
        ends, begins = to[ok], np.repeat(nodes, ok.sum(1))
        order = np.argsort(ends, kind="stable")
        ends, begins = ends[order], begins[order]
        targets, first, counts = np.unique(ends, return_index=True, return_counts=True)
        more = np.full((len(targets), counts.max(initial=0)), -1, np.int32)
        more[np.repeat(np.arange(len(targets)), counts), np.arange(len(ends)) - np.repeat(first, counts)] = begins
        both = np.concatenate([self.edges[targets], more], 1)
        known = (more[:, :, None] == self.edges[targets][:, None, :]).any(2)
        both[:, self.degree :][known] = -1
        n = (both >= 0).sum(1)
        fits = n <= self.degree
        packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)
        self.edges[targets[fits]] = packed[fits, : self.degree]
        for at in range(0, (~fits).sum(), 2048):
            rows = np.flatnonzero(~fits)[at : at + 2048]
            width = n[rows].max()
            self.edges[targets[rows]] = self.prune(targets[rows], packed[rows, :width])

    def search(self, q: np.ndarray, beam: int, visits: bool = False, step: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Beam search for every row of q: nodes and squared distances, nearest first, and all nodes that it expanded."""
        m = len(q)
        ids = np.full((m, beam), -1, np.int32)
        d = np.full((m, beam), np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], open_[:, 0] = self.start, True
        d[:, 0] = distances(q, self.x[ids[:, :1]])[:, 0]
        seen: list[np.ndarray] = []
        live = np.arange(m)
        while len(live):
            di = np.where(open_[live], d[live], np.inf)
            pick = np.argpartition(di, step - 1, 1)[:, :step] if beam > step else np.broadcast_to(np.arange(beam), (len(live), beam)).copy()
            ok = np.isfinite(np.take_along_axis(di, pick, 1))
            some = ok.any(1)
            live, pick, ok = live[some], pick[some], ok[some]
            if not len(live):
                break
            rows = live[:, None]
            nodes = np.where(ok, ids[rows, pick], -1)
            if visits:
                held = np.full((m, pick.shape[1]), -1, np.int32)
                held[live] = nodes
                seen.append(held)
            flat = open_[live]
            np.put_along_axis(flat, pick, False, 1)
            open_[live] = flat
            near = np.where(nodes[:, :, None] >= 0, self.edges[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            near = np.sort(near, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near[:, :, None] == ids[live][:, None, :]).any(2)] = -1
            dn = distances(q[live], self.x[np.maximum(near, 0)])
            dn[near < 0] = np.inf
            all_ids, all_d = np.concatenate([ids[live], near], 1), np.concatenate([d[live], dn], 1)
            all_open = np.concatenate([open_[live], near >= 0], 1)
            keep = np.argsort(all_d, 1, kind="stable")[:, :beam]
            ids[live], d[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_d, keep, 1)
            open_[live] = np.take_along_axis(all_open, keep, 1) & np.isfinite(d[live])
        found = None
        if visits:
            found = np.concatenate([ids, *seen], 1) if seen else ids
            found = np.sort(found, 1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return ids, d, found


#: Spread of the middle half of a shard's rows, against its whole extent, below which single precision can't tell them apart;
#: extents of the shard at which a query lies too far out for it.
FINE, OUT = 1e-3, 1e3


def euclidean(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of rows to v; by differences scaled to their largest where the squares of a double can't hold them."""
    with np.errstate(all="ignore"):
        d = x - v
        out = np.sqrt((d**2).sum(1))
        odd = ~np.isfinite(out) | (out < 1e-140)
        if odd.any():
            # Halves, as a difference of two doubles may be beyond doubles itself.
            d = x[odd] / 2 - v / 2
            most = np.abs(d).max(1, initial=0.0)
            unit = np.where(most > 0, most, 1.0)
            out[odd] = np.sqrt(((d / unit[:, None]) ** 2).sum(1)) * unit * 2
    return out


class Shard:
    """A shard's rows in double precision, and their graph in single precision: moved to their centre and scaled to their extent.

    Where the scaled rows are too close to each other for single precision (a few rows may lie far out), or a query lies far
    out, the shard is compared with the query in full.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.most = x, float(np.abs(x).max()) or 1.0
        scaled = x / self.most
        self.centre = scaled.mean(0)
        moved = scaled - self.centre
        self.extent = float(np.abs(moved).max()) or 1.0
        moved /= self.extent
        low, high = np.quantile(moved, [0.25, 0.75], axis=0)
        self.graph = Graph(moved.astype(np.float32)) if (high - low).max() >= FINE else None

    def nearest(self, q: np.ndarray, beam: int) -> list[np.ndarray]:
        """For each query the rows that may be nearest: those of a beam, or all."""
        with np.errstate(all="ignore"):
            moved = (q / self.most - self.centre) / self.extent
        near = np.abs(moved).max(1) <= OUT  # false for what isn't finite, too
        out: list[np.ndarray] = [np.arange(len(self.x))] * len(q)
        if self.graph is not None and near.any():
            ids, _, _ = self.graph.search(moved[near].astype(np.float32), beam)
            for i, found in zip(np.flatnonzero(near), ids):
                out[i] = found[found >= 0]
        return out


def take_part(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of doubles) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return held.filter(F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0))


def search(vectors: DataFrame, every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by every."""
    ship(vectors.sparkSession)
    held = take_part(vectors)
    # Equal vectors are one node with its k + 1 smallest ids; the rank filter prunes each task's rows before the shuffle.
    place = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    few = held.dropDuplicates(["vec_id", "embedding"]).withColumn("place", place).filter(F.col("place") <= k + 1)
    nodes = cut(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    count = nodes.count()
    shards = max(1, min(SHARDS, count // LEAST_ROWS), -(-count // shard_rows))
    dealt = nodes.withColumn("shard", F.struct(F.size("embedding").alias("length"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).alias("at")))
    queries = held.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"])
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    asked = queries.withColumn("at", at).select(F.struct(F.size("embedding").alias("length"), F.col("at")).alias("shard"), "vec_id", "embedding")

    def answer(key, own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if own.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = own.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        x = np.array(own["embedding"].tolist(), np.float64)
        members = own["ids"].tolist()
        shard = Shard(x)
        names, vs = queries["vec_id"].to_numpy(np.int64), np.array(queries["embedding"].tolist(), np.float64)
        out = []
        for at in range(0, len(vs), 256):
            q = vs[at : at + 256]
            for name, v, found in zip(names[at : at + 256], q, shard.nearest(q, beam)):
                exact = euclidean(x[found], v)
                if len(found) > 4 * beam:  # all rows: those as near as the k-th at most, one node more for the query's own
                    few = exact <= np.partition(exact, k)[k]
                    found, exact = found[few], exact[few]
                pairs = [(s, m) for s, i in zip(exact.tolist(), found) for m in members[i] if m != name]
                out += [(name, m, s) for s, m in sorted(pairs)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(answer, SCHEMA)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
