"""Approximate nearest neighbours by inner product in robust-pruned directed graphs, one for each shard of the vectors.

Rows are dealt to shards by a hash. In a shard equal vectors are one node that names all their ids. Nodes join the graph in
batches that double: a greedy search from the entry, over the graph as it is, proposes neighbours of each; of those the nearest is kept and
whatever is nearer to it, by a factor ALPHA, than to the node goes, again and again, so that kept edges point different ways. Each
edge is also offered the other way, and a node with too many is pruned alike. A second pass does so over the finished graph.
Nodes that the entry doesn't reach get an edge from a node near them. The largest inner product is
the smallest distance once every vector has a component more that brings all to one length, so graphs are built by distance.

The graphs are a table of nodes (shard, vector, ids, neighbours). Queries meet every shard, in blocks of bounded bytes; a beam of BEAM
nodes is kept in each, and the shard's nearest rows, scored exactly, are ranked over all shards.

Shards hold a number of rows that grows with the square root of the table, as both too few and too many of them cost; one never exceeds SHARD_BYTES.

Defined cases: vectors null, empty, zero or holding null or non-finite components, and rows without an id, take no part; vectors of
different lengths are never compared; equal rows are one; rows that share an id but not a vector are queries of their own, and no row is found for
a query that shares its id; ties go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

NEAREST = 20
#: Edges that a node keeps.
DEGREE = 32
ALPHA = 1.2
#: Nodes that a search keeps while it builds, and while it answers; nodes that it opens at once.
BUILD_BEAM = 64
BEAM = 96
OPENED = 4
#: Vectors searched or added together.
TOGETHER = 256
#: Shards of n rows, if vectors are short: SHARDS * sqrt(n).
SHARDS = 1 / 16
SHARD_BYTES = 256 << 20
#: Bytes of queries that meet a shard in one task.
QUERY_BYTES = 128 << 20
QUERY_EVERY = 20


class Graph:
    """Nodes as rows of points, brought to one length by a last component, and their edges, padded by -1."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None):
        lengths = np.einsum("ij,ij->i", vectors, vectors)
        last = np.sqrt(np.maximum(lengths.max() - lengths, 0))
        self.points = np.concatenate([vectors, last[:, None]], 1).astype(np.float32)
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.entry = int(np.argmin(self._distances(self.points.mean(0, dtype=np.float64).astype(np.float32)[None], np.arange(len(vectors))[None])[0]))
        self.edges = np.full((len(vectors), DEGREE), -1, np.int32) if edges is None else edges

    def _distances(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances, less the square of each point itself, to nodes (a row of them for each point)."""
        return self.squares[nodes] - 2 * np.matmul(self.points[nodes], points[:, :, None])[:, :, 0]

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam nodes (-1 where there are fewer) nearest to each point that a greedy search finds, and their distances."""
        n = len(points)
        nodes = np.full((n, beam), -1, np.int64)
        near = np.full((n, beam), np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        nodes[:, 0], opened[:, 0] = self.entry, False
        near[:, :1] = self._distances(points, nodes[:, :1])
        seen = np.zeros((n, len(self.points) + 1), bool)  # its last column takes the padding
        seen[:, [self.entry, -1]] = True
        active = np.arange(n)
        while len(active):
            rows = active[:, None]
            first = np.argsort(opened[active], axis=1, kind="stable")[:, :OPENED]  # the beam is in order of distance
            fresh = ~opened[rows, first]
            opened[rows, first] = True
            found = self.edges[np.where(fresh, nodes[rows, first], 0)]
            found = np.sort(np.where(fresh[:, :, None], found, -1).reshape(len(active), -1), axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[rows, found]] = -1
            seen[rows, found] = True
            at = np.where(found < 0, np.float32(np.inf), self._distances(points[active], found))
            both, dist = np.concatenate([nodes[active], found], 1), np.concatenate([near[active], at], 1)
            done = np.concatenate([opened[active], found < 0], 1)
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            nodes[active], near[active], opened[active] = (np.take_along_axis(x, order, 1) for x in (both, dist, done))
            active = active[~opened[active].all(1)]
        return nodes, near

    def prune(self, of: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """DEGREE diverse neighbours at most of each node among its candidates (-1: none)."""
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == of[:, None]] = -1
        to = self._distances(self.points[of], candidates) + self.squares[of][:, None]
        left = np.where(candidates < 0, np.float32(np.inf), np.maximum(to, 0))
        points, squares = self.points[candidates], self.squares[candidates]
        between = squares[:, :, None] + squares[:, None] - 2 * np.matmul(points, points.transpose(0, 2, 1))
        to, rows = left.copy(), np.arange(len(of))
        kept = np.full((len(of), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            best = np.argmin(left, axis=1)
            some = np.isfinite(left[rows, best])
            if not some.any():
                break
            kept[some, k] = candidates[some, best[some]]
            left[(ALPHA**2 * between[rows, best] <= to) & some[:, None]] = np.inf
            left[rows, best] = np.inf
        return kept

    def _offer(self, to: np.ndarray, nodes: np.ndarray) -> None:
        """Edges from each of to to each of nodes, DEGREE of them a node at a time, pruned where there are too many."""
        order = np.lexsort((nodes, to))
        to, nodes = to[order], nodes[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        place = np.arange(len(to)) - np.repeat(starts, np.diff(np.r_[starts, len(to)]))
        for turn in range(int(place.max(initial=-1)) // DEGREE + 1):
            now = place // DEGREE == turn
            of, row = np.unique(to[now], return_inverse=True)
            offered = np.full((len(of), DEGREE), -1, np.int64)
            offered[row, place[now] % DEGREE] = nodes[now]
            for k in range(0, len(of), TOGETHER):
                self.edges[of[k : k + TOGETHER]] = self.prune(of[k : k + TOGETHER], np.concatenate([self.edges[of[k : k + TOGETHER]], offered[k : k + TOGETHER]], 1))

    def build(self) -> Graph:
        n = len(self.points)
        order = np.random.default_rng(n).permutation(n)
        for again in (False, True):
            done = 0
            while done < n:
                batch = order[done : done + min(TOGETHER, n if again else max(1, done))]
                near, _ = self.search(self.points[batch], BUILD_BEAM)
                kept = self.prune(batch, np.concatenate([near, self.edges[batch]], 1))
                self.edges[batch] = kept
                row, column = np.nonzero(kept >= 0)
                self._offer(kept[row, column].astype(np.int64), batch[row])
                done += len(batch)
        return self._connect()

    def _reached(self) -> np.ndarray:
        reached, front = np.zeros(len(self.points), bool), np.array([self.entry])
        while len(front):
            reached[front] = True
            after = np.unique(self.edges[front])
            front = after[(after >= 0) & ~reached[after]]
        return reached

    def _connect(self) -> Graph:
        """An edge more, in columns beside the others, to each node that the entry doesn't reach, from the nearest that it does."""
        while len(lost := np.flatnonzero(~self._reached())):
            lost = lost[:TOGETHER]
            hosts = self.search(self.points[lost], 1)[0][:, 0]
            order = np.argsort(hosts, kind="stable")
            hosts, lost = hosts[order], lost[order]
            starts = np.flatnonzero(np.r_[True, hosts[1:] != hosts[:-1]])
            first = hosts[starts]  # a host takes one node a round: others may be reached through it
            column = np.full((len(self.points), 1), -1, np.int32)
            column[first, 0] = lost[starts]
            free = (self.edges < 0).any(1)
            slot = np.argmax(self.edges < 0, axis=1)
            self.edges[first[free[first]], slot[first[free[first]]]] = column[first[free[first]], 0]
            column[first[free[first]]] = -1
            if (column >= 0).any():
                self.edges = np.concatenate([self.edges, column], 1)
        return self


def _matrix(column: pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(lists), -1)


def _shard_graph(table: pa.Table) -> pa.Table:
    """The graph of one shard: a row a node."""
    order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
    ids, vectors = table["vec_id"].to_numpy()[order], _matrix(table["vector"])[order]
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    node = node.reshape(-1)
    by_node = np.argsort(node, kind="stable")
    bounds = np.r_[0, np.cumsum(np.bincount(node, minlength=len(distinct)))].astype(np.int32)
    edges = Graph(distinct).build().edges
    counts = np.r_[0, np.cumsum((edges >= 0).sum(1))].astype(np.int32)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    columns = {
        "dim": pa.array([table["dim"][0].as_py()] * len(distinct), pa.int32()),
        "shard": pa.array([table["shard"][0].as_py()] * len(distinct), pa.int32()),
        "node": pa.array(np.arange(len(distinct)), pa.int32()),
        "vector": lists(np.arange(len(distinct) + 1) * distinct.shape[1], pa.array(distinct.ravel())),
        "ids": lists(bounds, pa.array(ids[by_node])),
        "neighbours": lists(counts, pa.array(edges[edges >= 0].astype(np.int32))),
    }
    return pa.table(columns)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last: equal vectors give equal sums."""
    total = np.zeros(a.shape[:-1])
    for j in range(a.shape[-1]):
        total += a[..., j] * b[..., j]
    return total


def _answers(nearest: int, beam: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def answer(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        """(query, query_id, vec_id, score): the nearest rows of a shard for each query of a block."""
        out = [pa.table({"query_id": pa.array([], pa.int64()), "query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if not len(nodes) or not len(queries):
            return out[0]
        nodes = nodes.sort_by("node")
        vectors, ids = _matrix(nodes["vector"]), nodes["ids"].combine_chunks()
        near = nodes["neighbours"].combine_chunks()
        starts, values, all_ids, id_starts = near.offsets.to_numpy(), near.values.to_numpy(), ids.values.to_numpy(), ids.offsets.to_numpy()
        degrees = np.diff(starts)
        edges = np.full((len(vectors), max(1, degrees.max())), -1, np.int32)
        edges[np.repeat(np.arange(len(vectors)), degrees), np.arange(starts[0], starts[-1]) - np.repeat(starts[:-1], degrees)] = values[starts[0] : starts[-1]]
        graph, asked, number, wanted = Graph(vectors, edges), queries["query_id"].to_numpy(), queries["query"].to_numpy(), _matrix(queries["vector"])
        points = np.concatenate([wanted, np.zeros((len(wanted), 1))], 1).astype(np.float32)
        for k in range(0, len(wanted), TOGETHER):
            found, _ = graph.search(points[k : k + TOGETHER], beam)
            score = np.where(found < 0, -np.inf, _inner(vectors[found], wanted[k : k + TOGETHER][:, None]))
            row, column = np.nonzero(found >= 0)
            node, score = found[row, column], score[row, column]
            # a node's first ids are enough: one of them may be the query's own
            copies = np.minimum(id_starts[node + 1] - id_starts[node], nearest + 1)
            at = np.repeat(np.arange(len(node)), copies)
            vec = all_ids[id_starts[node][at] + np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)]
            row, score = row[at], score[at]
            keep = vec != asked[k + row]
            row, vec, score = row[keep], vec[keep], score[keep]
            order = np.lexsort((vec, -score, row))
            row, vec, score = row[order], vec[order], score[order]
            first = np.searchsorted(row, np.arange(TOGETHER))
            keep = np.arange(len(row)) - first[row] < nearest
            row = k + row[keep]
            out.append(pa.table({"query_id": asked[row], "query": number[row], "vec_id": vec[keep], "score": score[keep]}))
        return pa.concat_tables(out)

    return answer


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, vector, dim) of the rows that take part, each once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id", "vector").agg(F.size("vector").alias("dim"))


def build(rows: DataFrame) -> DataFrame:
    """The graphs of all shards as (dim, shard, node, vector, ids, neighbours)."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    shards = F.greatest(F.ceil(F.sqrt("n") * SHARDS), F.ceil(F.col("n") * F.col("dim") * 8 / SHARD_BYTES), F.lit(1))
    sizes = sizes.select("dim", shards.cast("int").alias("shards"))
    tasks = sizes.agg(F.sum("shards")).first()[0] or 1
    rows = rows.join(sizes, "dim")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards")).cast("int")).drop("shards")
    # Shards are small to shuffle but dear to build: their number of partitions is set, or a few tasks would build them all.
    return rows.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(_shard_graph, "dim int, shard int, node int, vector array<double>, ids array<long>, neighbours array<int>")


def search(scratch: Scratch, index: DataFrame, queries: DataFrame, nearest: int = NEAREST, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the rows nearest to each query of (vec_id, vector, dim), from the graphs in index."""
    shards = index.select("dim", F.expr("shard + 0").alias("shard")).distinct()
    blocks = queries.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.col("dim") * 8 / QUERY_BYTES)).cast("int").alias("blocks"))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "vector").alias("query"), "vector", "dim").join(blocks, "dim")
    asked = asked.withColumn("block", F.pmod("query", F.col("blocks")).cast("int")).drop("blocks").join(shards, "dim")
    nodes = index.join(blocks, "dim").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    key = ["dim", "shard", "block"]
    found = nodes.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_answers(nearest, beam), "query_id long, query long, vec_id long, score double")
    found = scratch.keep(found, "found")
    # rows of one id with different vectors are one neighbour: the better of them
    found = found.groupBy("query_id", "query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the NEAREST rows found for every row whose id is divisible by QUERY_EVERY."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = scratch.keep(usable(vectors, column), "rows")
    index = scratch.keep(build(rows), "graphs")
    return search(scratch, index, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
