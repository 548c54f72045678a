"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, scratch_path

# Distinct vectors in a shard on average, and queries that meet a shard in one task.
SHARD = 8192
QUERIES = 16_384
# Links of a node on the upper layers, twice as many on the lowest; candidates a link is chosen from; places of a search's beam.
DEGREE = 16
CANDIDATES = 64
BEAM = 128
# Nodes inserted at once, queries searched at once, and nodes of its beam that a query looks at in one step.
BATCH = 256
WIDTH = 4


# --- one shard ------------------------------------------------------------------------------------------------


def _diverse(scores: np.ndarray, among: np.ndarray, degree: int) -> np.ndarray:
    """Which candidates of each node become its links, as a mask.

    ``scores`` (nodes x candidates) are their products with the node, best first, ``among`` (nodes x candidates x candidates)
    those with one another. A candidate nearer to a chosen one than to the node is put off; what places are left go to the
    nearest that were. Candidates that are not there have score minus infinity.
    """
    there = np.isfinite(scores)
    chosen = np.zeros(scores.shape, bool)
    nearest = np.full(scores.shape, -np.inf)
    for c in range(scores.shape[1]):
        take = there[:, c] & (nearest[:, c] < scores[:, c]) & (chosen.sum(1) < degree)
        chosen[:, c] = take
        nearest = np.where(take[:, None], np.maximum(nearest, among[:, c]), nearest)
    left = degree - chosen.sum(1, keepdims=True)
    rest = there & ~chosen
    return chosen | rest & (np.cumsum(rest, 1) <= left)


def _link(points: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int) -> np.ndarray:
    """Links of ``nodes`` chosen from ``found`` (nodes x candidates, -1 for none, each at most once), -1 for none."""
    own = points[found] * (found >= 0)[:, :, None]
    scores = np.einsum("nd,ncd->nc", points[nodes], own)
    scores[found < 0] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")
    found, scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
    own = np.take_along_axis(own, order[:, :, None], 1)
    mask = _diverse(scores, own @ own.transpose(0, 2, 1), degree)
    links = np.full((len(nodes), degree), -1, np.int32)
    row, col = np.nonzero(mask)
    links[row, np.cumsum(mask, 1)[row, col] - 1] = found[row, col]
    return links


def build_layer(points: np.ndarray, degree: int, candidates: int = CANDIDATES) -> np.ndarray:
    """Links of all points (points x degree, -1 for none), inserted one batch after another.

    A new point chooses its links from the nearest of those inserted before and, within a batch, of those next to it; they are
    found by a product of matrices, which for the size of a shard costs less than a search. Each point that is chosen
    takes a link back and, with too many, chooses anew. So early points keep far links, as the graph needs them.
    """
    n = len(points)
    links = np.full((n, degree), -1, np.int32)
    start = 0
    while start < n:
        stop = min(n, start + max(1, min(start, BATCH)))
        nodes = np.arange(start, stop)
        scores = points[start:stop] @ points[:stop].T
        scores[np.arange(stop - start), nodes] = -np.inf
        best = min(candidates, stop)
        found = np.argpartition(-scores, best - 1, axis=1)[:, :best].astype(np.int32)
        found[~np.isfinite(np.take_along_axis(scores, found, 1))] = -1
        links[start:stop] = _link(points, nodes, found, degree)
        # Links back, each at most once for a pair.
        of, to = np.nonzero(links[start:stop] >= 0)
        target, back = links[start + of, to], (start + of).astype(np.int32)
        fresh = ~(links[target] == back[:, None]).any(1)
        target, back = target[fresh], back[fresh]
        order = np.argsort(target, kind="stable")
        target, back = target[order], back[order]
        changed, first, counts = np.unique(target, return_index=True, return_counts=True)
        if len(changed):
            offered = np.full((len(changed), int(counts.max())), -1, np.int32)
            row = np.repeat(np.arange(len(changed)), counts)
            offered[row, np.arange(len(target)) - first[row]] = back
            for a in range(0, len(changed), BATCH):
                some = changed[a : a + BATCH]
                both = np.concatenate([links[some], offered[a : a + BATCH]], 1)
                full = (both >= 0).sum(1) > degree
                fit = np.sort(both[~full], 1)[:, ::-1][:, :degree]
                links[some[~full]] = np.pad(fit, ((0, 0), (0, degree - fit.shape[1])), constant_values=-1)
                if full.any():
                    links[some[full]] = _link(points, some[full], both[full], degree)
        start = stop
    return links


class Graph:
    """Layers of links over vectors in insertion order: layer l holds the first ``sizes[l]`` of them, the lowest all."""

    def __init__(self, vectors: np.ndarray, sizes: list[int], layers: list[np.ndarray]) -> None:
        self.vectors, self.sizes, self.layers = vectors, sizes, layers

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE) -> Graph:
        """Vectors that are in a random order make the layers: every ``degree``-th part of them is one layer further up.

        For links all vectors get one more component that brings them to equal length, so that the largest inner product is also
        the smallest angle (Bachrach et al., 2014); queries have zero there.
        """
        squares = np.einsum("nd,nd->n", vectors, vectors)
        rest = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))
        points = np.concatenate([vectors, rest[:, None]], 1).astype(np.float32)
        sizes = [len(vectors)]
        while sizes[-1] > degree:
            sizes.append(-(-sizes[-1] // degree))
        layers = [build_layer(points[:size], degree if level else 2 * degree) for level, size in enumerate(sizes)]
        return cls(vectors.astype(np.float32), sizes, layers)

    def flat(self) -> np.ndarray:
        """All links as one array, layer after layer, -1 for none."""
        return np.concatenate([layer.ravel() for layer in self.layers])

    @classmethod
    def stored(cls, vectors: np.ndarray, sizes: list[int], flat: np.ndarray) -> Graph:
        layers, at = [], 0
        degree = len(flat) // (sum(sizes) + sizes[0])  # the lowest layer has twice the links
        for level, size in enumerate(sizes):
            width = degree if level else 2 * degree
            layers.append(flat[at : at + size * width].reshape(size, width))
            at += size * width
        return cls(vectors, sizes, layers)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes found for each query, best first, -1 for none, and their products."""
        queries = queries.astype(np.float32)
        # The top layer is no larger than a node's links: all of it is looked at.
        top = min(self.sizes[-1], beam)
        nodes = np.tile(np.arange(top, dtype=np.int32), (len(queries), 1))
        for level in range(len(self.sizes) - 1, -1, -1):
            # On the way down a few best nodes are enough; on the lowest layer the beam is full.
            nodes, scores = self._layer(queries, nodes, self.layers[level], self.sizes[level], beam if level == 0 else max(8, beam // 8))
        return nodes, scores

    def _layer(self, queries: np.ndarray, start: np.ndarray, links: np.ndarray, size: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = len(queries)
        everyone = np.arange(q)[:, None]
        seen = np.zeros((q, size + 1), bool)  # the last column stands for no node
        seen[everyone, start] = True
        seen[:, size] = True
        nodes = np.full((q, beam), size, np.int32)
        scores = np.full((q, beam), -np.inf, np.float32)
        width = min(beam, start.shape[1])
        first = np.where(start >= 0, start, size)[:, :width]
        nodes[:, :width] = first
        scores[:, :width] = np.where(first < size, np.einsum("qd,qcd->qc", queries, self.vectors[np.minimum(first, size - 1)]), -np.inf)
        done = nodes == size
        while True:
            # The best nodes of the beam that have not been looked at; queries with none are finished.
            open_scores = np.where(done, -np.inf, scores)
            live = np.flatnonzero((~done).any(1))
            if not len(live):
                break
            pick = np.argsort(-open_scores[live], axis=1, kind="stable")[:, :WIDTH]
            rows = live[:, None]
            usable = ~done[rows, pick]
            done[rows, pick] = True
            near = links[np.minimum(nodes[rows, pick], size - 1)].reshape(len(live), -1)
            near = np.where((near >= 0) & np.repeat(usable, links.shape[1], axis=1), near, size)
            near = np.where(seen[rows, near], size, near)
            # A node that several of the picked ones link to counts once.
            order = np.sort(near, 1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = size
            near = order
            seen[rows, near] = True
            products = np.einsum("qd,qcd->qc", queries[live], self.vectors[np.minimum(near, size - 1)])
            products[near == size] = -np.inf
            all_nodes = np.concatenate([nodes[live], near], 1)
            all_scores = np.concatenate([scores[live], products], 1)
            all_done = np.concatenate([done[live], near == size], 1)
            keep = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
            nodes[live] = np.take_along_axis(all_nodes, keep, 1)
            scores[live] = np.take_along_axis(all_scores, keep, 1)
            done[live] = np.take_along_axis(all_done, keep, 1)
        order = np.argsort(-scores, axis=1, kind="stable")
        nodes, scores = np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)
        return np.where(nodes == size, -1, nodes), scores


# --- shards as rows --------------------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    flat = column.combine_chunks()
    ends = np.r_[0, np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))]
    lengths = np.diff(ends)
    out = np.zeros((len(flat), max(int(lengths.max(initial=0)), dims or 0)))
    row = np.repeat(np.arange(len(flat)), lengths)
    out[row, np.arange(ends[-1]) - ends[row]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


GRAPH = "shard bigint, ids array<array<bigint>>, dims int, vectors array<double>, sizes array<int>, links array<int>"


def _build_shard(degree: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("place", "ascending"), ("least", "ascending")])
        vectors = _matrix(rows.column("vector"))
        graph = Graph.build(vectors, degree)
        names = ["shard", "ids", "dims", "vectors", "sizes", "links"]
        columns = [
            pa.array([rows.column("shard")[0].as_py()], pa.int64()),
            pa.array([rows.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            pa.array([vectors.shape[1]], pa.int32()),
            pa.array([vectors.ravel()], pa.list_(pa.float64())),
            pa.array([graph.sizes], pa.list_(pa.int32())),
            pa.array([graph.flat()], pa.list_(pa.int32())),
        ]
        return pa.Table.from_arrays(columns, names)

    return run


def build_index(nodes: DataFrame, shards: int, degree: int = DEGREE) -> DataFrame:
    """One row per shard with its vectors, the ids of each and the links as a flat array, written to the shared folder.

    ``nodes`` has ``vector`` and ``ids``. Vectors are dealt to shards and put in insertion order by hash.
    """
    place = F.xxhash64("vector")
    rows = nodes.select("vector", "ids", F.pmod(place, F.lit(shards)).alias("shard"), F.xxhash64(place, F.lit(1)).alias("place"), F.col("ids")[0].alias("least"))
    path = scratch_path(nodes.sparkSession, "graphs")
    built = rows.groupBy("shard").applyInArrow(_build_shard(degree), GRAPH)
    built.write.option("parquet.block.size", 16 << 20).parquet(path)
    return nodes.sparkSession.read.parquet(path)


def _search_shard(k: int, beam: int):
    names = ["query_id", "vec_id", "score"]

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if index.num_rows and queries.num_rows:
            dims = index.column("dims")[0].as_py()
            wanted = _matrix(queries.column("vector"), dims)
            vectors = index.column("vectors").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if wanted.shape[1] > dims:  # a longer query's further components meet zeros
                wanted = wanted[:, :dims]
            ids = index.column("ids")[0].as_py()
            graph = Graph.stored(
                vectors.astype(np.float32), index.column("sizes")[0].as_py(), index.column("links").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            )
            own_ids = queries.column("id").to_pylist()
            for a in range(0, len(own_ids), BATCH):
                some = wanted[a : a + BATCH]
                nodes, _ = graph.search(some, max(beam, 2 * k))
                for own, query, found in zip(own_ids[a : a + BATCH], some, nodes, strict=True):
                    found = found[found >= 0]
                    if len(found) <= k and len(found) < len(vectors):
                        found = np.arange(len(vectors))  # parts out of reach: the few cases are done in full
                    scores = (vectors[found] * query).sum(1)
                    # Every node has one id at least that is not the query's own, but for its own node.
                    keep = found[np.argsort(-scores, kind="stable")[: k + 1]]
                    hits = [(-s, i) for s, n in zip((vectors[keep] * query).sum(1), keep.tolist(), strict=True) for i in ids[n] if i != own]
                    for s, i in sorted(hits)[: k]:
                        out[0].append(own)
                        out[1].append(i)
                        out[2].append(-s)
        columns = [pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
        return pa.Table.from_arrays(columns, names)

    return run


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    every: int = 20,
    beam: int = BEAM,
    degree: int = DEGREE,
    shard: int = SHARD,
) -> DataFrame:
    """The ``k`` rows found nearest, by largest inner product, for every row whose id is divisible by ``every``.

    Distinct vectors are hashed to shards of about ``shard``; each shard is a graph of its own, stored as a row of flat arrays, and
    every query searches every shard with a beam of ``beam``; the k best of each shard are merged. The result is approximate: a
    wider beam finds more. Scores are inner products of the original vectors in double precision. Every row is indexed: rows of equal
    vectors share a node, which needs only their ``k`` + 1 smallest ids, since no others can be among the k nearest of any query.

    Returns ``query_id``, ``rank`` (from 1), the candidate's id and ``score``, nearest first, ties to the smaller id; a query with
    fewer candidates has fewer rows. Rows with a null id and vectors that are null, empty, zero or hold a null or non-finite component
    take no part; rows equal in id and vector count once; if an id has several vectors each is a candidate and of its
    queries the best scores stand. Shorter vectors are filled with zeros. Other columns are not looked at. An empty table
    gives an empty result.
    """
    x = F.col(f"`{vector_col}`")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull()).where(usable)
    rows = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), x.cast("array<double>").alias("vector"))
    # Equal rows are gone with the window: of each vector the smallest distinct ids stay.
    order = Window.partitionBy("vector").orderBy("id")
    alike = rows.select("id", "vector", F.dense_rank().over(order).alias("nth")).where(F.col("nth") <= k + 1)
    nodes = durable(alike.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    asked = durable(rows.where(F.col("id") % every == 0).dropDuplicates())
    n, q = nodes.count(), asked.count()
    shards, groups = max(1, -(-n // shard)), max(1, -(-q // QUERIES))
    index = build_index(nodes, shards, degree)
    left = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    right = asked.select(
        "id",
        "vector",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"),
        F.pmod(F.xxhash64("id", "vector"), F.lit(groups)).cast("int").alias("group"),
    )
    found = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(
        _search_shard(k, beam), "query_id bigint, vec_id bigint, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
