"""Exact top-k inner products by Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

# Vectors in a block of candidates, and queries that meet it in one task: a candidate is sent once for each so many queries.
CANDIDATES = 8192
QUERIES = 16_384
# How far down the lists the first round goes; each round goes four times as far.
DEPTH = 8


class SortedLists:
    """A block of vectors with one list per dimension, sorted by that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.lists, axis=0)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores), best first, ties to smaller ids, without the row ``own``.

        Lists are read from the end that the query's sign prefers. No vector that has not come up in any list
        scores above the sum of the components where reading stands; once k scores are above that
        bound the rest need not be read. A score equal to the bound does not stop: the tie may go to a row not yet read.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.ids == own
        found = np.zeros(0, np.int64)
        scores = np.zeros(0, query.dtype)
        depth = min(DEPTH, n)
        while True:
            fresh = np.zeros(n, bool)
            fresh[self.lists[n - depth :, up]] = True
            fresh[self.lists[:depth, down]] = True
            fresh &= ~seen
            if depth == n:
                fresh = ~seen  # lists are read to the end, also those that no component of the query reads
            new = np.flatnonzero(fresh)
            seen |= fresh
            found = np.concatenate([found, new])
            scores = np.concatenate([scores, self.vectors[new] @ query])
            best = np.lexsort((found, -scores))[:k]  # by place, as ids are in order
            found, scores = found[best], scores[best]
            bound = query[up] @ self.values[n - depth, up] + query[down] @ self.values[depth - 1, down]
            if depth == n or seen.all() or len(found) == k and scores[-1] > bound:
                return self.ids[found], scores
            depth = min(4 * depth, n)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros; doubles while their products are exact, else integers."""
    flat = column.combine_chunks()
    ends = np.r_[0, np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))]
    row = np.repeat(np.arange(len(flat)), np.diff(ends))
    out = np.zeros((len(flat), dims), np.int64)
    out[row, np.arange(ends[-1]) - ends[row]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _search_blocks(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if candidates.num_rows and queries.num_rows:
            dims = max(pc.max(pc.list_value_length(t.column("vector"))).as_py() for t in (candidates, queries))
            vectors, wanted = _matrix(candidates.column("vector"), dims), _matrix(queries.column("vector"), dims)
            largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * max(dims, 1)
            kind = np.float64 if largest < 2**53 else np.int64
            lists = SortedLists(candidates.column("id").to_numpy(), vectors.astype(kind))
            for own, query in zip(queries.column("id").to_pylist(), wanted.astype(kind), strict=True):
                ids, scores = lists.search(query, own, k)
                out[0] += [own] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.astype(np.int64).tolist()
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return run


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    every: int = 50,
    scale: int = 256,
) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for every row whose id is divisible by ``every``.

    Components are floor(scale * x). Candidates are all rows but those of the query's id. Queries and
    candidates are hashed into blocks of bounded size and each pair of blocks is searched by the threshold algorithm; the
    k best of each block are merged, and no pair of rows below a block's best leaves its task.

    Returns ``query_id``, ``rank`` (from 1), the candidate's id and ``score``; ties go to the smaller id, and a query with
    fewer candidates has fewer rows. Rows with a null id, a null vector or a null or non-finite component take no part;
    rows equal in id and vector count once; if an id has several vectors each is a candidate, and of its queries the
    best scores stand. Shorter vectors are filled with zeros. Other columns are not looked at. Scores have to fit 64 bits.
    """
    x = F.col(f"`{vector_col}`")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull())
    rows = rows.where(usable).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), whole.alias("vector"))
    rows = durable(rows.dropDuplicates())
    asked = rows.where(F.col("id") % every == 0)
    n, q = rows.count(), asked.count()
    blocks, groups = max(1, -(-n // CANDIDATES)), max(1, -(-q // QUERIES))
    place = F.xxhash64("id", "vector")
    # Every block of candidates meets every block of queries, each in a task of its own.
    left = rows.select(
        "id", "vector", F.pmod(place, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    )
    right = asked.select(
        "id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(place, F.lit(groups)).alias("group")
    )
    right = right.select("id", "vector", F.col("block").cast("bigint"), F.col("group").cast("int"))
    left = left.select("id", "vector", F.col("block").cast("bigint"), F.col("group").cast("int"))
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(
        _search_blocks(k), "query_id bigint, vec_id bigint, score bigint"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
