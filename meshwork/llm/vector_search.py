"""Exact top-k search by inner product with dual-tree cover-tree search.

Vectors become integers, floor(256 x). The candidates of a task go into cover trees, the queries
into another, whose leaves are small. Of all node pairs the one with the best bound comes next, so near
candidates are met first and each query group's worst k-th score rises early. The inner product of any
query and candidate under two nodes is at most

    c_q.c_d + r_q |c_d| + r_d |c_q| + r_q r_d        (c centre, r covering radius)

and at most the product of their longest vectors' lengths; a pair is pruned when the smaller of both is below
the worst k-th score of the queries under the query node. Where a pair of leaves remains, all their scores are
computed at once.

Queries are sent to the tasks in blocks of at most ``BLOCK`` vectors, one pass over the candidates
each, so nothing unbounded is broadcast; each task returns at most k rows per query, and a ranking
per query merges them. Scores are exact: doubles while every sum stays below 2^53, else 64-bit
integers.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as filled up with zeros; rows with one vec_id are separate candidates, none of them
for a query of that id; of query rows with one vec_id the least vector asks; ties go to the
smaller vec_id; a null vec_id takes no part; an empty table gives no rows. Scores are 64-bit:
components are taken to be small enough (2^28 for 64 of them) for their products' sum.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import cut

BLOCK = 16_384
#: Rows of a leaf, and of a child, at least, of candidates' and of queries' trees.
LEAF, SMALL = 128, 16
QUERY_LEAF, QUERY_SMALL = 4, 1
TRIES = 64
TREE = 8_192
_BASE = 1.5


class Node:
    """centre, covering radius, longest vector's length (top), rows of a leaf or children, parent; worst: k-th scores can't be below it."""

    __slots__ = ("centre", "norm", "radius", "top", "rows", "children", "parent", "worst")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: int, radius: float):
        self.centre, self.radius, self.rows = points[centre], radius, rows
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.top = float(np.sqrt(np.einsum("ij,ij->i", points[rows], points[rows]).max()))
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.worst = -np.inf

    def add(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)


def cover_tree(points: np.ndarray, leaf: int = LEAF, small: int = SMALL, rows: np.ndarray | None = None, centre: int | None = None) -> Node:
    """Children cover rows within 1 / _BASE of their parent's radius; a centre is its own first child. Rows so far from others that they make no child of ``small`` rows stay in leaves around their parent's centre."""
    rows = np.arange(len(points)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    away = _distance(points, rows, centre)
    node = Node(points, rows, centre, float(away.max()))
    if len(rows) <= leaf or node.radius == 0:
        return node
    reach, left, at, loose = node.radius / _BASE, np.arange(len(rows)), centre, []
    for _ in range(TRIES):
        near = _distance(points, rows[left], at) <= reach
        if small <= near.sum() < len(rows):
            node.add(cover_tree(points, leaf, small, rows[left[near]], at))
        else:
            loose.append(left[near])
        left = left[~near]
        if not len(left):
            break
        at = int(rows[left[0]])
    loose = np.concatenate([*loose, left])
    loose = loose[np.argsort(away[loose], kind="stable")]
    for i in range(0, len(loose), leaf):
        some = loose[i : i + leaf]
        node.add(Node(points, rows[some], centre, float(away[some].max())))
    return node


def _distance(points: np.ndarray, rows: np.ndarray, centre: int) -> np.ndarray:
    apart = points[rows] - points[centre]
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


class Search:
    """The k best candidates of each query, over any number of trees of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.exact = vectors
        self.points = vectors.astype(float)
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.filled = np.zeros(len(ids), np.int64)
        self.root = cover_tree(self.points, QUERY_LEAF, QUERY_SMALL) if len(ids) else None
        #: pairs whose score was worked out, and all pairs
        self.compared = self.pairs = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        points = vectors.astype(float)
        top = float(np.abs(points).max(initial=0)) * float(np.abs(self.points).max(initial=0)) * max(1, points.shape[1])
        self.safe = top < 2.0**53
        self.pairs += len(self.ids) * len(ids)
        self.visit(cover_tree(points), ids, vectors, points)

    def bound(self, q: Node, d: Node) -> float:
        top = q.centre @ d.centre + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
        top = min(top, q.top * d.top)
        return top + 1e-9 * (abs(top) + q.norm * d.norm + q.top * d.top + 1)

    def visit(self, root: Node, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> None:
        order = count()
        todo = [(-self.bound(self.root, root), next(order), self.root, root)]
        while todo:
            bound, _, q, d = heapq.heappop(todo)
            if -bound < q.worst:
                continue
            if not q.children and not d.children:
                self.compare(q, d, ids, vectors, points)
                continue
            split_candidates = d.children and (not q.children or d.radius >= q.radius)
            for a, b in ((q, c) for c in d.children) if split_candidates else ((c, d) for c in q.children):
                top = self.bound(a, b)
                if top >= a.worst:
                    heapq.heappush(todo, (-top, next(order), a, b))

    def compare(self, q: Node, d: Node, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> None:
        if self.safe:
            scores = self.points[q.rows] @ points[d.rows].T
        else:
            scores = self.exact[q.rows] @ vectors[d.rows].T
        self.compared += scores.size
        able = ids[d.rows][None, :] != self.ids[q.rows][:, None]
        able &= (scores >= self.score[q.rows, -1][:, None]) | (self.filled[q.rows] < self.k)[:, None]
        for i in np.flatnonzero(able.any(axis=1)).tolist():
            row, at = q.rows[i], np.flatnonzero(able[i])
            value = np.concatenate([self.score[row, : self.filled[row]], scores[i, at].astype(np.int64)])
            names = np.concatenate([self.found[row, : self.filled[row]], ids[d.rows[at]]])
            best = np.lexsort((names, -value))[: self.k]
            n = self.filled[row] = len(best)
            self.score[row, :n], self.found[row, :n] = value[best], names[best]
        q.worst = float(self.score[q.rows, -1].min()) if (self.filled[q.rows] >= self.k).all() else -np.inf
        while (q := q.parent) is not None:
            q.worst = min(c.worst for c in q.children)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix of this width or the longest list's, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def integers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (integer components) of the rows that take part."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(embedding, odd))
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("bigint")).alias("v"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates other than itself."""
    spark = candidates.sparkSession
    asked = cut(integers(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    rounds = max(1, -(-asked.count() // block * 5 // 4))
    data = integers(candidates, vec_id, embedding)
    found = None
    for i in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == i).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((part.column(0).to_numpy(), part.column(1).combine_chunks().flatten().to_numpy(), np.array([len(x) for x in part.column(1)], np.int64)))
        one = data.mapInArrow(_searcher(sent, k), "query_id bigint, vec_id bigint, score bigint")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, flat, sizes = sent.value
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
        wide = int(sizes.max(initial=0))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        search = None
        for ids, vectors in _trees(batches, wide):
            if search is None or vectors.shape[1] > search.exact.shape[1]:
                if search is not None:
                    held += _results(search)
                search = Search(names, matrix(lists, vectors.shape[1]), k)
            if len(names):
                if vectors.shape[1] < search.exact.shape[1]:
                    vectors = np.pad(vectors, ((0, 0), (0, search.exact.shape[1] - vectors.shape[1])))
                search.add(ids, vectors)
        if search is not None:
            held += _results(search)
        for q, v, s in held:
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _trees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates in portions of one tree."""
    for batch in batches:
        for at in range(0, batch.num_rows, TREE):
            some = batch.slice(at, TREE)
            column = some.column(1)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array([len(x) for x in column], np.int64))]), pa.int32()), column.flatten())
            yield some.column(0).to_numpy(), matrix(column, width)


def _results(search: Search) -> list[tuple]:
    have = np.arange(search.k)[None, :] < search.filled[:, None]
    return [(np.repeat(search.ids, search.filled), search.found[have], search.score[have])]


def report(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings.where("vec_id % 50 = 0"), embeddings)
