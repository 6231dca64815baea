"""Graph operators over nodes (structure_id, node_id) and edges (rows in both directions, or a network of blocks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.operators import paths
from meshwork.operators.blocks import CHUNK, FAN, Network, Tile, blocks, chunks, degree_of, most_chunks, powers, spread, tiles
from meshwork.session import discard, settle, settle_counted

_KEY = ["structure_id", "node_id"]


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy("structure_id").agg((F.count("*") / 2).cast("bigint").alias("n_edges"))


def degrees(nodes: DataFrame, edges: DataFrame | Network) -> DataFrame:
    """structure_id, node_id, degree; isolated nodes have 0."""
    if isinstance(edges, Network):

        def run(key, table):
            return pa.table({"structure_id": [key[0].as_py()], "chunk": [key[1].as_py()], "x": pa.array([degree_of(table)], pa.list_(pa.int64()))})

        found = edges.matrix.select("structure_id", "chunk", "degree").groupBy("structure_id", "chunk").applyInArrow(run, "structure_id string, chunk bigint, x array<bigint>")
        return nodes.select(*_KEY).join(spread(nodes, found, "degree", chunk=edges.chunk), _KEY, "left").fillna(0, ["degree"])
    found = edges.groupBy("structure_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select(*_KEY).join(found, _KEY, "left").fillna(0, ["degree"])


def max_normalised(scores: DataFrame, score: str = "score", by: tuple[str, ...] = ("structure_id",)) -> DataFrame:
    """score divided by its group's maximum, where that is above 0."""
    top = F.max(score).over(Window.partitionBy(*by))
    return scores.withColumn(score, F.when(top > 0, F.col(score) / top).otherwise(F.col(score)))


def gather(edges: DataFrame, vector: DataFrame, value: str = "value") -> DataFrame:
    """Sparse matrix times vector: for each node, the sum of value over its neighbours."""
    ends = vector.select("structure_id", F.col("node_id").alias("dst"), value)
    return edges.join(ends, ["structure_id", "dst"]).groupBy("structure_id", F.col("src").alias("node_id")).agg(F.sum(value).alias("gathered"))


def closeness(nodes: DataFrame, edges: DataFrame | Network) -> DataFrame:
    """r^2 / ((n - 1) sum of distances), r nodes reached besides oneself; 0 for isolated ones."""
    n = nodes.groupBy("structure_id").agg(F.count("*").alias("n"))
    rows = nodes.select(*_KEY).join(n, "structure_id").join(paths.reach(nodes, edges), _KEY, "left")
    score = F.when((F.col("far") > 0) & (F.col("n") > 1), F.col("r") * F.col("r") / ((F.col("n") - 1) * F.col("far"))).otherwise(0.0)
    return rows.select(*_KEY, score.alias("score"))


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 200, settle_every: int = 40, chunk: int = CHUNK) -> DataFrame:
    """A fixed number of unshifted power steps from the uniform vector, scaled to unit length every few steps and at the end."""
    matrix = blocks(nodes, edges, chunk)
    most = most_chunks(matrix)
    first = nodes.select(*_KEY, F.lit(1.0).alias("w"), F.lit(0.0).alias("v"))
    now = settle(chunks(first, chunk).select("structure_id", "chunk", F.slice("x", 1, (F.size("x") / 2).cast("int")).alias("x")), "eigenvector")
    done = 0
    while True:
        size = now.groupBy("structure_id").agg(F.sqrt(F.sum(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))).alias("size"))
        scaled = now.join(size, "structure_id").select("structure_id", "chunk", F.lit(True).alias("own"), F.when(F.col("size") > 1e-15, F.transform("x", lambda x: x / F.col("size"))).otherwise(F.col("x")).alias("x"))
        if done == rounds:
            return spread(nodes, scaled, "value", chunk=chunk).select(*_KEY, F.abs("value").alias("score"))
        steps = min(settle_every, rounds - done)
        later = settle(powers(matrix, scaled, steps, most, plain=True).select("structure_id", "chunk", "x"), "eigenvector")
        discard(now)
        now, done = later, done + steps


def _roots(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (i, j) but the smallest of each of their components, and that one: least labels spread and jump until none changes."""
    names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(names))
    return names[other], names[label[other]]


#: Components of a bit map that are searched one by one; what is left after them is taken edge by edge.
SEARCHED = 50


def _joined(tile: Tile, rows: np.ndarray, columns: np.ndarray, row_at: int, column_at: int) -> tuple[np.ndarray, np.ndarray]:
    """As _roots, of a block's edges between kept places (rows and columns are masks), as numbers of nodes."""
    if tile.bits is None:
        i, j = tile.places()
        some = rows[i] & columns[j]
        return _roots(i[some] + row_at, j[some] + column_at)
    left = np.flatnonzero(rows)
    bits = tile.packed()[left] & np.packbits(columns)
    left, bits = (x[bits.any(1)] for x in (left, bits))
    nodes, roots = [], []
    for _ in range(SEARCHED):
        if not len(left):
            break
        found = bits[0]
        while True:  # rows that share a column with those found, until they show no new one
            near = (bits & found).any(1)
            wider = np.bitwise_or.reduce(bits[near], axis=0)
            if (wider == found).all():
                break
            found = wider
        both = np.concatenate([left[near] + row_at, np.flatnonzero(np.unpackbits(found, count=tile.columns)) + column_at])
        nodes.append(both)
        roots.append(np.full(len(both), both.min()))
        left, bits = left[~near], bits[~near]
    if len(left):
        i, j = np.nonzero(np.unpackbits(bits, axis=1, count=tile.columns).view(bool))
        node, root = _roots(left[i] + row_at, j + column_at)
        nodes.append(node)
        roots.append(root)
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def stars(nodes: DataFrame, network: Network) -> DataFrame:
    """structure_id, src, dst: few edges, both ways, that connect the same nodes of ``nodes`` as the network's do.

    Each column chunk keeps one edge to a common node for each node that its blocks connect, and so does each group of FAN chunks of those:
    at most as many edges a group as the structure has nodes. A task sees which nodes are kept of its structure, a bit each.
    """
    chunk = network.chunk

    def mask(key, table):
        at = table.column("node_id").to_numpy()
        kept = np.zeros(at.max() + 1, bool)
        kept[at] = True
        return pa.table({"structure_id": [key[0].as_py()], "kept": [np.packbits(kept).tobytes()]})

    def star(structure: str, at: int, i: np.ndarray, j: np.ndarray) -> pa.Table:
        node, root = _roots(i, j)
        return pa.table({"structure_id": [structure], "chunk": pa.array([at], pa.int64()), "node": pa.array([node], pa.list_(pa.int64())), "root": pa.array([root], pa.list_(pa.int64()))})

    def first(key, left, right):
        if not right.num_rows or not left.num_rows:
            return star(key[0].as_py(), key[1].as_py(), np.zeros(0, np.int64), np.zeros(0, np.int64))
        kept = np.unpackbits(np.frombuffer(right.column("kept")[0].as_py(), np.uint8)).astype(bool)
        here = key[1].as_py()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for row, tile in zip(left.column("row").to_pylist(), tiles(left)):
            if row <= here and tile:  # the others are the same edges
                of = lambda at, n: np.concatenate([kept[at : at + n], np.zeros(n - len(kept[at : at + n]), bool)])
                found.append(_joined(tile, of(row * chunk, tile.rows), of(here * chunk, tile.columns), row * chunk, here * chunk))
        return star(key[0].as_py(), here, *(np.concatenate(x) for x in zip(*found)))

    def merged(key, table):
        return star(key[0].as_py(), key[1].as_py(), *(table.column(c).combine_chunks().flatten().to_numpy() for c in ("node", "root")))

    schema = "structure_id string, chunk bigint, node array<bigint>, root array<bigint>"
    kept = nodes.select(*_KEY).groupBy("structure_id").applyInArrow(mask, "structure_id string, kept binary")
    each = network.matrix.where("chunk = row").select(F.col("structure_id").alias("of"), F.col("chunk").alias("at"))
    each = each.join(kept, F.col("of") == F.col("structure_id")).select("of", "at", "kept")
    made = network.matrix.groupBy("structure_id", "chunk").cogroup(each.groupBy("of", "at")).applyInArrow(first, schema)
    made = made.withColumn("chunk", F.floor(F.col("chunk") / FAN)).groupBy("structure_id", "chunk").applyInArrow(merged, schema)
    one = settle(made.select("structure_id", F.explode(F.arrays_zip("node", "root")).alias("e")).select("structure_id", F.col("e.node").alias("src"), F.col("e.root").alias("dst")), "stars")
    return one.unionByName(one.select("structure_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def components(nodes: DataFrame, edges: DataFrame | Network) -> DataFrame:
    """structure_id, node_id, component (its smallest node): least labels spread and jump until none changes. Of a network the edges between these nodes count."""
    edges = stars(nodes, edges) if isinstance(edges, Network) else settle(edges, "edges")
    now = settle(nodes.select(*_KEY, F.col("node_id").alias("component")), "components")
    while True:
        near = edges.join(now.select("structure_id", F.col("node_id").alias("dst"), "component"), ["structure_id", "dst"])
        near = near.groupBy("structure_id", F.col("src").alias("node_id")).agg(F.min("component").alias("near"))
        spread = now.join(near, _KEY, "left").select(*_KEY, F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = now.select("structure_id", F.col("node_id").alias("component"), F.col("component").alias("root"))
        jumped = spread.join(jump, ["structure_id", "component"], "left").select(*_KEY, "old", F.coalesce("root", "component").alias("component"))
        new, made = settle_counted(jumped, "components", changed=F.count_if(F.col("old") != F.col("component")))
        discard(now)
        now = new.select(*_KEY, "component")
        now.settled_at = new.settled_at
        if not made["changed"]:
            return now


def induced(edges: DataFrame | Network, kept: DataFrame) -> DataFrame | Network:
    """Edges whose ends are both kept (a network stays whole: components of some nodes only count the edges between these)."""
    if isinstance(edges, Network):
        return edges
    k = kept.select(*_KEY)
    return edges.join(k.withColumnRenamed("node_id", "src"), ["structure_id", "src"], "left_semi").join(k.withColumnRenamed("node_id", "dst"), ["structure_id", "dst"], "left_semi")

