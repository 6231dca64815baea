"""Graph matrices as compressed blocks, vectors as chunks, and what is done with them: products, orthonormal bases, projections.

Nodes of a structure are dealt to chunks of ``CHUNK`` by number. A block holds the edges from one chunk to another, as two
arrays of places or, where that is shorter, as a bit map; a vector (w, v) of the 2n form is, per chunk, one array. A product meets the blocks of a column chunk with
the chunk's vector, sends the partial sums to their row chunks, and is complete where they are added up: one shuffle of
chunks per product, as the blocks lie bucketed by column chunk, however many chunks a structure has.

Bases are made orthonormal by a QR tree: each chunk's rows give a triangle, triangles are stacked ``FAN`` at a time and
reduced again until one is left per structure. It holds all inner products; small helpers work on it, and what they
find goes back to the chunks as a matrix to multiply the columns with.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.session import bucketed

CHUNK, FAN = 8192, 16
#: Values of a block that are unpacked at once.
UNPACKED = 4_000_000
_KEY = ["structure_id", "chunk"]
_STATE = "structure_id string, chunk bigint, own boolean, x array<double>"
_COLUMNS = pa.schema([("structure_id", pa.string()), ("chunk", pa.int64()), ("own", pa.bool_()), ("x", pa.list_(pa.float64()))])


_TILES = "structure_id string, chunk bigint, row bigint, size int, row_size int, i binary, j binary, bits binary, degree binary"


@dataclass
class Network:
    """A graph of which only the blocks are known, no row per edge; operators take it as they take edges."""

    matrix: DataFrame
    chunk: int


class Tile:
    """A block: edges from places j (of columns) to places i (of rows), as they are stored."""

    def __init__(self, i: bytes, j: bytes, bits: bytes | None, rows: int, columns: int):
        self.i, self.j, self.bits, self.rows, self.columns = i, j, bits, rows, columns

    @staticmethod
    def stored(i: np.ndarray, j: np.ndarray, rows: int, columns: int) -> tuple[bytes, bytes, bytes | None, bytes]:
        """i, j, bits and degree (edges of each column) of a block."""
        if 4 * len(i) > rows * (columns + 7) // 8:
            full = np.zeros((rows, columns), bool)
            full[i, j] = True
            if np.count_nonzero(full) == len(i):  # an edge that is given twice counts twice
                return Tile.stored_bits(full)
        return i.astype(np.uint16).tobytes(), j.astype(np.uint16).tobytes(), None, np.bincount(j, minlength=columns).astype(np.int32).tobytes()

    @staticmethod
    def stored_bits(full: np.ndarray) -> tuple[bytes, bytes, bytes | None, bytes]:
        if 4 * np.count_nonzero(full) <= full.shape[0] * (full.shape[1] + 7) // 8:
            return Tile.stored(*np.nonzero(full), *full.shape)
        return b"", b"", np.packbits(full, axis=1).tobytes(), full.sum(0).astype(np.int32).tobytes()

    def packed(self) -> np.ndarray:
        return np.frombuffer(self.bits, np.uint8).reshape(self.rows, -1)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if self.bits is None:
            return np.frombuffer(self.i, np.uint16).astype(np.int64), np.frombuffer(self.j, np.uint16).astype(np.int64)
        return np.nonzero(np.unpackbits(self.packed(), axis=1, count=self.columns).view(bool))

    def __bool__(self) -> bool:
        return bool(self.i or self.bits)

    def times(self, x: np.ndarray) -> np.ndarray:
        """The block times each row of x (one value per column)."""
        if self.bits is None:
            i, j = self.places()
            return np.stack([np.bincount(i, weights=w[j], minlength=self.rows) for w in x])
        bits, out = self.packed(), np.zeros((len(x), self.rows))
        if len(x) > 8:
            step = max(1, UNPACKED // self.columns)
            for k in range(0, self.rows, step):
                out[:, k : k + step] = x @ np.unpackbits(bits[k : k + step], axis=1, count=self.columns).astype(np.float64).T
            return out
        at, step = np.arange(bits.shape[1]) << 8, max(1, UNPACKED // bits.shape[1])
        for n, w in enumerate(x):  # what each byte's 256 values add up to, once for each byte of a row
            sums = (np.concatenate([w, np.zeros(-len(w) % 8)]).reshape(-1, 8) @ _BYTES).ravel()
            for k in range(0, self.rows, step):
                out[n, k : k + step] = sums[bits[k : k + step] + at].sum(1)
        return out


#: The bits of each byte, first bit first.
_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64).T


def tiles(table: pa.Table) -> list[Tile]:
    """The blocks of one column chunk."""
    columns = (table.column(c).to_pylist() for c in ("i", "j", "bits", "row_size", "size"))
    return [Tile(*x) for x in zip(*columns)]


def degree_of(table: pa.Table) -> np.ndarray:
    """Edges of each place of one column chunk, from its blocks."""
    return sum(np.frombuffer(x, np.int32) for x in table.column("degree").to_pylist()).astype(np.int64)


def blocks(nodes: DataFrame, edges: DataFrame | Network, chunk: int = CHUNK) -> DataFrame:
    """structure_id, chunk (of columns), row (chunk of rows), size and row_size (places in the chunks), i, j, bits: the edges (see Tile), degree. Every chunk has a block with itself, be it empty."""
    if isinstance(edges, Network):
        assert edges.chunk == chunk, "the network has chunks of another size"
        return edges.matrix
    of = lambda c: F.floor(F.col(c) / chunk)
    sizes = nodes.groupBy("structure_id", of("node_id").alias("chunk")).agg((F.max(F.col("node_id") % chunk) + 1).cast("int").alias("size"))
    ends = edges.select("structure_id", of("dst").alias("chunk"), of("src").alias("row"), F.struct((F.col("src") % chunk).cast("int").alias("i"), (F.col("dst") % chunk).cast("int").alias("j")).alias("e"))
    full = ends.groupBy(*_KEY, "row").agg(F.collect_list("e").alias("e"))
    rows = sizes.select(*_KEY, "size", F.explode(F.array("chunk")).alias("row")).join(full, [*_KEY, "row"], "full")
    rows = rows.drop("size").join(sizes, _KEY).join(sizes.select("structure_id", F.col("chunk").alias("row"), F.col("size").alias("row_size")), ["structure_id", "row"])
    places = lambda c: F.coalesce(F.transform("e", lambda e: e[c]), F.array().cast("array<int>")).alias(c)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                rows, columns = b.column(4)[k].as_py(), b.column(3)[k].as_py()
                one = Tile.stored(*(b.column(c)[k].values.to_numpy() for c in (5, 6)), rows, columns)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in range(5)), *(pa.array([x], pa.binary()) for x in one)], _NAMES)

    return stored(rows.select(*_KEY, "row", "size", "row_size", places("i"), places("j")).mapInArrow(run, _TILES))


_NAMES = [x.split()[0] for x in _TILES.split(", ")]


def stored(rows: DataFrame) -> DataFrame:
    return bucketed(rows, _KEY, "blocks")


def most_chunks(matrix: DataFrame) -> int:
    """Of a structure, at most."""
    return (matrix.agg(F.max("chunk")).first()[0] or 0) + 1


def spread(nodes: DataFrame, state: DataFrame, name: str, *others: str, chunk: int = CHUNK) -> DataFrame:
    """structure_id, node_id, name (the first of state's values at the node's place), others, for each node."""
    rows = state.select("structure_id", *others, "chunk", F.posexplode("x").alias("at", name))
    rows = rows.select("structure_id", (F.col("chunk") * chunk + F.col("at")).alias("node_id"), name, *others)
    return nodes.select("structure_id", "node_id").join(rows, ["structure_id", "node_id"])


def chunks(vector: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """structure_id, chunk, own, x from (structure_id, node_id, w, v): w, then v, of the chunk's places; 0 where there is no node."""
    rows = vector.select("structure_id", F.floor(F.col("node_id") / chunk).alias("chunk"), F.struct((F.col("node_id") % chunk).cast("int").alias("at"), F.col("w").cast("double").alias("w"), F.col("v").cast("double").alias("v")).alias("p"))

    def run(key, table):
        p = table.column("p").combine_chunks()
        at = p.field("at").to_numpy()
        x = np.zeros((2, at.max() + 1))
        x[0, at], x[1, at] = p.field("w").to_numpy(), p.field("v").to_numpy()
        return _rows(key, [(True, key[1].as_py(), x)])

    return rows.groupBy(*_KEY).applyInArrow(run, _STATE)


def _rows(key, out: list[tuple[bool, int, np.ndarray]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(out), pa.string()), pa.array([c for _, c, _ in out], pa.int64()), pa.array([o for o, *_ in out]), pa.array([x.ravel() for *_, x in out], pa.list_(pa.float64()))], schema=_COLUMNS)


def _met(advance: bool, scatter: bool, every: bool = False, alone: int = 0, plain: bool = False):
    """At a column chunk: partial sums complete the product of its last vector (every: of all of them, appended after them); then partial sums of the last vector (all) are sent on.

    alone: where every structure has one chunk only, so many products one after the other, as nothing has to be sent.
    plain: vectors are of n places and multiplied by A, and only the last one is kept.
    """

    def run(key, left, right):
        if not right.num_rows:
            return _COLUMNS.empty_table()
        size = left.column("size")[0].as_py()
        own = right.column("own").to_numpy()
        x = right.column("x").combine_chunks()
        whole = np.concatenate([x[i].values.to_numpy() for i in np.flatnonzero(own).tolist()]).reshape(-1, 1 if plain else 2, size)
        found, degree = tiles(left), None if plain else degree_of(left)
        last = whole if every else whole[-1:]

        made = [whole]
        for _ in range(alone or advance):
            near = found[0].times(last[:, 0]) if alone else sum((x[k].values.to_numpy().reshape(-1, size) for k in np.flatnonzero(~own).tolist()), np.zeros((len(last), size)))
            last = near[:, None] if plain else np.stack([near + (1 - degree) * last[:, 1], last[:, 0]], 1)
            made = [last] if plain else [*made, last]
        out = [(True, key[1].as_py(), np.concatenate(made))]
        if scatter:
            out += [(False, row, tile.times(last[:, 0])) for row, tile in zip(left.column("row").to_pylist(), found) if tile]
        return _rows(key, out)

    return run


def _meet(matrix: DataFrame, state: DataFrame, **how) -> DataFrame:
    return matrix.groupBy(*_KEY).cogroup(state.groupBy(*_KEY)).applyInArrow(_met(**how), _STATE)


def powers(matrix: DataFrame, state: DataFrame, steps: int, most_chunks: int, plain: bool = False) -> DataFrame:
    """state's vector and its ``steps`` further products with (w, v) -> (A w + (I - D) v, w); plain: only the last of its products with A. most_chunks: of a structure."""
    if most_chunks == 1:
        return _meet(matrix, state, advance=False, scatter=False, alone=steps, plain=plain)
    state = _meet(matrix, state, advance=False, scatter=True, plain=plain)
    for k in range(steps):
        state = _meet(matrix, state, advance=True, scatter=k < steps - 1, plain=plain)
    return state


def images(matrix: DataFrame, state: DataFrame, most_chunks: int) -> DataFrame:
    """state's columns, and after them the products of all of them."""
    if most_chunks == 1:
        return _meet(matrix, state, advance=False, scatter=False, every=True, alone=1)
    sent = _meet(matrix, state, advance=False, scatter=True, every=True)
    return _meet(matrix, sent, advance=True, scatter=False, every=True)


# --- QR trees


def _triangle(a: np.ndarray, k: int) -> np.ndarray:
    """The upper triangle (k x k) of a's QR decomposition."""
    out = np.zeros((k, k))
    r = np.linalg.qr(a, mode="r")
    out[: len(r)] = r
    return out


def triangles(state: DataFrame, most_chunks: int, fan: int = FAN) -> DataFrame:
    """structure_id, r (k x k, k columns): one triangle per structure, its columns' coordinates in an orthonormal frame. state: structure_id, chunk, columns (how many), x."""

    def leaf(batches):
        for b in batches:
            x = b.column(3)
            for i, k in enumerate(b.column(2).to_pylist()):
                r = _triangle(x[i].values.to_numpy().reshape(k, -1).T, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), b.column(2).slice(i, 1), pa.array([r.ravel()], pa.list_(pa.float64()))], names)

    def stacked(table):
        k, r = table.column("columns")[0].as_py(), table.column("r").combine_chunks()
        top = _triangle(r.flatten().to_numpy().reshape(-1, k), k)
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1) for c in names[:3]), pa.array([top.ravel()], pa.list_(pa.float64()))], names)

    names = ["structure_id", "chunk", "columns", "r"]
    schema = "structure_id string, chunk bigint, columns int, r array<double>"
    out = state.select("structure_id", "chunk", "columns", "x").mapInArrow(leaf, schema)
    while most_chunks > 1:
        out = out.withColumn("chunk", F.floor(F.col("chunk") / fan)).groupBy(*_KEY).applyInArrow(stacked, schema)
        most_chunks = -(-most_chunks // fan)
    return out.select("structure_id", "r")


def combined(state: DataFrame, small: DataFrame) -> DataFrame:
    """state's columns times each structure's small matrix (structure_id, m: rows of which are new columns in terms of the old, kept: how many; any others): structure_id, chunk, columns, x, and small's other columns."""
    more = [c for c in small.columns if c not in ("structure_id", "m", "kept")]
    rows = state.select("structure_id", "chunk", "columns", "x").join(small, "structure_id").select("structure_id", "chunk", "columns", "x", "m", "kept", *more)
    schema = rows.drop("m", "kept").schema

    def run(batches):
        for b in batches:
            out = []
            for x, k, m, n in zip(b.column(3), b.column(2).to_pylist(), b.column(4), b.column(5).to_pylist()):
                out.append((m.values.to_numpy().reshape(n, k) @ x.values.to_numpy().reshape(k, -1)).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(5), pa.array(out, pa.list_(pa.float64())), *b.columns[6:]], [f.name for f in schema])

    return rows.mapInArrow(run, schema)
