"""Reproducible pseudo-random start vectors, each value made on its own.

The generator is linear over bits: a step is a 64 x 64 bit matrix. Its powers of two, multiplied up once, take any row straight to its
place in the sequence, so values are made in parallel and come out bit by bit as from one loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a seed becomes the first state, and the three shifts of a step (left, right, left).
SCALE, SHIFTS = 2685821657736338717, (13, 7, 17)
_MASK = (1 << 64) - 1


def seeded_state(seed: int) -> int:
    return (seed * SCALE + 1) & _MASK


def stepped(state: np.ndarray) -> np.ndarray:
    a, b, c = map(np.uint64, SHIFTS)
    state = state ^ (state << a)
    state = state ^ (state >> b)
    return state ^ (state << c)


def _times(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The bit matrix with these columns times each state."""
    out = np.zeros_like(states)
    for k in range(64):
        out ^= np.where((states >> np.uint64(k)) & np.uint64(1), columns[k], np.uint64(0))
    return out


def powers() -> list[np.ndarray]:
    """Columns of the step's matrix to the powers 1, 2, 4, ..., 2^63."""
    out = [stepped(np.uint64(1) << np.arange(64, dtype=np.uint64))]
    while len(out) < 64:
        out.append(_times(out[-1], out[-1]))
    return out


def states_at(places: np.ndarray, seed: int, jumps: list[np.ndarray]) -> np.ndarray:
    """The state after so many steps, of each place."""
    states = np.full(len(places), seeded_state(seed), np.uint64)
    for k in range(int(places.max(initial=0)).bit_length()):
        some = np.flatnonzero((places >> k) & 1)
        states[some] = _times(jumps[k], states[some])
    return states


def seeded(nodes: DataFrame, seed: int) -> DataFrame:
    """structure_id, node_id, w, v, and w_bits, v_bits (the states behind them, hexadecimal): each structure's sequence goes through w of its nodes, then through v. Nodes are numbered from 0 without gaps."""
    n = nodes.groupBy("structure_id").agg(F.count("*").alias("n"))
    rows = nodes.select("structure_id", "node_id").join(n, "structure_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jumps = powers()
        for b in batches:
            at = b.column(1).to_numpy().astype(np.int64) + 1
            made = [states_at(x, seed, jumps) for x in (at, at + b.column(2).to_numpy())]
            values = [pa.array(x.astype(np.float64) / 2.0**64 - 0.5) for x in made]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *values, *(pa.array([f"{i:016x}" for i in x.tolist()]) for x in made)], [f.name for f in schema])

    schema = rows.select("structure_id", "node_id", F.lit(0.0).alias("w"), F.lit(0.0).alias("v"), F.lit("").alias("w_bits"), F.lit("").alias("v_bits")).schema
    return rows.mapInArrow(run, schema)
