"""Count-min sketches of 64-bit values, merged from the sketches of all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from foretrace.llm.hashing import mixed

DEPTH = 2
BLOCK_BITS = 20
CELL_BITS = (20, 30)  # of one row: two rows of 2**30 cells are 256 MB of bits at most
FLUSH = 1_000_000


def _cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(values + np.uint64((0x9E3779B97F4A7C15 * (row + 1)) & ((1 << 64) - 1))) >> np.uint64(64 - bits)


def cell_bits(values: float) -> int:
    """Eight cells or more for each value expected, within CELL_BITS. With fewer cells a sketch lets
    more values through and still loses none."""
    return int(min(CELL_BITS[1], max(CELL_BITS[0], np.ceil(np.log2(max(1.0, 8 * values))))))


@dataclass
class Bits:
    """For each cell, whether its count reached the level asked for."""

    bits: int
    cells: np.ndarray

    def hit(self, values: np.ndarray) -> np.ndarray:
        """False only for values whose count is surely below the level."""
        values = values.view(np.uint64)
        out = np.ones(len(values), bool)
        for row in range(DEPTH):
            cell = _cells(values, row, self.bits)
            out &= (self.cells[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def count_min(rows: DataFrame, values_of: Callable[[pd.DataFrame], Iterator[np.ndarray]], bits: int, level: int = 2,
              flush: int = FLUSH, arrow: bool = False) -> Bits:
    """Which cells count ``level`` (1 or 2) values or more.

    ``values_of`` gives the uint64 values of a batch (``arrow``: a record batch), in arrays. A task sends, for each block of
    cells, which cells it met once and which more often; blocks are added up independently.
    What reaches the driver has the fixed size of the sketch, whatever the number of values."""
    block_mask = np.uint64((1 << BLOCK_BITS) - 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def send() -> pd.DataFrame:
            found = []
            values = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            for row in range(DEPTH if len(values) else 0):
                cells, n = np.unique(_cells(values, row, bits), return_counts=True)
                block = cells >> np.uint64(BLOCK_BITS)
                cuts = np.flatnonzero(np.diff(block)) + 1
                for b, c, k in zip(block[np.r_[0, cuts]], np.split(cells, cuts), np.split(n, cuts)):
                    inside = (c & block_mask).astype("<u4")
                    found.append((row, int(b), inside.tobytes(), inside[k > 1].tobytes()))
            return pd.DataFrame(found, columns=["depth", "block", "cells", "again"])

        size = 0
        for batch in batches:
            for values in values_of(batch):
                held.append(values)
                size += len(values)
                if size >= flush:
                    yield send()
                    size = 0
        yield send()

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(1 << BLOCK_BITS, np.uint8)
        for cells, again in zip(parts["cells"], parts["again"]):
            for part in (cells, again):  # each holds a cell at most once
                at = np.frombuffer(part, "<u4")
                count[at] = np.minimum(count[at] + 1, 2)
        packed = np.packbits(count >= level, bitorder="little").tobytes()
        return pd.DataFrame({"depth": [key[0]], "block": [key[1]], "bits": [packed]})

    def partial_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("depth", pa.int32()), ("block", pa.int32()), ("cells", pa.binary()), ("again", pa.binary())])
        for part in partial(batches):
            yield pa.RecordBatch.from_pandas(part, schema=fields, preserve_index=False)

    counted = (rows.mapInArrow if arrow else rows.mapInPandas)(
        partial_arrow if arrow else partial, "depth int, block int, cells binary, again binary")
    merged = counted.groupBy("depth", "block").applyInPandas(
        merge, "depth int, block int, bits binary")
    out = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    width = (1 << BLOCK_BITS) // 8
    for r in merged.collect():
        out[r["depth"], r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return Bits(bits, out)
