"""Tables of fixed size over the space of 64-bit hashes: built on the executors, sent whole to all tasks.

A table has 2**bits cells, by a hash's leading bits.  Its size is set by
`bits` alone; as data grow cells fill, which costs work in later steps, never
results.  Slices of a table are packed where their cells are and put together
on the driver, which holds the one table and nothing else.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U
from .store import small_batches

SLICE = 16  # bits of a cell's number within a slice


def bits_for(entries: int, spare: int = 6, least: int = 20, most: int = 30) -> int:
    """Bits for a table in which `entries` fill about one cell in 2**spare, within bounds: 2**most bits are 128 MB."""
    return min(max(least, (max(entries, 1) - 1).bit_length() + spare), most)


def _slices(cells: DataFrame, bits: int, pack) -> np.ndarray:
    low = min(SLICE, bits)
    dealt = cells.withColumns({"slice": F.shiftright("cell", low).cast("int"), "low": F.col("cell").bitwiseAND(F.lit((1 << low) - 1)).cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "packed": [zlib.compress(pack(pdf, 1 << low).tobytes(), 1)]})

    empty = pack(pd.DataFrame({"low": [], "n": []}, dtype=np.int64), 1 << low)
    table = np.tile(empty, (1 << (bits - low), 1))
    with small_batches(cells.sparkSession):
        for row in dealt.groupBy("slice").applyInPandas(run, "slice int, packed binary").collect():  # at most a row a slice
            table[row["slice"]] = np.frombuffer(zlib.decompress(bytes(row["packed"])), np.uint8)
    return table.reshape(-1)


def cell_of(column: str, bits: int):
    return F.shiftrightunsigned(column, 64 - bits).alias("cell")


def bit_table(hashes: DataFrame, column: str, bits: int) -> bytes:
    """Which cells have a hash; for Bits."""

    def pack(pdf: pd.DataFrame, n: int) -> np.ndarray:
        own = np.zeros(n, bool)
        own[pdf["low"].to_numpy(np.int64)] = True
        return np.packbits(own)

    return zlib.compress(_slices(hashes.select(cell_of(column, bits)).distinct(), bits, pack).tobytes(), 1)


def level_table(counts: DataFrame, bits: int) -> bytes:
    """(cell, n) -> a byte a cell: 0 for none, else eight steps a doubling of n."""

    def pack(pdf: pd.DataFrame, n: int) -> np.ndarray:
        own = np.zeros(n, np.uint8)
        own[pdf["low"].to_numpy(np.int64)] = np.clip(np.round(8 * np.log2(1 + pdf["n"].to_numpy(np.float64))), 1, 255).astype(np.uint8)
        return own

    return zlib.compress(_slices(counts.groupBy("cell").agg(F.sum("n").alias("n")), bits, pack).tobytes(), 1)


class Bits:
    """Whether hashes' cells are set."""

    def __init__(self, packed: bytes, bits: int):
        self.table, self.shift = np.frombuffer(zlib.decompress(packed), np.uint8), U(64 - bits)

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        cell = self.cells(hashes)
        return self.table[cell >> 3] & (np.uint8(128) >> (cell & 7).astype(np.uint8)) > 0
