"""Count-min sketches of corpus counts, built from all rows, shipped in blocks.

A sketch of ``1 << bits`` counters and two rows answers how often a string
occurs; it never answers too little, and too much only where both rows
collide. ``noise`` is the measured chance that a string never seen reads as
seen twice or more; ``build`` takes the least size, in steps of two bits, whose
noise stays below a bound, up to a largest size. So what is broadcast follows
the number of distinct strings up to that size and not beyond.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCKS = 16


class Sketch:
    """Two rows of counters."""

    def __init__(self, bits: int, data: np.ndarray | None = None) -> None:
        self.bits = bits
        self.data = np.zeros((2, 1 << bits), np.int64) if data is None else data
        self.mask = (1 << bits) - 1

    def add(self, counts: Iterable[tuple[str, int]]) -> None:
        pairs = list(counts)
        if not pairs:
            return
        n = np.fromiter((c for _, c in pairs), np.int64, count=len(pairs))
        raw = [k.encode("utf-8", "surrogatepass") for k, _ in pairs]
        for row, at in enumerate(([zlib.crc32(b) for b in raw], [zlib.crc32(b[::-1], 0x9E37) for b in raw])):
            np.add.at(self.data[row], np.array(at, np.int64) & self.mask, n)

    def noise(self) -> float:
        """The chance that a string never seen reads as seen twice or more: once is no evidence, for a string is then its own."""
        return float(np.prod((self.data >= 2).mean(axis=1)))

    def packed(self) -> tuple[int, bytes]:
        """The sketch compressed, with counts up to the largest 32-bit number, as it is broadcast."""
        return self.bits, zlib.compress(np.minimum(self.data, np.iinfo(np.int32).max).astype(np.int32).tobytes(), 1)

    @staticmethod
    def unpacked(bits: int, data: bytes) -> Sketch:
        return Sketch(bits, np.frombuffer(zlib.decompress(data), np.int32).reshape(2, -1))

    def count(self, key: str) -> int:
        b = key.encode("utf-8", "surrogatepass")
        return int(min(self.data[0][zlib.crc32(b) & self.mask], self.data[1][zlib.crc32(b[::-1], 0x9E37) & self.mask]))


def build(df: DataFrame, bits: dict[str, int], fold: Callable[[dict[str, dict[str, int]], tuple], None], flush_at: int = 1_000_000, noise: float = 0.05, most_bits: int = 25) -> dict[str, Sketch]:
    """Sketches named in ``bits`` of what ``fold`` counts, batch by batch, over all rows of ``df``.

    A sketch whose noise exceeds ``noise`` is built anew with four times the
    counters, up to ``1 << most_bits``.
    """
    out = _build(df, bits, fold, flush_at)
    while larger := {k: min(s.bits + 2, most_bits) for k, s in out.items() if s.noise() > noise and s.bits < most_bits}:
        some = set(larger)

        def only(sums: dict[str, dict[str, int]], columns: tuple, some: set[str] = some) -> None:
            fold(sums, columns)
            for k in set(sums) - some:
                sums[k].clear()

        out |= {k: s for k, s in _build(df, {k: larger.get(k, s.bits) for k, s in out.items()}, only, flush_at).items() if k in some}
    return out


def _build(df: DataFrame, bits: dict[str, int], fold: Callable[[dict[str, dict[str, int]], tuple], None], flush_at: int) -> dict[str, Sketch]:
    """One pass over ``df``.

    Tasks send compressed blocks of their counters. Blocks are added up in a
    tree of two levels, first among about as many tasks as there are such
    groups, so no task reads the blocks of all; the driver gets the sums.
    """
    names = list(bits)
    arrow = pa.schema([("part", pa.int32()), ("branch", pa.int32()), ("data", pa.binary())])
    branches = max(1, math.isqrt(df.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = {k: Sketch(b) for k, b in bits.items()}
        sums: dict[str, dict[str, int]] = {k: {} for k in names}

        def flush() -> None:
            for k in names:
                sketches[k].add(sums[k].items())
                sums[k].clear()

        for batch in batches:
            fold(sums, tuple(c.to_pylist() for c in batch.columns))
            if sum(map(len, sums.values())) > flush_at:
                flush()
        flush()
        parts, data = [], []
        for at, k in enumerate(names):
            for no, block in enumerate(np.array_split(sketches[k].data.reshape(-1), BLOCKS)):
                if block.any():
                    parts.append(at * BLOCKS + no)
                    data.append(zlib.compress(block.tobytes(), 1))
        branch = TaskContext.get().partitionId() % branches
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([branch] * len(parts), pa.int32()), pa.array(data, pa.binary())], schema=arrow)

    def added(some: pd.DataFrame) -> pd.DataFrame:
        total = None
        for b in some["data"]:
            block = np.frombuffer(zlib.decompress(b), np.int64)
            total = block.copy() if total is None else total + block
        return pd.DataFrame({"part": [some["part"].iloc[0]], "data": [zlib.compress(total.tobytes(), 1)]})

    blocks = df.mapInArrow(run, "part int, branch int, data binary")
    if branches > 1:
        blocks = blocks.groupBy("part", "branch").applyInPandas(added, "part int, data binary")
    rows = blocks.groupBy("part").applyInPandas(added, "part int, data binary").collect()
    found = {r["part"]: np.frombuffer(zlib.decompress(r["data"]), np.int64) for r in rows}
    out = {}
    for at, k in enumerate(names):
        zeros = np.array_split(np.zeros(2 << bits[k], np.int64), BLOCKS)
        out[k] = Sketch(bits[k], np.concatenate([found.get(at * BLOCKS + no, b) for no, b in enumerate(zeros)]).reshape(2, -1))
    return out
