"""A count-min prefilter: which keys of a corpus may occur more than once.

Every partition counts its keys in a count-min sketch, and the sketches are merged; an estimate is never below the true count.
Counters stop at two: a bit for "once" and a bit for "twice" per cell. A merged sketch of up to a bound is broadcast
to the second scan. Beyond it, keys are dealt into shards by range: the sketches of each shard are merged in a task of
their own, which tells every chunk of documents which of its keys are estimated repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import splitmix
from .common import free, portions, settle, tidy

U = np.uint64
#: Rows of a sketch, and the most cells of a row of one that is broadcast: at most 32 MB reach an executor's worker.
DEPTH, MOST_CELLS = 2, 1 << 27
#: Cells of a row of a shard, and documents of a chunk, if there are shards.
SHARD_CELLS, CHUNK = 1 << 23, 1024
BLOCK = 1 << 20
#: Bytes of the texts that are looked at together; a longer one is looked at alone.
TOGETHER = 3 << 20

Keys = Callable[[pa.Array], np.ndarray]
Test = Callable[[np.ndarray], np.ndarray]


def _cells(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    mask = U(cells - 1)
    return [(keys & mask).astype(np.int64), ((keys >> U(32)) & mask).astype(np.int64)]


class Sketch:
    """A count-min sketch whose counters stop at two."""

    def __init__(self, cells: int):
        self.cells = cells
        self.once = np.zeros((DEPTH, cells >> 3), np.uint8)
        self.twice = np.zeros((DEPTH, cells >> 3), np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for row, cells in enumerate(_cells(keys, self.cells)):
            at, n = np.unique(cells, return_counts=True)
            byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
            again = (n > 1) | (self.once[row][byte] & bit > 0)
            np.bitwise_or.at(self.twice[row], byte[again], bit[again])
            np.bitwise_or.at(self.once[row], byte, bit)


def repeated(twice: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the sketch estimates at two or more."""
    out = np.ones(len(keys), bool)
    for row, cells in enumerate(_cells(keys, twice.shape[1] << 3)):
        out &= twice[row][cells >> 3] & np.left_shift(1, cells & 7).astype(np.uint8) > 0
    return out


def _merged(source: DataFrame, keys_of: Keys, cells: int) -> np.ndarray:
    """The "twice" bits [DEPTH, cells / 8] of the sketch of all texts."""
    import zstandard as zstd

    block = min(BLOCK, cells >> 3)

    @tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch, press = Sketch(cells), zstd.ZstdCompressor(level=1)
        for batch in batches:
            for some in portions(batch, "text", TOGETHER):
                sketch.add(keys_of(some.column("text")))
        part = TaskContext.get().partitionId()
        for row in range(DEPTH):
            for b in range(0, cells >> 3, block):
                bits = [x[row, b : b + block] for x in (sketch.once, sketch.twice)]
                if bits[0].any():
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([b // block]), pa.array([part]), *(pa.array([press.compress(x.tobytes())]) for x in bits)], names=["row", "block", "part", "once", "twice"])

    def merge(key, group):
        import pandas as pd

        once, twice = np.zeros(block, np.uint8), np.zeros(block, np.uint8)
        opened = zstd.ZstdDecompressor()
        for a, b in zip(group["once"], group["twice"], strict=True):
            x, y = (np.frombuffer(opened.decompress(z), np.uint8) for z in (a, b))
            twice |= y | (once & x)
            once |= x
        press = zstd.ZstdCompressor(level=1)
        return pd.DataFrame({"row": [key[0]], "block": [key[1]], "part": [key[2]], "once": [press.compress(once.tobytes())], "twice": [press.compress(twice.tobytes())]})

    schema = "row long, block long, part long, once binary, twice binary"
    parts = settle(source.select("text").mapInArrow(partial, schema), "sketch")
    most = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:  # a tree: no task merges more than 64 partial blocks
        most = -(-most // 64)
        merged = settle(parts.withColumn("part", F.floor(F.col("part") / 64)).groupBy("row", "block", "part").applyInPandas(merge, schema), "sketch")
        free(parts)
        parts = merged
        if most == 1:
            break
    out = np.zeros((DEPTH, cells >> 3), np.uint8)
    opened = zstd.ZstdDecompressor()
    for row, b, raw in parts.select("row", "block", "twice").collect():  # at most DEPTH * MOST_CELLS bits
        out[row, b * block : (b + 1) * block] = np.frombuffer(opened.decompress(raw), np.uint8)
    free(parts)
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, its rows) of a batch; the rows of a chunk stand together."""
    chunk = batch.column("chunk").to_numpy()
    edges = [*np.flatnonzero(np.diff(chunk, prepend=-1)).tolist(), len(chunk)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(chunk[a]), batch.slice(a, b - a)


def _sharded(source: DataFrame, keys_of: Keys, scan, schema: str, shards: int, cells: int) -> DataFrame:
    held = settle(source.withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK)), "held")
    of_shard = lambda keys: (splitmix(keys ^ U(0x5851F42D4C957F2D)) % U(shards)).astype(np.int64)

    @tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sketch of a chunk in each shard, as the list of its keys and which of them it has more than once."""
        for batch in batches:
            for chunk, part in _runs(batch):
                keys, n = np.unique(keys_of(part.column("text")), return_counts=True)
                shard = of_shard(keys)
                order = np.argsort(shard, kind="stable")
                keys, n, shard = keys[order], n[order], shard[order]
                edges = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
                cut = list(zip(edges, edges[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[a]) for a, _ in cut], pa.int64()), pa.array([chunk] * len(cut), pa.int64()), pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([(n[a:b] > 1).tobytes() for a, b in cut], pa.binary())],
                    names=["shard", "chunk", "keys", "again"],
                )

    def answer(group: pa.Table) -> pa.Table:
        sketch, lists = Sketch(cells), [np.frombuffer(x.as_buffer(), "<u8") for x in group["keys"]]
        for keys, again in zip(lists, group["again"], strict=True):
            sketch.add(keys)
            sketch.add(keys[np.frombuffer(again.as_buffer(), bool)])
        return pa.table([group["chunk"], pa.array([keys[repeated(sketch.twice, keys)].tobytes() for keys in lists], pa.binary())], names=["chunk", "keys"])

    def scanned(left: pa.Table, right: pa.Table) -> pa.Table:
        hot = np.unique(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in right["keys"].to_pylist())]))
        test = lambda keys: hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys if len(hot) else np.zeros(len(keys), bool)
        return pa.Table.from_batches([out for batch in left.combine_chunks().to_batches() for out in scan(batch, test)])

    found = held.mapInArrow(partial, "shard long, chunk long, keys binary, again binary").groupBy("shard").applyInArrow(answer, "chunk long, keys binary")
    found = settle(found, "repeated")
    out = settle(held.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(scanned, schema), "scanned")
    free(held, found)
    return out


def scan_repeated(source: DataFrame, keys_of: Keys, scan, schema: str, bytes_per_key: int, cells_per_key: int, most_cells: int = MOST_CELLS, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """``scan(batch, test)`` over all batches of ``source``, settled; ``test`` tells which keys may occur more than once.

    ``keys_of`` gives the 64-bit keys of an array of texts, the column ``text`` of ``source``. Nulls are for it to treat.
    """
    size = source.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    need, cells = size // bytes_per_key * cells_per_key, 1 << 16
    if need > 2 * most_cells:
        return _sharded(source, keys_of, scan, schema, math.ceil(need / shard_cells), shard_cells)
    while cells < min(need, most_cells):
        cells *= 2
    sketch = source.sparkSession.sparkContext.broadcast(_merged(source, keys_of, cells))

    @tidy
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = sketch.value
        for batch in batches:
            for some in portions(batch, "text", TOGETHER):
                yield from scan(some, lambda keys: repeated(twice, keys))

    out = settle(source.mapInArrow(scanned, schema), "scanned")
    sketch.unpersist()
    return out


#: Slots of the bitmap of names; a full one lets all texts through, which only costs time.
NAMES = 1 << 20


def named(source: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``source`` whose ``name`` may be among ``names``: a bitmap of those spares the shuffle of most others."""
    slot = F.pmod(F.xxhash64("name"), F.lit(NAMES))
    bits = np.zeros(NAMES >> 3, np.uint8)
    for b, v in names.select(F.floor(slot / 8).alias("b"), F.expr(f"shiftleft(1, cast(pmod(xxhash64(name), {NAMES}) % 8 as int))").alias("v")).groupBy("b").agg(F.bit_or("v")).collect():  # at most NAMES / 8 rows
        bits[b] = v
    shared, columns = source.sparkSession.sparkContext.broadcast(bits), source.columns

    @tidy
    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0)).select(columns)

    return source.withColumn("slot", slot).mapInArrow(there, source.schema)
