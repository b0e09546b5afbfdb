"""A count-min sketch of hashed items that is merged from sparse parts and answers "met twice or more".

Every task reports the cells it meets, sorted and delta coded, in shards of the cell range. A shard's reports are
merged one after the other in one count array, in a tree of bounded fan-in, so memory and the input of a task stay
bounded for any number of parts. The result is a bitmap of the cells counted at least twice, of a size that does not
depend on the data.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected

ROWS = 2
#: Bits of a cell number; a bitmap is ROWS * 2 ** CELL_BITS / 8 bytes (64 MB), the same for any input.
CELL_BITS = 28
SHARD_BITS = 7
_LOCAL = CELL_BITS - SHARD_BITS


def cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.uint32)


#: Hashes of which a task makes one report, and reports or sums that meet in one place of a shard.
HELD, FAN_IN = 1 << 21, 256


def _packed(sorted_cells: np.ndarray) -> bytes:
    """Sorted distinct cells of a shard: the steps between them, or a bitmap where that is shorter."""
    if len(sorted_cells) > 1 << _LOCAL - 4:
        bits = np.zeros(1 << _LOCAL, bool)
        bits[sorted_cells] = True
        return b"\x02" + zlib.compress(np.packbits(bits).tobytes(), 1)
    gaps = np.diff(sorted_cells, prepend=np.uint32(0))
    wide = len(gaps) and gaps.max() > 0xFFFF
    return (b"\x01" if wide else b"\x00") + zlib.compress((gaps if wide else gaps.astype(np.uint16)).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    if data[0] == 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(data[1:]), np.uint8)))
    gaps = np.frombuffer(zlib.decompress(data[1:]), np.uint32 if data[0] else np.uint16)
    return np.cumsum(gaps, dtype=np.int64)


def report(hashes: list[np.ndarray]) -> Iterator[tuple[int, bytes, bytes]]:
    """(shard, cells met, cells met more than once) of one part; one array of hashes for each of ROWS."""
    for row, h in enumerate(hashes):
        c = np.sort(cells(h))
        new = np.empty(len(c), bool)
        new[:1] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        once = c[new]
        again = once[np.diff(np.flatnonzero(new), append=len(c)) > 1]
        edges = np.arange(1 << SHARD_BITS, dtype=np.uint64) << np.uint64(_LOCAL)
        at, at2 = np.searchsorted(once, edges), np.searchsorted(again, edges)
        at, at2 = np.append(at, len(once)), np.append(at2, len(again))
        for s in range(1 << SHARD_BITS):
            if at[s + 1] > at[s]:
                base = np.uint32(s << _LOCAL)
                yield row << SHARD_BITS | s, _packed(once[at[s] : at[s + 1]] - base), _packed(again[at2[s] : at2[s + 1]] - base)


REPORT = "shard int, place bigint, once binary, again binary"


def _batch(reports: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*reports, strict=True), kinds, strict=True)], names=["shard", "place", "once", "again"])


def reports(parts: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Reports on the hashes of a task, of about HELD at once; each part has one array for each of ROWS."""
    held, size = [], 0

    def made():
        place = uuid.uuid4().int >> 65
        return _batch([(shard, place, once, again) for shard, once, again in report([np.concatenate(h) for h in zip(*held, strict=True)])])

    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size >= HELD:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def merge(found: DataFrame, parts: int) -> Bitmaps:
    """The cells that all reports together met at least twice. ``parts`` is about how many
    reports a shard has; FAN_IN of them are added up in one place, then FAN_IN of the sums, and so on."""

    def adding(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, counts = None, np.zeros(1 << _LOCAL, np.uint8)

            def done():
                if last:
                    return pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int32()), pa.array([zlib.compress(np.packbits(counts >= 2).tobytes(), 1)], pa.binary())], names=["shard", "bits"])
                return _batch([(*current, _packed(np.flatnonzero(counts).astype(np.uint32)), _packed(np.flatnonzero(counts >= 2).astype(np.uint32)))])

            for batch in batches:
                for shard, place, once, again in zip(*batch.columns, strict=True):
                    key = (shard.as_py(), 0 if last else place.as_py())
                    if key != current:
                        if current is not None:
                            yield done()
                        current = key
                        counts[:] = 0
                    for data in (once, again):
                        met = _unpacked(data.as_py())
                        counts[met] = np.minimum(counts[met] + 1, 2)
            if current is not None:
                yield done()

        return run

    n = ROWS << SHARD_BITS
    spark = found.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        dealt = found.withColumn("place", F.pmod("place", F.lit(parts).cast("long"))).repartition(max(tasks, n * parts // 16), "shard", "place")
        found = dealt.sortWithinPartitions("shard", "place").mapInArrow(adding(False), REPORT)
    rows = collected(found.repartition(min(n, max(tasks, parts)), "shard").sortWithinPartitions("shard").mapInArrow(adding(True), "shard int, bits binary"))
    return Bitmaps({r["shard"]: bytes(r["bits"]) for r in rows})


class Bitmaps:
    """The bitmaps (ROWS x bytes) of cells met at least twice, by shard; sent compressed and unpacked where they are used."""

    def __init__(self, shards: dict[int, bytes]):
        self.shards, self.unpacked = shards, None

    def __getstate__(self):
        return {"shards": self.shards, "unpacked": None}

    @property
    def bits(self) -> np.ndarray:
        if self.unpacked is None:
            made = np.zeros((ROWS << SHARD_BITS, (1 << _LOCAL) // 8), np.uint8)
            for shard, data in self.shards.items():
                made[shard] = np.frombuffer(zlib.decompress(data), np.uint8)
            self.unpacked = made.reshape(ROWS, -1)
        return self.unpacked


def repeated(bits: Bitmaps, hashes: list[np.ndarray]) -> np.ndarray:
    """Whether each item may have been met twice; false for none that was."""
    out = np.ones(len(hashes[0]), bool)
    for row, h in zip(bits.bits, hashes, strict=True):
        c = cells(h)
        out &= (row[c >> np.uint32(3)] >> (np.uint8(7) - (c & np.uint32(7)).astype(np.uint8)) & 1).astype(bool)
    return out
