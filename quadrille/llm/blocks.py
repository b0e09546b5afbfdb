"""Documents packed in blocks of a few megabytes, for operators that go over the same texts more than once.

A block is one row: ids, offsets and the joined UTF-8 bytes (compressed) of its documents, in order of id. The table is stored in
the shared folder, so a second pass meets the same documents in the same places.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, stored, text_bytes

BLOCK_BYTES = 3 << 20
#: Text bytes of the blocks that one task packs in a row, which share a run.
RUN_BYTES = 48 << 20
#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max
SCHEMA = "block bigint, ids binary, offsets binary, data binary, extra binary, run bigint"


@dataclass
class Block:
    block: int
    ids: np.ndarray
    offsets: np.ndarray
    raw: np.ndarray

    def parts(self, limit: int):
        """(first document, end, bytes, offsets) of runs of documents of about ``limit`` bytes."""
        for a, b in steps(self.offsets, limit):
            yield a, b, self.raw[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The stored table of blocks. Null texts are empty, null ids become NO_ID; ids must be integers. Columns in
    ``carry`` go along as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = uuid.uuid4().int >> 65, 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            all_ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in steps(offsets, BLOCK_BYTES):
                order = np.argsort(all_ids[a:b], kind="stable") + a
                parts = [raw[offsets[i] : offsets[i + 1]] for i in order]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                if size >= RUN_BYTES:
                    own, size = uuid.uuid4().int >> 65, 0
                size += int(ends[-1])
                values = [[uuid.uuid4().int >> 65], [all_ids[order].tobytes()], [ends.tobytes()], [zstandard.compress(np.concatenate(parts).tobytes(), 3)], [_stream(batch, order)], [own]]
                kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["block", "ids", "offsets", "data", "extra", "run"])

    return stored(docs.select(F.col(id_col).cast("long"), text_col, *carry).mapInArrow(run, SCHEMA), "blocks")


def _stream(batch: pa.RecordBatch, order: np.ndarray) -> bytes | None:
    if batch.num_columns < 3:
        return None
    own = pa.Table.from_batches([batch]).select(range(2, batch.num_columns)).take(pa.array(order))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, own.schema) as out:
        out.write_table(own)
    return sink.getvalue().to_pybytes()


def carried(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    """The blocks of an Arrow batch of the table, with their rows."""
    for i in range(batch.num_rows):
        block, ids, offsets, data = (batch.column(k)[i] for k in range(4))
        yield i, Block(block.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(offsets.as_buffer(), np.int64), np.frombuffer(zstandard.decompress(data.as_buffer()), np.uint8))


def null_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)
