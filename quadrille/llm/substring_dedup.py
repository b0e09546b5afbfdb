"""Substring dedup over windows of words: a count-min prefilter, then exact groups of the windows left.

First pass: merged sketches of all parts overestimate how often each window occurs. Second pass: only windows
estimated to repeat are grouped exactly, by 96 bits of hash; none that repeats is lost, as a sketch never counts too
low. Each block of documents has one entry per distinct window, with its smallest document id, and gets one bit back: whether
some document elsewhere has a smaller id. Window groups of any size meet as one entry per block, and a task sends one
row to a shard for all blocks of a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .blocks import Block, null_ids, pack, unpacked
from .common import STEP_BYTES, gram_hashes, stored, word_hashes, words_of

WINDOW = 13
#: Blocks of text whose window entries meet in one group of the exchange.
BLOCKS_PER_SHARD = 10
#: Blocks that make one report of a task, about.
BLOCKS_PER_REPORT = 4
#: Entries that a task sends together.
HELD = 1 << 20


class _Windows:
    """Words and windows of a block: word bounds, words per document, and the hashes and documents of its windows."""

    def __init__(self, block: Block, size: int):
        starts, ends, first, words = [], [], [np.zeros(1, np.int64)], [[], []]
        seen = 0
        for a, _, raw, offsets in block.parts(STEP_BYTES):
            s, e, f = words_of(raw, offsets)
            for which in (0, 1):
                words[which].append(word_hashes(raw, s, e, which))
            starts.append(s + block.offsets[a])
            ends.append(e + block.offsets[a])
            first.append(f[1:] + seen)
            seen += len(s)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.starts, self.ends, self.first = join(starts, np.int64), join(ends, np.int64), np.concatenate(first)
        hashes = [gram_hashes(join(w, np.uint64), size, which) for which, w in enumerate(words)]
        counts = np.diff(self.first)
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        n = len(hashes[0])
        inside = np.flatnonzero(doc[:n] == doc[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)
        self.at, self.doc = inside, doc[inside]
        self.hashes = [h[inside] for h in hashes]

    def entries(self, bits: sketch.Bitmaps, ids: np.ndarray):
        """Windows that may repeat, grouped: (their places in ``at``, group of each, then of each group: both hashes, smallest id)."""
        kept = np.flatnonzero(sketch.repeated(bits, self.hashes))
        h, g = self.hashes[0][kept], (self.hashes[1][kept] >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(h, kind="stable")
        h, g = h[order], g[order]
        if len(h) and ((h[1:] == h[:-1]) & (g[1:] != g[:-1])).any():
            order = order[np.lexsort((g, h))]
            h, g = self.hashes[0][kept][order], (self.hashes[1][kept][order] >> np.uint64(32)).astype(np.uint32)
        kept = kept[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        first = np.flatnonzero(new)
        # Documents of a block are in order of id and the sort is stable, so the first of a group has its smallest.
        return kept, np.cumsum(new) - 1, h[first], g[first], ids[self.doc[kept[first]]]


def _shards(h: np.ndarray, count: int) -> np.ndarray:
    """Bounds of the shards in sorted hashes."""
    edges = np.array([(i << 64) // count for i in range(count)], np.uint64)
    return np.append(np.searchsorted(h, edges), len(h))


def duplicates(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: ``id_col``, n_words, n_removed, kept_sha256, and with ``with_text`` the words kept, joined by a space.

    A word goes if a window of ``size`` words over it also starts in a document of a smaller id. Rows of equal id
    do not remove from each other; null ids come after all others. Null, empty and shorter texts have no window
    and keep all; an empty table gives an empty one. Every input row gives one row.
    """
    spark = docs.sparkSession
    blocks = pack(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch.reports(_Windows(block, size).hashes for batch in batches for _, block in unpacked(batch))

    n_blocks = blocks.count()
    bits = spark.sparkContext.broadcast(sketch.merge(blocks.mapInArrow(count, sketch.REPORT), n_blocks // BLOCKS_PER_REPORT + 1))
    n_shards = max(8, n_blocks // BLOCKS_PER_SHARD)

    def sent(run: int, held: list) -> pa.RecordBatch:
        """A row for each shard, with the entries of some blocks of a run, one block after the other."""
        names = np.array([name for name, *_ in held], np.int64)
        h, g, smallest = (np.concatenate(x) for x in zip(*[x[1:] for x in held], strict=True))
        of = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
        shard = np.concatenate([np.repeat(np.arange(n_shards), np.diff(_shards(x[1], n_shards))) for x in held])
        order = np.argsort(shard, kind="stable")
        h, g, smallest, of, shard = h[order], g[order], smallest[order], of[order], shard[order]
        rows = []
        bounds = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, b in zip(bounds, bounds[1:], strict=False):
            ids, index = np.unique(smallest[a:b], return_inverse=True)
            sizes = np.bincount(of[a:b], minlength=len(held)).astype(np.int32)
            rows.append((int(shard[a]), run, names.tobytes(), sizes.tobytes(), h[a:b].tobytes(), g[a:b].tobytes(), ids.tobytes(), index.astype(np.uint32 if len(ids) > 0xFFFF else np.uint16).tobytes()))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "run", "blocks", "sizes", "h", "g", "ids", "index"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, run = [], 0, None
        for batch in batches:
            for i, block in unpacked(batch):
                own = batch.column(5)[i].as_py()
                if n and (own != run or n >= HELD):
                    yield sent(run, held)
                    held, n = [], 0
                run = own
                _, _, h, g, smallest = _Windows(block, size).entries(bits.value, block.ids)
                if len(h):
                    held.append((block.block, h, g, smallest))
                    n += len(h)
        if n:
            yield sent(run, held)

    def group(table: pa.Table) -> pa.Table:
        hs, gs, ids, sizes = [], [], [], []
        for h, g, own, index in zip(*(table.column(c).to_pylist() for c in ("h", "g", "ids", "index")), strict=True):
            hs.append(np.frombuffer(h, np.uint64))
            gs.append(np.frombuffer(g, np.uint32))
            own = np.frombuffer(own, np.int64)
            ids.append(own[np.frombuffer(index, np.uint16 if len(index) == 2 * len(hs[-1]) else np.uint32)])
            sizes.append(len(hs[-1]))
        h, g, smallest = np.concatenate(hs), np.concatenate(gs), np.concatenate(ids)
        order = np.lexsort((g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        least = np.minimum.reduceat(smallest[order], np.flatnonzero(new))
        earlier = np.empty(len(h), bool)
        earlier[order] = least[np.cumsum(new) - 1] < smallest[order]
        ends = np.cumsum(sizes)
        answers = [np.packbits(earlier[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return pa.table({**{c: table.column(c) for c in ("run", "shard", "blocks", "sizes")}, "earlier": pa.array(answers, pa.binary())})

    entries = blocks.mapInArrow(send, "shard int, run bigint, blocks binary, sizes binary, h binary, g binary, ids binary, index binary")
    # An answer has one bit an entry; those of a run go along with each of its blocks. Stored, so that the entries' shuffle
    # files are gone before the blocks are shuffled.
    answers = stored(entries.groupBy("shard").applyInArrow(group, "run bigint, shard int, blocks binary, sizes binary, earlier binary"), "windows-answers")
    answers = answers.groupBy("run").agg(F.collect_list(F.struct("shard", "blocks", "sizes", "earlier")).alias("answers"))
    fields = "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * with_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in unpacked(batch):
                w = _Windows(block, size)
                kept, groups, h, _, smallest = w.entries(bits.value, block.ids)
                earlier, bounds = np.zeros(len(h), bool), _shards(h, n_shards)
                for x in batch.column(4)[i].as_py() or ():
                    own = np.flatnonzero(np.frombuffer(x["blocks"], np.int64) == block.block)
                    if len(own):
                        a, b = bounds[x["shard"]], bounds[x["shard"] + 1]
                        first = int(np.frombuffer(x["sizes"], np.int32)[: own[0]].sum())
                        earlier[a:b] = np.unpackbits(np.frombuffer(x["earlier"], np.uint8), count=first + b - a)[first:]
                gone = kept[earlier[groups] | (block.ids[w.doc[kept]] > smallest[groups])]
                yield _result(block, w, gone, size, with_text)

    return blocks.join(answers, "run", "left").select("block", "ids", "offsets", "data", "answers").mapInArrow(remove, fields).withColumnRenamed("doc", id_col)


def _result(block: Block, w: _Windows, gone: np.ndarray, size: int, with_text: bool) -> pa.RecordBatch:
    n = len(w.starts)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, w.at[gone], 1)
    np.add.at(change, w.at[gone] + size, -1)
    removed = np.cumsum(change[:n]) > 0
    total = np.concatenate([[0], np.cumsum(removed)])
    n_removed = total[w.first[1:]] - total[w.first[:-1]]
    left = np.concatenate([[0], np.cumsum(~removed)])[w.first]
    starts, length = w.starts[~removed], (w.ends - w.starts)[~removed] + 1
    ends = np.concatenate([[0], np.cumsum(length)])
    joined = np.full(ends[-1], 32, np.uint8)
    for a in range(0, len(starts), 1 << 17):
        b = min(a + (1 << 17), len(starts))
        base = ends[a]
        source = np.arange(ends[b] - base) + np.repeat(starts[a:b] - ends[a:b] + base, length[a:b])
        joined[base : ends[b]] = block.raw[np.minimum(source, len(block.raw) - 1)]
        joined[ends[a + 1 : b + 1] - 1] = 32
    texts = [joined[ends[a] : max(ends[a], ends[b] - 1)].tobytes() for a, b in zip(left, left[1:], strict=False)]
    columns = [null_ids(block.ids), pa.array(np.diff(w.first)), pa.array(n_removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
    names = ["doc", "n_words", "n_removed", "kept_sha256"]
    if with_text:
        columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
        names.append("text")
    return pa.RecordBatch.from_arrays(columns, names=names)


def op9_substring_dedup(spark, sf_dir):
    """Contract query: doc_id, n_words, n_removed and kept_sha256 of every whole text of ``documents``; see ``duplicates`` for
    nulls, empty texts, repeated rows and empty tables."""
    from .common import load

    return duplicates(load(spark, sf_dir, "documents"))
