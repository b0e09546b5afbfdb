"""Suffix-array dedup of byte strings by a common-prefix-aware distributed merge sort.

Suffixes are taken at anchors: the position of the smallest hashed 32-gram in each 100-byte window. Equal windows
have their anchor at the same offset, so every repeated window is found at a repeated anchor. An anchor's sort key is
the text from it to the end of its last window, then the text before it, reversed, back to its first window. Equal
keys are windows that repeat as a whole; keys that share the 32-gram form a family, a stretch of the sorted order.

A task sorts the keys of its documents to runs, keeps the first of equal ones, and sends runs front-coded, each key as
the length it shares with the one before and the rest, to ranges of the key order. A range merges its runs with a
loser tree that keeps for every loser how much it shares with the winner, so no known prefix is compared again; the
merge yields the order with its common prefix lengths. Families of different keys are resolved window by window. A
family that a range may share with its neighbours sends its windows through the same exchange once more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .blocks import Block, carried, null_ids, pack, unpacked
from .common import collected, mixed, stored

LENGTH = 100
GRAM = 32
BEFORE = LENGTH - GRAM
#: Bytes of a key: text from the anchor on, text before it, and how long both are.
KEY = LENGTH + BEFORE + 2
STEP = 1 << 20
#: Edges of ranges that the driver keeps at most; where more parts are needed, each range is dealt out by 32-gram.
EDGES = 4096
#: Sampled keys an edge, blocks of text whose keys meet in one part, keys of which a task makes one run, and blocks that
#: make one report of it.
KEYS_PER_EDGE, BLOCKS_PER_PART, HELD, BLOCKS_PER_REPORT = 8, 4, 1 << 16, 12
ENTRY = np.dtype([("id", np.int64), ("block", np.int64), ("doc", np.int32), ("start", np.int32)])
SPAN = np.dtype([("doc", np.int32), ("start", np.int32), ("length", np.int32)])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, document, hash of the 32-gram) for all windows of some documents (below 2 ** 21 bytes apiece or alone)."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    h = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)[raw]
    m = 0x9E3779B97F4A7C15
    for width in (1, 2, 4, 8, 16):
        h = h[:-width] * np.uint64(pow(m, width, 1 << 64)) + h[width:]
    h = mixed(h)
    bits = np.uint64(max(21, n.bit_length()))
    low = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    for width in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-width], low[width:])
    span = BEFORE + 1 - 64
    low = np.minimum(low[: len(low) - span], low[span:])  # the smallest of BEFORE + 1 grams from each window's start
    at = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets), 0))
    window = np.arange(len(at))
    valid = window + LENGTH <= offsets[1:][doc[: len(at)]]
    window, at, doc = window[valid], at[valid], doc[: len(valid)][valid]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return at[first], window[first], window[last], doc[first], h[at[first]]


def _sketched(h: np.ndarray) -> list[np.ndarray]:
    return [h, mixed(h * np.uint64(0xC2B2AE3D27D4EB4F))]


def keys_of(raw: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The sort keys of anchors, as fixed-size byte strings."""
    right, left = last + LENGTH - at, at - first
    out = np.zeros((len(at), KEY), np.uint8)
    after, before = np.arange(LENGTH, dtype=np.int32), np.arange(BEFORE, dtype=np.int32)
    for a in range(0, len(at), 2048):
        b = min(a + 2048, len(at))
        own = at[a:b, None].astype(np.int32)
        out[a:b, :LENGTH] = np.where(after < right[a:b, None], raw[np.minimum(own + after, len(raw) - 1)], 0)
        out[a:b, LENGTH : KEY - 2] = np.where(before < left[a:b, None], raw[np.maximum(own - 1 - before, 0)], 0)
    out[:, KEY - 2], out[:, KEY - 1] = right, left
    return out.view(f"S{KEY}").ravel()


def _text_of(key: bytes) -> bytes:
    """The text that a key stands for: from the start of its first window to the end of its last."""
    return key[LENGTH : LENGTH + key[KEY - 1]][::-1] + key[: key[KEY - 2]]


def front_coded(keys: np.ndarray, entries: np.ndarray, size: int) -> bytes:
    """A sorted run of byte strings of ``size`` bytes: shared lengths, rests of the keys, and entries."""
    m = keys.view(np.uint8).reshape(-1, size)
    differ = m[1:] != m[:-1]
    shared = np.zeros(len(m), np.uint8)
    shared[1:] = np.where(differ.any(1), differ.argmax(1), size)
    rest = m[np.arange(size) >= shared[:, None]]
    return len(m).to_bytes(4, "big") + zlib.compress(shared.tobytes() + entries.tobytes() + rest.tobytes(), 1)


class _Run:
    """Reads a front-coded run: ``key``, ``shared`` with the key before it, and ``at``, its place in ``entries``."""

    def __init__(self, data: bytes, size: int):
        n = int.from_bytes(data[:4], "big")
        plain = zlib.decompress(data[4:])
        self.shares, self.size, self.n = plain[:n], size, n
        self.entries = np.frombuffer(plain, ENTRY, n, n).tolist()
        self.rest, self.pos = plain, n + n * ENTRY.itemsize
        self.at, self.key, self.shared = -1, b"", 0

    def next(self) -> bool:
        self.at += 1
        if self.at == self.n:
            return False
        self.shared = shared = self.shares[self.at]
        end = self.pos + self.size - shared
        self.key = self.key[:shared] + self.rest[self.pos : end]
        self.pos = end
        return True


def merged(runs: list[_Run], size: int) -> Iterator[tuple[bytes, int, tuple]]:
    """(key, length shared with the key before, entry) of all runs in order, by a loser tree.

    Every run that waits in the tree knows how much its key shares with the last key that went out. Of two runs the
    one that shares more comes first, without a look at the text; only where both share equally much are the bytes
    after that compared, and the loser then knows how much it shares with the winner.
    """
    runs = [r for r in runs if r.next()]
    if not runs:
        return
    leaves = 1 << (len(runs) - 1).bit_length()
    shared = [0] * len(runs) + [-1] * (leaves - len(runs))  # -1: the run is over and loses to all
    keys = [r.key for r in runs] + [b""] * (leaves - len(runs))
    tree = [-1] * leaves
    number = int.from_bytes

    def play(a: int, b: int) -> tuple[int, int]:
        s, t = shared[a], shared[b]
        if s != t:
            return (a, b) if s > t else (b, a)
        if s < 0:
            return a, b
        x, y = keys[a], keys[b]
        if x == y:
            shared[b] = size
            return a, b
        at = size - ((number(x[s:], "big") ^ number(y[s:], "big")).bit_length() + 7 >> 3)
        if x[at] < y[at]:
            shared[b] = at
            return a, b
        shared[a] = at
        return b, a

    level = list(range(leaves))
    width = leaves
    while width > 1:
        width >>= 1
        winners = []
        for i in range(width):
            won, lost = play(level[2 * i], level[2 * i + 1])
            tree[width + i] = lost
            winners.append(won)
        level = winners
    won = level[0]
    while shared[won] >= 0:
        run = runs[won]
        yield keys[won], shared[won], run.entries[run.at]
        if run.next():
            keys[won], shared[won] = run.key, run.shared
        else:
            shared[won] = -1
        node = won + leaves >> 1
        while node:
            other = tree[node]
            s, t = shared[won], shared[other]
            if s < t:
                won, tree[node] = other, won
            elif s == t >= 0:
                won, tree[node] = play(won, other)
            node >>= 1


def _repeats(entries: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(gone, left) of entries of one content: gone are those with a smaller id elsewhere or an earlier start in their own row."""
    if len(entries) == 1:
        return [], entries
    least = min(e[0] for e in entries)
    gone, left, seen = [], [], {}
    for e in entries:
        if e[0] > least:
            gone.append(e)
            continue
        held = seen.get(e[1:3])
        if held is None:
            seen[e[1:3]] = e
        elif e[3] < held[3]:
            seen[e[1:3]] = e
            gone.append(held)
        else:
            gone.append(e)
    left = list(seen.values())
    return gone, left


class _Spans:
    """Removed spans by block."""

    def __init__(self):
        self.by_block: dict[int, list[tuple[int, int, int]]] = defaultdict(list)

    def add(self, entries, length: int):
        for e in entries:
            self.by_block[e[1]].append((e[2], e[3], length))

    def rows(self):
        for block, spans in self.by_block.items():
            yield -1, block, zlib.compress(np.array(sorted(spans), SPAN).tobytes(), 1)


def _windows(key: bytes, entries: list[tuple], reach: int) -> Iterator[tuple[bytes, list[tuple]]]:
    """Windows of the entries left of a key that lie within ``reach`` bytes shared after the anchor."""
    text, before = _text_of(key), key[KEY - 1]
    for o in range(min(len(text) - LENGTH, before + reach - LENGTH) + 1):
        yield text[o : o + LENGTH], [(e[0], e[1], e[2], e[3] + o) for e in entries]


def _resolve(family: list[tuple[bytes, list[tuple]]], spans: _Spans, outgoing: dict[bytes, list[tuple]] | None) -> None:
    """Removes repeats within a family of (key, entries); with ``outgoing`` its remaining windows are put there."""
    alone = len(family) == 1
    left = []
    for key, entries in family:
        gone, rest = _repeats(entries)
        spans.add(gone, key[KEY - 1] + key[KEY - 2])
        left.append((key, rest))
    if alone and outgoing is None and len(left[0][1]) == 1:
        return
    windows: dict[bytes, list[tuple]] = defaultdict(list) if outgoing is None else outgoing
    for i, (key, rest) in enumerate(left):
        reach = LENGTH
        if outgoing is None:
            reach = max([_shared_right(key, family[j][0]) for j in (i - 1, i + 1) if 0 <= j < len(family)], default=LENGTH)
        for text, own in _windows(key, rest, reach):
            windows[text] += own
    if outgoing is None:
        for entries in windows.values():
            if len(entries) > 1:
                spans.add(_repeats(entries)[0], LENGTH)


def _shared_right(a: bytes, b: bytes) -> int:
    """Bytes that two keys share after their anchors, in order of the keys the most with any neighbour."""
    x, y = int.from_bytes(a[:LENGTH], "big"), int.from_bytes(b[:LENGTH], "big")
    return min(LENGTH - ((x ^ y).bit_length() + 7 >> 3), LENGTH)


def _batch(rows) -> pa.RecordBatch | None:
    rows = list(rows)
    if not rows:
        return None
    part, block, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], names=["part", "block", "data"])


ROW = "part int, block bigint, data binary"


def _pieces(block: Block):
    """(first document, bytes, offsets, bytes before) of runs of documents of about STEP bytes; a longer document comes in
    pieces that overlap, so that every window of LENGTH bytes is in exactly one."""
    for a, b, raw, offsets in block.parts(STEP):
        if b - a > 1 or len(raw) < 2 * STEP:
            yield a, raw, offsets, 0
            continue
        for begin in range(0, len(raw), STEP):
            own = raw[begin : begin + STEP + LENGTH - 1]
            yield a, own, np.array([0, len(own)]), begin


def _block_keys(block: Block, bits: sketch.Bitmaps):
    """Keys and entries of the anchors of a block that may repeat."""
    keys, entries = [np.zeros(0, f"S{KEY}")], [np.zeros(0, ENTRY)]
    for a, raw, offsets, begin in _pieces(block):
        at, first, last, doc, h = anchors(raw, offsets)
        kept = np.flatnonzero(sketch.repeated(bits, _sketched(h)))
        at, first, last, doc = at[kept], first[kept], last[kept], doc[kept]
        keys.append(keys_of(raw, at, first, last))
        e = np.zeros(len(kept), ENTRY)
        e["id"], e["block"], e["doc"], e["start"] = block.ids[doc + a], block.block, doc + a, first - offsets[doc] + begin
        entries.append(e)
    return np.concatenate(keys), np.concatenate(entries)


def _combined(keys: np.ndarray, entries: np.ndarray):
    """Sorted keys and entries of some blocks without those that repeat an earlier one, and the entries that do. Entries come
    in order of id within their block, then of start."""
    order = np.argsort(entries["id"], kind="stable")
    order = order[np.argsort(keys[order], kind="stable")]
    keys, entries = keys[order], entries[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    lead = entries[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    row = np.ones(len(keys), bool)
    row[1:] = (entries["doc"][1:] != entries["doc"][:-1]) | (entries["block"][1:] != entries["block"][:-1])
    gone = ~new & ((entries["id"] > lead["id"]) | ~row)
    return keys[~gone], entries[~gone], keys[gone], entries[gone]


def _gram_hashes(keys: np.ndarray) -> np.ndarray:
    """A hash of the 32-gram that each key begins with, so of its family."""
    words = keys.view(np.uint8).reshape(-1, KEY)[:, :GRAM].copy().view(np.uint64)
    h = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
    return h


def _right_lengths(keys: np.ndarray) -> np.ndarray:
    m = keys.view(np.uint8).reshape(-1, KEY)
    return m[:, KEY - 2].astype(np.int32) + m[:, KEY - 1]


def spans_of(blocks: DataFrame) -> DataFrame:
    """Removed spans of all blocks, in rows (block, data) of compressed SPAN arrays."""
    spark = blocks.sparkSession

    def count(batches):
        yield from sketch.reports(_sketched(anchors(raw, offsets)[4]) for batch in batches for _, block in unpacked(batch) for _, raw, offsets, _ in _pieces(block))

    n_blocks = blocks.count()
    parts = max(16, n_blocks // BLOCKS_PER_PART)
    ranges = min(parts, EDGES)
    deals = -(-parts // ranges)
    bits = spark.sparkContext.broadcast(sketch.merge(blocks.mapInArrow(count, sketch.REPORT), n_blocks // BLOCKS_PER_REPORT + 1))

    def sample(batches):
        for batch in batches:
            for _, block in unpacked(batch):
                _, raw, offsets, _ = next(_pieces(block))
                at, first, last, _, h = anchors(raw, offsets)
                kept = np.flatnonzero(sketch.repeated(bits.value, _sketched(h)))
                kept = kept[np.argsort(mixed(at[kept].astype(np.uint64) + np.uint64(block.block)))[:64]]
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.array([k.ljust(KEY, b"\0") for k in keys_of(raw, at[kept], first[kept], last[kept]).tolist()], pa.binary())], names=["key"])

    # The edges balance the ranges; any would give the same result. A fixed number of keys, whatever the input.
    rows = collected(blocks.mapInArrow(sample, "key binary").orderBy(F.xxhash64("key")).limit(KEYS_PER_EDGE * EDGES))
    known = sorted(bytes(r["key"]) for r in rows)
    edges = np.array(sorted({known[len(known) * i // ranges] for i in range(1, ranges)}) if known else [], f"S{KEY}")

    def runs_of(held):
        keys, entries, gone_keys, gone = _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
        out = []
        lengths = _right_lengths(gone_keys) if len(gone) else ()
        for block in np.unique(gone["block"]).tolist():
            own = gone["block"] == block
            spans = np.zeros(int(own.sum()), SPAN)
            spans["doc"], spans["start"], spans["length"] = gone["doc"][own], gone["start"][own], lengths[own]
            out.append((block % ((len(edges) + 1) * deals), block, b"S" + zlib.compress(np.sort(spans).tobytes(), 1)))
        part = np.searchsorted(edges, keys, "right") * deals
        if deals > 1:
            part = part + (_gram_hashes(keys) % np.uint64(deals)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, entries, part = keys[order], entries[order], part[order]
        bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for a, b in zip(bounds, bounds[1:], strict=False):
            out.append((int(part[a]), 0, b"R" + front_coded(keys[a:b], entries[a:b], KEY)))
        return _batch(out)

    def send(batches):
        held, size = [], 0
        for batch in batches:
            for _, block in unpacked(batch):
                held.append(_block_keys(block, bits.value))
                size += len(held[-1][0])
                if size >= HELD:
                    yield runs_of(held)
                    held, size = [], 0
        if size:
            yield runs_of(held)

    def resolve(table: pa.Table) -> pa.Table:
        spans, outgoing, out, runs = _Spans(), defaultdict(list), [], []
        for block, data in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True):
            if data[:1] == b"S":
                out.append((-1, block, data[1:]))
            else:
                runs.append(_Run(data[1:], KEY))
        family, first = [], True
        for key, shared, entry in merged(runs, KEY):
            if shared == KEY:
                family[-1][1].append(entry)
                continue
            if shared < GRAM and family:
                _resolve(family, spans, outgoing if first else None)
                family, first = [], False
            family.append((key, [entry]))
        if family:
            _resolve(family, spans, outgoing)
        out += spans.rows()
        out += _window_runs(outgoing, (len(edges) + 1) * deals)
        return pa.Table.from_batches([_batch(out)] if out else [], schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]))

    found = stored(blocks.mapInArrow(send, ROW).groupBy("part").applyInArrow(resolve, ROW), "suffix-spans")

    def again(table: pa.Table) -> pa.Table:
        spans, group, before = _Spans(), [], None
        for key, _, entry in merged([_Run(d, LENGTH) for d in table.column("data").to_pylist()], LENGTH):
            if key != before:
                spans.add(_repeats(group)[0] if group else [], LENGTH)
                group, before = [], key
            group.append(entry)
        spans.add(_repeats(group)[0] if group else [], LENGTH)
        out = list(spans.rows())
        return pa.Table.from_batches([_batch(out)] if out else [], schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]))

    shared = found.where("part >= 0").groupBy("part").applyInArrow(again, ROW)
    return found.where("part < 0").unionAll(shared).select("block", "data")


def _window_runs(windows: dict[bytes, list[tuple]], parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Runs of windows for the second exchange, dealt by their hash; of equal ones what may still be first."""
    by_part: dict[int, list[tuple[bytes, tuple]]] = defaultdict(list)
    for text, entries in windows.items():
        own = by_part[zlib.crc32(text) % parts]
        for e in entries:
            own.append((text, e))
    for part, own in by_part.items():
        own.sort()
        keys = np.frombuffer(b"".join(t for t, _ in own), np.uint8)
        yield part, 0, front_coded(keys, np.array([e for _, e in own], ENTRY), LENGTH)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, with ``with_text`` the text left, and the
    columns in ``carry``.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a document of a smaller id, or earlier
    in the same row. Rows of equal id do not remove from each other; null ids come last. Null, empty and shorter
    texts keep all; an empty table gives an empty one; every input row gives one row. The text left keeps every
    character of which a byte stays.
    """
    if carry and {id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"} & {*carry}:
        raise ValueError(f"columns that the result has itself can't be carried: {carry}")
    blocks = pack(docs, id_col, text_col, carry)
    spans = spans_of(blocks).groupBy("block").agg(F.collect_list("data").alias("spans"))
    fields = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * with_text + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def remove(batches):
        for batch in batches:
            for i, block in unpacked(batch):
                found = [np.frombuffer(zlib.decompress(d), SPAN) for d in batch.column(5)[i].as_py() or ()]
                out = _result(block, np.concatenate(found) if found else np.zeros(0, SPAN), with_text)
                for name, column in zip(carry, carried(batch.column(4)[i].as_py()).columns if carry else (), strict=True):
                    out = out.append_column(name, column.combine_chunks())
                yield out

    return blocks.join(spans, "block", "left").select("block", "ids", "offsets", "data", "extra", "spans").mapInArrow(remove, fields).withColumnRenamed("doc", id_col)


def _intervals(spans: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and end in the block of the maximal runs that ``spans`` cover, none over the end of a document."""
    spans = np.sort(spans, order=["doc", "start"])
    doc = spans["doc"]
    begin = offsets[doc] + spans["start"]
    # Every end lies within its document, so the furthest end so far tells of this document's spans alone.
    reach = np.maximum.accumulate(begin + spans["length"]) if len(spans) else begin
    new = np.ones(len(spans), bool)
    new[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], begin[first], reach[np.append(first[1:], len(spans)) - 1] if len(first) else begin


def _result(block: Block, spans: np.ndarray, with_text: bool) -> pa.RecordBatch:
    raw, offsets = block.raw, block.offsets
    doc, begin, end = _intervals(spans, offsets)
    stays = np.ones(len(raw), bool)
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        stays[a:b] = False
    n = len(offsets) - 1
    removed, runs = np.bincount(doc, end - begin, n).astype(np.int64), np.bincount(doc, minlength=n)
    left, ends = raw[stays], offsets - np.concatenate([[0], np.cumsum(removed)])
    hashes = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
    columns = [null_ids(block.ids), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs.astype(np.int64)), pa.array(hashes, pa.string())]
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        columns.append(pa.array([_characters(raw[a:b], stays[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary()).cast(pa.string()))
        names.append("text")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _characters(raw: np.ndarray, stays: np.ndarray) -> bytes:
    """The characters of a text of which a byte stays."""
    if stays.all():
        return raw.tobytes()
    lead = np.flatnonzero(raw & 0xC0 != 0x80)
    return raw[np.repeat(np.logical_or.reduceat(stays, lead), np.diff(np.append(lead, len(raw))))].tobytes()


def op8_suffix_dedup(spark, sf_dir):
    """Contract query: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every whole text of ``documents``; see ``dedup``
    for nulls, empty and very long texts, repeated rows and empty tables."""
    from .common import load

    return dedup(load(spark, sf_dir, "documents"))
