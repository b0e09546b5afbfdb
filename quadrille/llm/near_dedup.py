"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A merged count sketch over all documents gives rough document frequencies of five-word shingles, for candidates only. A
consistent weighted sample of each text's shingles agrees between two texts with the probability of their weighted
Jaccard similarity; BANDS groups of ROWS samples make buckets. Buckets, large ones in pieces whose leaders meet again,
first propose links along their strongest estimated agreements, a few per member. The shingles of texts with proposals
are then counted exactly over all documents; with these frequencies every proposal is verified by the weighted Jaccard
similarity of both whole texts, and classes are the connected components of verified links.

What the few left out is tested next. Within a bucket a search spreads from class to class along estimates of longer
signatures and returns one row for each class it joins, never the pairs; classes joined so make areas. Within an area
the same search spreads along exact similarities of whole texts and again returns one row for each class it joins. No
pair of different classes of a bucket is left untested unless its estimate is too low, and the rows that come out grow
with the number of classes, not of pairs. Nodes are distinct texts, so exact copies cost one row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHILE_STORED, collected, emptied, gram_hashes, mixed, set_for, steps, stored, text_bytes, word_hashes, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 3
SAMPLES = BANDS * ROWS
#: Agreeing samples from which a pair is verified (an estimate of 0.5), and from which one link settles a member.
LEAST_AGREE, SETTLED = SAMPLES // 2, 38
#: Proposals each unsettled member of a bucket keeps at first, the best first; ``linked`` tests the rest.
BEST = 2
#: Further samples of texts that have proposed links, and agreeing samples of all from which a pair of the rest is
#: verified (an estimate of 0.68, 4.8 standard deviations below SIMILARITY).
FINE = 214
LEAST_FINE = round(0.68 * (SAMPLES + FINE))
#: Members of a bucket that are compared at once; larger buckets are dealt out in pieces or pairs of blocks.
PIECE = 4096
#: Characters of the texts that are verified at once, about. Areas of up to AREA_BLOCKS times as many are verified as a
#: whole, larger ones by the buckets in them.
AREA_CHARS, AREA_BLOCKS = 1 << 21, 8
#: Cells of the document frequency sketch, the same for any input.
CELL_BITS = 20
CELL_SHARDS, CELL_PLACES = 16, 256
STEP = 1 << 18
#: Bits of the filter on texts that have proposed links.
FILTER_BITS = 26
#: For exact counts: shingles that a task holds before it sends them, about those of a range of shingles, the least bits
#: that name a range, and characters of the texts that ask together.
HELD, RANGE_KEYS, RANGE_BITS, CHUNK_CHARS = 1 << 21, 1 << 21, 6, 1 << 21


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of some documents; shingles are 48-bit hashes. A text of 1 to 4 words is one
    shingle, one without words has none."""
    starts, ends, first = words_of(raw, offsets)
    words = word_hashes(raw, starts, ends)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    h = gram_hashes(words, SHINGLE)
    inside = doc[: len(h)] == doc[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    hashes, docs = [h[inside]], [doc[: len(h)][inside]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes.append(gram_hashes(words, n)[first[short]])
            docs.append(short)
    key = np.concatenate(docs).astype(np.uint64) << np.uint64(48) | np.concatenate(hashes) >> np.uint64(16)
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def _cells(shingle: np.ndarray) -> np.ndarray:
    return (mixed(shingle.copy()) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _parts(column: pa.Array):
    raw, offsets = text_bytes(column)
    for a, b in steps(offsets, STEP):
        for c in range(a, b, 60_000):  # document numbers have 16 bits
            d = min(b, c + 60_000)
            yield c, d, raw[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency of what ``df`` of ``n`` documents have."""
    return np.log((n + 1) / (np.minimum(df, n) + 1)) + 1


def rough_idf(total: np.ndarray, n: int) -> np.ndarray:
    """Rough inverse document frequency by cell of the sketch. What the median cell holds is what strangers add to any
    cell; without it a rare shingle stays rare in a sketch that millions of others have filled."""
    return idf_of(np.maximum(total - int(np.median(total)), 1), n).astype(np.float32)


def idf_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rough inverse document frequency by cell, over all documents."""
    return rough_idf(*_sketch(docs, text_col))


def _sketch(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """(documents by cell, one for each of their shingles; number of documents)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, raw, offsets in _parts(batch.column(0)):
                total += np.bincount(_cells(shingles(raw, offsets)[1]), minlength=1 << CELL_BITS)
        if n:
            pieces = np.split(total.astype(np.int32 if total.max() < 1 << 31 else np.int64), CELL_SHARDS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CELL_SHARDS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in pieces], pa.binary()), pa.array([n] * CELL_SHARDS, pa.int64())], names=["shard", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << CELL_BITS) // CELL_SHARDS
        sums: dict[int, list] = {}
        for batch in batches:
            for shard, data, n in zip(*batch.columns, strict=True):
                plain = zlib.decompress(data.as_py())
                own = sums.setdefault(shard.as_py(), [np.zeros(size, np.int64), 0])
                own[0] += np.frombuffer(plain, np.int32 if len(plain) == 4 * size else np.int64)
                own[1] += n.as_py()
        for shard, (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), pa.array([n], pa.int64())], names=["shard", "counts", "n"])

    kinds = "shard int, counts binary, n bigint"
    # A shard's counts are added up in up to CELL_PLACES places first; CELL_SHARDS rows of a fixed size come back.
    placed = docs.select(text_col).mapInArrow(count, kinds).withColumn("place", F.pmod(F.spark_partition_id(), F.lit(CELL_PLACES)))
    sums = placed.repartition("shard", "place").drop("place").mapInArrow(add, kinds)
    rows = collected(sums.repartition(CELL_SHARDS, "shard").mapInArrow(add, kinds))
    total = np.zeros(1 << CELL_BITS, np.int64)
    for r in rows:
        size = (1 << CELL_BITS) // CELL_SHARDS
        total[r["shard"] * size : (r["shard"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return total, rows[0]["n"] if rows else 0


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, no more than the largest needs."""
    wide = (int(values.max(initial=1)).bit_length() + 7) // 8
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


def _ranges(key: np.ndarray, bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(range, first, end, packed steps between shingles) of sorted distinct shingles, by their first ``bits`` bits."""
    low = np.uint64(48 - bits)
    own = key >> low
    at = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1)) != 0).tolist()
    for a, b in zip(at, [*at[1:], len(key)], strict=True):
        yield int(own[a]), a, b, _packed(np.diff(key[a:b], prepend=own[a] << low))


def _keys(which: int, n: int, data: bytes, bits: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, n), dtype=np.uint64) + (np.uint64(which) << np.uint64(48 - bits))


def weighed(texts: DataFrame, docs: DataFrame, text_col: str, n: int, incidences: int) -> DataFrame:
    """``texts`` (node, text) with ``idf``: the exact inverse document frequency, over the ``n`` rows of ``docs``, of each
    shingle of the text in the order of ``shingles``.

    Texts ask in chunks for their distinct shingles; a range of shingles adds up what all documents have of those.
    ``incidences`` (the sum of the sketch) and the length of the texts decide how many ranges and chunks there are.
    """
    bits = max(RANGE_BITS, (incidences // RANGE_KEYS).bit_length())
    chunks = (texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // CHUNK_CHARS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent():
            key, times = np.unique(np.concatenate(held), return_counts=True)
            rows = [(r, b - a, data, _packed(times[a:b])) for r, a, b, data in _ranges(key, bits)]
            which, size, keys, counts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(size, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["range", "size", "keys", "counts"])

        for batch in batches:
            for _, _, raw, offsets in _parts(batch.column(0)):
                held.append(shingles(raw, offsets)[1])
                size += len(held[-1])
                if size >= HELD:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def own_shingles(table: pa.Table):
        return [(a, b, *shingles(raw, offsets)[:2]) for a, b, raw, offsets in _parts(table.column("text").combine_chunks())]

    def ask(table: pa.Table) -> pa.Table:
        parts = own_shingles(table)
        key = np.unique(np.concatenate([p[3] for p in parts]))
        rows = [(r, b - a, data) for r, a, b, data in _ranges(key, bits)]
        which, size, keys = zip(*rows, strict=True) if rows else ((), (), ())
        chunk = [table.column("chunk")[0].as_py()] * len(rows)
        return pa.table({"range": pa.array(which, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "size": pa.array(size, pa.int32()), "keys": pa.array(keys, pa.binary())})

    def add(counted: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = [_keys(r, n, data, bits) for r, n, data in zip(*(asked.column(c).to_pylist() for c in ("range", "size", "keys")), strict=True)]
        out = []
        if wanted:
            every = np.unique(np.concatenate(wanted))
            df = np.zeros(len(every), np.int64)
            for i in range(counted.num_rows):
                r, n, data, times = (counted.column(c)[i].as_py() for c in ("range", "size", "keys", "counts"))
                key = _keys(r, n, data, bits)
                at = np.minimum(np.searchsorted(every, key), len(every) - 1)
                hit = every[at] == key
                df[at[hit]] += _unpacked(times, n)[hit].astype(np.int64)
            out = [_packed(df[np.searchsorted(every, key)]) for key in wanted]
        return pa.table({"chunk": asked.column("chunk").cast(pa.int64()), "range": asked.column("range").cast(pa.int64()), "size": asked.column("size").cast(pa.int32()), "df": pa.array(out, pa.binary())})

    def answer(table: pa.Table, counted: pa.Table) -> pa.Table:
        idf = [b""] * table.num_rows
        if table.num_rows:
            parts = own_shingles(table)
            every = np.unique(np.concatenate([p[3] for p in parts]))
            rows = sorted(zip(*(counted.column(c).to_pylist() for c in ("range", "size", "df")), strict=True))
            weight = idf_of(np.concatenate([np.zeros(0, np.uint64), *(_unpacked(data, m) for _, m, data in rows)]).astype(np.int64), n)
            for a, b, doc, key in parts:
                own = weight[np.searchsorted(every, key)]
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                for d in range(b - a):
                    idf[a + d] = zlib.compress(own[ends[d] : ends[d + 1]].tobytes(), 1)
        return pa.table({"node": table.column("node").cast(pa.binary()), "text": table.column("text").cast(pa.string()), "idf": pa.array(idf, pa.binary())})

    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks).cast("long")))
    asked = dealt.groupBy("chunk").applyInArrow(ask, "range bigint, chunk bigint, size int, keys binary")
    counted = docs.select(text_col).mapInArrow(count, "range bigint, size int, keys binary, counts binary")
    found = counted.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(add, "chunk bigint, range bigint, size int, df binary")
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(answer, "node binary, text string, idf binary")


def _own_idf(column: pa.Array) -> np.ndarray:
    """What ``weighed`` gave to each shingle of some texts."""
    return np.frombuffer(b"".join(zlib.decompress(x) for x in column.to_pylist()))


def _quantiles(which: str) -> np.ndarray:
    """4096 quantiles of ln of a Gamma(2, 1) variable, or of the variable itself, by its distribution function."""
    x = np.geomspace(1e-3, 40, 200_001)
    p = (np.arange(4096) + 0.5) / 4096
    q = np.interp(p, 1 - np.exp(-x) * (1 + x), x)
    return (np.log(q) if which == "log" else q).astype(np.float32)


_GAMMA, _LOG_GAMMA = _quantiles("plain"), _quantiles("log")
_ONE_BY_GAMMA = 1 / _GAMMA
_SEEDS = np.random.default_rng(4).integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_FINE_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, FINE, dtype=np.uint64)


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, seeds: np.ndarray = _SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, their consistent weighted samples, one for each seed, as 32-bit names)."""
    if not len(doc):
        return doc, np.zeros((0, len(seeds)), np.uint32)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    out = np.empty((len(at), len(seeds)), np.uint32)
    log_w = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFF)
    for j, seed in enumerate(seeds):
        x = shingle ^ seed
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        i = (x & low).view(np.int64)
        r = _GAMMA[i]
        beta = (x >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w * _ONE_BY_GAMMA[i] + beta)
        log_a = _LOG_GAMMA[(x >> np.uint64(12) & low).view(np.int64)] - r * (t - beta + 1)
        order = log_a.view(np.int32)
        rank = np.where(order < 0, ~order, order ^ np.int32(-(1 << 31))).view(np.uint32)
        name = (x >> np.uint64(24)).astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        out[:, j] = np.minimum.reduceat(rank.astype(np.uint64) << np.uint64(32) | name, at).astype(np.uint32)
    return doc[at], out


def _bands(names: np.ndarray) -> np.ndarray:
    out = np.empty((len(names), BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(len(names), b, np.uint64)
        for r in range(ROWS):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + names[:, b * ROWS + r])
        out[:, b] = h.view(np.int64)
    return out


def node(text_col: str = "text"):
    """The name of a distinct text: 128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32))


def signatures(texts: DataFrame, idf) -> DataFrame:
    """(node, signature of SAMPLES bytes, bands) of ``texts`` (node, text); texts without words have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in _parts(batch.column(1)):
                doc, shingle, count = shingles(raw, offsets)
                own, names = samples(doc, shingle, count * idf.value[_cells(shingle)])
                signature, bands = [b""] * (b - a), [[]] * (b - a)
                for d, s, x in zip(own.tolist(), (names & np.uint32(0xFF)).astype(np.uint8), _bands(names).tolist(), strict=True):
                    signature[d], bands[d] = s.tobytes(), x
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["node", "signature", "bands"])

    return texts.mapInArrow(run, "node binary, signature binary, bands array<bigint>")


def finer(signed: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """``texts`` (node, text, perhaps idf) with the signature and bands of ``signed``, with FINE more bytes of signature.
    Texts that have an ``idf`` (see ``weighed``) are sampled by it, others by the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in _parts(batch.column(1)):
                part = batch.slice(a, b - a)
                doc, shingle, count = shingles(raw, offsets)
                weight = _own_idf(part.column(2)) if batch.num_columns > 2 else idf.value[_cells(shingle)]
                own, names = samples(doc, shingle, count * weight, _FINE_SEEDS)
                fine = pa.array([s.tobytes() for s in (names & np.uint32(0xFF)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in part.columns), fine], names=[*batch.schema.names, "fine"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields)
    # A fixed number of partitions, as the work does not follow from the bytes.
    more = texts.repartition(_partitions(texts), "node").mapInArrow(run, f"{fields}, fine binary")
    return signed.join(more, "node").select(*texts.columns, F.concat("signature", "fine").alias("signature"), "bands")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _proposals(sig: np.ndarray, keep: int = BEST) -> tuple[set[tuple[int, int]], list[int]]:
    """Links (index pairs) that a piece of a bucket proposes, and its leaders."""
    n = len(sig)
    best = np.full((n, keep), -1, np.int64)
    agreed = np.zeros((n, keep), np.int16)

    def offer(members: np.ndarray, partners: np.ndarray, agree: np.ndarray):
        for slot in range(keep):
            better = agree > agreed[members, slot]
            m = members[better]
            old_p, old_a = best[m, slot].copy(), agreed[m, slot].copy()
            best[m, slot], agreed[m, slot] = partners[better], agree[better]
            partners, agree = partners.copy(), agree.copy()
            partners[better], agree[better] = old_p, old_a

    pool, leaders, links = np.arange(n), [], set()
    while len(pool):
        lead, pool = int(pool[0]), pool[1:]
        leaders.append(lead)
        agree = (sig[pool] == sig[lead]).sum(1, dtype=np.int16)
        strong = agree >= SETTLED
        links.update((lead, int(x)) for x in pool[strong])
        weak = (agree >= LEAST_AGREE) & ~strong
        if weak.any():
            members = pool[weak]
            offer(members, np.full(len(members), lead), agree[weak])
            taken = pool[strong]
            if len(taken):
                for a in range(0, len(members), 256):
                    own = members[a : a + 256]
                    near = (sig[own][:, None, :] == sig[taken][None, :, :]).sum(2, dtype=np.int16) if len(taken) <= 512 else np.stack([(sig[taken] == s).sum(1, dtype=np.int16) for s in sig[own]])
                    offer(own, taken[near.argmax(1)], near.max(1))
        pool = pool[~strong]
    m, slot = np.nonzero(agreed >= LEAST_AGREE)
    links.update(zip(best[m, slot].tolist(), m.tolist(), strict=True))
    return links, leaders


def candidates(signed: DataFrame, keep: int = BEST) -> tuple[DataFrame, DataFrame]:
    """Distinct proposed links (a, b) of nodes, a < b, from all buckets, at most ``keep`` + 1 a member and bucket; and nodes
    of large buckets whose members are unlike each other, to be compared by ``loose``.

    A bucket of more than PIECE members is dealt out in pieces, and their leaders meet in a next round, until all fit in
    one piece or the leaders of a round are more than half of those that led the round before.
    """
    members = signed.where(F.size("bands") > 0).select(F.explode("bands").alias("bucket"), "node", "signature")
    rows, before = None, None
    while True:
        # Stored, so that its size is known: a few large buckets are broadcast, and the members are shuffled once.
        sizes = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE), "large-buckets")
        if sizes.isEmpty():
            dealt = members.withColumn("piece", F.lit(-1).cast("bigint"))
        else:
            dealt = members.join(sizes, "bucket", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PIECE)), F.lit(-1)))
        dealt = dealt.select("bucket", "piece", "node", "signature").repartition("bucket", "piece").sortWithinPartitions("bucket", "piece", "node")
        found = stored(dealt.mapInArrow(lambda batches: _propose(batches, keep), "a binary, b binary, bucket bigint, signature binary"), "candidates")
        pairs = found.where("b IS NOT NULL").select("a", "b")
        rows = pairs if rows is None else rows.unionAll(pairs)
        members = found.where("b IS NULL").select("bucket", F.col("a").alias("node"), "signature")
        left = members.count()
        if not left or before is not None and 2 * left > before:
            return stored(rows.distinct(), "links"), members.select("node").distinct()
        before = left


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group of sorted batches, together."""
    left = None
    for batch in (*batches, None):
        if batch is None:
            held, left = left, None
        else:
            held = pa.Table.from_batches([batch])
            held = pa.concat_tables([left, held]) if left is not None else held
        if held is None or not held.num_rows:
            continue
        new = np.zeros(held.num_rows - 1, bool)
        for k in keys:
            new |= np.diff(held.column(k).to_numpy()) != 0
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        if batch is None:
            edges.append(held.num_rows)
        else:
            left = held.slice(edges[-1])
        for a, b in zip(edges, edges[1:], strict=False):
            yield held.slice(a, b - a)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1)


def _propose(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the pieces, with the leaders of those of a large bucket (b is null)."""
    for group in _groups(batches, ("bucket", "piece")):
        bucket, piece, n = group.column("bucket")[0].as_py(), group.column("piece")[0].as_py(), group.num_rows
        if n == 1 and piece < 0:
            continue
        sig = _matrix(group.column("signature"))
        found, leaders = _proposals(sig, keep)
        names = group.column("node").to_pylist()
        rows = [(min(names[x], names[y]), max(names[x], names[y]), None, None) for x, y in found]
        if piece >= 0:
            rows += [(names[x], None, bucket, sig[x].tobytes()) for x in leaders]
        if rows:
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["a", "b", "bucket", "signature"])


def verified(links: DataFrame, texts: DataFrame, idf, least: float = SIMILARITY) -> DataFrame:
    """``links`` (a, b) whose texts have a weighted Jaccard similarity of ``least`` or more, with ``similarity``. Texts that
    have an ``idf`` (see ``weighed``) are weighted by it, others by the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            sizes = np.array([len(x) + len(y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in steps(ends, 1 << 20):
                for c in range(a, b, 30_000):
                    d = min(b, c + 30_000)
                    left, right, *own = (x.slice(c, d - c) for x in batch.columns[2:])
                    scores[c:d] = weighted_jaccard(left, right, idf.value, own)
            keep = pa.array(scores >= least - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(scores).filter(keep)], names=["a", "b", "similarity"])

    more = texts.columns[1:]
    x, y = texts.toDF("a", *(f"{c}_a" for c in more)), texts.toDF("b", *(f"{c}_b" for c in more))
    both = links.join(x, "a").join(y, "b").select("a", "b", *(f"{c}_{k}" for c in more for k in "ab"))
    return both.mapInArrow(run, "a binary, b binary, similarity double")


def weighted_jaccard(left: pa.Array, right: pa.Array, idf: np.ndarray, own: list[pa.Array] | None = None) -> np.ndarray:
    """The similarity of each pair of texts: sum of the smaller over sum of the larger TF-IDF weights; 0 without words.
    ``own`` are the columns of both sides that ``weighed`` made; without them ``idf`` by cell counts."""
    keys, counts = [], []
    for column in (left, right):
        raw, offsets = text_bytes(column)
        doc, shingle, count = shingles(raw, offsets)
        keys.append(doc.astype(np.uint64) << np.uint64(48) | shingle)
        counts.append(count)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, count = key[order], np.concatenate(counts)[order]
    if not len(key):
        return np.zeros(len(left))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(key)))
    high = np.maximum.reduceat(count, at)
    low = np.where(size == 2, np.minimum.reduceat(count, at), 0)
    weight = np.concatenate([_own_idf(c) for c in own])[order[at]] if own else idf[_cells(key[at] & np.uint64((1 << 48) - 1))].astype(np.float64)
    pair = (key[at] >> np.uint64(48)).astype(np.int64)
    top, bottom = np.bincount(pair, low * weight, len(left)), np.bincount(pair, high * weight, len(left))
    return top / np.maximum(bottom, 1e-12)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``links`` (a, b); label is the smallest node of the component. Labels spread to
    neighbours and jump to the label of their label until nothing changes; every round is stored."""
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.toDF("of", "next")
        after = stored(spread.join(jump, spread["label"] == jump["of"], "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = not after.where("old <> label").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels


def _spread(label: np.ndarray, hits) -> Iterator[tuple[int, int]]:
    """Index pairs that join classes (equal ``label``), one for each class that a search reaches from another.

    ``hits(frontier, pool)`` gives the index pairs of both that are linked. A search starts at a class and goes on from
    every member it reaches, so each member meets what no search has reached before it; of classes that are joined
    already no further pair is tested.
    """
    order = np.argsort(label, kind="stable")
    edges = np.flatnonzero(np.diff(label[order], prepend=label[order[:1]] - 1)) if len(label) else np.zeros(0, np.int64)
    of_class = np.split(order, edges[1:])
    number = np.empty(len(label), np.int64)
    for i, members in enumerate(of_class):
        number[members] = i
    free = np.ones(len(label), bool)
    for first in of_class:
        if not free[first[0]]:
            continue
        queue = first
        free[first] = False
        while len(queue) and len(pool := np.flatnonzero(free)):
            step = max(1, (1 << 14) // len(pool))
            front, queue = queue[:step], queue[step:]
            reached = {}
            for u, v in hits(front, pool):
                reached.setdefault(int(number[v]), (u, v))
            for pair in reached.values():
                yield pair
            if reached:
                more = np.concatenate([of_class[c] for c in reached])
                free[more] = False
                queue = np.concatenate([queue, more])


def _alike(sig: np.ndarray, front: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Whether each of ``front`` (rows) agrees with each of ``pool`` on LEAST_FINE samples."""
    return (sig[front][:, None, :] == sig[pool][None, :, :]).sum(2, dtype=np.int16) >= LEAST_FINE


def _dealt(members: DataFrame, weight, most: int) -> DataFrame:
    """Rows (cell, x, y, block, ..) of ``members`` (cell, label, node, ..) of cells of several labels. A cell is dealt out in
    blocks of a ``weight`` of about ``most``, and a group (cell, x, y) compares two blocks or one with itself.

    Members of the cell's heaviest label stand in blocks of their own, which meet only the others.
    """
    sizes = members.groupBy("cell", "label").agg(F.sum(weight).alias("n"))
    several = sizes.groupBy("cell").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    blocks = lambda n: F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    several = several.select("cell", F.col("main.label").alias("main"), blocks(F.col("n") - F.col("main.n")).alias("others"), blocks(F.col("main.n")).alias("mains"))
    leads = F.col("label") == F.col("main")
    place = F.xxhash64("node")
    dealt = members.join(several, "cell").withColumn("block", F.when(leads, F.col("others") + F.pmod(place, "mains")).otherwise(F.pmod(place, "others")).cast("int"))
    # With one block of each kind a single group holds all.
    met = F.when(F.col("others") + F.col("mains") <= 2, F.array(F.lit(0))).when(leads, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    dealt = dealt.withColumn("other", F.explode(met)).withColumn("block", F.when(F.col("others") + F.col("mains") <= 2, 0).otherwise(F.col("block")))
    dealt = dealt.select("*", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).drop("other", "main", "others", "mains")
    return dealt


def loose(signed: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of labels that searches through the buckets join: a pair of labels is joined, perhaps over
    others, if members of both share a bucket and agree on LEAST_FINE samples. ``own`` has (node, label)."""
    members = signed.join(own, "node").select(F.explode("bands").alias("cell"), "node", "label")
    parts = _partitions(signed)
    dealt = _dealt(members, F.lit(1), PIECE)
    # Signatures join last: they are long, and only members of buckets with several labels need theirs.
    dealt = dealt.join(signed.select("node", "signature"), "node").select("cell", "x", "y", "label", "signature")
    dealt = dealt.repartition(parts, "cell", "x", "y").sortWithinPartitions("cell", "x", "y")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("cell", "x", "y")):
            sig = _matrix(group.column("signature"))

            def links(front, pool):
                alike = _alike(sig, front, pool)
                return zip(front[alike.argmax(0)][alike.any(0)], pool[alike.any(0)], strict=True)

            yield from _joined(group, links)

    return dealt.mapInArrow(join, "a binary, b binary").distinct()


def _joined(group: pa.Table, links) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of labels that a search joins."""
    label = group.column("label").combine_chunks()
    found = list(_spread(label.dictionary_encode().indices.to_numpy(), links))
    if found:
        u, v = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([label.take(pa.array(u)), label.take(pa.array(v))], names=["a", "b"])


class _Texts:
    """Whole texts of a group as rows of local shingle numbers with counts, for exact similarities."""

    def __init__(self, table: pa.Table, idf):
        docs, keys, counts, weights, base = [], [], [], [], 0
        column = table.column("text").combine_chunks()
        stored_idf = table.column("idf").combine_chunks() if "idf" in table.column_names else None
        for a, b, raw, offsets in _parts(column):
            doc, shingle, count = shingles(raw, offsets)
            docs.append(doc + a)
            keys.append(shingle)
            counts.append(count)
            weights.append(_own_idf(stored_idf.slice(a, b - a)) if stored_idf is not None else idf.value[_cells(shingle)].astype(np.float64))
        doc, key = np.concatenate(docs), np.concatenate(keys)
        self.count, self.weight = np.concatenate(counts), np.concatenate(weights)
        known, self.name = np.unique(key, return_inverse=True)
        self.begin = np.searchsorted(doc, np.arange(table.num_rows + 1))
        self.total = np.bincount(doc, self.count * self.weight, table.num_rows)
        self.met = np.zeros(len(known), self.count.dtype)

    def similar(self, u: int, others: np.ndarray) -> np.ndarray:
        """The weighted Jaccard similarity of text ``u`` and each of ``others``."""
        own = slice(self.begin[u], self.begin[u + 1])
        self.met[self.name[own]] = self.count[own]
        sizes = self.begin[others + 1] - self.begin[others]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.begin[others] - ends + sizes, sizes)
        shared = np.minimum(self.met[self.name[at]], self.count[at]) * self.weight[at]
        top = np.bincount(np.repeat(np.arange(len(others)), sizes), shared, len(others))
        self.met[self.name[own]] = 0
        return top / np.maximum(self.total[u] + self.total[others] - top, 1e-12)


def rest(signed: DataFrame, own: DataFrame, areas: DataFrame, idf, least: float) -> DataFrame:
    """Distinct pairs (a, b) of labels that are joined, perhaps over others, by verified links within the ``areas`` (node,
    label) of labels. Texts that have an ``idf`` (see ``weighed``) are weighted by it, others by the sketch."""
    parts = _partitions(signed)
    members = signed.join(own, "node").join(areas.toDF("label", "area"), "label")
    large = members.groupBy("area").agg(F.sum(F.length("text")).alias("chars")).where(F.col("chars") > AREA_BLOCKS * AREA_CHARS).select("area", F.lit(True).alias("large"))
    cells = F.when(F.col("large"), F.transform("bands", lambda b: F.xxhash64(b, "area"))).otherwise(F.array(F.xxhash64("area")))
    columns = [c for c in ("node", "text", "idf", "signature") if c in signed.columns]
    placed = members.select("area", "node", "label", "bands", F.length("text").alias("chars")).join(large, "area", "left").select(F.explode(cells).alias("cell"), "node", "label", "chars")
    dealt = _dealt(placed, F.col("chars"), AREA_CHARS).select("cell", "x", "y", "label", "node")
    dealt = dealt.join(signed.select(*columns), "node").drop("node").repartition(parts, "cell", "x", "y").sortWithinPartitions("cell", "x", "y")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("cell", "x", "y")):
            sig, held = _matrix(group.column("signature")), _Texts(group, idf)

            def links(front, pool):
                for u, alike in zip(front, _alike(sig, front, pool), strict=True):
                    near = pool[alike & (np.minimum(held.total[u], held.total[pool]) >= (least - 1e-9) * np.maximum(held.total[u], held.total[pool]))]
                    if len(near):
                        for v in near[held.similar(u, near) >= least - 1e-9]:
                            yield u, v

            yield from _joined(group, links)

    return dealt.mapInArrow(join, "a binary, b binary").distinct()


def linked(links: DataFrame, signed: DataFrame, idf, least: float = SIMILARITY) -> DataFrame:
    """(node, label) of the classes that ``links`` and then all other pairs that share a bucket make, of all nodes of
    ``signed`` (see ``finer``)."""
    texts = signed.select(*(c for c in ("node", "text", "idf") if c in signed.columns))
    good = components(stored(verified(links, texts, idf, least), "verified"))
    own = stored(signed.select("node").join(good, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    near = stored(loose(signed, own), "loose")
    if near.isEmpty():
        return own
    more = stored(rest(signed, own, components(near), idf, least), "rest")
    if more.isEmpty():
        return own
    return own.join(components(more).toDF("label", "joined"), "label", "left").select("node", F.coalesce("joined", "label").alias("label"))


def _maybe_in(named: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows (node, text) of ``named`` whose node may be in ``needed``, none of those left out: a test of FILTER_BITS
    bits (8 MB for any input) before the texts are shuffled for the exact join."""
    h = F.xxhash64("node")
    word = F.shiftrightunsigned(h, 64 - FILTER_BITS + 6).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 64 - FILTER_BITS).bitwiseAND(63).cast("int"))
    with set_for(named.sparkSession, WHILE_STORED):
        found = needed.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << FILTER_BITS - 6, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    sent = named.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            hit = sent.value[x >> np.uint64(64 - FILTER_BITS + 6)] >> (x >> np.uint64(64 - FILTER_BITS) & np.uint64(63)) & np.uint64(1)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (1, 2)], names=["node", "text"]).filter(pa.array(hit.astype(bool)))

    return named.select(h.alias("h"), "node", "text").mapInArrow(keep, "node binary, text string")


def _members(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(id, node, label) of every row: its text's name and the label of its class."""
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", node("text"))
    total, n = _sketch(docs, text_col)
    idf = docs.sparkSession.sparkContext.broadcast(rough_idf(total, n))
    signed = stored(signatures(named.select("node", "text"), idf).dropDuplicates(["node"]), "signatures")
    links, unlike = candidates(signed)
    needed = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).unionAll(unlike).distinct()
    texts = stored(_maybe_in(named, needed).groupBy("node").agg(F.first("text").alias("text")).join(needed, "node", "left_semi"), "texts")
    fine = stored(finer(signed, weighed(texts, docs, text_col, n, int(total.sum())), idf), "signed")
    emptied(signed, texts)
    labels = linked(links, fine, idf, least)
    members = stored(named.select("id", "node").join(labels, "node", "left").select("id", "node", F.coalesce("label", "node").alias("label")), "members")
    emptied(fine)
    return members


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per document ``id_col`` and class_id, the smallest id of its class of near duplicates.

    Equal texts, null and empty ones together, are of one class; texts without words resemble only their equals,
    those of 1 to 4 words only the same words. Every row gives one row; a class whose ids are all null has a null
    class_id, and an empty table gives an empty one.
    """
    members = _members(docs, id_col, text_col, least)
    # Stored, so that the join has a shuffle of its own on both sides, which Spark can split where a class is large.
    names = stored(members.groupBy("label").agg(F.min("id").alias("class_id")), "class-names")
    return members.join(names, "label").select(F.col("id").alias(id_col), "class_id")


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest id, and of rows equal in id and text any one."""
    members = _members(docs, id_col, text_col, least)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    firsts = members.groupBy("label").agg(F.min(order).alias("_first")).select(F.col("_first.id").alias("_id"), F.col("_first.node").alias("_node"))
    named = docs.withColumn("_name", node(text_col))
    return named.join(firsts, (F.col("_name") == F.col("_node")) & F.col(id_col).eqNullSafe(F.col("_id"))).dropDuplicates(["_name", id_col]).select(*docs.columns)


def op4_near_dedup(spark, sf_dir):
    """Contract query: doc_id and class_id of every row of ``documents``; see ``classes`` for nulls, empty texts, repeated rows
    and empty tables."""
    from .common import load

    return classes(load(spark, sf_dir, "documents"))
