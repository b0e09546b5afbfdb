"""Every operator against a brute-force version, and on odd rows and empty tables."""

import base64
import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from quadrille.llm import byte_bpe, flac, mixing, near_dedup, quality_knn, quality_rules, queries, substring_dedup, suffix_dedup, url_filters, warc
from quadrille.llm.common import load
from tests.conftest import plain

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    found = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), columns)


def check_removed_bytes(rows, docs):
    first, marks = {}, {}
    for key, text in sorted(docs.items()):
        b = text.encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in first and (first[w][0] < key or first[w] < (key, k)):
                mark[k : k + 100] = b"\1" * 100
            first.setdefault(w, (key, k))
        marks[key] = mark
    for r in rows:
        b, m = docs[r.doc_id].encode(), marks[r.doc_id]
        runs = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(m), runs, sha(bytes(x for x, y in zip(b, m, strict=True) if not y)))


def texts(spark, small, n=None):
    return {r.doc_id: r.text or "" for r in load(spark, small, "documents").collect()}


def test_suffix_dedup(spark, small):
    check_removed_bytes(suffix_dedup.op8_suffix_dedup(spark, small).collect(), texts(spark, small))


def test_suffix_dedup_hot_context(spark):
    """One passage in many contexts, periodic texts, and repeats of exactly and just under 100 bytes."""
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    shared, exact = noise(130), noise(100)
    docs = {i: noise(int(rng.integers(0, 90))) + shared + noise(int(rng.integers(0, 90))) for i in range(60)}
    docs |= {100: "ab" * 300, 101: "ab" * 90, 102: exact, 103: "x" + exact, 104: exact[:99], 105: noise(50) + exact + exact, 106: "é" * 120, 107: "é" * 70}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    check_removed_bytes(suffix_dedup.dedup(df).collect(), docs)
    left = {r.doc_id: r.text for r in suffix_dedup.dedup(df, with_text=True).collect()}
    assert left[103] == "x" and set(left[106]) <= {"é"}


def test_suffix_dedup_long_texts_and_many_parts(spark, monkeypatch):
    """Texts that are read in pieces, ranges that are dealt out by 32-gram, and a tree of sketches."""
    from quadrille.llm import sketch

    for module, name, value in ((suffix_dedup, "EDGES", 2), (suffix_dedup, "BLOCKS_PER_REPORT", 1), (sketch, "FAN_IN", 2)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(13)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    step = suffix_dedup.STEP
    long = noise(2 * step + 70_000)
    docs = {0: noise(500), 1: long, 2: noise(30) + long[step - 700 : step + 900] + "é" + long[2 * step - 101 : 2 * step + 30] + noise(40)}
    docs |= {3 + i: long[500 * i : 500 * i + 130 + i] + noise(30) + long[step - 60 : step + 60] for i in range(60)}
    docs |= {100: long[step - 99 : step + 1] + noise(10), 101: long[step - 98 : step + 1] + noise(10)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(9)
    check_removed_bytes(suffix_dedup.dedup(df).collect(), docs)


def test_loser_tree_never_misorders():
    rng = np.random.default_rng(5)
    size, runs, every = 12, [], []
    for i in range(9):
        keys = sorted(bytes(rng.integers(97, 99, size, dtype=np.uint8)) for _ in range(int(rng.integers(0, 40))))
        entries = np.zeros(len(keys), suffix_dedup.ENTRY)
        entries["id"] = i
        every += keys
        if keys:
            runs.append(suffix_dedup._Run(suffix_dedup.front_coded(np.frombuffer(b"".join(keys), np.uint8), entries, size), size))
    out = list(suffix_dedup.merged(runs, size))
    assert [k for k, _, _ in out] == sorted(every)
    for (a, _, _), (b, shared, _) in zip(out, out[1:], strict=False):
        assert shared == next((i for i in range(size) if a[i] != b[i]), size)


def test_substring_dedup(spark, small):
    docs = texts(spark, small)
    words = {i: WORDS.findall(t) for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for r in substring_dedup.op9_substring_dedup(spark, small).collect():
        w = words[r.doc_id]
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r.doc_id:
                gone[k : k + 13] = [True] * 13
        assert (r.n_words, r.n_removed) == (len(w), sum(gone))
        assert r.kept_sha256 == sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())


def shingle_counts(t):
    w = WORDS.findall(t)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_classes(docs, least=0.8):
    """Classes by all pairs of whole texts that share a shingle: tuples of words, exact frequencies, no code of the operator."""
    from collections import Counter, defaultdict
    from math import log

    bags, having = {}, defaultdict(list)
    for key, text in docs.items():
        w = WORDS.findall(text)
        bags[key] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        for s in bags[key]:
            having[s].append(key)
    idf = {s: log((len(docs) + 1) / (len(own) + 1)) + 1 for s, own in having.items()}
    total = {k: sum(n * idf[s] for s, n in bag.items()) for k, bag in bags.items()}
    parent = {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    same = {}
    for key in sorted(docs):
        parent[find(key)] = find(same.setdefault(docs[key], key))
        met = Counter()
        for s, n in bags[key].items():
            for other in having[s]:
                if other < key:
                    met[other] += min(n, bags[other][s]) * idf[s]
        for other, top in met.items():
            if top >= (least - 1e-9) * (total[key] + total[other] - top):
                x, y = find(key), find(other)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in docs}


def test_near_dedup(spark, small):
    docs = texts(spark, small)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(load(spark, small, "documents")).collect()} == plain_classes(docs)


def around_the_bound(n, seed, most):
    """Texts of similarities around 0.8."""
    rng = np.random.default_rng(seed)
    docs = {}
    for i in range(n):
        own = [f"w{k}" for k in range(300)]
        for k in rng.choice(290, 1 + i % most, replace=False):
            own[k] = f"e{i}_{k}"
        docs[i] = " ".join(own)
    return docs


def test_near_dedup_in_small_pieces(spark, monkeypatch):
    """Large buckets in pieces whose leaders meet again, and areas in pairs of blocks or by bucket, give the classes of all
    pairs, and one row for each class joined."""
    for name, value in (("PIECE", 8), ("AREA_CHARS", 20_000), ("AREA_BLOCKS", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    docs = around_the_bound(120, 6, 6)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    expected = plain_classes(docs)
    assert 1 < len(set(expected.values())) < len(docs)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()} == expected


def test_spread_joins_each_class_once():
    rng = np.random.default_rng(9)
    at = rng.uniform(0, 40, 200)
    label = rng.integers(0, 120, 200)
    near = lambda front, pool: ((u, v) for u in front for v in pool if abs(at[u] - at[v]) < 0.15)
    found = list(near_dedup._spread(label, near))
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in found:
        assert abs(at[u] - at[v]) < 0.15 and find(label[u]) != find(label[v])
        parent[find(label[u])] = find(label[v])
    assert all(find(label[u]) == find(label[v]) for u in range(200) for v in range(200) if abs(at[u] - at[v]) < 0.15)


def test_near_dedup_chain_and_hot_group(spark):
    """A chain of copies, each like the next but not like the first, and a large group of near copies."""
    rng = np.random.default_rng(2)
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, 400)]
    rows, words = [], list(base)
    for i in range(8):
        rows.append((i, " ".join(words)))
        for k in rng.integers(0, 400, 5):
            words[k] = f"new{i}_{k}"
    for i in range(300):
        own = [f"h{x}" for x in range(300)]
        own[int(rng.integers(0, 300))] = f"edit{i}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(5000 + i, " ".join(f"u{i}_{x}" for x in range(200))) for i in range(20)]
    cls = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {cls[i] for i in range(8)} == {0}
    assert {cls[1000 + i] for i in range(300)} == {1000}
    assert all(cls[5000 + i] == 5000 + i for i in range(20))


def test_near_dedup_tests_what_the_first_proposals_leave_out(spark, monkeypatch):
    """Texts of similarities around 0.8, with one first proposal, few pairs a pass and small blocks: the classes are those
    of all pairs."""
    monkeypatch.setattr(near_dedup, "PIECE", 8)
    docs = around_the_bound(60, 3, 4)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    table, n = near_dedup._sketch(df, "text")
    idf = spark.sparkContext.broadcast(near_dedup.rough_idf(table, n))
    named = df.select(near_dedup.node().alias("node"), "text")
    signed = near_dedup.signatures(named, idf)
    links = near_dedup.stored(near_dedup.candidates(signed, keep=1)[0].limit(20), "few")
    exact = near_dedup.weighed(near_dedup.stored(named, "named"), df, "text", n, int(table.sum()))
    near = near_dedup.linked(links, near_dedup.stored(near_dedup.finer(signed, exact, idf), "signed"), idf)
    label = {bytes(r.node): bytes(r.label) for r in near.collect()}
    names = {r.doc_id: bytes(r.node) for r in df.select("doc_id", near_dedup.node().alias("node")).collect()}
    found, own = {i: label.get(n, n) for i, n in names.items()}, plain_classes(docs)
    assert 1 < len(set(own.values())) < len(docs)
    assert {frozenset(i for i in docs if own[i] == c) for c in own.values()} == {frozenset(i for i in docs if found[i] == c) for c in found.values()}


def test_near_dedup_verifies_with_exact_document_frequencies(spark):
    """Rare shingles that share a sketch cell with those of a frequent text keep their own weight: one pair is linked that
    the sketch parts, another is not that it links."""
    import pyarrow as pa

    def shingled(text):
        return near_dedup.shingles(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[1]

    filler = " ".join(f"f{i}" for i in range(20_000))
    hot = np.zeros(1 << near_dedup.CELL_BITS, bool)
    hot[near_dedup._cells(shingled(filler))] = True
    made = iter(range(1_000_000))

    def longer(words, in_hot, more):
        words = list(words)
        for _ in range(more):
            words.append(next(w for w in (f"r{k}" for k in made) if len(words) < 4 or hot[near_dedup._cells(shingled(" ".join([*words[-4:], w])))[0]] == in_hot))
        return words

    u = longer(longer([], True, 32), False, 28)
    v = longer(u, False, 10)
    x = longer([], False, 44)
    y = longer(x, True, 12)
    docs = [" ".join(w) for w in (u, v, x, y)] + [filler] * 30 + [f"other {i} of a few texts here" for i in range(6)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    own = [set(shingled(t).tolist()) for t in docs]
    named = df.select(near_dedup.node().alias("node"), "text").distinct()
    for r in near_dedup.weighed(named, df, "text", len(docs), sum(map(len, own))).collect():
        true = [sum(k in d for d in own) for k in shingled(r.text).tolist()]
        assert np.allclose(near_dedup._own_idf(pa.array([bytes(r.idf)])), near_dedup.idf_of(np.array(true), len(docs)))
    sketch = near_dedup.weighted_jaccard(pa.array([docs[0], docs[2]]), pa.array([docs[1], docs[3]]), near_dedup.idf_table(df))
    assert sketch[0] < near_dedup.SIMILARITY < sketch[1]
    cls = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert cls[1] == 0 and cls[3] == 3


def test_proposals_of_a_bucket():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 256, (5, near_dedup.SAMPLES), dtype=np.uint8)
    sig = centres[np.arange(40) % 5].copy()
    sig[:, 0] = np.arange(40)
    links, leaders = near_dedup._proposals(sig)
    assert leaders == [0, 1, 2, 3, 4] and links == {(i % 5, i) for i in range(5, 40)}
    near = centres[:1].repeat(4, 0)
    near[1, :10], near[2, :10], near[3, 10:20] = 1, 1, 2
    links, _ = near_dedup._proposals(near)
    assert (1, 2) in links and {(0, 1), (0, 2), (0, 3)} <= links


def test_weighted_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    shingle = rng.integers(0, 1 << 48, 400, dtype=np.uint64)
    shingle.sort()
    weight = rng.random(400) * 5 + 0.5
    agree, alike = 0, 0.0
    for _ in range(60):
        keep = rng.random(400) < 0.9
        doc = np.zeros(400, np.int64)
        _, a = near_dedup.samples(doc, shingle, weight)
        _, b = near_dedup.samples(doc[keep], shingle[keep], weight[keep])
        agree += int((a == b).sum())
        alike += weight[keep].sum() / weight.sum()
        shingle = np.sort(rng.integers(0, 1 << 48, 400, dtype=np.uint64))
    assert abs(agree / 60 / near_dedup.SAMPLES - alike / 60) < 0.03


def test_byte_bpe_is_tiktoken(spark, small):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = texts(spark, small)
    for r in byte_bpe.op3_byte_bpe(spark, small).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))
    coder = byte_bpe.PrefixCoder(ranks)
    piece = b"internationalization"
    table = coder.extend(piece[:8], [])
    assert coder.ids(coder.extend(piece, list(table))) == coder.encode(piece)
    edited, table = coder.replaced(piece, coder.extend(piece, []), 5, 9, b"xyz")
    assert edited == b"interxyzonalization" and coder.ids(table) == coder.encode(edited)
    assert byte_bpe.TextCoder(ranks, P.PATTERN).encode(" a\t\n  b é漢🙂 123abc's  ") == reference.encode_ordinary(" a\t\n  b é漢🙂 123abc's  ")


def test_byte_bpe_long_unbroken_texts_and_small_caches(spark, monkeypatch):
    """A piece of 1 MB takes time and memory in proportion; chunks and caches of any size change nothing."""
    import tracemalloc

    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(4)
    long = "".join(map(chr, rng.integers(97, 123, 1_000_000))) + "é漢" * 20_000 + "a" * 50_000
    coder = byte_bpe.TextCoder(ranks, P.PATTERN)
    tracemalloc.start()
    assert coder.encode(long) == reference.encode_ordinary(long)
    assert tracemalloc.get_traced_memory()[1] < 200 * len(long)
    tracemalloc.stop()
    for name in ("CACHE_PIECES", "CACHE_PAIRS", "CHUNK_PIECES", "CHUNK_CHARS"):
        monkeypatch.setattr(byte_bpe, name, 3)
    mixed = "The quick  brown\n\tfox's 1234 jumps, überall! 漢字 " * 30 + " " * 50 + "x"
    small = byte_bpe.TextCoder(ranks, P.PATTERN)
    assert small.encode(mixed) == reference.encode_ordinary(mixed) and small.decode(small.encode(mixed)) == mixed.encode()
    assert len(small.known) <= 3 and len(small.coder.follows) <= 3
    df = spark.createDataFrame([(1, mixed), (2, long), (3, ""), (None, None)], "doc_id bigint, text string")
    for r in byte_bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect():
        text = {1: mixed, 2: long}.get(r.doc_id, "")
        assert r.ids == reference.encode_ordinary(text) and (r.n_tokens, r.decoded_sha256) == (len(r.ids), sha(text.encode()))
        assert r.ids_sha256 == sha(" ".join(map(str, r.ids)).encode())


def test_flac_round_trip(spark, small):
    rng = np.random.default_rng(1)
    waves = [(128 + 100 * np.sin(np.arange(192 * 5) / 9)).astype(np.uint8).tobytes(), b" " * 192, bytes(rng.integers(0, 256, 192 * 40, dtype=np.uint8)), bytes([0, 255] * 96 * 3), b"ab" * 96]
    media = flac.encode(waves)
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode(media)] == waves
    assert flac.header(media[2])["samples"] == 192 * 40 and len(flac.header(media[2])["points"]) == 5
    for at in (len(media[2]) // 2, len(media[2]) - 1):
        broken = bytearray(media[2])
        broken[at] ^= 8
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
    docs = texts(spark, small)
    for r in flac.op5_flac(spark, small).collect():
        b = docs[r.doc_id].encode()
        payload = b + b" " * (-len(b) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        stream = flac.encode([payload])[0]
        x = [c - 128 for c in payload]
        turns = sum((x[i] * len(x) > sum(x)) != (x[i - 1] * len(x) > sum(x)) for i in range(1, len(x)))
        assert (r.media_bytes, r.media_sha256) == (len(stream), sha(stream))
        assert r.feature == f"peak={max(map(abs, x))};mean={1000 * sum(x) // len(x)};energy={1000 * (sum(c * c for c in x) // len(x))};turns={turns}" or r.feature == f"peak={max(map(abs, x))};mean={1000 * sum(x) // len(x)};energy={1000 * sum(c * c for c in x) // len(x)};turns={turns}"
        if len(payload) < 5000:
            assert plain_flac(stream) == payload
    blocks = flac.pcm_blocks(flac.encode_column(load(spark, small, "documents").limit(3))).orderBy("doc_id", "sample_offset").collect()
    joined = {}
    for r in blocks:
        assert r.sample_offset == len(joined.setdefault(r.doc_id, bytearray()))
        joined[r.doc_id] += bytes(x + 128 & 255 for x in r.pcm)
    assert all(bytes(v).rstrip(b" ") == docs[k].encode().rstrip(b" ") for k, v in joined.items())


def plain_flac(stream):
    """The payload of a stream, read bit by bit from the format's description, without any code of the operator."""
    at, last = 4, False
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            total = int.from_bytes(stream[at + 14 : at + 22], "big") & (1 << 36) - 1
            md5 = stream[at + 22 : at + 38]
        at += 4 + size
    bits = "".join(format(b, "08b") for b in stream[at:])
    pos, out = 0, []

    def take(n):
        nonlocal pos
        pos += n
        return int(bits[pos - n : pos], 2) if n else 0

    signed = lambda v, n: v - (1 << n) if v >> n - 1 else v
    while len(out) < total:
        assert take(15) == 0b111111111111100 and take(1) == 0 and take(4) == 1 and take(4) == 0 and take(4) == 0 and take(3) == 1 and take(1) == 0
        lead = format(take(8), "08b")
        for _ in range(max(0, lead.index("0") - 1)):
            take(8)
        take(8)
        assert take(1) == 0
        kind = take(6)
        assert take(1) == 0
        x = []
        if kind == 0:
            x = [signed(take(8), 8)] * 192
        elif kind == 1:
            x = [signed(take(8), 8) for _ in range(192)]
        else:
            order = kind - 8
            assert 0 <= order <= 4
            x = [signed(take(8), 8) for _ in range(order)]
            assert take(2) == 0 and take(4) == 0
            k = take(4)
            while len(x) < 192:
                high = bits.index("1", pos) - pos
                pos += high + 1
                z = high << k | take(k)
                c = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order]
                x.append((z >> 1 ^ -(z & 1)) + sum(a * x[-1 - i] for i, a in enumerate(c)))
        out += x
        pos = -(-pos // 8) * 8 + 16
    assert pos == len(bits) and hashlib.md5(bytes(v & 255 for v in out)).digest() == md5
    return bytes(v + 128 for v in out)


def linear_frame(samples, coefficients, shift):
    """A frame with stored predictor coefficients, written bit by bit."""
    bits = lambda v, n: format(v & (1 << n) - 1, f"0{n}b")
    order = len(coefficients)
    out = bits(32 + order - 1, 7) + "0" + "".join(bits(x, 8) for x in samples[:order])
    out = bits(0, 1) + bits(32 + order - 1, 6) + "0" + "".join(bits(x, 8) for x in samples[:order]) + bits(7, 4) + bits(shift, 5) + "".join(bits(c, 8) for c in coefficients) + bits(0, 6) + bits(3, 4)
    for i in range(order, len(samples)):
        r = samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(coefficients)) >> shift)
        z = 2 * r if r >= 0 else -2 * r - 1
        out += "0" * (z >> 3) + "1" + bits(z, 3)
    out += "0" * (-len(out) % 8)
    head = bytes([0xFF, 0xF8, 0x10, 0x02, 0x00])
    data = np.frombuffer(head, np.uint8)
    head += bytes([int(flac.header_crcs(data, np.array([0]), np.array([5]))[0])])
    body = head + int(out, 2).to_bytes(len(out) // 8, "big")
    crc = int(flac.frame_crcs(np.frombuffer(body + b"\0", np.uint8), np.array([0]), np.array([len(body)]))[0])
    return body + crc.to_bytes(2, "big")


def test_flac_stored_coefficients():
    samples = [int(90 * np.sin(i / 7)) for i in range(192)]
    frame = np.frombuffer(linear_frame(samples, [60, -30], 5), np.uint8)
    stream = flac._stream(frame, np.array([0, len(frame)]), np.array(samples, np.int8).tobytes())
    assert flac.decode([stream])[0].tolist() == samples


def general_stream(x, bits, block, assignment):
    """A stream written bit by bit from the format's description: two channels, predictor order 2, Rice partitions of which
    one is plain, and checksums from their definitions."""

    def crc(data, width, poly):
        c = 0
        for byte in data:
            c ^= byte << width - 8
            for _ in range(8):
                c = (c << 1 ^ poly if c >> width - 1 & 1 else c << 1) & (1 << width) - 1
        return c

    word = lambda v, n: format(v & (1 << n) - 1, f"0{n}b") if n else ""
    frames = b""
    for number, at in enumerate(range(0, len(x), block)):
        part = x[at : at + block]
        left, right = part[:, 0].astype(int), part[:, 1].astype(int)
        channels = {1: (left, right), 8: (left, left - right), 9: (left - right, right), 10: (left + right >> 1, left - right)}[assignment]
        head = word(0x7FFC, 15) + "0" + word(7, 4) + word(0, 4) + word(assignment, 4) + word(4, 3) + "0" + word(number, 8) + word(len(part) - 1, 16)
        head = int(head, 2).to_bytes(len(head) // 8, "big")
        out = ""
        for i, c in enumerate(channels):
            width, n = bits + (assignment != 1 and i == (0 if assignment == 9 else 1)), len(c)
            out += "0" + word(10, 6) + "0" + word(c[0], width) + word(c[1], width) + word(1, 2) + word(2, 4)
            r = [int(c[j]) - 2 * int(c[j - 1]) + int(c[j - 2]) for j in range(2, n)]
            for k in range(4):
                own = r[max(0, n // 4 * k - 2) : n // 4 * (k + 1) - 2]
                if k == 2:
                    out += word(31, 5) + word(20, 5) + "".join(word(v, 20) for v in own)
                else:
                    out += word(6 + k, 5)
                    for v in own:
                        z = 2 * v if v >= 0 else -2 * v - 1
                        out += "0" * (z >> 6 + k) + "1" + word(z, 6 + k)
        out += "0" * (-len(out) % 8)
        body = head + bytes([crc(head, 8, 7)]) + int(out, 2).to_bytes(len(out) // 8, "big")
        frames += body + crc(body, 16, 0x8005).to_bytes(2, "big")
    md5 = hashlib.md5(x.astype("<i2").tobytes()).digest()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | bits - 1 << 36 | len(x)).to_bytes(8, "big") + md5
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + frames


@pytest.mark.parametrize("assignment", [1, 8, 9, 10])
def test_flac_streams_of_other_forms(spark, assignment):
    n = 1000
    x = np.stack([3000 * np.sin(np.arange(n) / 9), 2900 * np.sin(np.arange(n) / 9 + 0.1)], 1).astype(np.int32)
    stream = general_stream(x, 16, 400, assignment)
    own = flac.encode([b"ab" * 96])[0]
    both = flac.decode([stream, own])
    assert (both[0] == x).all() and bytes((both[1] + 128).astype(np.uint8)) == b"ab" * 96
    for at in (len(stream) // 2, len(stream) - 1):
        broken = bytearray(stream)
        broken[at] ^= 8
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
    if assignment == 10:
        df = spark.createDataFrame([(1, bytearray(stream))], "doc_id bigint, media binary")
        rows = flac.pcm_blocks(df, block_samples=300).orderBy("sample_offset").collect()
        assert [r.sample_offset for r in rows] == [0, 300, 600, 900] and b"".join(bytes(r.pcm) for r in rows) == x.astype("<i2").tobytes()


def test_warc_reader():
    big = b"<p>" + b"x" * 300_000
    archive = warc.write_record(1, "http://a/\r\nX: y", big) + warc.write_record(2, None, b"") + warc.write_record(3, "http://b/", big, 1)
    found = list(warc.read_records(archive, chunk=100))
    assert [h["WARC-Type"] for h, _ in found] == ["response", "response", "revisit"]
    assert warc.payload_of(found[0][1]) == big and found[0][0]["WARC-Target-URI"] == "http://a/%0D%0AX: y"
    with pytest.raises(ValueError):
        list(warc.read_records(archive[:-5]))
    plain_record = zlib.decompress(warc.write_record(1, "u", b"abcdef"), 31)
    for a, b in ((b"abcdef", b"abcdeg"), (b"abcdef", b"abc")):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(z.compress(plain_record.replace(a, b)) + z.flush()))


def test_quality_rules(spark, small):
    docs = texts(spark, small)
    for r in quality_rules.op6_quality_rules(spark, small).collect():
        t = docs[r.doc_id]
        w = WORDS.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = Counter(grams)
        covered = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_verdicts_by_brute_force(spark, small):
    """``kept`` and ``rule`` of every document from its text and the learned list alone."""
    rules = quality_rules.learn(quality_rules.labelled_statistics(load(spark, small, "documents"), load(spark, small, "labels")))
    docs = texts(spark, small)
    assert rules
    for r in quality_rules.op6_quality_rules(spark, small).collect():
        t = docs[r.doc_id]
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        n, chars = max(len(w), 1), sum(map(len, w))
        row = {
            "symbol_ratio": sum(c in "#*$%&|<>" for c in t) / n,
            "dup_line_ratio": (len(lines) - len(set(lines))) / max(len(lines), 1),
            "repeat_ratio": r.n_repeat_words / n,
            "distinct_ratio": len(set(w)) / n**0.5,
            "mean_word": chars / n,
            "upper_ratio": sum(unicodedata.category(c) == "Lu" for c in t) / max(chars, 1),
            "bang_ratio": sum(c in "!?" for c in t) / n,
            "line_words": len(w) / max(len(lines), 1),
        }
        first = next((i for i, x in enumerate(rules, 1) if x.meets(row)), None)
        assert r.rule == first and r.kept == (not r.base_failed and first is None)


def test_quality_rules_learn(spark):
    rows = quality_rules.labelled_statistics(load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels"))
    rules = quality_rules.learn(rows)
    hit = [r for r in rows if any(x.meets(r) for x in rules)]
    assert rules and sum(r["bad"] for r in hit) > 0.6 * sum(r["bad"] for r in rows) and sum(r["good"] for r in hit) < 0.02 * sum(r["good"] for r in rows)
    assert quality_rules.learn([]) == ()


def test_quality_knn_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = quality_knn.op2_quality_knn(spark, sf).where("held_out").join(load(spark, sf, "labels"), "doc_id").select("score", "quality", "predicted").collect()
    good = np.array([r.score for r in out if r.quality == 1])
    bad = np.array([r.score for r in out if r.quality == 0])
    assert ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_quality_knn_by_brute_force(spark, small):
    """Frequencies over all documents, and every score, from single documents and all cosines."""
    docs, df, labels = texts(spark, small), load(spark, small, "documents"), load(spark, small, "labels")
    terms = {k: quality_knn.term_counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for k, t in docs.items()}
    idf = quality_knn.document_frequencies(df, "text")
    counts = np.zeros(quality_knn.SIZE)
    for _, term, _ in terms.values():
        counts[term] += 1
    assert np.allclose(idf, np.log((1 + len(docs)) / (1 + counts)) + 1, rtol=1e-5)
    label = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5}
    model = quality_knn.fit(quality_knn.labelled_sample(df, labels, "doc_id", "text", "quality"), idf)
    assert sorted(model.votes.tolist()) == sorted(float(x) for x in label.values())
    unit = lambda k: (lambda v: v / max(np.linalg.norm(v), 1e-12))(model.projection[terms[k][1]].astype(float).T @ terms[k][2])
    known = np.array([unit(k) for k in sorted(label)])
    vote = np.array([label[k] for k in sorted(label)])
    for r in quality_knn.op2_quality_knn(spark, small).collect():
        s = np.round(known @ unit(r.doc_id), 5)
        near = s >= np.sort(s)[-quality_knn.NEIGHBOURS]
        w = np.maximum(s, 0) ** 4 + 1e-9
        assert abs(r.score - (w * vote)[near].sum() / w[near].sum()) < 0.03
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    m = quality_knn.Model(np.zeros((1, 1)), unit(rng.standard_normal((90, 8))).astype(np.float32), rng.integers(0, 2, 90).astype(np.float32))
    x = unit(rng.standard_normal((700, 8))).astype(np.float32)
    got = quality_knn.votes(m, x)
    for i in range(0, 700, 97):
        s = m.vectors @ x[i]
        near = np.argsort(-s)[: quality_knn.NEIGHBOURS]
        w = np.maximum(s[near], 0).astype(float) ** 4 + 1e-9
        assert abs(got[i] - (w * m.votes[near]).sum() / w.sum()) < 1e-4


def test_mixing_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, None: 70}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        free -= over
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixing_hits_targets(spark):
    sf = "/root/testdata/sf0.1"
    rows = mixing.op7_mixing(spark, sf).join(load(spark, sf, "documents").select("doc_id", "source"), "doc_id").collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


def test_url_filters(spark):
    urls = ["http://Example.COM/en/1", "http://www.example.com/en/1", "https://a.www.example.com/en/", "http://com/x", "http://notcom/x", "http://x.net/es/1", "http://x.net/ES/1", "http://net", "nourl", None, "http://a.org/casino/1?x", "http://casino.org#a", "ftp://İ.com/a#b", "://com/q?r", "http://a.com", "http://x/://com/", "http://a.org/free-money", "http://b.org/free/x/money", "http://c.org/d/Setup.EXE?q", "http://c.org/exe/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").selectExpr("*", "'x' as host", "'y' as rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(r), r, v) for r, v in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")) if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=None)
        own = "block" if re.search(r"(^|[^0-9a-z])casino([^0-9a-z]|$)|free.money|/[^/]*[.]exe$", (host + path).lower()) else "allow"
        assert got[i] == (host, path, best[1] if best else None, best[2] if best else own)


def test_url_filters_in_a_joined_index(spark, monkeypatch):
    """Thousands of rules, in the plan and as a table, against a loop over all of them."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rules = tuple(url_filters.site("block" if i % 2 else "allow", f"{words[i % 300]}.{words[(i * 7) % 300]}.net/{words[i % 11]}/", True) for i in range(1200))
    terms = tuple(url_filters.term("block", f"{words[i % 300]} {words[(i * 3 + i // 300) % 300]}") for i in range(600))
    pick = lambda n: [words[int(x)] for x in rng.integers(0, 300, n)]
    urls = [f"http://a.{w}.{words[words.index(w) * 7 % 300]}.net/{words[words.index(w) % 11]}/x" for w in pick(100)]
    urls += [f"http://{a}.org/{b}/{words[words.index(b) * 3 % 300]}.html" for a, b in zip(pick(100), pick(100), strict=True)] + ["http://same.org/x"] * 50
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(df, rules, terms).collect()}
    for i, u in enumerate(urls):
        place = u.split("://")[1]
        own = max(((r.weight, r.name, r.verdict) for r in rules if re.search(r.regex, place)), default=None)
        other = any(re.search(r.regex, place) for r in terms)
        assert found[i] == (own[1] if own else None, own[2] if own else "block" if other else "allow")
    assert {v for _, v in found.values()} == {"allow", "block"} and url_filters.judge(df, (), ()).where("verdict <> 'allow'").isEmpty()


def test_odd_rows(spark, odd_docs, odd_labels):
    import public_tokenizers as P

    n = odd_docs.count()
    for docs, rows in ((odd_docs, n), (odd_docs.limit(0), 0)):
        assert near_dedup.classes(docs).count() == rows
        assert suffix_dedup.dedup(docs).count() == rows
        assert substring_dedup.duplicates(docs).count() == rows
        assert flac.digest_column(flac.encode_column(docs)).count() == rows
        assert byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).count() == rows
        mixed = mixing.mix(docs)
        assert mixed.count() == rows and mixing.repeated(mixed).count() >= 0
        assert quality_rules.judge(docs, odd_labels).count() == rows
        assert quality_rules.judge(docs, odd_labels.limit(0)).count() == rows
        assert quality_knn.classify(docs, odd_labels).count() == rows
        assert quality_knn.classify(docs, odd_labels.limit(0)).count() == rows
        pages = docs.selectExpr("doc_id as page_id", "lang as url", "text as html", "size", "kept", "label")
        assert warc.read_archives(warc.write_archives(pages), with_payload=True).count() == rows
        assert url_filters.judge(pages).count() == rows


def test_odd_rows_have_defined_results(spark, odd_docs):
    cls = sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(odd_docs).collect()), key=str)
    by = dict((a, b) for a, b in cls if a is not None)
    assert by[2] == 1 and by[3] == 1 and by[6] == 5 and by[4] == 4
    assert sum(1 for a, b in cls if a is None and b == 4) == 1 and sum(1 for a, b in cls if a is None and b == 5) == 1
    removed = {}
    for r in suffix_dedup.dedup(odd_docs).collect():
        removed.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed))
    assert removed[1][0][1] == 0 and removed[2][0][0] == removed[2][0][1] and removed[7][0] == removed[7][1]
    page = spark.createDataFrame([(5, "u", "y" * 2000), (9, None, "y" * 2000), (9, None, "y" * 2000), (None, "u", "y" * 2000), (3, "u", "z"), (4, "u", "z"), (6, "u", None)], "page_id bigint, url string, html string")
    rows = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.write_archives(page)).collect()), key=str)
    assert rows == sorted([(5, "revisit", 9, 2000), (9, "response", None, 2000), (9, "response", None, 2000), (None, "revisit", 9, 2000), (3, "response", None, 1), (4, "response", None, 1), (6, "response", None, 0)], key=str)


def test_every_odd_row_has_the_result_of_its_text(spark, odd_docs, odd_labels):
    """Each row, null or repeated ids included, gives what its text alone gives; clashing columns change nothing."""
    import public_tokenizers as P
    import tiktoken

    rows = [(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()]
    same = lambda found, expected: sorted(map(str, found)) == sorted(map(str, expected))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    coded = byte_bpe.encode_documents(odd_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True)
    assert same([(r.doc_id, r.n_tokens, list(r.ids), r.decoded_sha256) for r in coded.collect()], [(k, len(ids := reference.encode_ordinary(t)), ids, sha(t.encode())) for k, t in rows])
    padded = lambda t: t.encode() + b" " * (-len(t.encode()) % 192 if t else 192)
    media = flac.digest_column(flac.stored(flac.encode_column(odd_docs), "media", flac.MEDIA_OPTIONS))
    assert same([(r.doc_id, r.n_bytes, r.payload_sha256) for r in media.collect()], [(k, len(t.encode()), sha(padded(t))) for k, t in rows])
    words = [(k, WORDS.findall(t)) for k, t in rows]
    judged = quality_rules.judge(odd_docs, odd_labels).collect()
    assert same([(r.doc_id, r.n_words, r.word_chars) for r in judged], [(k, len(w), sum(map(len, w))) for k, w in words])
    assert not any(r.kept for r in judged if r.n_words < 10) and all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in judged)
    scored = quality_knn.classify(odd_docs, odd_labels).collect()
    of_text = {}
    for r, (_, t) in zip(sorted(scored, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda x: str(x[0])), strict=True):
        if r.doc_id is not None:
            assert of_text.setdefault(t, r.score) == r.score and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    mixed = mixing.mix(odd_docs).collect()
    assert same([(r.doc_id, r["size"]) for r in mixed], [(k, len(w)) for k, w in words]) and all(r.copies in (0, 1, 2) for r in mixed)
    assert len({r.copies for r in mixed if r.doc_id == 7}) == 1
    # Windows that also start in a smaller id go, and rows of equal id keep theirs; null ids come last.
    order = lambda k: (k is None, k or 0)
    first = {}
    for k, w in sorted(words, key=lambda x: order(x[0])):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    expected = []
    for k, w in words:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] != k for j in range(i, i + 13)}
        expected.append((k, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())))
    assert same([tuple(r) for r in substring_dedup.duplicates(odd_docs).collect()], expected)
