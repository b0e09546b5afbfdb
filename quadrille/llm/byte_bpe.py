"""Byte-level BPE by prefix dynamic programming.

For a byte string every prefix has exactly one valid encoding, and that encoding is the valid encoding of a shorter
prefix plus one last token. Storing each prefix's last token therefore stores all encodings at once: appending
bytes goes on from the table, and an edit recomputes only from the first changed byte on. A token may follow
another when merging their joined bytes by rank gives back these two tokens.

The table is a list by offset. An automaton of all tokens names those that end at each offset, the longest first, so
time and memory grow with the length of a piece, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Distinct pieces whose encoding a Python worker keeps, and as many of those before; what was not met again goes.
CACHE_PIECES = 200_000
#: Pairs of tokens of which it keeps whether one may follow the other, likewise.
CACHE_PAIRS = 250_000
#: Characters of a text up to which it is split at once, and pieces of a longer one that are encoded at once.
CHUNK_CHARS, CHUNK_PIECES = 1 << 20, 1 << 16
#: Bits for a token, and a rank above all others.
_BITS, _NEVER = 24, 1 << 60


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Recent(dict):
    """A dict that computes what is missing and forgets what was not asked for among the last ``size`` new keys or more."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.before = compute, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        found = self.before.get(key)
        if found is None:
            found = self.compute(key)
        self[key] = found
        return found


class PrefixCoder:
    """Encodes single pieces (matches of the split pattern) by the table of last tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ending = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.ending.add_word(t.decode("latin-1"), i)
        self.ending.make_automaton()
        self.follows = Recent(self._may_follow, CACHE_PAIRS)
        self._whole: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[bytes, int]]] = {}

    def _merged(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """The piece after merges, lowest rank and leftmost first, until ``down_to`` parts are left: the definition."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_whole(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = len(self._merged(self.token[token])) == 1
        return known

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's left (0) or right (-1) end while it is merged: parts, and the rank that ends each."""
        known = self._edges.get((token, side))
        if known is None:
            part, known = self.token[token], [(self.token[token], 2 * _NEVER)]
            while len(part) > 1:
                until = self.ranks[part]
                part = self._merged(part, 2)[side]
                known.append((part, until))
            known.reverse()
            self._edges[token, side] = known
        return known

    def _may_follow(self, pair: int) -> bool:
        """Whether a token stays after another: no part at the end of the one merges with one at the start of the other first."""
        ends, starts, rank = self._edge(pair >> _BITS, -1), self._edge(pair & (1 << _BITS) - 1, 0), self.ranks.get
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = ends[i], starts[j]
            across = rank(x + y, _NEVER)
            if across < until_x and across <= until_y and across < _NEVER:
                return False
            if until_x == until_y == 2 * _NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """``last`` (last tokens of the prefixes 1, 2, .. of ``piece`` already known) completed for all of ``piece``."""
        done, length, follows = len(last), self.length, self.follows
        last += [-1] * (len(piece) - done)
        for end, t in self.ending.iter(piece.decode("latin-1"), max(0, done - self.longest + 1)):
            if last[end] < 0:
                before = end - length[t]
                if before < 0:
                    if self._is_whole(t):
                        last[end] = t
                elif last[before] >= 0 and follows[last[before] << _BITS | t]:
                    last[end] = t
        if -1 in last[done:]:
            raise ValueError(f"bytes without a token: {piece[: last.index(-1) + 1]!r}")
        return last

    def replaced(self, piece: bytes, last: list[int], begin: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Piece and table after ``piece[begin:end]`` became ``new``; the table up to ``begin`` is reused."""
        piece = piece[:begin] + new + piece[end:]
        return piece, self.extend(piece, last[:begin])

    def ids(self, last: list[int]) -> tuple[int, ...]:
        """The encoding of the whole piece: last tokens followed back from its end."""
        out, at, length = [], len(last), self.length
        while at:
            out.append(last[at - 1])
            at -= length[out[-1]]
        out.reverse()
        return tuple(out)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        return self.ids(self.extend(piece, []))


class TextCoder:
    """Encodes and decodes texts; keeps the ids of recent pieces, as text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.coder = PrefixCoder(ranks)
        self.pattern = regex.compile(pattern)
        self.known = Recent(lambda piece: " ".join(map(str, self.coder.encode(piece.encode()))), CACHE_PIECES)
        size = 1 + max(ranks.values())
        self.sizes = np.zeros(size, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.coder.token.get(i, b"") for i in range(size)), np.uint8)

    def parts(self, text: str) -> Iterator[str]:
        """The decimal ids of the text's pieces, joined by spaces, in one or more parts."""
        if len(text) <= CHUNK_CHARS:
            if text:
                yield " ".join(map(self.known.__getitem__, self.pattern.findall(text)))
            return
        found = self.pattern.finditer(text)
        while pieces := [self.known[m[0]] for m in islice(found, CHUNK_PIECES)]:
            yield " ".join(pieces)

    def numbers(self, part: str) -> np.ndarray:
        return np.fromstring(part, np.int32, sep=" ")

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.numbers(part).tolist()]

    def decode(self, ids) -> bytes:
        """The bytes that the ids stand for, from the table of tokens."""
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[ids] - ends + sizes, sizes)].tobytes()


_CODERS: dict[str, TextCoder] = {}


def _coder(content: bytes, pattern: str) -> TextCoder:
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = TextCoder(parse_ranks(content), pattern)
    return _CODERS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: ``id_col``, n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids`` the ids themselves.

    The hashes are of the decimal ids joined by a space and of the bytes decoded from those ids. A null text is
    encoded as the empty one: no tokens and the hashes of nothing. Ids of documents may be null or repeated, each
    row is encoded by itself; an empty table gives an empty one. ``ranks_path`` is read by the driver alone.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(content.value, pattern)
        for batch in batches:
            counts, hashes, decoded, kept = [], [], [], []
            for text in batch.column(1):
                of_ids, of_bytes, own = hashlib.sha256(), hashlib.sha256(), [np.zeros(0, np.int32)]
                n = 0
                for part in coder.parts(text.as_py() or ""):
                    of_ids.update((" " + part if n else part).encode())
                    ids = coder.numbers(part)
                    for a in range(0, len(ids), CHUNK_PIECES):
                        of_bytes.update(coder.decode(ids[a : a + CHUNK_PIECES]))
                    n += len(ids)
                    if with_ids:
                        own.append(ids)
                counts.append(n)
                hashes.append(of_ids.hexdigest())
                decoded.append(of_bytes.hexdigest())
                if with_ids:
                    kept.append(np.concatenate(own))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def op3_byte_bpe(spark, sf_dir):
    """Contract query: doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text of ``documents``; see
    ``encode_documents`` for nulls, empty texts, repeated rows and empty tables."""
    import public_tokenizers

    from .common import load

    docs = load(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
