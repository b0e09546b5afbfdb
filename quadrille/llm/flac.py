"""FLAC media column: lossless 8-bit mono streams of text bytes, vectorised over many frames at once.

Encoding tries the fixed predictors of order 0 to 4 for each frame of 192 samples and codes the residual with one
Rice parameter. Streams carry a seek table with a point every 8 frames. Decoding starts at every seek point at
once and goes through the frames in lockstep: it parses headers, reads Rice codes, runs the linear predictor
(fixed or stored coefficients), and verifies both checksums of every frame and the MD5 of the stream. Streams of any
other form that FLAC allows (more channels, other sample sizes and blocks, several Rice partitions) are read too, frame
after frame, with the same checks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import steps, stored, text_bytes

BLOCK = 192
SEEK_FRAMES = 8
RATE = 8000
#: Coefficients of the fixed predictors, most recent sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint32)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


#: CRC-16 of two bytes at once: the checksum of a 16-bit word after a state of 0.
CRC16_WORD = (CRC16[(np.arange(1 << 16) >> 8)] << 8 & 0xFFFF) ^ CRC16[CRC16[np.arange(1 << 16) >> 8] >> 8 ^ np.arange(1 << 16) & 0xFF]
CRC16_WORD = CRC16_WORD.astype(np.uint16)


def header_crcs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-8 of each range of a few bytes."""
    crc, size = np.zeros(len(begins), np.uint32), ends - begins
    for i in range(int(size.max()) if len(size) else 0):
        crc = np.where(size > i, CRC8[crc ^ data[begins + i]], crc)
    return crc


def frame_crcs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-16 of each range. All ranges go together, two bytes at a time; a zero byte before a range of odd
    length changes nothing, since the checksum starts at 0."""
    size = ends - begins
    order = np.argsort(-size, kind="stable")
    at, odd = begins[order].astype(np.int64), size[order] & 1
    words = (size[order] + odd) >> 1
    pairs = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    crc = CRC16_WORD[np.where(odd == 1, data[at], pairs[at])] if len(at) else np.zeros(0, np.uint16)
    at = at - odd
    for i in range(1, int(words[0]) if len(words) else 0):
        n = int(np.searchsorted(-words, -i, "left"))
        crc[:n] = CRC16_WORD[crc[:n] ^ pairs[at[:n] + 2 * i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the header's variable-length form: a matrix of up to 6 bytes and their counts."""
    n = numbers.astype(np.int64)
    count = 1 + (n >= 1 << 7).astype(np.int64) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    out = np.zeros((len(n), 6), np.uint8)
    for c in np.unique(count):
        rows = count == c
        v = n[rows]
        for i in range(c - 1, 0, -1):
            out[rows, i] = 0x80 | v & 0x3F
            v = v >> 6
        out[rows, 0] = v if c == 1 else (0xFF00 >> c & 0xFF) | v
    return out, count


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the rows of ``samples`` (int, n x BLOCK): their bytes joined, and n + 1 offsets."""
    n = len(samples)
    x = samples.astype(np.int32)
    residuals = [x]
    for _ in range(4):
        residuals.append(np.diff(residuals[-1], axis=1))
    weigh = np.stack([np.abs(r).sum(1) + 8 * o for o, r in enumerate(residuals)])
    order = weigh.argmin(0)
    constant = (x == x[:, :1]).all(1)
    k = np.zeros(n, np.int64)
    bits = np.full(n, 8 * BLOCK + 8, np.int64)
    coded = np.zeros(n, bool)
    zig = {}
    for o in range(5):
        rows = np.flatnonzero((order == o) & ~constant)
        if not len(rows):
            continue
        r = residuals[o][rows]
        z = (r << 1 ^ r >> 31).astype(np.uint16)
        size = np.stack([(z >> np.uint16(j)).sum(1, dtype=np.int64) + (1 + j) * (BLOCK - o) for j in range(9)])
        best = size.argmin(0)
        total = 8 + 8 * o + 10 + size.min(0)
        k[rows] = best
        use = total < bits[rows]
        coded[rows[use]] = True
        bits[rows[use]] = total[use]
        zig[o] = (rows[use], z[use])
    bits[constant] = 16
    number, count = _number_bytes(numbers)
    head = 4 + count
    length = head + 1 + (bits + 7) // 8 + 2
    offsets = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(offsets[-1]) + 4, np.uint8)
    start = offsets[:-1]
    out[start], out[start + 1], out[start + 2], out[start + 3] = 0xFF, 0xF8, 0x10, 0x02  # sync, 192 samples, mono of 8 bits
    for i in range(6):
        rows = count > i
        out[start[rows] + 4 + i] = number[rows, i]
    body = start + head + 1
    out[body[constant] + 1] = x[constant, 0] & 0xFF
    plain = np.flatnonzero(~constant & ~coded)
    out[body[plain]] = 0x02
    out[body[plain][:, None] + 1 + np.arange(BLOCK)] = x[plain] & 0xFF
    for o, (rows, z) in zig.items():
        if not len(rows):
            continue
        at, p = body[rows], k[rows][:, None]
        out[at] = (8 + o) << 1
        if o:
            out[at[:, None] + 1 + np.arange(o)] = x[rows, :o] & 0xFF
        out[at + 1 + o] = k[rows] >> 2  # two bits of coding method, four of partition order, four of parameter
        out[at + 2 + o] = (k[rows] & 3) << 6
        q = z >> p.astype(np.uint16)
        width = q + (1 + p).astype(np.uint16)
        ends = np.cumsum(width, axis=1, dtype=np.int32).astype(np.int64) + ((at + 1 + o) * 8 + 10)[:, None]
        first = ends - (1 + p)
        code = ((z & ((1 << p) - 1).astype(np.uint16)) | (1 << p).astype(np.uint16)).astype(np.int64) << (23 - p - (first & 7))
        byte = (first >> 3).ravel()
        low = int(byte[0])
        code = code.ravel()
        # Codes never share a bit, so adding up their bytes joins them.
        for i in range(3):
            part = np.bincount(byte - low + i, code >> (16 - 8 * i) & 0xFF)
            out[low : low + len(part)] += part.astype(np.uint8)
    out = out[: offsets[-1]]
    out[start + head] = header_crcs(out, start, start + head)
    whole = frame_crcs(out, start, offsets[1:] - 2)
    out[offsets[1:] - 2], out[offsets[1:] - 1] = whole >> 8, whole & 0xFF
    return out, offsets


def _stream(frames: np.ndarray, offsets: np.ndarray, pcm: bytes) -> bytes:
    """A whole file: marker, stream header, seek table and frames (``offsets`` of this file's frames)."""
    size = np.diff(offsets)
    n = len(size) * BLOCK
    info = BLOCK.to_bytes(2, "big") * 2 + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    points = np.arange(0, len(size), SEEK_FRAMES)
    table = np.zeros(len(points), np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
    table["sample"], table["byte"], table["count"] = points * BLOCK, offsets[points] - offsets[0], BLOCK
    seek = table.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frames[offsets[0] : offsets[-1]].tobytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload (a positive multiple of BLOCK bytes each): byte b is the sample b - 128."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"payloads are positive multiples of {BLOCK} bytes")
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    numbers = np.arange(firsts[-1]) - np.repeat(firsts[:-1], counts)
    samples = (raw.astype(np.int16) - 128).reshape(-1, BLOCK)
    pieces = [encode_frames(samples[i : i + 4096], numbers[i : i + 4096]) for i in range(0, len(samples), 4096)]
    frames = np.concatenate([p[0] for p in pieces])
    ends, shift = [np.zeros(1, np.int64)], 0
    for _, o in pieces:
        ends.append(o[1:] + shift)
        shift += o[-1]
    offsets = np.concatenate(ends)
    signed = samples.astype(np.int8).tobytes()
    return [_stream(frames, offsets[a : b + 1], signed[a * BLOCK : b * BLOCK]) for a, b in zip(firsts, firsts[1:], strict=False)]


class OtherForm(ValueError):
    """A valid stream of another form than ``encode`` writes."""


def header(media: bytes) -> dict:
    """Stream header and seek points of a file; ``plain`` where it may be of the form that ``encode`` writes."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, out = 4, False, {"points": np.zeros((0, 2), np.int64)}
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            rest = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[:2], "big"), "rate": rest >> 44, "channels": (rest >> 41 & 7) + 1, "bits": (rest >> 36 & 31) + 1, "samples": rest & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            table = np.frombuffer(body, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
            out["points"] = np.stack([table["sample"].astype(np.int64), table["byte"].astype(np.int64)], 1)
        at += 4 + size
    out["audio"] = at
    if "samples" not in out:
        raise ValueError("a FLAC stream without a stream header")
    out["plain"] = (out["channels"], out["bits"], out["block"], out["samples"] % BLOCK) == (1, 8, BLOCK, 0) and out["samples"] > 0
    return out


#: Block sizes, sample rates and sample sizes by the codes of frame headers; None: written after the header.
BLOCK_SIZES = (None, 192, 576, 1152, 2304, 4608, None, None, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
SAMPLE_BITS = (None, 8, 12, None, 16, 20, 24, 32)


class _Bits:
    """Reads numbers bit by bit."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end = data, at * 8, len(data) * 8

    def take(self, n: int) -> int:
        a, self.at = self.at, self.at + n
        if self.at > self.end:
            raise ValueError("a frame is cut off")
        return int.from_bytes(self.data[a >> 3 : self.at + 7 >> 3], "big") >> (-self.at & 7) & (1 << n) - 1 if n else 0

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def zeros(self) -> int:
        """The length of a run of zeros; the one that ends it is read too."""
        n = 0
        while True:
            step = min(32, self.end - self.at)
            if step <= 0:
                raise ValueError("a residual never ends")
            v = self.take(step)
            if v:
                self.at -= v.bit_length() - 1
                return n + step - v.bit_length()
            n += step


def _residual(b: _Bits, block: int, order: int) -> list[int]:
    """Rice residuals in any number of partitions; a partition may hold plain numbers instead."""
    method = b.take(2)
    if method > 1:
        raise ValueError("an unknown coding method")
    width, partitions, out = 4 + method, 1 << b.take(4), []
    for i in range(partitions):
        n = block // partitions - (order if i == 0 else 0)
        k = b.take(width)
        if k == (1 << width) - 1:
            size = b.take(5)
            out += [b.signed(size) for _ in range(n)]
            continue
        for _ in range(n):
            z = b.zeros() << k | b.take(k)
            out.append(z >> 1 ^ -(z & 1))
    return out


def _subframe(b: _Bits, block: int, bits: int) -> list[int]:
    if b.take(1):
        raise ValueError("a subframe of unknown kind")
    kind = b.take(6)
    wasted = b.zeros() + 1 if b.take(1) else 0
    bits -= wasted
    if kind == 0:
        x = [b.signed(bits)] * block
    elif kind == 1:
        x = [b.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        x = [b.signed(bits) for _ in range(order)]
        weights, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        for r in _residual(b, block, order):
            x.append(r + (sum(w * x[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("a subframe of unknown kind")
    return [v << wasted for v in x] if wasted else x


def _any_frame(b: _Bits, head: dict) -> list[list[int]]:
    """The channels of the next frame."""
    begin = b.at >> 3
    if b.take(15) != 0x7FFC:
        raise ValueError("a frame header is missing")
    b.take(1)
    size, rate, channels, bits = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    for _ in range(_more_bytes(b)):
        b.take(8)
    block = BLOCK_SIZES[size] if size not in (6, 7) else b.take(8 if size == 6 else 16) + 1
    if rate >= 12:
        b.take(8 if rate == 12 else 16)
    width = SAMPLE_BITS[bits] if bits else head["bits"]
    if block is None or width is None or channels > 10:
        raise ValueError("a frame header of unknown form")
    data = np.frombuffer(b.data, np.uint8)
    end = b.at >> 3
    if header_crcs(data, np.array([begin]), np.array([end]))[0] != b.take(8):
        raise ValueError("a frame header's checksum is wrong")
    side = {8: 1, 9: 0, 10: 1}.get(channels)
    x = [_subframe(b, block, width + (i == side)) for i in range(2 if channels >= 8 else channels + 1)]
    b.at += -b.at & 7
    end = b.at >> 3
    if frame_crcs(data, np.array([begin]), np.array([end]))[0] != b.take(16):
        raise ValueError("a frame's checksum is wrong")
    if channels == 8:
        x[1] = [p - q for p, q in zip(*x, strict=True)]
    elif channels == 9:
        x[0] = [p + q for p, q in zip(*x, strict=True)]
    elif channels == 10:
        x = [list(z) for z in zip(*(((2 * m + (s & 1) + s) >> 1, (2 * m + (s & 1) - s) >> 1) for m, s in zip(*x, strict=True)), strict=True)]
    return x


def _more_bytes(b: _Bits) -> int:
    """How many bytes follow the first of a frame's number, which is read."""
    lead = b.take(8)
    return 0 if lead < 0x80 else 7 - (0xFF ^ lead).bit_length()


def decode_any(media: bytes) -> np.ndarray:
    """The samples of a stream of any form, int32: one dimension, or samples x channels of several channels."""
    head, parts, n = header(media), [], 0
    b = _Bits(media + bytes(2), head["audio"])
    b.end -= 16
    while n < head["samples"] or not head["samples"] and b.end - b.at >= 48:
        frame = np.array(_any_frame(b, head), np.int64).T
        parts.append(frame)
        n += len(frame)
    x = np.concatenate(parts).astype(np.int32) if parts else np.zeros((0, head["channels"]), np.int32)
    size = (head["bits"] + 7) // 8
    if any(head["md5"]) and hashlib.md5(pcm_bytes(x, size)).digest() != head["md5"]:
        raise ValueError("the samples' MD5 is wrong")
    return x[:, 0] if x.shape[1] == 1 else x


def pcm_bytes(x: np.ndarray, size: int) -> bytes:
    """Samples as signed little-endian numbers of ``size`` bytes, the channels of a sample together."""
    return x.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :size].tobytes()


#: Leading zeros of each 16-bit number.
_ZEROS = (16 - np.frexp(np.arange(1 << 16))[1]).astype(np.uint8)


def _decode_chains(data: np.ndarray, at: np.ndarray, frames: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Samples (int16, total frames x BLOCK) of runs of frames that start at bytes ``at`` and are decoded together."""
    firsts = np.concatenate([[0], np.cumsum(frames)])
    out = np.empty((int(firsts[-1]), BLOCK), np.int16)
    window = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)[:-1].copy().view(">u8").ravel().astype(np.uint64)
    one = np.uint64(1)

    def at_bit(p):
        return window[p >> 3] << (p & 7).astype(np.uint64)

    def take(p, width):
        """``width`` (0 to 32) bits from bit ``p`` on."""
        return (at_bit(p) >> one >> np.asarray(63 - width).astype(np.uint64)).astype(np.int64)

    signed = lambda v: (v ^ 128) - 128
    at, begun, ended = at.astype(np.int64), [], []
    for step in range(int(frames.max()) if len(frames) else 0):
        own = np.flatnonzero(frames > step)
        begin = at[own]
        if (data[begin] != 0xFF).any() or (data[begin + 1] != 0xF8).any() or (data[begin + 2] != 0x10).any() or (data[begin + 3] != 0x02).any():
            raise OtherForm("a frame header is missing or of another form")
        lead = data[begin + 4].astype(np.int64)
        extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
        number = np.where(extra == 0, lead, lead & (0x3F >> extra))
        for i in range(1, 6):
            number = np.where(extra >= i, number << 6 | data[np.minimum(begin + 4 + i, len(data) - 1)] & 0x3F, number)
        if (number != numbers[own] + step).any():
            raise ValueError("frames are out of order")
        head = begin + 5 + extra
        if (header_crcs(data, begin, head) != data[head]).any():
            raise ValueError("a frame header's checksum is wrong")
        p = (head + 1) * 8
        kind = take(p, 8) >> 1
        p = p + 8
        x = np.zeros((BLOCK, len(own)), np.int32)
        constant, plain, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
        if not (constant | plain | fixed | linear).all():
            raise ValueError("a subframe of unknown kind")
        x[:, constant] = signed(take(p[constant], 8))
        p[constant] += 8
        if plain.any():
            x[:, plain] = signed(take(p[plain] + 8 * np.arange(BLOCK)[:, None], 8))
            p[plain] += 8 * BLOCK
        order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
        for o in np.unique(order[fixed | linear]):
            rice = np.flatnonzero((fixed | linear) & (order == o))
            x[:, rice], p[rice] = _rice(kind[rice], p[rice], int(o), take, at_bit)
        end = (p + 7) // 8
        if len(end) and end.max() + 2 > len(data):
            raise ValueError("a frame is cut off")
        begun.append(begin)
        ended.append(end)
        at[own] = end + 2
        out[firsts[own] + step] = x.T
    if begun:
        begin, end = np.concatenate(begun), np.concatenate(ended)
        if (frame_crcs(data, begin, end) != (data[end].astype(np.uint16) << np.uint16(8) | data[end + 1])).any():
            raise ValueError("a frame's checksum is wrong")
    return out


def _rice(kind: np.ndarray, q: np.ndarray, o: int, take, at_bit) -> tuple[np.ndarray, np.ndarray]:
    """Samples (BLOCK x n) of subframes that predict from ``o`` samples, and the bits where they end."""
    r = np.zeros((BLOCK, len(q)), np.int32)
    for i in range(o):
        r[i] = (take(q + 8 * i, 8) ^ 128) - 128
    q = q + 8 * o
    weights, shift = np.zeros((o, len(q)), np.int64), np.zeros(len(q), np.int64)
    fixed, lin = np.flatnonzero(kind < 32), np.flatnonzero(kind >= 32)
    if o <= 4:
        weights[:, fixed] = np.array(FIXED[o], np.int64)[:, None]
    if len(lin):
        precision = take(q[lin], 4) + 1
        shift[lin] = take(q[lin] + 4, 5)
        q[lin] += 9
        for i in range(o):
            c = take(q[lin], precision)
            weights[i, lin] = c - ((c >> (precision - 1)) << precision)
            q[lin] += precision
    if (take(q, 6) != 0).any():
        raise OtherForm("more than one Rice partition, or other parameters")
    k = take(q + 6, 4)
    q = q + 10
    k64, one, top, flip = k.astype(np.uint64), np.uint64(1), np.uint64(48), (63 - k).astype(np.uint64)
    weights = weights.astype(np.int32) if not len(lin) else weights
    for i in range(o, BLOCK):
        w = at_bit(q)
        zeros = _ZEROS[w >> top]
        if (zeros == 16).any():
            zeros = zeros.astype(np.int64)
            more = np.flatnonzero(zeros == 16)
            while len(more):
                step = _ZEROS[at_bit(q[more] + zeros[more]) >> top]
                zeros[more] += step
                more = more[step == 16]
                if zeros.max() > 1 << 16:
                    raise ValueError("a residual never ends")
            w = at_bit(q + zeros) << one
            z = (zeros << k) | (w >> one >> flip).astype(np.int64)
        else:
            z = (zeros.astype(np.uint64) << k64 | w << (zeros + np.uint8(1)) >> one >> flip).astype(np.int64)
        q = q + zeros + 1 + k
        v = (z >> 1) ^ -(z & 1)
        if o:
            total = weights[0] * r[i - 1]
            for j in range(1, o):
                total = total + weights[j] * r[i - 1 - j]
            v = v + (total >> shift if len(lin) else total)
        r[i] = v
    return r, q


def decode(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream; raises ValueError where a checksum or a header is wrong.

    Streams of the form that ``encode`` writes are decoded together (int16), others one by one (see ``decode_any``).
    """
    heads = [header(m) for m in media]
    plain = [i for i, h in enumerate(heads) if h["plain"]]
    out: list = [None] * len(media)
    try:
        for i, x in zip(plain, _decode_together([media[i] for i in plain], [heads[i] for i in plain]), strict=True):
            out[i] = x
    except OtherForm:
        pass
    return [decode_any(m) if x is None else x for x, m in zip(out, media, strict=True)]


def _decode_together(media: list[bytes], heads: list[dict]) -> list[np.ndarray]:
    audio = [np.frombuffer(m, np.uint8, offset=h["audio"]) for m, h in zip(media, heads, strict=True)]
    firsts = np.concatenate([[0], np.cumsum([len(a) for a in audio])]).astype(np.int64)
    at, frames, numbers = [], [], []
    for h, first in zip(heads, firsts, strict=False):
        points, total = h["points"], h["samples"] // BLOCK
        if not len(points):
            points = np.zeros((1, 2), np.int64)
        begins = points[:, 0] // BLOCK
        at.append(points[:, 1] + first)
        frames.append(np.diff(np.append(begins, total)))
        numbers.append(begins)
    data = np.concatenate([*audio, np.zeros(16, np.uint8)])
    samples = _decode_chains(data, np.concatenate(at), np.concatenate(frames), np.concatenate(numbers)).reshape(-1) if media else np.zeros(0, np.int16)
    ends = np.concatenate([[0], np.cumsum([h["samples"] for h in heads])]).astype(np.int64)
    out = [samples[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    for x, h in zip(out, heads, strict=True):
        if hashlib.md5(x.astype(np.int8).tobytes()).digest() != h["md5"]:
            raise ValueError("the samples' MD5 is wrong")
    return out


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (of the unpadded text) and media: the text's UTF-8 bytes, padded with spaces to a positive
    multiple of BLOCK, as a FLAC stream. A null text is stored as the empty one: BLOCK spaces. Each row is stored
    by itself, so repeated rows and null ids are no special case; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in steps(offsets, 3 << 20):
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                media = encode([t + b" " * (-len(t) % BLOCK if t else BLOCK) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


def _in_groups(column: pa.Array, limit: int = 3 << 20):
    """Lists of stored streams of about ``limit`` bytes together."""
    group, size, first = [], 0, 0
    for i, m in enumerate(column):
        m = m.as_py()
        group.append(m)
        size += len(m)
        if size >= limit:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", block_samples: int = 8 * BLOCK) -> DataFrame:
    """The decoded samples in blocks: ``id_col``, sample_offset and pcm (signed little-endian samples of whole
    bytes, the channels of a sample together)."""

    def run(batches):
        for batch in batches:
            for first, group in _in_groups(batch.column(1)):
                ids, at, pcm = [], [], []
                for i, x in enumerate(decode(group), first):
                    size = (header(group[i - first])["bits"] + 7) // 8
                    for begin in range(0, len(x), block_samples):
                        ids.append(i)
                        at.append(begin)
                        pcm.append(pcm_bytes(x[begin : begin + block_samples], size))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(at, pa.int64()), pa.array(pcm, pa.binary())], names=[id_col, "sample_offset", "pcm"])

    return media.select(id_col, "media").mapInArrow(run, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, sample_offset bigint, pcm binary")


def feature(x: np.ndarray) -> str:
    """Peak, mean and energy in thousandths of a sample, and sign changes of the samples about their mean."""
    y = x.astype(np.int64)
    total, n = int(y.sum()), len(y)
    above = y * n > total
    return f"peak={int(np.abs(y).max())};mean={1000 * total // n};energy={1000 * int((y * y).sum()) // n};turns={int((above[1:] != above[:-1]).sum())}"


def digest_column(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each stored stream, read back: payload_bytes, payload_sha256, tail_crc32 (of the last 16 payload bytes),
    media_bytes, media_sha256 and feature; ``n_bytes`` is passed on."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, group in _in_groups(batch.column(2)):
                samples = decode(group)
                payloads = [(x + 128).astype(np.uint8).tobytes() for x in samples]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(group)),
                        batch.column(1).slice(first, len(group)),
                        pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                        pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                        pa.array([len(m) for m in group], pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in group]),
                        pa.array([feature(x) for x in samples]),
                    ],
                    names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


#: How the media table is written. Streams of text bytes hardly shrink, but copies of a text repeat their bytes.
MEDIA_OPTIONS = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "9", "parquet.block.size": str(32 << 20)}


def op5_flac(spark, sf_dir):
    """Contract query: the media column of ``documents`` is written to the shared folder, and what is read back gives doc_id,
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature; see ``encode_column`` for
    nulls, empty texts, repeated rows and empty tables."""
    from .common import load

    return digest_column(stored(encode_column(load(spark, sf_dir, "documents")), "media", MEDIA_OPTIONS))
