"""FLAC media columns: whole streams decoded to PCM blocks that can be sought by sample.

Decoding follows RFC 9639: frame headers with CRC-8, constant, verbatim, fixed and linear subframes, Rice residuals
with escapes, wasted bits, stereo decorrelation, frame CRC-16. A frame that fails its checks becomes a block of
status ``bad`` without samples, and decoding goes on at the next frame that passes them.

Rice codes of a partition are found in an array of the 1 bits: each names the one that ends the next code, so only that chain
is walked; quotients and remainders are read off all at once. Linear predictors run over many subframes at
a time, of whichever frames and streams, one sample of each a step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType


def _table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = x << 1 ^ poly if x >> bits - 1 else x << 1
            x &= (1 << bits) - 1
        out.append(x)
    return out


_T8, _T16 = _table(0x07, 8), _table(0x8005, 16)
#: Bytes whose checksums are taken together, codes from which arrays pay, subframes likewise, samples that wait for their predictors.
_WIDE, MANY_CODES, MANY_SUBFRAMES, WAITING = 64, 48, 8, 1 << 19


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = _T8[x ^ b]
    return x


def _after(x: np.ndarray) -> np.ndarray:
    """CRC-16 states after a further byte of 0."""
    return (x << 8 & 0xFFFF) ^ np.array(_T16)[x >> 8]


def _crc_tables() -> tuple[np.ndarray, list[int]]:
    """CRC-16 of every byte at every place of _WIDE bytes, and every state after _WIDE bytes of 0."""
    rows = [np.array(_T16)]
    state = np.arange(1 << 16)
    for i in range(_WIDE):
        state = _after(state)
        if i:
            rows.append(_after(rows[-1]))
    return np.array(rows[::-1]), state.tolist()


_ROWS, _STATES = _crc_tables()


def crc16(data: bytes) -> int:
    x = 0
    if len(data) > 2 * _WIDE:  # zeros in front change nothing
        whole = np.frombuffer(bytes(-len(data) % _WIDE) + data, np.uint8).reshape(-1, _WIDE)
        for row in np.bitwise_xor.reduce(_ROWS[np.arange(_WIDE), whole], axis=1).tolist():
            x = _STATES[x] ^ row
        return x
    for b in data:
        x = (x << 8 & 0xFFFF) ^ _T16[x >> 8 ^ b]
    return x


class Bad(ValueError):
    """The stream breaks the format."""


class Bits:
    """Reads numbers of any width, from the most significant bit on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.acc, self.have = data, at, 0, 0

    def _fill(self, n: int) -> None:
        while self.have < n:
            chunk = self.data[self.at : self.at + 8]
            if not chunk:
                raise Bad("out of data")
            self.acc = (self.acc << 8 * len(chunk)) | int.from_bytes(chunk)
            self.at += len(chunk)
            self.have += 8 * len(chunk)

    def take(self, n: int) -> int:
        if self.have < n:
            self._fill(n)
        self.have -= n
        x = self.acc >> self.have
        self.acc &= (1 << self.have) - 1
        return x

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> n - 1 else x

    def zeros(self) -> int:
        """Length of a run of 0 bits; the 1 after it is read too."""
        n = 0
        while not self.acc:
            n += self.have
            self.have = 0
            self._fill(1)
        n += self.have - self.acc.bit_length()
        self.have = self.acc.bit_length() - 1
        self.acc &= (1 << self.have) - 1
        return n

    def rice(self, n: int, k: int) -> list[int] | np.ndarray:
        if n >= MANY_CODES:
            return self._rice(n, k)
        out = []
        for _ in range(n):
            q = self.zeros()
            if k:
                q = q << k | self.take(k)
            out.append(q >> 1 ^ -(q & 1))
        return out

    def _rice(self, n: int, k: int) -> np.ndarray:
        begin = 8 * self.at - self.have
        base, room = begin >> 3, (n * (k + 4) >> 3) + 64
        while True:
            raw = np.frombuffer(self.data, np.uint8, min(room, len(self.data) - base), base)
            ones = np.flatnonzero(np.unpackbits(raw))
            i = int(np.searchsorted(ones, begin & 7))
            then, chain = np.searchsorted(ones, ones + (1 + k)).tolist(), []
            then.append(len(ones))
            for _ in range(n):
                chain.append(i)
                i = then[i]
            if chain[-1] < len(ones):
                break
            if base + room >= len(self.data):
                raise Bad("out of data")
            room *= 2
        at = ones[chain]  # where each code's zeros end
        q = np.diff(at, prepend=(begin & 7) - 1 - k) - 1 - k
        if k:
            p = at + 1
            padded = np.concatenate((raw, np.frombuffer(self.data[base + len(raw) : base + len(raw) + 8], np.uint8), np.zeros(8, np.uint8))).astype(np.uint64)
            word = np.zeros(n, np.uint64)
            for j in range(5):  # at most 30 bits from any bit of a byte on
                word = word << np.uint64(8) | padded[(p >> 3) + j]
            low = (word >> (np.uint64(40 - k) - (p & 7).astype(np.uint64))) & np.uint64((1 << k) - 1)
            q = q << k | low.astype(np.int64)
        end = (base << 3) + int(at[-1]) + 1 + k
        if end > 8 * len(self.data):
            raise Bad("out of data")
        self.at, self.acc, self.have = end >> 3, 0, 0
        if end & 7:
            self.take(end & 7)
        return q >> 1 ^ -(q & 1)

    def align(self) -> int:
        """Byte position after what is read, padding included."""
        return self.at - self.have // 8


@dataclass
class Info:
    """What STREAMINFO says."""

    rate: int = 0
    channels: int = 0
    bits: int = 0
    total: int = 0
    block: int = 0
    md5: bytes = b""


def stream_info(data: bytes) -> tuple[Info, int]:
    """STREAMINFO and the place of the first frame."""
    if data[:4] != b"fLaC":
        raise Bad("not flac")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(data):
            raise Bad("metadata cut off")
        last, kind, size = bool(data[at] >> 7), data[at] & 127, int.from_bytes(data[at + 1 : at + 4])
        if kind == 0:
            b = Bits(data[at + 4 : at + 4 + size])
            block = b.take(16)
            b.take(16 + 24 + 24)
            info = Info(b.take(20), b.take(3) + 1, b.take(5) + 1, b.take(36), block, b.take(128).to_bytes(16))
        at += 4 + size
    if info is None:
        raise Bad("no STREAMINFO")
    return info, at


@dataclass
class Frame:
    number: int
    first: int
    size: int
    channels: int
    mode: int
    bits: int
    rate: int


def _header(data: bytes, at: int, info: Info) -> tuple[Frame, int]:
    """The frame header at ``at`` and its end; its CRC-8 must hold."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise Bad("no frame header")
    b = Bits(data, at + 2)
    size, rate, mode, bits = b.take(4), b.take(4), b.take(4), b.take(3)
    if b.take(1) or mode > 10 or bits == 3 or rate == 15 or not size:
        raise Bad("reserved value")
    x = b.take(8)
    more = 0
    while more < 7 and x >> 7 - more & 1:
        more += 1
    if more == 1 or more > 7:
        raise Bad("coded number")
    number = x & ((1 << 7 - more) - 1) if more else x
    for _ in range(max(0, more - 1)):
        number = number << 6 | b.take(8) & 63
    size = 192 if size == 1 else 576 << size - 2 if size < 6 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << size - 8
    rates = {0: info.rate, 1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
    rate = rates[rate] if rate in rates else b.take(8) * 1000 if rate == 12 else b.take(16) * (1 if rate == 13 else 10)
    end = b.align()
    if len(data) <= end or crc8(data[at:end]) != data[end]:
        raise Bad("header checksum")
    first = number if data[at + 1] & 1 else number * info.block
    return Frame(number, first, size, mode + 1 if mode < 8 else 2, mode, (0, 8, 12, 0, 16, 20, 24, 32)[bits] or info.bits, rate), end + 1


def _residual(b: Bits, size: int, order: int) -> np.ndarray:
    method, parts = b.take(2), b.take(4)
    if method > 1 or size % (1 << parts) or size >> parts < order:
        raise Bad("residual")
    width, out, at = 4 + method, np.empty(size - order, np.int64), 0
    for i in range(1 << parts):
        n = (size >> parts) - (order if i == 0 else 0)
        k = b.take(width)
        if k == (1 << width) - 1:
            raw = b.take(5)
            out[at : at + n] = [b.signed(raw) for _ in range(n)]
        else:
            out[at : at + n] = b.rice(n, k)
        at += n
    return out


@dataclass
class Subframe:
    """Samples of a channel; where ``back`` is set, those after its length are still residuals of a linear predictor."""

    x: np.ndarray
    wasted: int
    back: list[int] | None = None
    shift: int = 0


def _subframe(b: Bits, size: int, bits: int) -> Subframe:
    if b.take(1):
        raise Bad("subframe padding")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.zeros() + 1
        bits -= wasted
    if bits < 1:
        raise Bad("wasted bits")
    if kind == 0:
        return Subframe(np.full(size, b.signed(bits)), wasted)
    if kind == 1:
        return Subframe(np.array([b.signed(bits) for _ in range(size)], np.int64), wasted)
    order = kind - 8 if 8 <= kind <= 12 else kind - 31
    if not (8 <= kind <= 12 or kind >= 32):
        raise Bad("reserved subframe")
    if order > size:
        raise Bad("order")
    x = np.empty(size, np.int64)
    x[:order] = warm = [b.signed(bits) for _ in range(order)]
    if kind >= 32:
        precision = b.take(4) + 1
        if precision == 16:
            raise Bad("precision")
        shift = b.signed(5)
        if shift < 0:
            raise Bad("shift")
        back = [b.signed(precision) for _ in range(order)][::-1]
        x[order:] = _residual(b, size, order)
        return Subframe(x, wasted, back, shift)
    out = _residual(b, size, order)
    for level in range(order, 0, -1):  # each level sums up the differences of the one below
        d = warm
        for _ in range(level - 1):
            d = [z - y for y, z in zip(d, d[1:])]
        out = np.cumsum(out) + d[-1]
    x[order:] = out
    return Subframe(x, wasted)


def _predicted(subframes: list[Subframe]) -> None:
    """Turn residuals into samples, a step for all subframes of one length and order."""
    alike: dict[tuple[int, int], list[Subframe]] = {}
    for s in subframes:
        if s.back is not None:
            alike.setdefault((len(s.x), len(s.back)), []).append(s)
    for (size, order), group in alike.items():
        if len(group) >= MANY_SUBFRAMES:
            x, back, shift = np.array([s.x for s in group]).T.copy(), np.array([s.back for s in group]).T, np.array([s.shift for s in group])
            for t in range(order, size):
                x[t] += (x[t - order : t] * back).sum(0) >> shift
            for s, row in zip(group, np.ascontiguousarray(x.T)):
                s.x = row
            continue
        for s in group:
            out = s.x[:order].tolist()
            for r in s.x[order:].tolist():
                out.append(r + (sum(map(mul, s.back, out[-order:])) >> s.shift))
            s.x = np.array(out, np.int64)
    for s in subframes:
        s.back = None
        if s.wasted:
            s.x, s.wasted = s.x << s.wasted, 0


def _frame(data: bytes, at: int, info: Info) -> tuple[Frame, list[Subframe], int]:
    """Header, channels and the end of the frame at ``at``, whose checksums hold."""
    f, start = _header(data, at, info)
    b = Bits(data, start)
    side = {8: 1, 9: 0, 10: 1}.get(f.mode)
    x = [_subframe(b, f.size, f.bits + (c == side)) for c in range(f.channels)]
    end = b.align()
    if len(data) < end + 2 or crc16(data[at:end]) != int.from_bytes(data[end : end + 2]):
        raise Bad("frame checksum")
    return f, x, end + 2


def _channels(f: Frame, subframes: list[Subframe]) -> np.ndarray:
    x = [s.x for s in subframes]
    if f.mode == 8:
        x = [x[0], x[0] - x[1]]
    elif f.mode == 9:
        x = [x[0] + x[1], x[1]]
    elif f.mode == 10:
        mid = x[0] << 1 | x[1] & 1
        x = [mid + x[1] >> 1, mid - x[1] >> 1]
    return np.array(x)


Block = tuple[int, int, int, Frame | None, list[Subframe] | None]


def _parsed(data: bytes) -> Iterator[Block]:
    """Blocks of a stream in order, samples still to be predicted. What no sound frame has, up to the stream's own total, is bad."""
    info, at = stream_info(data)
    expected = 0

    def sound(at: int) -> tuple[Frame, list[Subframe], int]:
        f, x, end = _frame(data, at, info)
        if f.first < expected or info.total and f.first + f.size > info.total:
            raise Bad("place")
        return f, x, end

    while at < len(data):
        begin, found = at, None
        while found is None and 0 <= at < len(data):
            try:
                found = sound(at)
            except Bad:
                at = data.find(b"\xff", at + 1)
        if found is None:
            yield begin, expected, max(0, info.total - expected), None, None
            return
        f, x, end = found
        if at > begin or f.first > expected:
            yield begin, expected, f.first - expected, None, None
        yield at, f.first, f.size, f, x
        expected, at = f.first + f.size, end
    if expected < info.total:
        yield at, expected, info.total - expected, None, None


def _solved(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks (the last two entries are frame and subframes) with their samples by channel, predicted many at a time."""
    wait, n = [], 0
    for x in blocks:
        wait.append(x)
        n += sum(len(s.x) for s in x[-1] or ())
        if n >= WAITING:
            yield from _flushed(wait)
            wait, n = [], 0
    yield from _flushed(wait)


def _flushed(wait: list[tuple]) -> Iterator[tuple]:
    _predicted([s for x in wait for s in x[-1] or ()])
    for *rest, f, subframes in wait:
        yield *rest, f, None if f is None else _channels(f, subframes)


def decode(data: bytes) -> Iterator[tuple[int, int, int, Frame | None, np.ndarray | None]]:
    """(byte offset, first sample, samples, frame, samples by channel) of every block; None where a frame is broken or missing."""
    return _solved(_parsed(data))


def pcm(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples in whole bytes."""
    width = (bits + 7) // 8
    flat = x.T.reshape(-1).astype("<i4" if width < 4 else "<i8")
    return np.ascontiguousarray(flat.view(np.uint8).reshape(len(flat), -1)[:, :width]).tobytes()


def whole_checksum(data: bytes) -> bool:
    """Whether all samples have the MD5 that STREAMINFO gives."""
    info, _ = stream_info(data)
    h = hashlib.md5()
    for *_, f, x in decode(data):
        if f is None:
            return False
        h.update(pcm(x, f.bits))
    return h.digest() == info.md5


_BLOCK = StructType([StructField("block", IntegerType()), StructField("first_sample", LongType()), StructField("n_samples", LongType()), StructField("byte_offset", LongType()), StructField("sample_rate", IntegerType()), StructField("channels", IntegerType()), StructField("bits", IntegerType()), StructField("pcm", BinaryType()), StructField("status", StringType())])


def blocks(media: DataFrame, key: str, column: str) -> DataFrame:
    """``key`` and, for each frame, ``block, first_sample, n_samples, byte_offset, sample_rate, channels, bits, pcm, status``.

    ``pcm`` holds interleaved little-endian samples; status is ``ok``, ``bad`` (frames that fail their checks or are not there; the samples
    that are missing up to the next sound frame, or to STREAMINFO's total, are counted, pcm is null) or ``not flac`` (one row, block 0, for
    bytes without the marker or STREAMINFO). Null and empty media have no row; repeated rows repeat theirs. Other columns are not read.
    """

    def streams(batches):
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not data:
                    continue
                try:
                    info, _ = stream_info(data)
                except Bad:
                    yield i, None, 0, 0, None, None, None, None
                    continue
                for n, x in enumerate(_parsed(data)):
                    yield i, info, n, *x

    def run(batches):
        rows, held = [], 0
        for i, info, n, at, first, size, f, x in _solved(streams(batches)):
            if info is None:
                rows.append((i, 0, None, None, 0, None, None, None, None, "not flac"))
            elif f is None:
                rows.append((i, n, first, size, at, info.rate, info.channels, info.bits, None, "bad"))
            else:
                rows.append((i, n, first, size, at, f.rate, f.channels, f.bits, pcm(x, f.bits), "ok"))
                held += len(rows[-1][-2])
            if len(rows) > 500 or held > 4 << 20:
                yield _rows(rows, schema)
                rows, held = [], 0
        if rows:
            yield _rows(rows, schema)

    out = StructType([media.schema[key], *_BLOCK.fields])
    schema = to_arrow_schema(out)
    return media.select(key, F.col(column).cast("binary")).mapInArrow(run, out)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def seek(found: DataFrame, sample: int | Column) -> DataFrame:
    """The blocks that hold a sample, and its place within the block."""
    s = F.lit(sample) if isinstance(sample, int) else sample
    return found.where((F.col("first_sample") <= s) & (s < F.col("first_sample") + F.col("n_samples"))).withColumn("at", s - F.col("first_sample"))

