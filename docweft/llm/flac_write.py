"""A FLAC writer, for tables that hold no media: tests, and the query that packs vectors as sound."""

from __future__ import annotations

import hashlib

import numpy as np

from .flac import crc8, crc16, pcm


class _Out:
    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, x: int, n: int) -> None:
        if n:
            self.parts.append(format(x & ((1 << n) - 1), f"0{n}b"))

    def all(self, xs: list[int], n: int) -> None:
        mask, form = (1 << n) - 1, f"0{n}b"
        if n:
            self.parts += [format(x & mask, form) for x in xs]

    def bytes(self) -> bytes:
        bits = "".join(self.parts)
        size = -(-len(bits) // 8)
        return int(bits.ljust(8 * size, "0") or "0", 2).to_bytes(size)


def _fold(r: np.ndarray) -> np.ndarray:
    return np.where(r < 0, -2 * r - 1, 2 * r)


def _best_k(u: np.ndarray) -> tuple[int, int]:
    costs = (u[None, :] >> np.arange(15)[:, None]).sum(1) + len(u) * np.arange(1, 16)
    k = int(costs.argmin())
    return k, int(costs[k])


def _residual(o: _Out, r: np.ndarray, order: int, parts: int, escape: bool) -> None:
    o.put(0, 2)
    o.put(parts, 4)
    size = (len(r) + order) >> parts
    at = 0
    for i in range(1 << parts):
        n = size - (order if i == 0 else 0)
        piece = r[at : at + n]
        at += n
        if escape:
            width = max((int(abs(x)).bit_length() + 1 for x in piece.tolist()), default=0)
            o.put(15, 4)
            o.put(width, 5)
            o.all(piece.tolist(), width)
            continue
        k, _ = _best_k(_fold(piece))
        o.put(k, 4)
        low, form = (1 << k) - 1, f"0{k}b"
        o.parts += ["0" * (u >> k) + "1" + (format(u & low, form) if k else "") for u in _fold(piece).tolist()]


def _subframe(o: _Out, x: np.ndarray, bits: int, kind: str, order: int, parts: int, escape: bool) -> None:
    wasted = 0
    if kind != "verbatim" and x.any():
        while not (x & ((2 << wasted) - 1)).any():
            wasted += 1
    x, bits = x >> wasted, bits - wasted
    if (x == x[0]).all():
        kind = "constant"
    order = min(order, len(x))
    if kind == "lpc" and order == 0:
        kind = "verbatim"
    o.put(0, 1)
    o.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind], 6)
    o.put(1 if wasted else 0, 1)
    if wasted:
        o.put(1, wasted)
    while parts and ((len(x) % (1 << parts)) or len(x) >> parts < order):
        parts -= 1
    if kind == "constant":
        o.put(int(x[0]), bits)
    elif kind == "verbatim":
        o.all(x.tolist(), bits)
    elif kind == "fixed":
        o.all(x[:order].tolist(), bits)
        _residual(o, np.diff(x, order), order, parts, escape)
    else:
        rows = np.lib.stride_tricks.sliding_window_view(x, order)[:-1, ::-1]
        a = np.linalg.lstsq(rows.astype(float), x[order:].astype(float), rcond=None)[0] if len(rows) else np.zeros(order)
        shift = 9
        q = np.clip(np.round(a * (1 << shift)), -2047, 2047).astype(np.int64)
        guess = (rows * q).sum(1) >> shift
        o.all(x[:order].tolist(), bits)
        o.put(11, 4)
        o.put(shift, 5)
        o.all(q.tolist(), 12)
        _residual(o, x[order:] - guess, order, parts, escape)


def _number(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    more = 1
    while n >> 6 * more + 6 - more:
        more += 1
    return bytes([(0xFF << 7 - more) & 0xFF | n >> 6 * more, *(0x80 | n >> 6 * i & 63 for i in reversed(range(more)))])


def encode(x: np.ndarray, bits: int = 16, rate: int = 16000, block: int = 4096, kind: str = "fixed", order: int = 2, parts: int = 0, mode: int | None = None, escape: bool = False) -> bytes:
    """A stream of ``x`` (channels by samples). ``mode`` is 8, 9 or 10 for left/side, right/side and mid/side."""
    channels, total = x.shape
    head = block.to_bytes(2) * 2 + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | total).to_bytes(8) + hashlib.md5(pcm(x, bits)).digest()
    out = [b"fLaC\x80", len(head).to_bytes(3), head]
    for n, at in enumerate(range(0, total, block)):
        part = x[:, at : at + block].astype(np.int64)
        size = part.shape[1]
        code = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}.get(bits, 0)
        frame = bytes([0xFF, 0xF8, 0x70, (channels - 1 if mode is None else mode) << 4 | code << 1]) + _number(n) + (size - 1).to_bytes(2)
        frame += bytes([crc8(frame)])
        o = _Out()
        side = {8: 1, 9: 0, 10: 1}.get(mode)
        if mode == 8:
            part = np.array([part[0], part[0] - part[1]])
        elif mode == 9:
            part = np.array([part[0] - part[1], part[1]])
        elif mode == 10:
            part = np.array([part[0] + part[1] >> 1, part[0] - part[1]])
        for c in range(channels):
            _subframe(o, part[c], bits + (c == side), kind, order, parts, escape)
        frame += o.bytes()
        out += [frame, crc16(frame).to_bytes(2)]
    return b"".join(out)
