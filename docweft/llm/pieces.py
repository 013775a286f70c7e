"""SentencePiece encoding and decoding by a forward pass over a trie of distinct marked words.

The words of a batch are marked (blank as U+2581), made distinct, sorted and walked as a trie, depth first: one
stack holds the forward state of every prefix, and a word starts from the state of the prefix that it
shares with the word before. For unigram models the state is the Viterbi score and the last piece.
For BPE models the best-scored path is not what the model means, so the state is the last piece of the
prefix's own BPE result: the one piece whose left neighbour, the result of the rest, stays apart from it
when the two are merged. Both give the ids of the public library. Ids are read off backwards at a word's end, so that
memory is in proportion to the longest word.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 2 << 20
#: What the store may hold before all words leave it that came in one slice only. A worker stays some 200 MB larger than an idle one, and an executor has several.
WORDS_KEPT = 150_000
IDS_KEPT = 5 * WORDS_KEPT
APART_KEPT = 200_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    i, n = 0, len(raw)

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, raw[i : i + size]
            i += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if size == 4 else "<d", raw[i : i + size])[0]
            i += size


class Model:
    """Pieces, scores and flags of a model file. Only identity normalisation can be read."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.prefix = 1, True
        for f, v in _fields(raw):
            if f == 1:
                piece = dict(_fields(v))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, 1))
            elif f == 2:
                self.kind = dict(_fields(v)).get(3, 1)
            elif f == 3:
                spec = dict(_fields(v))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models with identity normalisation and all blanks kept can be read")
        if self.kind not in (1, 2):
            raise ValueError("only unigram and BPE models can be read")
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] in (1, 4)}
        self.unknown = kinds.index(2)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == 6}
        self.longest = max(map(len, self.ids), default=1)
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.raw = [bytes([int(p[3:5], 16)]) if kinds[i] == 6 else b"" if kinds[i] == 3 else b" \xe2\x81\x87 " if kinds[i] == 2 else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw_len = np.array([len(x) for x in self.raw], np.int64)
        self.raw_at = np.concatenate(([0], np.cumsum(self.raw_len)))[:-1]
        self.raw_all = np.frombuffer(b"".join(self.raw), np.uint8)
        self._apart: dict[int, bool] = {}
        self.out: dict[int, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self._again: set[str] = set()
        self.flat, self.start = array("i"), array("q", [0])

    def merges(self, s: str) -> list[str]:
        """Plain BPE of a short string: the best-scored neighbours first, the leftmost of equals."""
        out, ids, scores = list(s), self.ids, self.scores
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                k = ids.get(out[i] + out[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def _symbols(self) -> None:
        """Numbers for all pieces that merging makes, and for single characters as they come."""
        self.symbol = {p: i for p, i in self.ids.items() if self.kind == 1 or len(p) == 1 or self.merges(p) == [p]}
        self.spelt = dict((i, p) for p, i in self.symbol.items())
        self.out = {i: (i,) for i in self.symbol.values()}

    def _character(self, c: str) -> int:
        k = self.symbol.get(c)
        if k is None:
            k = self.symbol[c] = len(self.pieces) + len(self.symbol)
            self.spelt[k] = c
            self.out[k] = tuple(self.bytes[b] for b in c.encode()) if len(self.bytes) == 256 else (self.unknown,)
        return k

    def _apart_now(self, a: int, b: int) -> bool:
        if len(self._apart) > APART_KEPT:
            self._apart.clear()
        x, y = self.spelt[a], self.spelt[b]
        ok = self._apart[a << 24 | b] = self.merges(x + y) == [x, y]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode distinct marked words, in sorted order, into the store."""
        if not self.out:
            self._symbols()
        sym: list[int] = [-1]  # the last piece of every prefix of the word on the stack
        best: list[float] = [0.0]
        back: list[int] = [0]  # where that piece begins
        before = ""
        symbol, scores, longest, apart, bpe, out = self.symbol.get, self.scores, self.longest, self._apart, self.kind == 2, self.out
        for w in sorted(words):
            n = len(w)
            k = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                k += 1
            del sym[k + 1 :], best[k + 1 :], back[k + 1 :]
            for i in range(k + 1, n + 1):
                if bpe:
                    # Exactly one piece fits, so the order of trying doesn't matter; most are short.
                    for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                        p = symbol(w[j:i])
                        if p is None:
                            if j < i - 1:
                                continue
                            p = self._character(w[j])
                        if not j:
                            break
                        ok = apart.get(sym[j] << 24 | p)
                        if ok or ok is None and self._apart_now(sym[j], p):
                            break
                    else:
                        raise AssertionError(w)
                else:
                    j = i - 1
                    p = self._character(w[j])
                    top = best[j] + (scores[p] if p < len(scores) else self.low)
                    for a in range(i - longest if i > longest else 0, i - 1):
                        q = symbol(w[a:i])
                        if q is not None and best[a] + scores[q] > top:
                            j, p, top = a, q, best[a] + scores[q]
                    best.append(top)
                sym.append(p)
                back.append(j)
            before = w
            self.index[w] = len(self.start) - 1
            path = []
            while n:
                path.append(sym[n])
                n = back[n]
            last = -1
            for p in reversed(path):
                x = out[p]
                if last != self.unknown or x != (last,):  # neighbours that are unknown are one
                    self.flat.extend(x)
                    last = x[-1]
            self.start.append(len(self.flat))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the texts' offsets in it."""
        if len(self.index) > WORDS_KEPT or len(self.flat) > IDS_KEPT:
            self._keep()
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, f"  |^ | $|{MARK}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        if not self.prefix:
            odd[:] = True
        parts = pc.split_pattern(texts, " ")
        lists, flat = parts.offsets.to_numpy(), parts.values
        if odd.any():
            rows, offsets = [], [0]
            for t, strange, words in zip(texts.to_pylist(), odd, parts):
                rows.extend(_CHUNK.findall((MARK if self.prefix and t else "") + t.replace(" ", MARK)) if strange else [MARK + w for w in words.as_py()])
                offsets.append(len(rows))
            lists, flat, mark = np.array(offsets), pa.array(rows, pa.string()), ""
        else:
            mark = MARK
        coded = flat.slice(lists[0], lists[-1] - lists[0]).dictionary_encode()
        lists = lists - lists[0]
        words = [mark + w for w in coded.dictionary.to_pylist()]
        known = list(map(self.index.get, words))
        new = [w for w, a in zip(words, known) if a is None]
        self._again.update(w for w, a in zip(words, known) if a is not None)
        self.learn(new)
        at = np.array([self.index[w] if a is None else a for w, a in zip(words, known)], np.int64)
        code = at[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
        start, ids = np.frombuffer(self.start, np.int64).copy(), np.frombuffer(self.flat, np.int32).copy()
        n = start[code + 1] - start[code]
        ends = np.concatenate(([0], np.cumsum(n)))
        return ids[np.repeat(start[code] - ends[:-1], n) + np.arange(ends[-1])], ends[lists]

    def _keep(self) -> None:
        """Only words that came again stay in the store; none if even they are too many."""
        words = list(self._again)
        at = np.array([self.index[w] for w in words], np.int64)
        start, ids = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.int32)
        n = start[at + 1] - start[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        kept = ids[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        del start, ids  # else the arrays can't grow
        self._reset()
        if len(words) <= WORDS_KEPT * 3 // 4 and ends[-1] <= IDS_KEPT * 3 // 4:
            self.index = dict(zip(words, range(len(words))))
            self.flat.frombytes(kept)
            self.start = array("q", ends.tolist())

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in one array, and the texts' offsets in it."""
        n = self.raw_len[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        data = self.raw_all[np.repeat(self.raw_at[ids] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[offsets]
        if self.prefix:
            keep = np.ones(len(data), bool)
            first = at[:-1][at[:-1] < at[1:]]
            keep[first[data[first] == 32]] = False
            data, at = data[keep], np.concatenate(([0], np.cumsum(keep)))[at]
        return data, at


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = Model(f.read())
    return _MODELS[path]


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip``: every text's ids, and whether they decode to the very text.

    Nothing is shuffled: each task encodes the distinct words of its own batches. A null text gives null ids,
    0 tokens and a null ``round_trip``; an empty one gives no ids. Rows stay as many, whatever their ids.
    Columns besides ``doc_id`` and ``text`` are not read. The model file must be at ``path`` on every machine.
    """

    def run(batches):
        m = model(path)
        for b in C.slices(batches, size=SLICE):
            text = b.column("text")
            ids, offsets = m.encode(text)
            data, at = C.strings(text)
            back, back_at = m.decode(ids, offsets)
            same = np.diff(at) == np.diff(back_at)
            if np.array_equal(at, back_at):
                wrong = np.flatnonzero(data != back)
                same[np.searchsorted(at, wrong, "right") - 1] = False
            else:
                for i in np.flatnonzero(same):
                    same[i] = np.array_equal(data[at[i] : at[i + 1]], back[back_at[i] : back_at[i + 1]])
            null = pc.is_null(text).to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null) if null.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), lists, pa.array(same, mask=null)], ["doc_id", "n_tokens", "ids", "round_trip"])

    C.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        m = model(path)
        for b in batches:
            out = []
            for ids in b.column("ids").to_pylist():
                if ids is None:
                    out.append(None)
                    continue
                data, _ = m.decode(np.array(ids, np.int64), np.array([0, len(ids)]))
                out.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")
