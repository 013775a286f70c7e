"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most e edits shares at least
``t = m - q + 1 - q*e`` of its q-grams with the text, all on e+1 neighbouring diagonals. Hits are counted in
overlapping diagonal bands twice that wide, so some band holds a whole occurrence; bands with t hits are
verified by banded alignment. Texts and items are compared lower-cased, any white space as a blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Characters of items that one pass over the texts searches; a larger benchmark takes several passes.
ITEM_CHARS = 8_000_000
#: Characters of the pairs that are aligned together.
CELLS = 1 << 21
_CODE: list[np.ndarray] = []
_OUT = "doc_id bigint, item_id bigint, edits int, max_edits int"


def _codes(cp: np.ndarray) -> np.ndarray:
    if not _CODE:
        _CODE.append(C.mix(np.arange(0x110000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))
    return _CODE[0][cp]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all texts in one array, and the texts' offsets."""
    lower = [t.lower() for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[1:] = np.cumsum([len(t) for t in lower])
    cp = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    cp[(cp >= 9) & (cp <= 13) | (cp == 0xA0) | (cp == 0x2028) | (cp == 0x2029)] = 32
    return cp, offsets


def _rolling(cp: np.ndarray, q: int) -> np.ndarray:
    if len(cp) < q:
        return np.zeros(0, np.uint64)
    c = C.prefix_hash(_codes(cp))
    _, inv = C._powers(len(cp) - q + 1)
    x = (c[q:] - c[:-q]) * inv
    return x * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """q-grams of the items: a bit table to pass over most positions, exact postings for the others."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        kept = [(i, code_points([t])[0]) for i, t in items]
        kept = [(i, x) for i, x in kept if len(x) >= q]
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.codes = [x for _, x in kept]
        self.m = np.array([len(x) for x in self.codes], np.int64)
        self.e = np.minimum((self.m * rate).astype(np.int64), (self.m - q) // q)
        self.t = self.m - q + 1 - q * self.e
        grams = [_rolling(x, q) for x in self.codes]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def search(self, cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and edits of every occurrence within its item's edit budget, several for one pair at times."""
        none = (np.zeros(0, np.int64),) * 3
        x = _rolling(cp, self.q)
        if not len(x) or not len(self.ids):
            return none
        p = np.flatnonzero(self.bits[x >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.keys, x[p]), len(self.keys) - 1)
        true = self.keys[at] == x[p]
        p, at = p[true], at[true]
        row = np.searchsorted(offsets, p, "right") - 1
        true = p + self.q <= offsets[row + 1]
        p, at, row = p[true], at[true], row[true]
        # An occurrence puts t hits within m+e characters; hits in sparser places belong to none.
        t, span = int(self.t.min()), int((self.m + self.e).max())
        if len(p) < t:
            return none
        dense = np.flatnonzero(p[t - 1 :] - p[: len(p) - t + 1] <= span)
        edge = np.zeros(len(p) + 1, np.int64)
        np.add.at(edge, dense, 1)
        np.add.at(edge, dense + t, -1)
        true = np.cumsum(edge[:-1]) > 0
        p, at, row = p[true], at[true], row[true]
        n = self.first[at + 1] - self.first[at]
        if not n.sum():
            return none
        post = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item = self.item[post]
        diagonal = np.repeat(p, n) - self.pos[post]
        row = np.repeat(row, n)
        step = self.e[item] + 1
        band = diagonal // step
        row, item, band = np.tile(row, 2), np.tile(item, 2), np.concatenate((band, band - 1))
        order = np.lexsort((band, item, row))
        row, item, band = row[order], item[order], band[order]
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1]))))
        count = np.diff(np.append(new, len(row)))
        row, item, band = row[new], item[new], band[new]
        true = count >= self.t[item]
        row, item, band = row[true], item[true], band[true]
        edits = self.align(cp, offsets, row, item, band * (self.e[item] + 1))
        true = edits <= self.e[item]
        return row[true], item[true], edits[true]

    def align(self, cp: np.ndarray, offsets: np.ndarray, row: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Fewest edits of each item against its row on the diagonals start .. start+2(e+1); ends in the row are free."""
        out = np.full(len(row), 1 << 20, np.int64)
        if not len(row):
            return out
        m, e = self.m[item], self.e[item]
        width = 2 * (e + 1)
        rest = []
        for c in range(len(row)):
            lo, hi = max(int(offsets[row[c]]), int(start[c])), min(int(offsets[row[c] + 1]), int(start[c] + width[c] + m[c]))
            x = self.codes[item[c]]
            y = cp[lo:hi]
            n = len(y) - len(x) + 1
            if n > 0 and any(np.array_equal(x, y[d : d + len(x)]) for d in np.flatnonzero(y[:n] == x[0])):
                out[c] = 0
            else:
                rest.append(c)
        rest.sort(key=lambda c: (int(m[c]), int(width[c])))
        while rest:  # items of like length together, as many as CELLS holds; the longest stand alone
            n = 1
            while n < len(rest) and (n + 1) * int(m[rest[n]] + width[rest[n]]) <= CELLS:
                n += 1
            self._banded(cp, offsets, row, item, start, np.array(rest[:n]), out)
            rest = rest[n:]
        return out

    def _banded(self, cp: np.ndarray, offsets: np.ndarray, row: np.ndarray, item: np.ndarray, start: np.ndarray, k: np.ndarray, out: np.ndarray) -> None:
        """``align`` of the pairs ``k`` by one band each, a step for all of them."""
        m, width = self.m[item[k]], 2 * (self.e[item[k]] + 1)
        w, height = int(width.max()) + 1, int(m.max())
        xs = np.full((len(k), height), 1 << 30, np.int32)
        ys = np.full((len(k), height + w), -1, np.int32)
        for r, c in enumerate(k.tolist()):
            xs[r, : m[r]] = self.codes[item[c]]
            lo, hi = max(int(offsets[row[c]]), int(start[c])), min(int(offsets[row[c] + 1]), int(start[c] + width[r] + m[r]))
            ys[r, lo - start[c] : hi - start[c]] = cp[lo:hi]
        cols = np.arange(w)
        outside = cols[None, :] > width[:, None]
        d = np.where(outside, 1 << 20, 0)
        for i in range(height):
            new = d + (xs[:, i : i + 1] != ys[:, i : i + w])
            new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
            new = np.minimum.accumulate(new - cols, axis=1) + cols
            d = np.where(outside, 1 << 20, new)
            ends = m == i + 1
            if ends.any():
                out[k[ends]] = d[ends].min(axis=1)


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.05) -> DataFrame:
    """``doc_id, item_id, edits, max_edits`` of every document that holds a benchmark item.

    ``max_edits`` is ``rate`` of the item's length, less where the lemma would lose its force (t < 1).
    Null or empty texts and items, items of under ``q`` characters and null ids give no row; repeated
    rows give one, with the fewest edits. Columns besides the ids and ``text`` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null")
    C.small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-total // ITEM_CHARS) or 1
    found = None
    for part in range(passes):
        own = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == part)
        index = docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in own.collect()], q, rate))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in C.slices(batches):
                cp, offsets = code_points(pc.fill_null(b.column("text"), "").to_pylist())
                row, item, edits = ix.search(cp, offsets)
                if len(row):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(ix.ids[item]), pa.array(edits.astype(np.int32)), pa.array(ix.e[item].astype(np.int32))], ["doc_id", "item_id", "edits", "max_edits"])

        hits = docs.mapInArrow(run, _OUT)
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("max_edits").alias("max_edits"))
