"""Perplexity under a Brown class-based bigram model clustered by exchange.

p(w | v) = p(class(w) | class(v)) * p(w | class(w)), with a class and a count of its own for every word of the corpus.

Words of at least ``rate`` of all tokens (so never more than 1/rate of them) are exchanged on the driver. A round is one
pass over their bigram counts: it sums each unit's counts with the classes on either side, of which there are at most
1/rate + ENDINGS rows of 2 * classes + 2 numbers however large the corpus. With them the driver moves one unit after the other
to the class of the greatest gain in likelihood, and keeps the class bigrams up to date. Half the units have their turn in
a round, for a unit's row doesn't see the moves of the others; the assignment of the greatest likelihood, which every
round computes anew, is kept. Rounds go on until two of them together gain less than LEAST a token, ROUNDS at most. All other words
stand in these rounds by their ending.

Then each of the others moves to its own best class: the counts of every such word with the classes on either side meet
in one task, which takes the greatest gain. Their classes and counts are a table that is never collected; texts
are cut into slices that ask it for their distinct words. An ending's class remains for words that the corpus doesn't have.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

ENDINGS = 1024
MERGE = 24
#: Bits of a unit's number in a pair.
PAIR, _LOW = 32, (1 << 32) - 1
#: Rounds at most, half the units' turns each, and the gain in log-likelihood a token from two of them under which no more follow.
ROUNDS, LEAST = 16, 2e-3
SLICE = 4 << 20
#: Words whose gains are computed together.
TOGETHER = 4096
#: Pairs in a blob.
PACK = 1 << 17


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, ending and row of every word."""
    data, offsets = C.strings(pc.utf8_lower(pc.fill_null(b.column("text"), "")))
    start, end, row = C.words(data, offsets, C.WORD)
    c = C.prefix_hash(C.byte_codes(data))
    return C.span_hash(c, start, end), (C.span_hash(c, np.maximum(start, end - 3), end) % np.uint64(ENDINGS)).astype(np.int32), row


def _words_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_words`` of a large batch, hashed a small slice at a time."""
    parts, base = [_words(b.slice(0, 0))], 0
    for x in C.slices(iter([b])):
        h, ending, row = _words(x)
        parts.append((h, ending, row + base))
        base += x.num_rows
    h, ending, row = (np.concatenate(x) for x in zip(*parts))
    return h, ending, row


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)


def _counts(pieces: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with counts, merged over several pieces before they leave the task."""
    parts = []
    for keys in pieces:
        parts.append(np.unique(keys, return_counts=True))
        if len(parts) >= MERGE:
            yield _summed(parts)
            parts = []
    if parts:
        yield _summed(parts)


def _packed(pairs: DataFrame) -> DataFrame:
    """``blob``: the rows of ``pairs`` (``pair, n``) by the PACK in a row, each partition's in its own; the rounds read them some fifty times, and a row costs the JVM as much as its numbers cost numpy."""

    def run(batches):
        parts, rows = [], 0
        for b in batches:
            parts.append(np.stack([b.column(i).to_numpy() for i in range(2)]))
            rows += b.num_rows
            if rows >= PACK:
                yield _blob(parts)
                parts, rows = [], 0
        if rows:
            yield _blob(parts)

    return C.cut(pairs.mapInArrow(run, "blob binary"))


def _blob(parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts, axis=1).tobytes()], pa.binary())], ["blob"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts of every blob."""
    for b in batches:
        for blob in b.column("blob"):
            x = np.frombuffer(blob.as_buffer(), np.int64)
            yield x[: len(x) // 2], x[len(x) // 2 :]


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, n in _unpacked(batches):
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], ["pair", "n"])


class Units:
    """Numbers of units: frequent words by hash, then endings, then the start of a text."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.start = len(hashes) + ENDINGS
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = len(self.hashes) + ending.astype(np.int64)
        maybe = np.flatnonzero(self.some[h >> np.uint64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            true = self.hashes[at] == h[maybe]
            out[maybe[true]] = at[true]
        return out


def _with_previous(unit: np.ndarray, row: np.ndarray, start: int) -> np.ndarray:
    before = np.empty_like(unit)
    before[1:] = unit[:-1]
    if len(unit):
        before[np.concatenate(([True], row[1:] != row[:-1]))] = start
    return before


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def moves(counts: np.ndarray, right: np.ndarray, left: np.ndarray, own: int, loop: float) -> np.ndarray:
    """Gain in log-likelihood of moving a unit of class ``own`` to every class.

    ``counts`` are class bigrams (the last row is that of text starts), ``right`` and ``left`` the unit's counts
    with classes after and before it, ``loop`` its count with itself.
    """
    k = counts.shape[1]
    n = counts.copy()
    r, s = right.astype(float).copy(), left.astype(float).copy()
    r[own] -= loop
    s[own] -= loop
    n[own] -= r
    n[:, own] -= s
    n[own, own] -= loop
    rows, cols = n.sum(1) + s, n.sum(0) + r  # the unit's neighbours count it wherever it is
    q, old = n[:k], _xlogx(n)
    inside = _xlogx(q + r) - old[:k]  # as row b, by column
    gain = inside.sum(1) - np.diag(inside)
    outside = _xlogx(n + s[:, None]) - old  # as column b, by row
    gain += outside.sum(0) - np.diag(outside[:k])
    d = np.diag(q)
    gain += _xlogx(d + r + s[:k] + loop) - _xlogx(d)
    gain -= _xlogx(rows[:k] + r.sum() + loop) - _xlogx(rows[:k]) + _xlogx(cols + s.sum() + loop) - _xlogx(cols)
    return gain - gain[own]


def moves_of(counts: np.ndarray, own: np.ndarray, word: np.ndarray, column: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``moves`` of many units that each move alone: a row for every entry of ``own``. Columns are those of ``exchange``."""
    k, i = counts.shape[1], np.arange(len(own))
    dense = np.zeros((len(own), 2 * k + 2))
    dense[word, column] = n
    r, s, loop = dense[:, :k], dense[:, k : 2 * k + 1], dense[:, -1]
    r[i, own] -= loop
    s[i, own] -= loop
    gain = np.zeros((len(own), k))
    for mine, other, table in ((r, s, counts[:k].T), (s, r, counts)):
        w, c = np.nonzero(mine)
        if not len(w):
            continue
        e, x = np.arange(len(w)), mine[w, c]
        have = table[c].astype(float)  # of the class beside it with every class, without the unit
        have[e, own[w]] -= x
        at = np.flatnonzero(c == own[w])
        have[at] -= other[w[at], :k]
        have[at, own[w[at]]] -= loop[w[at]]
        more = _xlogx(have + x[:, None]) - _xlogx(have)
        inside = np.flatnonzero(c < k)
        more[inside, c[inside]] = 0
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        gain[w[first]] += np.add.reduceat(more, first)
    d, rows, cols = (np.tile(x, (len(own), 1)).astype(float) for x in (np.diag(counts[:k]), counts.sum(1)[:k], counts.sum(0)))
    right, left = r.sum(1) + loop, s.sum(1) + loop
    d[i, own] -= r[i, own] + s[i, own] + loop
    rows[i, own] -= right
    cols[i, own] -= left
    gain += _xlogx(d + r + s[:, :k] + loop[:, None]) - _xlogx(d)
    gain -= _xlogx(rows + right[:, None]) - _xlogx(rows) + _xlogx(cols + left[:, None]) - _xlogx(cols)
    return gain - gain[i, own][:, None]


def likelihood(counts: np.ndarray) -> float:
    """Log-likelihood of class bigrams, up to what the classes don't change."""
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(0)).sum() - _xlogx(counts.sum(1)).sum())


def exchange(counts: np.ndarray, cls: np.ndarray, unit: np.ndarray, column: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes after one turn of the units in ``unit`` (ascending), whose counts by ``column`` are ``n``.

    Columns: k classes after the unit, k + 1 before it, the unit itself.
    """
    k = counts.shape[1]
    counts, cls = counts.copy(), cls.copy()
    first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))) if len(unit) else np.zeros(0, int)
    for lo, hi in zip(first, np.append(first[1:], len(unit))):
        row = np.zeros(2 * k + 2)
        row[column[lo:hi]] = n[lo:hi]
        right, left, loop = row[:k].copy(), row[k : 2 * k + 1].copy(), row[-1]
        a = int(cls[unit[lo]])
        gain = moves(counts, right, left, a, loop)
        b = int(gain.argmax())
        if gain[b] <= 1e-6:
            continue
        cls[unit[lo]] = b
        right[a] -= loop
        left[a] -= loop
        for c, sign in ((a, -1), (b, 1)):
            counts[c] += sign * right
            counts[:, c] += sign * left
            counts[c, c] += sign * loop
        np.maximum(counts, 0, out=counts)
    return cls


class Model:
    def __init__(self, units: Units, cls: np.ndarray, counts: np.ndarray, n: np.ndarray, tail: DataFrame | None = None):
        """``n`` tokens of every unit; ``tail`` has ``h, cls, n`` of the words that are no units."""
        self.units, self.cls, self.tail = units, cls, tail
        k, own = counts.shape[1], len(units.hashes)
        self.follow(counts)
        # An ending stands for what the corpus doesn't have.
        size = np.bincount(cls[:-1], minlength=k)
        n = np.concatenate((n[:own], np.zeros(ENDINGS)))
        total = np.bincount(cls[:-1], n, minlength=k)
        for r in tail.groupBy("cls").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect() if tail is not None else ():
            size[r["cls"]] += r["kinds"]
            total[r["cls"]] += r["n"]
        self.norm = np.log(np.maximum(total + 0.5 * size, 0.5))
        self.emit = np.log(n + 0.5) - self.norm[cls[:-1]]

    def follow(self, counts: np.ndarray) -> None:
        """Take the steps between classes from their bigrams."""
        k = counts.shape[1]
        rows = counts.sum(1, keepdims=True)
        base = (counts.sum(0) + 1) / (counts.sum() + k)
        seen = (counts > 0).sum(1, keepdims=True)
        # Witten-Bell: the unseen share of a history goes to the classes' own frequencies.
        self.step = np.log((counts + (seen + 1) * base) / (rows + seen + 1))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tail": None}  # a table stays with the driver

    def score(self, h: np.ndarray, ending: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        unit = self.units.of(h, ending)
        p = self.step[self.cls[_with_previous(unit, row, self.units.start)], self.cls[unit]] + self.emit[unit]
        return np.bincount(row, p, minlength=rows).astype(float)  # without words numpy gives integers


def _squeezed(x: tuple) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x))


class _Slice:
    """Some texts as the units of their words; words that are no units are numbered by the slice's own list."""

    def __init__(self, blob: bytes, units: Units):
        self.ids, self.sizes, unit, self.ending = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.unit, self.others = unit.astype(np.int64), len(units.hashes)
        self.at = np.flatnonzero(self.unit >= self.others)
        self.word = self.unit[self.at] - self.others

    def classes(self, cls: np.ndarray, found: pa.Table | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of every token, class before it, and the counts of the slice's own words, 0 where none is ``found``."""
        own, n = cls[self.others + self.ending], np.zeros(len(self.ending))
        if found is not None and found.num_rows:
            i = found["i"].to_numpy()
            own[i], n[i] = found["cls"].to_numpy(), found["n"].to_numpy()
        c = np.concatenate((cls[: self.others], own))[self.unit]
        return c, _with_previous(c, self.row, cls[-1]), n


def _sliced(docs: DataFrame, units: Units) -> DataFrame:
    """``key, rare, blob``: slices of ``docs`` (``doc_id, text``) with the distinct words that are no units."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        u = shared.value
        for b in C.slices(batches, size=SLICE):
            h, ending, row = _words_of(b)
            unit = u.of(h, ending)
            at = np.flatnonzero(unit >= len(u.hashes))
            key, first, inverse = np.unique(h[at], return_index=True, return_inverse=True)
            unit[at] = len(u.hashes) + inverse
            blob = _squeezed((b.column("doc_id"), np.bincount(row, minlength=b.num_rows), unit.astype(np.int32), ending[at][first]))
            rare = pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), rare, pa.array([blob], pa.binary())], ["key", "rare", "blob"])

    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return C.written(docs.mapInArrow(run, "key string, rare array<bigint>, blob binary"))


def _answered(slices: DataFrame, tail: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the blob of every slice and what ``tail`` has of its words: ``i, cls, n``."""
    found = slices.select(F.col("key").alias("of"), F.posexplode("rare").alias("i", "h")).join(tail, "h").select("of", "i", "cls", "n")

    def each(mine, answers):
        return run(mine["blob"][0].as_py(), answers)

    return slices.select("key", "blob").groupBy("key").cogroup(found.groupBy("of")).applyInArrow(each, schema)


def _settled(slices: DataFrame, units: Units, cls: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``h, own, cls, n`` of every word that is no unit: the class of its ending, its own best class, its count."""
    k = counts.shape[1]
    wide = 2 * k + 2
    shared = slices.sparkSession.sparkContext.broadcast((units, cls, counts))

    def around(batches):
        u, g, _ = shared.value
        for b in batches:
            for rare, blob in zip(b.column("rare"), b.column("blob")):
                s = _Slice(blob.as_py(), u)
                c, before, _ = s.classes(g)
                fresh = np.ones(len(s.row) + 1, bool)
                fresh[1:-1] = s.row[1:] != s.row[:-1]
                inner = ~fresh[s.at + 1]  # with a word after it
                nxt = s.at[inner] + 1
                same = s.unit[nxt] == s.unit[s.at[inner]]
                w = s.word[inner]
                key, n = np.unique(np.concatenate((s.word * wide + k + before[s.at], w * wide + c[nxt], w[same] * wide + 2 * k + 1)), return_counts=True)
                h, word = rare.values.to_numpy(), key // wide
                yield pa.RecordBatch.from_arrays([pa.array(h[word]), pa.array(g[s.others + s.ending[word]] * wide + key % wide), pa.array(n)], ["h", "code", "n"])

    def settle(batches):
        table, left = shared.value[2], None
        for b in batches:
            x = [b.column(i).to_numpy() for i in range(3)]
            x = x if left is None else [np.concatenate(p) for p in zip(left, x)]
            end = int(np.searchsorted(x[0], x[0][-1])) if len(x[0]) else 0  # the last word may go on
            left = [p[end:] for p in x]
            yield from best(table, *(p[:end] for p in x))
        if left is not None:
            yield from best(table, *left)

    def best(table, h, code, n):
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
        for lo in range(0, len(first), TOGETHER):
            some = first[lo : lo + TOGETHER]
            end = first[lo + TOGETHER] if lo + TOGETHER < len(first) else len(h)
            word = np.repeat(np.arange(len(some)), np.diff(np.append(some, end)))
            column, m, own = code[some[0] : end] % wide, n[some[0] : end], code[some] // wide
            gain = moves_of(table, own, word, column, m)
            to = gain.argmax(1)
            to = np.where(gain[np.arange(len(some)), to] > 1e-6, to, own)
            total = np.bincount(word, m * ((column >= k) & (column <= 2 * k)), minlength=len(some)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(own.astype(np.int32)), pa.array(to.astype(np.int32)), pa.array(total)], ["h", "own", "cls", "n"])

    rows = slices.mapInArrow(around, "h bigint, code bigint, n bigint").repartition("h").groupBy("h", "code").agg(F.sum("n").alias("n"))
    return C.cut(rows.sortWithinPartitions("h").mapInArrow(settle, "h bigint, own int, cls int, n bigint"))


SCORES = "doc_id bigint, n_words bigint, log_prob double, perplexity double"


def _score_rows(ids: pa.Array, n: np.ndarray, p: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    ppl = pa.array(np.exp(np.minimum(-p / np.maximum(n, 1), 700)), mask=n == 0)
    return [ids, pa.array(n, pa.int64()), pa.array(p, pa.float64()), ppl], ["doc_id", "n_words", "log_prob", "perplexity"]


def _located(slices: DataFrame, model: Model) -> DataFrame:
    """``blob``: ids of the texts of a slice, their numbers of words, the class of every word, and the texts' sums of log p(w | class)."""
    shared = slices.sparkSession.sparkContext.broadcast(model)

    def locate(blob, found):
        m = shared.value
        s = _Slice(blob, m.units)
        c, _, n = s.classes(m.cls, found)
        emit = m.emit[s.others + s.ending]
        own = np.zeros(len(n), np.int64)
        own[s.word] = c[s.at]
        seen = np.flatnonzero(n)
        emit[seen] = np.log(n[seen] + 0.5) - m.norm[own[seen]]
        p = np.bincount(s.row, np.concatenate((m.emit[: s.others], emit))[s.unit], minlength=len(s.sizes)).astype(float)
        return pa.table([pa.array([_squeezed((s.ids, s.sizes, c.astype(np.uint16), p))], pa.binary())], ["blob"])

    return _answered(slices, model.tail, locate, "blob binary")


def _steps(blob: bytes, start: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, sizes, c, p = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    c, row = c.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    return ids, sizes, row, c, _with_previous(c, row, start), p


def _walked(located: DataFrame, model: Model) -> DataFrame:
    """Scores from the classes that ``_located`` found."""
    step = located.sparkSession.sparkContext.broadcast(model.step)

    def run(batches):
        for b in batches:
            for blob in b.column("blob"):
                ids, sizes, row, c, before, p = _steps(blob.as_py(), len(step.value) - 1)
                p = p + np.bincount(row, step.value[before, c], minlength=len(sizes))
                yield pa.RecordBatch.from_arrays(*_score_rows(ids, sizes, p))

    return located.mapInArrow(run, SCORES)


def _fitted(docs: DataFrame, classes: int, rounds: int, rate: float) -> tuple[Model, DataFrame | None]:
    """The model, and the classes of the words of ``docs`` (``doc_id, text``) if some of them are no units."""
    spark, k = docs.sparkSession, classes
    C.small_batches(spark)
    units, cls, counts, n, whole = _exchanged(docs.select("text").where("text is not null"), classes, rounds, rate)
    C.swept(spark)
    if whole:
        return Model(units, cls, counts, n), None
    slices = _sliced(docs, units)
    settled = _settled(slices, units, cls, counts)
    C.swept(spark)

    def class_pairs(batches):
        total = np.zeros((k + 1) * k, np.int64)
        for b in batches:
            for blob in b.column("blob"):
                _, _, _, c, before, _ = _steps(blob.as_py(), k)
                total += np.bincount(before * k + c, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["u", "n"])

    for column in ("cls", "own"):
        model = Model(units, cls, counts, n, settled.select("h", F.col(column).alias("cls"), "n"))
        located = C.written(_located(slices, model))
        C.swept(spark)
        got = located.mapInArrow(class_pairs, "u bigint, n bigint").groupBy("u").agg(F.sum("n").alias("n")).toArrow()
        moved = np.zeros((k + 1) * k)
        moved[got["u"].to_numpy()] = got["n"].to_numpy()
        moved = moved.reshape(k + 1, k)
        if likelihood(moved) > likelihood(counts):  # else they lost by moving all at once, each as if alone
            break
    model.follow(moved)
    return model, located


def train(docs: DataFrame, classes: int = 48, rounds: int = ROUNDS, rate: float = 1e-5) -> Model:
    """The model of all texts of ``docs``. Words under ``rate`` are settled after the rounds. Of classes of equal gain the first is taken, a move without gain isn't. Null and wordless texts add nothing; repeated rows count as often as they stand."""
    return _fitted(docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("text").cast("string")), classes, rounds, rate)[0]


def perplexities(docs: DataFrame, classes: int = 48, rounds: int = ROUNDS, rate: float = 1e-5) -> DataFrame:
    """``scored`` of ``docs`` by the model of their own texts, whose words are looked up only once."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    model, located = _fitted(docs, classes, rounds, rate)
    return scored(docs, model) if located is None else _walked(located, model)


def _exchanged(texts: DataFrame, classes: int, rounds: int, rate: float) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Units, their classes, class bigrams, the units' tokens, and whether all words are units."""
    spark = texts.sparkSession

    def count_words(batches):
        parts = []
        for b in C.slices(batches):
            parts.append(np.unique(_words(b)[0], return_counts=True))
            if len(parts) >= MERGE:
                yield _word_rows(parts)
                parts = []
        if parts:
            yield _word_rows(parts)

    words = C.cut(texts.mapInArrow(count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    tokens = words.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= F.lit(rate * tokens)
    frequent = words.where(often).select("h").toArrow()
    units = Units(np.asarray(frequent["h"].combine_chunks() if frequent.num_rows else pa.array([], pa.int64())).view(np.uint64))
    whole = words.where(~often).limit(1).count() == 0
    shared = spark.sparkContext.broadcast(units)

    def count_pairs(batches):
        def pieces():
            for b in C.slices(batches):
                h, ending, row = _words(b)
                unit = shared.value.of(h, ending)
                yield _with_previous(unit, row, shared.value.start) << PAIR | unit

        for key, n in _counts(pieces()):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

    # Of distinct pairs a unit has at most as many as there are units, so either end can have its own in one task, and rounds send nothing.
    pairs = texts.mapInArrow(count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    first = _packed(pairs.repartition(F.shiftright("pair", PAIR)))
    second = _packed(first.mapInArrow(_pair_rows, "pair bigint, n bigint").repartition(F.col("pair").bitwiseAND(_LOW)))
    size = units.start + 1

    def count_units(batches):
        total = np.zeros(size, np.int64)
        for p, m in _unpacked(batches):
            total += np.bincount(p & _LOW, m, minlength=size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["u", "n"])

    n = np.zeros(size, np.int64)
    got = first.mapInArrow(count_units, "u bigint, n bigint").groupBy("u").agg(F.sum("n").alias("n")).toArrow()
    n[got["u"].to_numpy()] = got["n"].to_numpy()

    k = classes
    cls = np.full(size, k, np.int64)  # the start of a text keeps the last class to itself
    cls[np.argsort(-n[:-1], kind="stable")] = np.arange(size - 1) % k
    counts, best, reached = np.zeros((k + 1, k)), (-np.inf, cls, np.zeros((k + 1, k))), []
    for turn in range(rounds + 1):
        g = spark.sparkContext.broadcast(cls)

        def class_pairs(batches, g=g):
            total = np.zeros((k + 1) * k)
            c = g.value
            for p, m in _unpacked(batches):
                total += np.bincount(c[p >> PAIR] * k + c[p & _LOW], m, minlength=len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0].astype(np.int64))], ["u", "n"])

        got = first.mapInArrow(class_pairs, "u bigint, n bigint").groupBy("u").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((k + 1) * k)
        counts[got["u"].to_numpy()] = got["n"].to_numpy()
        counts = counts.reshape(k + 1, k)
        reached.append(likelihood(counts))
        best = max(best, (reached[-1], cls, counts), key=lambda x: x[0])
        if turn == rounds or turn > 2 and turn % 2 == 0 and reached[-1] - reached[-3] < LEAST * tokens:
            break
        wide = 2 * k + 2

        def around(batches, g=g, turn=turn, after=True):
            """Per unit whose turn it is: counts with the class after and itself, or with the class before."""
            c = g.value
            parts = []
            for p, m in _unpacked(batches):
                v, u = p >> PAIR, p & _LOW
                for unit, other, w in ((v, c[u], m), (u[u == v], np.full((u == v).sum(), 2 * k + 1), m[u == v])) if after else ((u, k + c[v], m),):
                    mine = (unit % 2 == turn % 2) & (unit != size - 1)
                    parts.append((unit[mine] * wide + other[mine], w[mine]))
                if sum(len(x) for x, _ in parts) > 2_000_000:
                    parts = [_summed(parts)]
            if parts:
                key, m = _summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array(key // wide), pa.array(key % wide), pa.array(m)], ["u", "k", "n"])

        got = pa.concat_tables(rows.mapInArrow(lambda b, f=around, end=end: f(b, after=end), "u bigint, k bigint, n bigint").toArrow() for rows, end in ((first, True), (second, False)))
        got = got.sort_by([("u", "ascending"), ("k", "ascending")])
        cls = exchange(counts, cls, *(got[c].to_numpy() for c in "ukn"))
    _, cls, counts = best
    return units, cls, counts, n, whole


def _word_rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    key, n = _summed(parts)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["h", "n"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_words, log_prob, perplexity`` of every row.

    Words are lower-cased runs of letters and digits. A text without words, empty or null, has 0 words, log_prob 0
    and a null perplexity. Rows stay as many as they are, null and repeated ids included. Columns besides
    ``doc_id`` and ``text`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if model.tail is not None:
        return _walked(_located(_sliced(docs, model.units), model), model)

    def run(batches):
        for b in C.slices(batches):
            h, ending, row = _words(b)
            p = shared.value.score(h, ending, row, b.num_rows)
            n = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(*_score_rows(b.column("doc_id"), n, p))

    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(run, SCORES)
