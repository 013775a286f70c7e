"""Toxicity by a classifier chain of linear models over hashed words and word beginnings.

Categories are predicted one after the other. The model of a later category also gets the probabilities of the
earlier ones, and is trained on out-of-fold predictions of them, so it sees them as unsure as they will
be on new texts. The tables label documents as toxic or not and name no kinds of it; the kinds come from the documents:
spherical k-means over the features that tell toxic documents from others parts the toxic ones into ``GROUPS``
groups, the earlier categories of the chain. Toxic at all is the last one.

A text's value for a feature is its count per 100 words (of the words plus ``PAD``, which keeps short texts sober).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

GROUPS = 2
CATEGORIES = (*(f"group_{i + 1}" for i in range(GROUPS)), "toxic")
BITS = 20
STARTS = (4, 5, 6, 7, 8, 9)
PAD = 20
#: Documents that a feature needs to tell anything.
LEAST_DOCS = 4
FOLDS = 3
#: Entries of a sparse table that are multiplied together.
PIECE = 1 << 18


def _features(texts: pa.Array) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Feature numbers with their rows, piece by piece, and the number of words of each row."""
    data, offsets = C.strings(pc.utf8_lower(pc.fill_null(texts, "")))
    start, end, row = C.words(data, offsets, C.WORD)
    c = C.prefix_hash(C.byte_codes(data))
    shift = np.uint64(64 - BITS)

    def parts():
        yield (C.span_hash(c, start, end) >> shift).astype(np.int64), row
        for n in STARTS:
            long = np.flatnonzero(end - start > n)
            s = start[long]
            yield (C.mix(C.span_hash(c, s, s + n) + C._ODD[n]) >> shift).astype(np.int64), row[long]

    return parts(), np.bincount(row, minlength=len(offsets) - 1)


@dataclass
class Link:
    """One model of the chain: a weight for every feature, one for each earlier category's probability, a bias."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    links: list[Link]
    threshold: float

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Probabilities, a row for each category."""
        parts, n = _features(texts)
        some = np.zeros(1 << BITS, bool)
        for x in self.links:
            some |= x.weights != 0
        sums = np.zeros((len(self.links), len(n)))
        for f, row in parts:
            hit = np.flatnonzero(some[f])
            for k, x in enumerate(self.links):
                sums[k] += np.bincount(row[hit], x.weights[f[hit]], minlength=len(n))
        p = np.zeros_like(sums)
        for k, x in enumerate(self.links):
            p[k] = _sigmoid(100 * sums[k] / (n + PAD) + x.bias + x.earlier @ p[:k])
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Sparse:
    """Rows of (feature, value) pairs with dense extra columns; what logistic regression needs of them."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, rows: int, cols: int):
        self.row, self.col, self.val, self.rows, self.cols = row, col, val, rows, cols

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._summed(self.row, self.col, w.astype(np.float32), self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._summed(self.col, self.row, g.astype(np.float32), self.cols)

    def _summed(self, to: np.ndarray, of: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for i in range(0, len(to), PIECE):  # bincount copies what it gets, in 8 bytes a number
            j = slice(i, i + PIECE)
            out += np.bincount(to[j], self.val[j] * x[of[j]], minlength=size)
        return out


def _fit(x: _Sparse, extra: np.ndarray, y: np.ndarray, keep: np.ndarray, steps: int = 60, l2: float = 2e-4, memory: int = 10) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by L-BFGS over the rows of ``keep``; a constant where they are of one class."""
    size, positive = int(keep.sum()), float(y[keep].sum())
    rate = (positive + 0.5) / (size + 1)
    n, m = x.cols, extra.shape[1]
    p = np.zeros(n + m + 1)
    p[-1] = np.log(rate / (1 - rate))
    if not 0 < positive < size:
        return p[:n], p[n:-1], -30.0 if not positive else 30.0

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(p[:n]) + extra @ p[n:-1] + p[-1]
        g = keep * (_sigmoid(z) - y) / size
        d = np.concatenate((x.back(g), extra.T @ g, [g.sum()]))
        d[:-1] += l2 * p[:-1]
        return float((keep * (np.logaddexp(0, z) - y * z)).sum()) / size + l2 / 2 * float(p[:-1] @ p[:-1]), d

    now, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for s, t, r in reversed(past):
            used.append(r * float(s @ q))
            q -= used[-1] * t
        if past:
            s, t, r = past[-1]
            q /= r * float(t @ t)
        for (s, t, r), a in zip(past, reversed(used)):
            q += s * (a - r * float(t @ q))
        step, slope = 1.0 if past else min(1.0, 1 / np.abs(g).sum()), float(g @ q)
        while True:
            then, h = loss(p - step * q)
            if then <= now - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, t = -step * q, h - g
        if s @ t > 1e-12:
            past = [*past, (s, t, 1 / float(s @ t))][-memory:]
        gained, p, now, g = now - then, p + s, then, h
        if gained < 1e-6 * max(1, abs(now)):
            break
    return p[:n], p[n:-1], float(p[-1])


def _telling(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, z: float = 2.5) -> np.ndarray:
    """Features, by documents of either side that have them, whose shares of the two sides differ clearly."""
    pos, neg, a, b = pos + 0.5, neg + 0.5, n_pos + 1, n_neg + 1
    score = np.log(pos / (a - pos + 0.5).clip(0.5)) - np.log(neg / (b - neg + 0.5).clip(0.5))
    score /= np.sqrt(1 / pos + 1 / neg)
    return (np.abs(score) > z) & (pos + neg >= LEAST_DOCS + 1)


def _select(row: np.ndarray, col: np.ndarray, y: np.ndarray) -> np.ndarray:
    pos, neg = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for i in range(0, len(col), 4 * PIECE):
        c, yes = col[i : i + 4 * PIECE], y[row[i : i + 4 * PIECE]] > 0
        pos += np.bincount(c[yes], minlength=1 << BITS)
        neg += np.bincount(c[~yes], minlength=1 << BITS)
    some = np.flatnonzero(pos + neg)  # the others tell nothing, and there are many
    return some[_telling(pos[some], neg[some], int(y.sum()), int((y == 0).sum()))]


def groups_of(features: list[np.ndarray], toxic: np.ndarray, groups: int = GROUPS, rounds: int = 20) -> np.ndarray:
    """The group of every document, -1 for those that aren't toxic, from each document's distinct features.

    Spherical k-means over the features that toxic documents have more often than others. It begins with the toxic document that
    has most of them, then always the one least like those chosen; documents without any are of group 0. Ties go to the first.
    """
    out = np.where(toxic > 0, 0, -1)
    mine = np.flatnonzero(toxic)
    pos, neg = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for f, t in zip(features, toxic):
        (pos if t else neg)[f] += 1
    some = np.flatnonzero(pos + neg >= LEAST_DOCS)
    a, b = pos[some], neg[some]
    own = some[_telling(a, b, len(mine), len(toxic) - len(mine)) & (a.astype(float) * max(1, len(toxic) - len(mine)) > b.astype(float) * max(1, len(mine)))]
    tells = np.zeros(1 << BITS, bool)
    tells[own] = True
    place = np.full(1 << BITS, -1, np.int32)
    place[own] = np.arange(len(own))
    lists = [place[features[i]][tells[features[i]]] for i in mine]
    size = np.array([len(x) for x in lists], int)
    if not size.sum():
        return out
    row, col = np.repeat(np.arange(len(mine)), size), np.concatenate(lists)
    value = 1 / np.sqrt(pos[own[col]])  # a feature of few documents says more
    value /= np.sqrt(np.bincount(row, value**2, minlength=len(mine)))[row]
    x = _Sparse(row, col, value, len(mine), len(own))
    one = lambda i: x.back((np.arange(len(mine)) == i).astype(float))
    centres = [one(int(size.argmax()))]
    while len(centres) < groups:
        near = np.max([x.times(c) for c in centres], axis=0)
        centres.append(one(int(np.where(size > 0, near, np.inf).argmin())))
    group = np.zeros(len(mine), int)
    for _ in range(rounds):
        before, group = group, np.argmax([x.times(c) for c in centres], axis=0)
        for k in range(groups):
            c = x.back((group == k).astype(float))
            if c.any():
                centres[k] = c / np.sqrt(float(c @ c))
        if np.array_equal(before, group):
            break
    out[mine] = group
    return out


def _needed(features: list[np.ndarray], labels: np.ndarray, folds: int) -> np.ndarray:
    """The features that any of the chain's models, over all rows or all but one fold, will select; all others can go beforehand."""
    out = np.zeros(1 << BITS, bool)
    fold = np.arange(len(features)) % folds
    whole = np.zeros((folds, 1 << BITS), np.int32)
    for i, f in enumerate(features):
        whole[fold[i], f] += 1
    some = np.flatnonzero(whole.sum(0, dtype=np.int32) >= LEAST_DOCS)
    whole = whole[:, some]
    for y in labels:
        pos = np.zeros((folds, 1 << BITS), np.int32)
        for i in np.flatnonzero(y):
            pos[fold[i], features[i]] += 1
        pos = pos[:, some]
        for k in range(-1, folds):
            on = [j for j in range(folds) if j != k]
            p, n = pos[on].sum(0), int(y[fold != k].sum())
            out[some[_telling(p, whole[on].sum(0) - p, n, int((fold != k).sum()) - n)]] = True
    return out


def fit_chain(row: np.ndarray, col: np.ndarray, count: np.ndarray, n_words: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> Chain:
    """A chain from counts of features by document; ``labels`` has a row for each category."""
    rows = len(n_words)
    value = (100 * count / (n_words[row] + PAD)).astype(np.float32)
    fold = np.arange(rows) % folds
    links: list[Link] = []
    odds, earlier = np.zeros(rows), np.zeros((0, rows))
    for y in labels.astype(float):

        def model(keep: np.ndarray):
            mine = keep[row]
            chosen = _select((np.cumsum(keep) - 1).astype(np.int32)[row[mine]], col[mine], y[keep])
            place = np.full(1 << BITS, -1, np.int32)
            place[chosen] = np.arange(len(chosen))
            hit = place[col] >= 0
            x = _Sparse(row[hit], place[col[hit]], value[hit], rows, len(chosen))
            return x, chosen, _fit(x, earlier.T, y, keep)

        odds = np.zeros(rows)
        for k in range(folds):
            if (fold != k).any():
                x, _, (w, e, b) = model(fold != k)
                odds[fold == k] = (x.times(w) + earlier.T @ e + b)[fold == k]
        _, chosen, (w, e, b) = model(np.ones(rows, bool))
        whole = np.zeros(1 << BITS, np.float32)
        whole[chosen] = w
        links.append(Link(whole, e, b))
        earlier = np.vstack((earlier, _sigmoid(odds)))
    return Chain(links, _threshold(odds, labels[-1]))


def _threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """The probability at which out-of-fold predictions reach the best F1, 0.5 where that says nothing."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    cut = odds[order[k]] if k + 1 == len(y) else (odds[order[k]] + odds[order[k + 1]]) / 2
    return float(_sigmoid(np.array(cut)))


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, negatives: int = 5000) -> Chain:
    """A chain from at most ``positives`` + ``negatives`` labelled documents, those of the smallest id hashes.

    A document labelled more than once is toxic if any label says so; null labels, null ids and labels of
    unknown documents are not used. Without examples of both classes a category's probability is next to 0 or 1.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    C.small_batches(docs.sparkSession)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic > 0").orderBy(*order).limit(positives).unionByName(known.where("toxic <= 0").orderBy(*order).limit(negatives))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in C.slices(batches):
            parts, n = _features(b.column("text"))
            parts = list(parts)
            f, row = (np.concatenate(x) for x in zip(*parts))
            key, count = np.unique(row << BITS | f, return_counts=True)
            at = np.searchsorted(key >> BITS, np.arange(b.num_rows + 1))
            f = (key & ((1 << BITS) - 1)).astype(np.int32)
            count = count.astype(np.int32)
            pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(n), pack(f), pack(count)], ["doc_id", "toxic", "n", "f", "c"])

    kept = texts.mapInArrow(run, "doc_id bigint, toxic int, n bigint, f binary, c binary").toArrow()
    order = pc.sort_indices(kept, [("doc_id", "ascending"), ("n", "ascending")]).to_numpy()  # the table itself isn't copied
    toxic, n = (np.array(kept[c].to_pylist(), float)[order] for c in ("toxic", "n"))
    toxic = toxic.astype(int).clip(0, 1)
    f, count = ([np.frombuffer(kept[c][i].as_buffer(), np.int32) for i in order.tolist()] for c in "fc")
    group = groups_of(f, toxic)
    y = np.array([*((group == k).astype(int) for k in range(GROUPS)), toxic])
    needed = _needed(f, y, FOLDS)
    hit = [needed[x] for x in f]
    row = np.repeat(np.arange(len(f), dtype=np.int32), [int(h.sum()) for h in hit])
    join = lambda xs: np.concatenate([x[h] for x, h in zip(xs, hit)]) if xs else np.zeros(0, np.int32)
    col, count = join(f), join(count)
    del f, hit, kept
    C.give_back()
    chain = fit_chain(row, col, count, n, y)
    C.give_back()
    return chain


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id, p_group_1, p_group_2, p_toxic, is_toxic`` of every row.

    Null and empty texts are not toxic, with the probabilities of a text without a known feature. Rows stay as many as they
    are, null and repeated ids included. Columns besides ``doc_id`` and ``text`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        m = shared.value
        for b in C.slices(batches):
            text = b.column("text")
            p = m.predict(text)
            some = pc.fill_null(pc.greater(pc.utf8_length(text), 0), False)
            yes = pc.and_(pa.array(p[-1] >= m.threshold), some)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in p), yes], ["doc_id", *(f"p_{k}" for k in CATEGORIES), "is_toxic"])

    columns = ", ".join(f"p_{k} double" for k in CATEGORIES)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, f"doc_id bigint, {columns}, is_toxic boolean")


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without the rows that ``chain`` finds toxic; every column as it was."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in C.slices(batches):
            text = b.column(at).cast(pa.string())
            some = pc.fill_null(pc.greater(pc.utf8_length(text), 0), False)
            yield b.filter(pc.invert(pc.and_(pa.array(m.predict(text)[-1] >= m.threshold), some)))

    return docs.mapInArrow(run, docs.schema)
