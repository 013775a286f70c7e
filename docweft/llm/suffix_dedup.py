"""Repeated passages by a distributed merge sort of word suffixes.

Every window of ``words`` words picks one of its positions, the start of its smallest hashed ``gram`` words
(winnowing); equal windows pick the same place, so sorting the suffixes that start there finds every
repeated window. The suffix of a place reaches to the end of the last window that picked it, and the words
before the place, back to the first such window, travel with it.

Tasks sort their suffixes in runs. Entries of a run that are equal, words before the place included, and of several documents are settled
there: all their windows repeat, and one entry that names two of the documents goes on for all, so a passage that a third of
all documents share sends one entry a run. The runs are cut at common splitters, which are whole groups of ``gram`` words, and the pieces
exchanged front-coded: each suffix is the length of the prefix it shares with its predecessor, and the rest. A loser tree
merges the pieces of a range. Every contender knows how much of the last winner it shares; the longer
share wins at once, and equal shares compare from there on, so no known prefix is compared again. In merged
order, suffixes that share ``gram`` words are neighbours, and their windows are compared whole.
"""

from __future__ import annotations

import re
import struct
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

RUN_BYTES = 6 << 20
SAMPLE_DOCS = 4000
#: Bytes of suffixes that a range of the merge is to hold.
RANGE_BYTES = 64 << 20
Entry = tuple[bytes, bytes, int, int, int]
_HEAD = struct.Struct("<qqqqqq")


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of white space becomes one blank, none at the start of a row."""
    n = len(data)
    blank = C.SPACE[data]
    drop = np.zeros(n, bool)
    drop[1:] = blank[1:] & blank[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    drop[first] = blank[first]
    lead = first[blank[first]]
    for p in lead.tolist():  # blanks that go on from a row's start are dropped by the rule above
        drop[p] = True
    keep = ~drop
    at = np.concatenate(([0], np.cumsum(keep)))
    return np.where(blank, np.uint8(32), data)[keep], at[offsets]


def places(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions picked by windows, with the first and the last window that picked each."""
    none = (np.zeros(0, np.int64),) * 3
    if len(start) < words:
        return none
    g = C.ngram(C.word_hashes(data, start, end), gram)
    low = np.uint64((1 << 24) - 1)
    key = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    width = words - gram + 1
    m, have = key, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    window = np.flatnonzero(row[: len(start) - words + 1] == row[words - 1 :])
    if not len(window):
        return none
    base = window & ~np.int64(low)
    pick = (m[window] & low).astype(np.int64) | base
    pick = np.where(pick < window, pick + (1 << 24), pick)
    new = np.flatnonzero(np.concatenate(([True], (pick[1:] != pick[:-1]) | (row[window[1:]] != row[window[:-1]]))))
    last = np.append(new[1:], len(window)) - 1
    return pick[new], window[new], window[last]


def shared(a: bytes, b: bytes, k: int = 0) -> int:
    """Length of the common prefix of a and b, of which k bytes are known."""
    n = min(len(a), len(b))
    step = 8
    while k < n:
        hi = min(k + step, n)
        x, y = a[k:hi], b[k:hi]
        if x != y:
            d = int.from_bytes(x) ^ int.from_bytes(y)
            return k + (hi - k) - (d.bit_length() + 7) // 8
        k, step = hi, step * 2
    return n


def suffixes(batches: Iterator[pa.RecordBatch], words: int, gram: int) -> Iterator[list[tuple[bytes, bytes, int, int]]]:
    """Runs of (suffix, words before it, doc_id, index of the first window's first word)."""
    run, size = [], 0
    for b in C.slices(batches):
        ids = b.column("doc_id").to_pylist()
        data, offsets = squeeze(*C.strings(b.column("text")))
        start, end, row = C.words(data, offsets, ~C.SPACE)
        a, p, q = places(data, start, end, row, words, gram)
        raw = data.tobytes()
        r = row[a] if len(a) else a
        first = np.searchsorted(row, np.arange(b.num_rows))
        for x, y, z, i, w in zip(start[a].tolist(), start[p].tolist(), end[q + words - 1].tolist(), r.tolist(), (p - first[r]).tolist()):
            run.append((raw[x:z], raw[y:x], ids[i], w))
        size += len(data)
        if size >= RUN_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def settled(run: list[tuple[bytes, bytes, int, int]], words: int) -> tuple[list[Entry], np.ndarray]:
    """A sorted run with one entry (suffix, words before it, doc_id, first word, a further doc_id) for equal ones of several documents, and these ones' passages: doc_id, first and end word."""
    out: list[Entry] = []
    spans: list[tuple[int, int, int]] = []
    i = 0
    while i < len(run):
        s, back, doc, word = run[i]
        j = i + 1
        while j < len(run) and run[j][0] == s and run[j][1] == back:
            j += 1
        if j == i + 1 or run[j - 1][2] == doc:
            out.extend((s, back, d, w, d) for _, _, d, w in run[i:j])
        else:
            long = back.count(b" ") + s.count(b" ") + 1  # words from the first window's first to the last one's end
            spans.extend((d, w, w + long) for _, _, d, w in run[i:j])
            out.append((s, back, doc, word, run[j - 1][2]))
        i = j
    return out, np.array(spans, np.int64).reshape(-1, 3)


def pack(run: list[Entry]) -> bytes:
    """A sorted run, front-coded and compressed."""
    lcp, rest, before = array("i"), [], b""
    for s, *_ in run:
        k = shared(before, s)
        lcp.append(k)
        rest.append(s[k:])
        before = s
    backs = [x[1] for x in run]
    tails, back = b"".join(rest), b"".join(backs)
    cols = [lcp, array("i", map(len, rest)), array("i", map(len, backs)), array("q", (x[2] for x in run)), array("q", (x[3] for x in run)), array("q", (x[-1] if len(x) > 4 else x[2] for x in run))]
    return zstandard.ZstdCompressor(level=3).compress(_HEAD.pack(len(run), len(tails), len(back), 0, 0, 0) + b"".join(x.tobytes() for x in cols) + tails + back)


def unpack(blob: bytes) -> Iterator[tuple[bytes, int, bytes, int, int, int]]:
    """(suffix, prefix shared with the one before, words before it, doc_id, first word, further doc_id), in order."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, t, *_ = _HEAD.unpack_from(raw)
    at = _HEAD.size

    def column(kind: str, width: int) -> array:
        nonlocal at
        x = array(kind)
        x.frombytes(raw[at : at + n * width])
        at += n * width
        return x

    lcp, rest, backs, doc, word, other = column("i", 4), column("i", 4), column("i", 4), column("q", 8), column("q", 8), column("q", 8)
    i, j = at, at + t
    s = b""
    for k, r, w, d, p, o in zip(lcp, rest, backs, doc, word, other):
        s = s[:k] + raw[i : i + r]
        i += r
        yield s, k, raw[j : j + w], d, p, o
        j += w


def merge(runs: list[Iterator[tuple[bytes, int, bytes, int, int, int]]]) -> Iterator[tuple[bytes, int, bytes, int, int, int]]:
    """All runs as one in order; the second field becomes the prefix shared with the one before in it."""
    n = len(runs)
    if not n:
        return
    nexts = [r.__next__ for r in runs]
    head: list = [None] * n
    know = [-1] * n  # of the last winner's bytes; -1: this run is over

    def pull(r: int) -> None:
        try:
            head[r] = x = nexts[r]()
            know[r] = x[1]
        except StopIteration:
            head[r], know[r] = None, -1

    def wins(x: int, y: int) -> bool:
        """Whether x goes before y; the loser's known prefix is then that with the winner."""
        a, b = know[x], know[y]
        if a != b:
            return a > b
        if a < 0:
            return True
        s, t = head[x][0], head[y][0]
        k = shared(s, t, a)
        first = k == len(s) or (k < len(t) and s[k] < t[k])
        know[y if first else x] = k
        return first

    for r in range(n):
        pull(r)
    lost = [-1] * n

    def play(node: int) -> int:
        if node >= n:
            return node - n
        x, y = play(2 * node), play(2 * node + 1)
        if wins(x, y):
            lost[node] = y
            return x
        lost[node] = x
        return y

    r = play(1) if n > 1 else 0
    while know[r] >= 0:
        x = head[r]
        yield x[0], know[r], *x[2:]
        pull(r)
        node = (r + n) >> 1
        while node:
            o = lost[node]
            a, b = know[r], know[o]
            if a < b or a == b and not wins(r, o):
                lost[node] = r
                r = o
            node >>= 1


_HASH = np.dtype([("a", np.uint64), ("b", np.uint64)])


class Group:
    """Suffixes that share their first ``gram`` words: the 128-bit hashes of all their whole windows, by member."""

    def __init__(self, words: int):
        self.words, self.hash, self.count, self.doc, self.word, self.other, self.seen = words, [], array("i"), array("q"), array("q"), array("q"), {}

    def add(self, s: bytes, back: bytes, doc: int, word: int, other: int) -> None:
        whole = back + s
        h = self.seen.get(whole)
        if h is None:
            blank = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
            n = len(blank) + 2 - self.words
            starts = [0, *(blank[: n - 1] + 1).tolist()]
            ends = [*blank[self.words - 1 :].tolist(), len(whole)]
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[i:j]) for i, j in zip(starts, ends)), _HASH)
            if len(self.seen) < 256:
                self.seen[whole] = h
        self.hash.append(h)
        self.count.append(len(h))
        self.doc.append(doc)
        self.word.append(word)
        self.other.append(other)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, first and end word of the runs of windows that another document has as well."""
        count, doc, word, other = (np.array(x, np.int64) for x in (self.count, self.doc, self.word, self.other))
        h = np.concatenate(self.hash)
        order = np.lexsort((h["b"], h["a"]))
        fresh = np.concatenate(([True], h[order[1:]] != h[order[:-1]]))
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(fresh) - 1
        member = np.repeat(np.arange(len(count)), count)
        d = doc[member]
        lo, hi = np.full(which.max() + 1, np.iinfo(np.int64).max), np.full(which.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(lo, which, d)
        np.maximum.at(hi, which, np.maximum(d, other[member]))
        hit = np.flatnonzero((lo < hi)[which])
        if not len(hit):
            return hit, hit, hit
        at = hit - (np.cumsum(count) - count)[member[hit]] + word[member[hit]]
        new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (member[hit[1:]] != member[hit[:-1]])))
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(hit)) - 1
        return d[hit[begin]], at[begin], at[last] + self.words


def groups(merged: Iterator[tuple[bytes, int, bytes, int, int, int]], words: int, gram: int) -> Iterator[Group]:
    """Neighbours that share ``gram`` words."""
    gram_end = _gram_end(gram)
    first, group, need = None, None, 0
    for s, k, back, doc, word, other in merged:
        same = False
        if first is not None and k >= 2 * gram - 1:
            if not need:
                need = gram_end.match(first[0]).end()
            same = k >= need and s[need : need + 1] in (b"", b" ") and first[0][need : need + 1] in (b"", b" ")
        if same:
            if group is None:
                group = Group(words)
                group.add(*first)
            group.add(s, back, doc, word, other)
        else:
            if group is not None:
                yield group
            first, group, need = (s, back, doc, word, other), None, 0
    if group is not None:
        yield group


def _gram_end(gram: int) -> re.Pattern:
    return re.compile(rb"[^ ]+(?: [^ ]+){%d}" % (gram - 1))


def repeated_passages(docs: DataFrame, words: int = 50, gram: int = 10) -> DataFrame:
    """``doc_id, start_word, end_word, n_words``: the passages of at least ``words`` words that another document has too.

    Words are runs of other than ASCII white space, counted from 0; ``end_word`` is exclusive. Passages are unions of
    windows of ``words`` words that occur in documents of at least two ids; those that touch are one.
    Null or short texts and null ids have none; repeated rows of one id are one document. Columns
    besides ``doc_id`` and ``text`` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sample(batches):
        end = _gram_end(gram)
        for run in suffixes(batches, words, gram):
            keys = [end.match(x[0]).group() for x in run]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([len(x[0]) + len(x[1]) for x in run], pa.int64())], ["s", "n"])

    # Only the borders of the ranges come from a sample. A border is the first words of whole groups, so no group is split, and any borders give the same result.
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    some = docs.sample(share, 7) if share < 1 else docs
    keys = sorted((bytes(r.s), r.n) for r in some.mapInArrow(sample, "s binary, n bigint").collect())
    so_far = np.cumsum([n for _, n in keys]) if keys else np.zeros(1)
    parts = max(least, int(so_far[-1] / share) // RANGE_BYTES)
    borders = sorted({keys[i][0] for i in np.searchsorted(so_far, so_far[-1] * np.arange(1, parts) / parts).tolist()}) if keys else []

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, run in enumerate(suffixes(batches, words, gram)):
            run.sort()
            run, spans = settled(run, words)
            cuts = [0, *(bisect_left(run, (b,)) for b in borders), len(run)]
            mine = [(i, pack(run[lo:hi]), None) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
            if len(spans):
                mine.append((int(spans[0].sum() + at) % parts, None, spans.tobytes()))  # they only pass on
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*mine), (pa.int32(), pa.binary(), pa.binary()))], ["part", "run", "spans"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start_word", "end_word"]
        own: dict[int, list[bytes]] = {}
        for b in batches:
            for part, run, spans in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), b.column("spans").to_pylist()):
                if run is None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(spans, np.int64).reshape(-1, 3).T], names)
                else:
                    own.setdefault(part, []).append(run)
        for part in sorted(own):
            out: list[tuple] = []
            for g in groups(merge([unpack(x) for x in own.pop(part)]), words, gram):
                out.append(g.spans())
                if len(out) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)

    runs = docs.mapInArrow(send, "part int, run binary, spans binary").repartitionById(parts, F.col("part"))
    found = runs.mapInArrow(combine, "doc_id bigint, start_word bigint, end_word bigint")
    by_doc = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.col("start_word") > F.coalesce(before, F.lit(-1))).cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    merged = found.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
