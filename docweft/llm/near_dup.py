"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Every text becomes its set of hashed word n-grams (words lower-cased, punctuation separates). Texts with
   equal sets are one node, which takes exact copies out of all later steps whatever their number.
2. A node keeps the k smallest hashes: its bottom-k sketch. Inverted lists of the retained values give the
   overlaps. A pair that can pass the filter shares at least ``need`` values, so it shares one among the
   ``shared - need + 1`` rarest values of either side; only those are listed. This is exact, caps no
   list, and keeps passages that many documents share from pairing documents that have more of their own.
3. The union sketch (k smallest of both sketches) estimates the Jaccard index; pairs below
   ``threshold - slack`` go.
4. The whole n-gram sets of the remaining pairs are intersected: exact Jaccard decides.
5. Connected components over verified pairs and exact copies are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

BROADCAST_ROWS = 200_000
#: Members of a block of an inverted list.
BLOCK = 1000


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in C.slices(batches):
        data, offsets = C.strings(pc.utf8_lower(pc.fill_null(b.column("text"), "")))
        start, end, row = C.words(data, offsets, C.WORD)
        h = C.word_hashes(data, start, end)
        grams = C.ngram(h, n)
        at = np.searchsorted(row, np.arange(b.num_rows + 1))
        out = []
        for i in range(b.num_rows):
            lo, hi = int(at[i]), int(at[i + 1])
            if hi - lo >= n:
                out.append(np.unique(grams[lo : hi - n + 1]))
            elif hi > lo:
                out.append(C.mix(np.array([np.add.reduce(h[lo:hi] * C._ODD[: hi - lo])], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield b, out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    offsets[1:] = np.cumsum([len(a) for a in arrays])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, n: int = 3, k: int = 64) -> DataFrame:
    """``doc_id, s1, s2, n, sketch``: a 128-bit hash of the set, its size, its k smallest hashes (ascending as unsigned)."""

    def run(batches):
        m = np.uint64(0xD6E8FEB86659FD93)
        for b, sets in _sets(batches, n):
            s1 = np.array([np.add.reduce(s) for s in sets], np.uint64)
            s2 = np.array([np.add.reduce(C.mix(s ^ m)) for s in sets], np.uint64)
            arrays = [b.column("doc_id"), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), _lists([s[:k] for s in sets])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "s1", "s2", "n", "sketch"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, s1 bigint, s2 bigint, n int, sketch array<bigint>")


def prefixes(nodes: DataFrame, least: float) -> DataFrame:
    """``rep, n, sketch, vs``: the rarest retained values by which a node must meet a partner; nodes that can't have one are left out."""
    values = nodes.select("rep", F.explode("sketch").alias("value"))
    # Values are unique within a sketch, so a frequency above one means another node.
    shared = C.with_sums(values, ["value"], F.count("*").alias("f")).where("f > 1")
    kept = shared.groupBy("rep").agg(F.collect_list(F.struct("f", "value")).alias("vs"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(least) * F.size("sketch") - F.lit(1e-9)).cast("int"))
    sk = nodes.select("rep", "n", "sketch", need.alias("need"))
    rarest = F.transform(F.slice(F.array_sort("vs"), 1, F.size("vs") - F.col("need") + 1), lambda x: x["value"])
    return kept.join(sk, "rep").where(F.size("vs") >= F.col("need")).select("rep", "n", "sketch", rarest.alias("vs"))


def _near_size(threshold: float):
    return F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - F.lit(1e-9)


def estimated(pairs: DataFrame, sketched: DataFrame, least: float, k: int) -> DataFrame:
    """The ``a, b`` whose union sketch estimates a Jaccard index of at least ``least``."""
    x, y = (sketched.select(F.col("rep").alias(c), F.col("sketch").alias(f"s_{c}")) for c in "ab")

    def run(batches):
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            (xv, xo), (yv, yo) = ((np.asarray(c.values).view(np.uint64), np.asarray(c.offsets)) for c in (t.column("s_a"), t.column("s_b")))
            for i in range(t.num_rows):
                u = np.sort(np.concatenate((xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]])))
                twice = u[1:] == u[:-1]
                fresh = u[np.concatenate(([True], ~twice))]
                size = min(k, len(fresh))
                keep[i] = np.count_nonzero(twice & (u[1:] <= fresh[size - 1])) >= least * size - 1e-9
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(x, "a").join(y, "b").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, threshold: float, n: int) -> DataFrame:
    """``a, b, jaccard`` of the pairs whose whole n-gram sets reach the threshold.

    Texts travel to the pairs rather than sets, which take more than twice the room.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if pairs.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    own = docs.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    x, y = (own.select(F.col("doc_id").alias(c), F.col("text").alias(f"t_{c}")) for c in "ab")

    def run(batches):
        for t in C.slices(batches, "t_a"):
            ta, tb = t.column("t_a").dictionary_encode(), t.column("t_b").dictionary_encode()
            sa, sb = (next_sets(c.dictionary, n) for c in (ta, tb))
            j = np.zeros(t.num_rows)
            for i, (p, q) in enumerate(zip(ta.indices.to_pylist(), tb.indices.to_pylist())):
                a, b = sa[p], sb[q]
                both = len(a) + len(b) - len(np.union1d(a, b))
                j[i] = both / max(1, len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(j)], ["a", "b", "jaccard"]).filter(pa.array(j >= threshold - 1e-9))

    found = pairs.join(x, "a").join(y, "b").mapInArrow(run, "a bigint, b bigint, jaccard double")
    return found.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def next_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    return [s for _, sets in _sets(iter([batch]), n) for s in sets]


def near_duplicates(docs: DataFrame, threshold: float = 0.6, n: int = 3, k: int = 64, slack: float = 0.15) -> DataFrame:
    """``doc_id, kept_doc_id, group_size`` of every document that has a near copy; the smallest id of a group is kept.

    Two documents are near if the Jaccard index of their n-gram sets is at least ``threshold``; groups are the connected
    components. Members of an inverted list are first held against its smallest and its largest id; then
    all pairs of a list that are not yet in one group, so no pair that could change a group is left out
    and a group of m copies costs about m pairs, not m * m.

    Texts without a word are like no other. Documents without a near copy or without a ``doc_id`` have no
    row. Rows that share a ``doc_id`` are one document, near another if any of its rows is. Columns besides
    ``doc_id`` and ``text`` are not read.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    C.small_batches(docs.sparkSession)
    least = threshold - slack
    seen = C.cut(sketches(docs, n, k).where("n > 0"))
    nodes = seen.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    listed = C.cut(prefixes(nodes, least))
    same = C.with_sums(seen.select("doc_id", "s1", "s2"), ["s1", "s2"], F.min("doc_id").alias("rep")).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    entries = listed.select("rep", "n", F.explode("vs").alias("value"))
    me = F.struct("rep", "n")
    ends = C.with_sums(entries, ["value"], F.min(me).alias("lo"), F.max(me).alias("hi")).select(me.alias("x"), F.explode(F.array("lo", "hi")).alias("y"))
    stars = ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x.rep < y.rep")
    stars = stars.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).where(_near_size(threshold)).select("a", "b").distinct()
    tried = C.cut(estimated(stars, listed, least, k))
    first = C.cut(verified(tried, docs, threshold, n).select("a", "b"))

    group = C.components(first)
    grouped = entries.join(group.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # Lists are cut into blocks of about BLOCK, so none is ever whole in one row.
    sizes = grouped.groupBy("value", "root").agg(F.count("*").alias("size"))
    open_ = sizes.groupBy("value").agg(F.count("*").alias("groups")).where("groups > 1").select("value")
    some = grouped.join(open_, "value", "left_semi").join(sizes, ["value", "root"])
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK))
    lists = some.groupBy("value", "root", block.alias("block")).agg(F.collect_list(me).alias("members"))
    left, right = (lists.select("value", F.col("root").alias(f"r_{c}"), F.col("members").alias(f"m_{c}")) for c in "ab")
    across = left.join(right, "value").where("r_a < r_b").select(F.explode("m_a").alias("x"), "m_b").select("x", F.explode("m_b").alias("y"))
    across = across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x.rep < y.rep")
    across = across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).where(_near_size(threshold)).select("a", "b").distinct()
    later = C.cut(estimated(across, listed, least, k).join(tried, ["a", "b"], "left_anti"))
    second = verified(later, docs, threshold, n).select("a", "b")

    found = C.components(same.unionByName(first).unionByName(second))
    return C.with_sums(found, ["root"], F.count("*").alias("group_size")).select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"), "group_size")
