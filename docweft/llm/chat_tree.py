"""Conversations merged into prefix trees: shared turns once, depth first, with position ids and attention intervals.

A node is a distinct sequence of turns from the start; its key hashes all of them. Distinct conversations are ordered by
the keys of their prefixes, so that nodes come depth first and every tree in one piece: what a conversation doesn't
share with the one before it are new nodes, and what it shares are their ancestors, which a stack holds. So no node asks for its
ancestors by a join, and one system prompt in front of every conversation makes no task larger.

Ranges of conversations are walked beside each other, each as if it were the first. The driver then gets two paths of every range, its first
and its last, and from them tells each which nodes it repeats, which ancestors it goes on from, and what tokens stand before it.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import pieces

#: Bytes of text whose tokens are looked up together.
TOGETHER = 1 << 20


def rendered(role: str | None, text: str | None) -> str:
    return f"<|{role or ''}|>\n{text or ''}<|end|>\n"


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, keys, roles, texts`` of every conversation, in the order of its turns; a key stands for the turns so far."""
    turns = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")).where("conv_id is not null").distinct()
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    whole = whole.select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: x["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for roles, texts in zip(b.column("roles").to_pylist(), b.column("texts").to_pylist()):
                key, own = b"", []
                for x in zip(roles, texts):
                    key = hashlib.blake2b(key + repr(x).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    own.append(key)
                keys.append(own)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(keys, pa.list_(pa.binary())), b.column("roles"), b.column("texts")], ["conv_id", "keys", "roles", "texts"])

    return whole.mapInArrow(run, "conv_id bigint, keys array<binary>, roles array<string>, texts array<string>")


def _shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


WALKED = "key binary, depth int, role string, n_tokens bigint, ids array<int>, at bigint, edge binary"


def _walk(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """New nodes of a range's conversations in order; ``at`` counts the range's tokens. A last row has the range's edge: its number, first path with sizes, last path with places and sizes, tokens."""
    m = pieces.model(path)
    at, before = 0, []
    stack: list[tuple[bytes, int, int]] = []
    first: list[tuple[bytes, int]] | None = None
    wait: list[tuple[list[bytes], int, list, list[str]]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal at, first
        ids, offsets = m.encode(pa.array([t for *_, texts in wait for t in texts], pa.string()))
        key, depth, role, places = [], [], [], []
        i = 0
        for keys, known, roles, _ in wait:
            del stack[known:]
            for d in range(known, len(keys)):
                n = int(offsets[i + 1] - offsets[i])
                stack.append((keys[d], at, n))
                key.append(keys[d])
                depth.append(d + 1)
                role.append(roles[d])
                places.append(at)
                at += n
                i += 1
            if first is None:
                first = [(k, n) for k, _, n in stack]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
        columns = [pa.array(key, pa.binary()), pa.array(depth, pa.int32()), pa.array(role, pa.string()), pa.array(np.diff(offsets), pa.int64()), lists, pa.array(places, pa.int64()), pa.nulls(len(key), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    NAMES = [x.split()[0] for x in WALKED.split(", ")]
    for b in batches:
        some = (b.slice(i, 64) for i in range(0, b.num_rows, 64))  # few as Python objects at a time
        for keys, roles, texts in (x for c in some for x in zip(*(c.column(k).to_pylist() for k in ("keys", "roles", "texts")))):
            known = _shared(before, keys)
            new = [rendered(r, t) for r, t in zip(roles[known:], texts[known:])]
            wait.append((keys, known, roles, new))
            before, size = keys, size + sum(map(len, new))
            if size > TOGETHER:
                yield flush()
                wait.clear()
                size = 0
    if wait:
        yield flush()
    if first is not None:
        edge = pickle.dumps((TaskContext.get().partitionId(), first, stack, at))
        types = [pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.array([edge], pa.binary())], NAMES)


def _starts(edges: list[tuple]) -> dict[int, tuple[int, int, list[tuple[int, int]]]]:
    """For each range: how many nodes of its first path it repeats, what is to be added to its places, and the repeated nodes' places and sizes."""
    out, base, last = {}, 0, []
    for part, first, stack, total in sorted(edges, key=lambda e: e[0]):
        again = _shared([k for k, _, _ in last], [k for k, _ in first])
        lift = base - sum(n for _, n in first[:again])
        kept = last[:again]
        out[part] = (again, lift, [(at, n) for _, at, n in kept])
        old = min(again, _shared([k for k, _ in first], [k for k, _, _ in stack]))
        last = kept[:old] + [(k, at + lift, n) for k, at, n in stack[old:]]
        base = lift + total
    return out


def _placed(batches: Iterator[pa.RecordBatch], starts: dict) -> Iterator[pa.RecordBatch]:
    """Nodes with their tree, their place in its tokens, their first position and their ancestors' merged intervals."""
    again, lift, repeated = starts.get(TaskContext.get().partitionId(), (0, 0, []))
    seen = 0
    stack: list[tuple[int, list[tuple[int, int]], int, bytes]] = []  # end, merged intervals up to it, tokens so far, root's key
    base = 0

    def push(depth: int, at: int, n: int, key: bytes) -> tuple:
        nonlocal base
        del stack[depth - 1 :]
        if depth == 1:
            base = at
        above, before = (stack[-1][1], stack[-1][2]) if stack else ([], 0)
        if above and above[-1][1] == at:
            merged = [*above[:-1], (above[-1][0], at + n)]
        else:
            merged = [*above, (at, at + n)]
        stack.append((at + n, merged, before + n, stack[0][3] if stack else key))
        return above, before

    for b in batches:
        b = b.filter(b.column("edge").is_null())
        keys, depths, at, n = (b.column(k).to_pylist() for k in ("key", "depth", "at", "n_tokens"))
        tree, offset, start, lo, hi, keep = [], [], [], [], [], []
        for k, d, a, c in zip(keys, depths, at, n):
            mine = seen >= again
            above, before = push(d, a + lift, c, k) if mine else push(d, *repeated[seen], k)
            seen += 1
            keep.append(mine)
            if mine:
                tree.append(stack[0][3].hex())
                offset.append(a + lift - base)
                start.append(before)
                lo.append([x - base for x, _ in above])
                hi.append([y - base for _, y in above])
        b = b.filter(pa.array(keep, pa.bool_()))
        own = [pa.array(tree, pa.string()), pa.array(offset, pa.int64()), b.column("depth"), b.column("role"), b.column("n_tokens"), b.column("ids"), pa.array(start, pa.int64()), pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64())), b.column("key")]
        yield pa.RecordBatch.from_arrays(own, ["tree_id", "offset", "depth", "role", "n_tokens", "ids", "start", "attend_from", "attend_to", "key"])


def packed(turns: DataFrame, path: str = pieces.MODEL) -> DataFrame:
    """One row per node and one per conversation: ``kind, tree_id, node, depth, offset, role, n_tokens, ids, position_ids, attend_from, attend_to, n_conversations, conv_id``.

    Of a node (kind ``turn``): ``tree_id`` is the key of its tree's root, ``node`` its own, ``offset`` the place of its first token in the
    tree's sequence, ``position_ids`` its tokens' places in its own conversation. A token attends to all of
    [attend_from[i], attend_to[i]), the merged intervals of its ancestors, and to the node's own tokens up to itself.
    ``n_conversations`` counts the conversations that pass the node. Of a conversation: its last ``node``, the ``tree_id``, and its
    ``depth``; all else is null. However many conversations are equal, they are a row each and a node once.

    Turns are ordered by ``turn``, null first, ties by role and text; repeated rows count once. A null role or text
    reads as empty but makes a node of its own. A null ``conv_id`` names no conversation. Other columns are not read.
    Long conversations take memory in proportion to their length.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = C.written(paths(turns))
    last = F.element_at("keys", -1)
    distinct = every.groupBy(last.alias("last")).agg(F.first(F.struct("keys", "roles", "texts")).alias("x"), F.count("*").alias("n"))
    ordered = distinct.select("x.*").repartitionByRange(parts, "keys").sortWithinPartitions("keys")
    walked = C.cut(ordered.mapInArrow(lambda b: _walk(b, path), WALKED))
    edges = [pickle.loads(r.edge) for r in walked.where("edge is not null").select("edge").collect()]
    starts = turns.sparkSession.sparkContext.broadcast(_starts(edges))
    nodes = walked.mapInArrow(lambda b: _placed(b, starts.value), "tree_id string, offset bigint, depth int, role string, n_tokens bigint, ids array<int>, start bigint, attend_from array<bigint>, attend_to array<bigint>, key binary")
    # A hot root is summed before it is sent; afterwards every key is there once on both sides.
    passing = every.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n_conversations"))
    positions = F.when(F.col("n_tokens") > 0, F.sequence("start", F.col("start") + F.col("n_tokens") - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    nodes = nodes.join(passing, "key").select(
        F.lit("turn").alias("kind"), "tree_id", F.lower(F.hex("key")).alias("node"), "depth", "offset", "role", "n_tokens", "ids", positions.alias("position_ids"), "attend_from", "attend_to", "n_conversations", F.lit(None).cast("bigint").alias("conv_id"),
    )
    own = every.select(F.lit("conversation").alias("kind"), F.lower(F.hex(F.element_at("keys", 1))).alias("tree_id"), F.lower(F.hex(last)).alias("node"), F.size("keys").alias("depth"), "conv_id")
    return nodes.unionByName(own, allowMissingColumns=True)
