"""Shared helpers: Arrow text buffers as numpy arrays, vectorised hashing, lineage cuts, components.

Texts never become one Python object per word: a slice of a column is one byte array, words are
index ranges into it, and their 64-bit hashes come from a prefix polynomial over the bytes.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
KEPT_POWERS = SLICE_BYTES + 1
#: Ids that are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_ODD = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words once punctuation is a separator: ASCII letters and digits, and all of a multi-byte character.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    ``spark.checkpoint.dir`` of the session names the folder. Where it is unset, a local master gets
    a temporary folder; a cluster is refused, for its machines share none.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: smaller than ``cut`` for whole texts."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works beside


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` whose ``doc_id`` isn't in ``bad`` (a materialised table of ids); rows with a null id stay."""
    bad = bad.select("doc_id")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, "doc_id", "left_anti").select(docs.columns)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not (sc.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="docweft-checkpoint-")
    sc.setCheckpointDir(shared)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(r: np.uint64, n: int) -> np.ndarray:
    x = np.full(n, r, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > KEPT_POWERS:  # of a single long text; a worker that lives on doesn't keep them
        return _power(_R, n), _power(_RINV, n)
    if not _POW:
        _POW.update(p=_power(_R, KEPT_POWERS), i=_power(_RINV, KEPT_POWERS))
    return _POW["p"][:n], _POW["i"][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """c with c[j]-c[i] = r^i times the polynomial hash of codes[i:j]; codes are already 64-bit values."""
    p, _ = _powers(len(codes) + 1)
    c = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p[: len(codes)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span, equal for equal contents wherever they stand."""
    _, inv = _powers(len(c))
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def strings(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Return to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of some MB: the setting's 64 MB are held several times over by the JVM and by each worker. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not now or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``size`` bytes of text; a longer text is a piece of its own."""
    give_back()
    for b in batches:
        if not b.num_rows:
            continue
        at = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, (at[lo - 1] if lo else 0) + size, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes for which ``inside`` holds; runs end at row ends."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begin = w.copy()
    begin[1:] &= ~w[:-1] | first[1:n]
    end = np.zeros(n + 1, bool)
    end[1:] = w
    end[1:n] &= ~w[1:] | first[1:n]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end), np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(byte_codes(data)), start, end)


def ngram(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries of h (len(h)-n+1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    s = np.zeros(m, np.uint64)
    for j in range(n):
        s += h[j : j + m] * _ODD[j]
    return mix(s)


def with_sums(df: DataFrame, keys: list[str], *sums) -> DataFrame:
    """``df`` with aggregates over the rows of equal ``keys`` (none null). A window would bring the rows of a key into one task; sums are taken before they are sent, and the join back is split where a key is hot."""
    return df.join(df.groupBy(*keys).agg(*sums), keys)


def components(edges: DataFrame) -> DataFrame:
    """Smallest member of each node's connected component.

    ``edges`` has bigint columns ``a`` and ``b``; null ends and loops are ignored. Returns
    ``node, root`` for every node of an edge, roots included. Alternates large-star and small-star
    steps and checkpoints between rounds; no node's neighbours are gathered, however many it has.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_sums(both, ["u"], F.min("v").alias("least")).withColumn("m", F.least("u", "least")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = with_sums(large, ["u"], F.min("v").alias("m"))
        small = m.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(small)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
