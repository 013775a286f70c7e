"""Vector search and a Parquet-backed store.

A search reads ids and vectors only; texts are joined to the winners. One query is a bounded sort (TakeOrderedAndProject);
a batch of queries is a matrix product over Arrow batches of vectors, each giving its k best only.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

QUERY_ROWS = 10_000
#: Vectors and queries of one product, whose scores then take some MB.
TILE_ROWS, TILE_QUERIES = 2048, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def score(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2, never negative, to six places so that ties are ties everywhere."""
    return F.round(F.greatest(F.lit(0.0), (1 + cosine(a, b)) / 2), 6)


def search(vectors: DataFrame, query: list[float], top_k: int = 5, where: Column | None = None, key: str = "id", column: str = "embedding") -> DataFrame:
    """``key, score, rank`` of the best rows, ties by key. ``where`` is applied before the ranking."""
    v = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    best = v.select(F.col(key), score(F.col(column), q).alias("score")).orderBy(F.col("score").desc(), F.col(key)).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(key))))


def batch_search(vectors: DataFrame, queries: DataFrame, top_k: int = 5, key: str = "id", column: str = "embedding", query_key: str = "query_id", where: Column | None = None) -> DataFrame:
    """``query_key, key, score, rank`` for every row of ``queries`` (``query_key, embedding``).

    Queries go to the vectors as a matrix, ``QUERY_ROWS`` at a time; each batch of vectors is one product and gives only
    its k best for every query, so the exchange before the final ranking grows with neither text nor vectors.
    Ties go by key; null and empty vectors, and vectors of another length than the query's, are no match.
    """
    v = vectors if where is None else vectors.where(where)
    v = v.select(F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v"))
    q = queries.select(F.col(query_key).alias("q"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    kinds = {"k": v.schema["k"].dataType.simpleString(), "q": q.schema["q"].dataType.simpleString()}
    slices = -(-q.count() // QUERY_ROWS) or 1
    found = None
    for i in range(slices):
        own = q if slices == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(slices)) == i)
        rows = own.collect()
        shared = vectors.sparkSession.sparkContext.broadcast(([r.q for r in rows], [np.array(r.v) for r in rows]))

        def run(batches, shared=shared):
            names, qs = shared.value
            by_size: dict[int, list[int]] = {}
            for at, x in enumerate(qs):
                by_size.setdefault(len(x), []).append(at)
            sets = {size: (np.array(at), np.array([qs[i] for i in at]).reshape(len(at), size)) for size, at in by_size.items() if size}
            for b in batches:
                v, keys = b.column("v"), b.column("k")
                ends, flat = v.offsets.to_numpy(), v.values
                whole = np.diff(ends) * v.is_valid().to_numpy(zero_copy_only=False)
                if flat.null_count:
                    holes = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
                    whole[holes[ends[1:]] > holes[ends[:-1]]] = 0
                flat = flat.to_numpy(zero_copy_only=False)
                place = np.empty(len(keys), np.int64)
                place[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
                for size, (at, n) in sets.items():
                    mine = np.flatnonzero(whole == size)
                    for lo in range(0, len(mine), TILE_ROWS):
                        j = mine[lo : lo + TILE_ROWS]
                        m = flat[ends[j][:, None] + np.arange(size)]
                        for c in range(0, len(at), TILE_QUERIES):
                            q, r, s = best(m, n[c : c + TILE_QUERIES], place[j])
                            cols = [pa.array([names[i] for i in at[c + q]], types[0]), keys.take(pa.array(j[r])), pa.array(s)]
                            yield pa.RecordBatch.from_arrays(cols, ["q", "k", "score"])

        def best(m, n, place):
            """Query, row and score of the k best rows of every query, ties by the rows' place."""
            norm = np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(n, axis=1)[None, :]
            s = np.round(np.maximum(0.0, (1 + np.divide(m @ n.T, norm, out=np.zeros_like(norm), where=norm > 0)) / 2), 6)
            r, q = np.nonzero(s >= np.partition(s, -top_k, axis=0)[-top_k]) if len(s) > top_k else np.nonzero(np.ones(s.shape, bool))
            order = np.lexsort((place[r], -s[r, q], q))
            r, q = r[order], q[order]
            first = np.searchsorted(q, np.arange(s.shape[1]))
            keep = np.arange(len(q)) - first[q] < top_k
            return q[keep], r[keep], s[r[keep], q[keep]]

        types = [to_arrow_type(q.schema["q"].dataType), to_arrow_type(v.schema["k"].dataType)]
        part = v.where("k is not null").mapInArrow(run, f"q {kinds['q']}, k {kinds['k']}, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("k")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select(F.col("q").alias(query_key), F.col("k").alias(key), "score", "rank")


def retrieve(vectors: DataFrame, queries: DataFrame, top_k: int | None = None, threshold: float | None = None, default_k: int = 5, default_threshold: float = 0.3, key: str = "id", query_key: str = "query_id", where: Column | None = None) -> DataFrame:
    """The best k, then those that reach the threshold; k of 0 or None is the default, a threshold of 0 or less keeps all."""
    limit = default_threshold if threshold is None else threshold
    best = batch_search(vectors, queries, top_k or default_k, key=key, query_key=query_key, where=where)
    return best.where(F.col("score") >= limit) if limit > 0 else best


def latest(rows: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """One row a key, that of the greatest version; of equal versions the one that sorts last by its other columns."""
    rest = [F.col(c).desc() for c in sorted(rows.columns) if c not in (key, version)]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc(), *rest))
    return rows.withColumn("_dw_rank", rank).where("_dw_rank = 1").drop("_dw_rank")


METADATA = {"document_id": "", "filename": "", "page_start": 1, "page_end": 1, "chapter": "", "section": "", "chunk_index": 0, "total_chunk": 0, "token_count": 0, "word_count": 0, "language": "", "block_type": "paragraph"}


def flatten(chunks: DataFrame) -> DataFrame:
    """``id, text`` and the twelve plain columns of a record, without nulls."""
    return chunks.select("id", F.coalesce("text", F.lit("")).alias("text"), *[(F.coalesce(F.col(c), F.lit(d)) if c in chunks.columns else F.lit(d)).cast("string" if isinstance(d, str) else "int").alias(c) for c, d in METADATA.items()])


class Store:
    """Collections of records ``id, text, …, embedding`` under one path.

    A collection is a base and changes to it, each a folder of its own: records put there and ids taken away. A version lists them in order,
    so a write costs what it changes, not what is there. Readers take the last version that was finished, so a lost
    executor or a failed write leaves the one before. When changes come to half the base they are merged with it; when only their number
    grows, with each other. What no version but the last two lists is deleted.
    """

    MOST = 16

    def __init__(self, spark: SparkSession, path: str, collection: str = "documents"):
        self.spark, self.path, self.collection = spark, path.rstrip("/"), collection

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[str]:
        fs, path = self._fs()
        home = path(f"{self.path}/{self.collection}")
        if not fs.exists(home):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(home))
        return [n for n in names if n.startswith("v-") and fs.exists(path(f"{self.path}/{self.collection}/{n}/_SUCCESS"))]

    def _listed(self, version: str) -> list[tuple[str, int]]:
        """Folder and rows of the base and of each change."""
        rows = self.spark.read.schema("at int, part string, n bigint").json(f"{self.path}/{self.collection}/{version}").orderBy("at").collect()
        return [(r.part, r.n) for r in rows]

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.collection}/parts/{name}")

    def _newest(self, parts: list[tuple[str, int]]) -> DataFrame:
        """Of every id the last that some changes say."""
        found = None
        for at, (name, _) in enumerate(parts):
            one = self._part(name).withColumn("_dw_at", F.lit(at))
            found = one if found is None else found.unionByName(one, allowMissingColumns=True)
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("_dw_at").desc()))
        return found.withColumn("_dw_rank", rank).where("_dw_rank = 1").drop("_dw_rank", "_dw_at")

    def _merged(self, parts: list[tuple[str, int]]) -> DataFrame:
        base = self._part(parts[0][0])
        if len(parts) > 1:
            newest = self._newest(parts[1:])
            base = base.join(newest.select("id"), "id", "left_anti").unionByName(newest, allowMissingColumns=True)
        return base.where("not _dw_gone").drop("_dw_gone")

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self._merged(self._listed(versions[-1])) if versions else None

    def _put(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{self.collection}/parts/{name}")
        return name

    def _commit(self, old: list[str], parts: list[tuple[str, int]]) -> None:
        gone = F.lit(False).alias("_dw_gone")
        changed = sum(n for _, n in parts[1:])
        if len(parts) > 1 and 2 * changed > parts[0][1]:
            name = self._put(self._merged(parts).select("*", gone))
            parts = [(name, self._part(name).count())]
        elif len(parts) > self.MOST:
            name = self._put(self._newest(parts[1:]))
            parts = [parts[0], (name, self._part(name).count())]
        number = int(old[-1].split("-")[1]) + 1 if old else 1
        version = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
        listed = self.spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], "at int, part string, n bigint")
        listed.coalesce(1).write.json(f"{self.path}/{self.collection}/{version}")
        fs, path = self._fs()
        kept = {n for n, _ in parts} | {n for n, _ in (self._listed(old[-1]) if old else ())}
        home = f"{self.path}/{self.collection}"
        for n in old[:-1]:  # the one before stays for those who read it
            for name, _ in self._listed(n):
                if name not in kept:
                    fs.delete(path(f"{home}/parts/{name}"), True)
            fs.delete(path(f"{home}/{n}"), True)

    def upsert(self, records: DataFrame) -> int:
        """Records by id in place of those that are there; the number of ``records``, which are read once. Null ids are counted but not kept; of equal ids in ``records`` the one of the least hash of its columns stays, whatever their order."""
        seen = Observation()
        new = records.drop("_dw_gone").observe(seen, F.count(F.lit(1)).alias("n")).where("id is not null")
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(*new.columns)))
        new = new.withColumn("_dw_rank", rank).where("_dw_rank = 1").drop("_dw_rank")
        name = self._put(new.select("*", F.lit(False).alias("_dw_gone")))
        count = seen.get.get("n", 0)
        if count:
            old = self._versions()
            self._commit(old, [*(self._listed(old[-1]) if old else ()), (name, self._part(name).count())])
        return count

    def delete(self, ids: list[str]) -> int:
        """Number of ids given, whether there or not."""
        old = self._versions()
        if old and ids:
            gone = self.spark.createDataFrame([(i,) for i in sorted(set(ids))], "id string")
            self._commit(old, [*self._listed(old[-1]), (self._put(gone.withColumn("_dw_gone", F.lit(True))), len(set(ids)))])
        return len(ids)

    def delete_where(self, ids: DataFrame) -> None:
        """Take away all ids of a table (``id``), however many."""
        old = self._versions()
        if old:
            name = self._put(ids.select("id").where("id is not null").distinct().withColumn("_dw_gone", F.lit(True)))
            self._commit(old, [*self._listed(old[-1]), (name, self._part(name).count())])

    def count(self) -> int:
        rows = self.read()
        return rows.count() if rows is not None else 0

    def list_collections(self) -> list[str]:
        fs, path = self._fs()
        home = path(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(home) if s.isDirectory()) if fs.exists(home) else []

    def search(self, query: list[float], top_k: int = 5, where: Column | None = None) -> DataFrame | None:
        """Records with ``score, rank``; texts are joined to the k winners only."""
        rows = self.read()
        if rows is None:
            return None
        return search(rows, query, top_k, where).join(rows.drop("embedding"), "id")


def stats(rows: DataFrame) -> DataFrame:
    """``collection, total_chunks`` by collection."""
    return rows.groupBy("collection").agg(F.count("*").alias("total_chunks"))
