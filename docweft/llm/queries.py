"""Queries of the ten operators over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, class_lm, decontaminate, flac, flac_write, line_dedup, near_dup, pieces, suffix_dedup, surrogates, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed_lines")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.perplexities(_table(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(_table(spark, sf_dir, "documents"), key="docweft").select("doc_id", "text", "n_replaced")


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.packed(_table(spark, sf_dir, "conversations"))


#: How vectors are packed, by vec_id modulo 4: block length, predictor, order, partitions, stereo mode (halves of a vector as channels), escapes.
SOUNDS = ((24, "lpc", 3, 0, None, False), (4096, "fixed", 2, 1, 10, False), (16, "lpc", 2, 0, 8, True), (32, "verbatim", 0, 0, None, False))


def sound(vectors: DataFrame) -> DataFrame:
    """``vec_id, media``: each vector as a FLAC stream of 16-bit samples, for the tables hold no media. A null vector has none."""

    def run(batches):
        for b in batches:
            media = []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                x = np.round(np.array([0 if e is None else e for e in v or ()], np.float64) * 32767).astype(np.int64)
                block, kind, order, parts, mode, escape = SOUNDS[(i or 0) % 4]
                mode = None if len(x) % 2 else mode
                x = x.reshape(1 if mode is None else 2, -1)
                media.append(flac_write.encode(x, block=block, kind=kind, order=order, parts=parts, mode=mode, escape=escape) if x.size else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(media, pa.binary())], ["vec_id", "media"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, media binary")


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flac.blocks(sound(_table(spark, sf_dir, "embeddings")), "vec_id", "media")
    return found.select("vec_id", "block", "first_sample", "n_samples", "sample_rate", "channels", "bits", F.lower(F.hex("pcm")).alias("pcm"), "status")


QUERIES = {"op6_flac": op6_flac, "op3_chat_tree": op3_chat_tree, "op7_surrogates": op7_surrogates, "op4_class_lm": op4_class_lm, "op9_toxicity": op9_toxicity, "op2_sentencepiece": op2_sentencepiece, "op5_line_dedup": op5_line_dedup, "op10_suffix_dedup": op10_suffix_dedup, "op1_decontamination": op1_decontamination, "op8_near_duplicates": op8_near_duplicates}
ORACLE: dict[str, str] = {
    "op6_flac": r"""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda e: round(coalesce(e, 0)::DOUBLE * 32767)::BIGINT) AS x FROM embeddings WHERE len(embedding) > 0),
h AS (SELECT vec_id, x, CASE vec_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 4096 WHEN 2 THEN 16 ELSE 32 END AS size, CASE WHEN vec_id % 4 IN (1, 2) AND len(x) % 2 = 0 THEN 2 ELSE 1 END AS ch FROM s),
b AS (SELECT vec_id, x, size, ch, len(x) // ch AS n, unnest(range(0, (len(x) // ch + size - 1) // size)) AS block FROM h),
c AS (SELECT vec_id, block, size, ch, list_transform(range(ch * block * size, ch * least(n, (block + 1) * size)), lambda i: x[(i % ch) * n + i // ch + 1]) AS y FROM b)
SELECT vec_id, block::INTEGER AS block, block * size AS first_sample, (len(y) // ch)::BIGINT AS n_samples, 16000 AS sample_rate, ch AS channels, 16 AS bits,
  array_to_string(list_transform(y, lambda v: printf('%02x%02x', v & 255, (v >> 8) & 255)), '') AS pcm, 'ok' AS status
FROM c
""",
    "op5_line_dedup": r"""
WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10))), E' \t\r\f\x0b') AS line FROM documents WHERE source IS NOT NULL),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
e AS (SELECT k, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT k, p, line, trim(line, E' \t\r\f\x0b') IN (SELECT line FROM b) AS cut FROM e),
g AS (SELECT k, string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT cut) AS text, count(*) FILTER (WHERE cut) AS n FROM f GROUP BY k)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text, coalesce(n, 0)::INTEGER AS n_removed_lines FROM d LEFT JOIN g USING (k)
""",
    "op10_suffix_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
v AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 49, 0)::BIGINT)) AS p FROM w),
t AS (SELECT doc_id, p, array_to_string(ws[p + 1 : p + 50], ' ') AS passage FROM v),
r AS (SELECT passage FROM t GROUP BY passage HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT DISTINCT doc_id, p FROM t WHERE passage IN (SELECT passage FROM r)),
i AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM h),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM i)
SELECT doc_id, min(p) AS start_word, max(p) + 50 AS end_word, max(p) + 50 - min(p) AS n_words FROM g GROUP BY doc_id, island
""",
}
