"""Chunks with their validations as JSON, JSONL or Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.config import Export

from . import validate as V

_META = ["id", "document_id", "filename", "page_start", "page_end", "chapter", "section", "chunk_index", "total_chunk", "token_count", "word_count", "language", "block_type"]


def joined(chunks: DataFrame, validations: DataFrame) -> DataFrame:
    """Every chunk, with ``quality_score`` and ``findings`` where it has them."""
    return chunks.join(validations.select(F.col("chunk_id").alias("id"), "quality_score", "findings"), "id", "left")


def records(chunks: DataFrame, validations: DataFrame, metadata: bool = True) -> DataFrame:
    """``doc_id, chunk_index, id, text[, metadata], validation``, ready for a JSON writer."""
    pick = lambda xs, *names: F.transform(xs, lambda f: F.struct(*[f[n].alias(n) for n in names]))
    v = F.when(F.col("quality_score").isNotNull(), F.struct("quality_score", pick(V.warnings(), "code", "severity", "message").alias("warnings"), pick(V.recommendations(), "code", "message").alias("recommendations")))
    more = [F.struct(*_META).alias("metadata")] if metadata else []
    return joined(chunks, validations).select("doc_id", "filename", "chunk_index", "id", "text", *more, v.alias("validation"))


def json_rows(chunks: DataFrame, validations: DataFrame, metadata: bool = True) -> DataFrame:
    """``doc_id, filename, chunk_index, json``: one object a chunk, characters as they are; a missing validation is left out."""
    r = records(chunks, validations, metadata)
    names = [c for c in r.columns if c not in ("doc_id", "filename", "chunk_index")]
    return r.select("doc_id", "filename", "chunk_index", F.to_json(F.struct(*names)).alias("json"))


def _tag(score: Column) -> Column:
    return F.concat(score.cast("string"), F.lit("/100 "), F.when(score >= 90, "🟢").when(score >= 70, "🟡").otherwise("🔴"))


def markdown_blocks(chunks: DataFrame, validations: DataFrame, metadata: bool = True, title: str = "Chunks") -> DataFrame:
    """``doc_id, filename, chunk_index, block``: the passage that stands for each chunk."""
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(F.col(c))
    text = lambda c: F.col(c).cast("string")
    meta = F.concat(F.lit("> `"), F.col("filename"), F.lit("` · "), dash("chapter"), F.lit(" › "), dash("section"), F.lit(" · page "), text("page_start"), F.lit("-"), text("page_end"), F.lit(" · "), text("token_count"), F.lit(" tok / "), text("word_count"), F.lit(" kata · lang="), dash("language"), F.lit("\n\n"))
    notes = F.array_join(F.transform(V.warnings(), lambda f: F.concat(F.lit("\n- ⚠️ **"), f["code"], F.lit("**: "), f["message"])), "")
    scored = F.when(F.col("quality_score").isNotNull(), F.concat(F.lit("*Quality score: "), _tag(F.col("quality_score")), F.lit("*"), notes, F.lit("\n"))).otherwise("")
    block = F.concat(F.lit("## Chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit("\n\n"), meta if metadata else F.lit(""), F.col("text"), F.lit("\n\n"), scored, F.lit("\n---\n"))
    return joined(chunks, validations).select("doc_id", "filename", "chunk_index", block.alias("block"))


def documents(chunks: DataFrame, validations: DataFrame, cfg: Export = Export()) -> DataFrame:
    """``doc_id, stem, body``: one file's content a document."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem")
    if cfg.format in ("markdown", "md"):
        rows, part, head = markdown_blocks(chunks, validations, cfg.include_metadata), "block", True
    else:
        rows, part, head = json_rows(chunks, validations, cfg.include_metadata), "json", False
    g = rows.groupBy("doc_id", "filename").agg(F.array_sort(F.collect_list(F.struct("chunk_index", part))).alias("x"))
    parts = F.transform("x", lambda v: v[part])
    if head:
        body = F.concat(F.lit("# Chunks\n\n- Total chunks: **"), F.size("x").cast("string"), F.lit("**\n\n---\n\n"), F.array_join(parts, "\n"))
    elif cfg.format == "json":
        body = F.concat(F.lit("[\n  " if cfg.pretty_json else "["), F.array_join(parts, ",\n  " if cfg.pretty_json else ", "), F.lit("\n]" if cfg.pretty_json else "]"))
    else:
        body = F.concat(F.array_join(parts, "\n"), F.lit("\n"))
    return g.select("doc_id", stem, body.alias("body"))


EXTENSION = {"json": "json", "jsonl": "jsonl", "markdown": "md", "md": "md"}


def write(chunks: DataFrame, validations: DataFrame, cfg: Export = Export()) -> str:
    """A folder of parts, partitioned by document for JSON and Markdown, plain JSON lines otherwise."""
    if cfg.format not in EXTENSION:
        raise ValueError(f"no exporter {cfg.format!r}")
    path = f"{cfg.output_dir.rstrip('/')}/chunks.{EXTENSION[cfg.format]}"
    if cfg.format == "jsonl":
        json_rows(chunks, validations, cfg.include_metadata).select("json").write.mode("overwrite").text(path)
    else:
        documents(chunks, validations, cfg).select("stem", F.col("body").alias("value")).write.mode("overwrite").partitionBy("stem").text(path)
    return path
