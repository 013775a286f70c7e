"""Metadata and quality of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.config import Metadata, Validation
from docweft.functions import text as T

FINDING = "struct<code:string,severity:string,message:string>"


def enrich(chunks: DataFrame, samples: DataFrame | None = None, cfg: Metadata = Metadata(), counter=T.count_tokens) -> DataFrame:
    """Counts anew, a language where there is none, and a last page not before the first.

    ``samples`` gives ``doc_id, sample``; without it the first five chunks' first 200 characters serve.
    """
    out = chunks.withColumn("token_count", counter(F.col("text"))).withColumn("word_count", T.count_words("text")).withColumn("page_end", F.greatest("page_end", "page_start"))
    if not cfg.detect_language:
        return out
    if samples is None:
        heads = chunks.where("chunk_index < 5").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.substring("text", 1, 200).alias("t")))).alias("h"))
        samples = heads.select("doc_id", F.array_join(F.transform("h", lambda x: x["t"]), " ").alias("sample"))
    found = samples.select("doc_id", F.when(T.is_blank("sample"), "").otherwise(T.detect_language("sample")).alias("_dw_lang"))
    out = out.join(found, "doc_id", "left").withColumn("language", F.when(F.coalesce("language", F.lit("")) == "", F.coalesce("_dw_lang", F.lit(""))).otherwise(F.col("language")))
    return out.select(chunks.columns)


def language_samples(elements: DataFrame) -> DataFrame:
    """``doc_id, sample``: the first 500 characters of each document's text."""
    own = F.concat(F.array("content"), F.coalesce("items", F.array().cast("array<string>")), F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))))
    text = F.array_join(F.filter(own, lambda x: x != ""), "\n")
    one = elements.where("ord is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.substring(text, 1, 500).alias("t")))).alias("x"))
    return one.select("doc_id", F.substring(F.array_join(F.filter(F.transform("x", lambda v: v["t"]), lambda t: t != ""), "\n"), 1, 500).alias("sample"))


def _finding(code: str, severity: str, message: Column | str) -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), m.alias("message"))


def token_bounds(cfg: Validation = Validation()) -> Column:
    n = F.col("token_count")
    note = lambda s: F.concat(n.cast("string"), F.lit(s))
    over = _finding("OVERSIZED", "warning", note(" tokens, above 700")) if cfg.flag_oversized else F.lit(None)
    under = _finding("UNDERSIZED", "warning", note(" tokens, below 250")) if cfg.flag_undersized else F.lit(None)
    return F.when(n > 700, over).when(n < 250, under).when(~n.between(450, 550), _finding("NON_IDEAL_SIZE", "info", note(" tokens, outside 450 to 550")))


def _text_lines() -> Column:
    return F.filter(F.transform(T.lines("text"), T.strip), lambda x: x != "")


def truncated_start() -> Column:
    first = F.get(_text_lines(), 0)
    return F.when(first.rlike("^[a-z]"), _finding("POSSIBLE_TRUNC_START", "warning", "begins with a small letter"))


def truncated_end() -> Column:
    last = F.try_element_at(_text_lines(), F.lit(-1))
    return F.when(last.rlike(r"(?U)\w$") & ~F.substring(last, 1, 1).isin("#", "|", "-"), _finding("POSSIBLE_TRUNC_END", "warning", "ends without punctuation"))


def empty_heading() -> Column:
    return F.when(F.exists(F.slice(_text_lines(), 1, 3), lambda x: x.rlike("^#[# ]*$")), _finding("EMPTY_HEADING", "error", "a heading has no text"))


def incomplete_metadata() -> Column:
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in ("id", "document_id", "filename", "chapter", "section", "language")] + [F.when(F.coalesce(F.col(c), F.lit(0)) <= 0, c) for c in ("token_count", "total_chunk")]
    names = F.array_compact(F.array(*missing))
    return F.when(F.size(names) > 0, _finding("INCOMPLETE_METADATA", "warning", F.concat(F.lit("missing: "), F.array_join(names, ", "))))


def duplicate() -> Column:
    """Only the second of equal chunks of a document is marked."""
    rank = F.row_number().over(Window.partitionBy("doc_id", T.signature("text")).orderBy("chunk_index"))
    return F.when(rank == 2, _finding("DUPLICATE", "warning", "equals an earlier chunk"))


PENALTY = {"OVERSIZED": 15, "UNDERSIZED": 8, "NON_IDEAL_SIZE": 3, "POSSIBLE_TRUNC_START": 10, "POSSIBLE_TRUNC_END": 10, "EMPTY_HEADING": 20, "INCOMPLETE_METADATA": 5, "DUPLICATE": 12}


def validate(chunks: DataFrame, cfg: Validation = Validation()) -> DataFrame:
    """``doc_id, chunk_id, quality_score, findings`` of every chunk; switched off, all have 100 and none."""
    if not cfg.enabled:
        return chunks.select("doc_id", F.col("id").alias("chunk_id"), F.lit(100).alias("quality_score"), F.array().cast(f"array<{FINDING}>").alias("findings"))
    checks = [token_bounds(cfg), truncated_start(), truncated_end(), empty_heading(), incomplete_metadata()] + ([duplicate()] if cfg.flag_duplicate else [])
    names = [f"_dw_f{i}" for i in range(len(checks))]
    found = chunks.select("*", *[c.cast(FINDING).alias(n) for c, n in zip(checks, names)]).withColumn("findings", F.array_compact(F.array(*names)))
    cost = F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv])
    lost = F.aggregate("findings", F.lit(0), lambda s, f: s + F.element_at(cost, f["code"]))
    return found.select("doc_id", F.col("id").alias("chunk_id"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).alias("quality_score"), "findings")


def warnings(findings: Column | str = "findings") -> Column:
    return F.filter(findings, lambda f: f["severity"].isin("warning", "error"))


def recommendations(findings: Column | str = "findings") -> Column:
    return F.filter(findings, lambda f: f["severity"] == "info")
