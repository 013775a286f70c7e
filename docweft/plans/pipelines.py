"""Documents to chunks, chunks to vectors, questions to answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.config import Config
from docweft.functions import text as T
from docweft.functions import tokens
from docweft.functions.lineage import cut, small_batches
from docweft.operators import chunk, clean, embed, export, generate, hierarchy, validate, vectors
from docweft.sources import elements, files


@dataclass
class Processed:
    """What a run over documents gives. Elements are written once; the rest is lazy."""

    elements: DataFrame
    blocks: DataFrame
    chunks: DataFrame
    validations: DataFrame
    errors: DataFrame | None = None

    def summary(self) -> DataFrame:
        """``documents, chunks, mean_score, failed``."""
        # Every chunk has one validation, so these alone tell all and the chunks are made once.
        docs = self.validations.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.round(F.avg("quality_score"), 4).alias("mean_score"))
        failed = self.errors.agg(F.count("*").alias("failed")) if self.errors is not None else docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("failed"))
        return docs.crossJoin(failed)


def from_elements(e: DataFrame, names: DataFrame | None = None, cfg: Config = Config(), paged: bool | None = None) -> Processed:
    """Cleaning, hierarchy, blocks, chunks, metadata and validation of an element table; ``paged`` tells whether it has page breaks."""
    small_batches(e.sparkSession)
    tree = cut(hierarchy.promote_headings(clean.clean(e, cfg.cleaning, paged)))  # read for blocks and for language samples
    blocks = hierarchy.blocks(tree)
    chunks = chunk.chunks(blocks, names, cfg.chunking)
    chunks = validate.enrich(chunks, validate.language_samples(tree), cfg.metadata, tokens.counter(cfg.chunking.encoding))
    return Processed(tree, blocks, chunks, validate.validate(chunks, cfg.validation))


def process_texts(docs: DataFrame, cfg: Config = Config(), markdown: bool = False) -> Processed:
    """``doc_id, text[, filename]`` as plain text or Markdown."""
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    names = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "filename") if "filename" in docs.columns else None
    return from_elements(elements.parse_markdown(own) if markdown else elements.parse_txt(own), names, cfg, paged=False)


def process(spark: SparkSession, path: str, cfg: Config = Config()) -> Processed:
    """All supported files under a path; files that can't be read are in ``errors``."""
    raw = files.read_files(spark, path)
    e, errors = files.parse(raw, cfg.parsing.parser)
    paged = bool(raw.where("ext = 'pdf'").limit(1).count())
    done = from_elements(e, raw.select(F.col("path").alias("doc_id"), "filename"), cfg, paged)
    done.errors = errors
    return done


def run(spark: SparkSession, path: str, cfg: Config = Config()) -> tuple[Processed, str]:
    """Process and export."""
    done = process(spark, path, cfg)
    return done, export.write(done.chunks, done.validations, cfg.export)


def embedded(chunks: DataFrame, cfg: Config = Config(), keep: bool = False) -> DataFrame:
    """Flat records with their vectors; ``keep`` writes the records first, for a search that isn't made of the store reads them twice."""
    flat = cut(vectors.flatten(chunks)) if keep else vectors.flatten(chunks)
    return flat.withColumn("embedding", embed.get_embedder(cfg.embedding)(F.col("text")))


def index(spark: SparkSession, source: str, cfg: Config = Config(), min_quality: int = 0) -> int:
    """Chunks of files, or of JSON lines (to which alone ``min_quality`` applies), into the store; the number put there."""
    chunks = files.read_chunks(spark, source, min_quality) if source.lower().endswith(".jsonl") else process(spark, source, cfg).chunks
    return vectors.Store(spark, cfg.store.path, cfg.store.collection).upsert(embedded(chunks, cfg))


def index_upload(spark: SparkSession, filename: str, content: bytes, cfg: Config = Config()) -> tuple[int, list[str]]:
    """Chunks of one file's bytes into the store: the number put there, and what went wrong. The file is known by its name."""
    ext = filename.rsplit(".", 1)[-1].lower() if "." in filename else ""
    raw = spark.createDataFrame([(filename, filename, ext, bytearray(content))], "path string, filename string, ext string, content binary")
    e, errors = files.parse(raw, cfg.parsing.parser)
    done = from_elements(e, raw.select(F.col("path").alias("doc_id"), "filename"), cfg, ext == "pdf")
    n = vectors.Store(spark, cfg.store.path, cfg.store.collection).upsert(embedded(done.chunks, cfg))
    return n, [f"{r.path}: {r.error}" for r in errors.collect()]


def stats(spark: SparkSession, cfg: Config = Config()) -> dict:
    store = vectors.Store(spark, cfg.store.path, cfg.store.collection)
    return {"collection": cfg.store.collection, "total_chunks": store.count(), "collections": store.list_collections(), "embedding_provider": cfg.embedding.provider, "embedding_model": cfg.embedding.model}


def retrieve(records: DataFrame, questions: DataFrame, cfg: Config = Config(), top_k: int | None = None, threshold: float | None = None, document_id: str | None = None) -> DataFrame:
    """Hits of ``query_id, question`` among records, with text and metadata of the winners."""
    q = questions.withColumn("embedding", embed.get_embedder(cfg.embedding)(F.col("question")))
    pool = records.where(F.col("document_id") == document_id) if document_id else records
    best = vectors.retrieve(pool, q, top_k, threshold, cfg.retrieval.top_k, cfg.retrieval.score_threshold)
    return best.join(records.drop("embedding"), "id")


def answer(records: DataFrame, questions: DataFrame, cfg: Config = Config(), **more) -> DataFrame:
    """An answer for every question, from the model where there are hits."""
    hits = retrieve(records, questions, cfg, **more)
    return generate.answers(generate.prompts(questions, hits), generate.get_llm(cfg.llm), cfg.llm.model)


def document_ids(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.document_id("doc_id").alias("document_id"))
