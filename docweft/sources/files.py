"""Files by extension, documents from files, chunks from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elements, html, office

NATIVE = ("pdf", "docx", "xlsx", "xlsm", "csv", "tsv", "html", "htm", "md", "markdown", "txt")
EXTRA = ("pptx", "png", "jpg", "jpeg")  # with the optional layout parser only
SUPPORTED = NATIVE + EXTRA


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_supported(path: Column | str) -> Column:
    return extension(path).isin(*SUPPORTED)


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def discover(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime, ext`` of supported files under a path, in order of path; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    return found.where(is_supported("path")).withColumn("ext", extension("path")).orderBy("path")


def group_by_extension(paths: DataFrame) -> DataFrame:
    """``ext, paths, n``."""
    return paths.groupBy(extension("path").alias("ext")).agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count("*").alias("n"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, filename, ext, content`` of supported files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.where(is_supported("path")).select("path", file_name("path").alias("filename"), extension("path").alias("ext"), "content")


def parse(files: DataFrame, parser: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Elements of ``path, filename, ext, content``, and ``path, error`` of files that can't be read.

    ``doc_id`` is the path; two files of one name stay two documents. Bytes of text files that are no UTF-8 read as U+FFFD. Each format is a branch of one union, so a run over
    one format plans the others away on empty inputs.
    """
    if parser not in ("auto", "native", "docling"):
        raise ValueError(f"no parser {parser!r}")
    docs = files.select(F.col("path").alias("doc_id"), "filename", "ext", "content")
    text = docs.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")
    plain = elements.parse_txt(text.where("ext = 'txt'"))
    marked = elements.parse_markdown(text.where("ext in ('md', 'markdown')"))
    pages = html.parse_html(text.where("ext in ('html', 'htm')"), "doc_id", "text")
    binary = office.parse_binary(docs.where("ext in ('docx', 'xlsx', 'xlsm', 'csv', 'tsv')"))
    lined = office.pdf_lines(docs.where("ext = 'pdf'"))
    paged = office.pdf_elements(lined.where("error is null").drop("error"))
    good = binary.where("error is null").select(*elements.NAMES)
    unread = docs.where(~F.col("ext").isin(*NATIVE)).select("doc_id", F.lit("no parser for this format").alias("error"))
    failed = lambda x: x.where("error is not null").select("doc_id", "error")
    errors = failed(binary).unionByName(failed(lined)).unionByName(unread)
    return plain.unionByName(marked).unionByName(pages).unionByName(good).unionByName(paged), errors.withColumnRenamed("doc_id", "path")


_CHUNK = "id string, text string, metadata struct<id:string,document_id:string,filename:string,page_start:int,page_end:int,chapter:string,section:string,chunk_index:int,total_chunk:int,token_count:int,word_count:int,language:string,block_type:string>, validation struct<quality_score:int>"


def read_chunks(spark: SparkSession, path: str, min_quality: int = 0) -> DataFrame:
    """Chunks of JSON lines, flat. A missing score counts as 100, missing metadata as its default."""
    return flatten_chunks(spark.read.schema(_CHUNK).json(path), min_quality)


def flatten_chunks(rows: DataFrame, min_quality: int = 0) -> DataFrame:
    if min_quality > 0:
        rows = rows.where(F.coalesce("validation.quality_score", F.lit(100)) >= min_quality)
    from docweft.operators.vectors import METADATA

    return rows.select(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(F.col(f"metadata.{c}"), F.lit(d)).alias(c) for c, d in METADATA.items()])


