"""Tables as text: rows in batches, each row a line of "column: value"."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions.lineage import cut

BATCH_CHARS, SAMPLE_ROWS, MOST, HARD_MOST = 1600, 50, 50, 200
DELIMITERS = (",", ";", "\t", "|")
ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252")


#: What reads as an empty cell.
EMPTY = frozenset(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])


def encoding(head: bytes) -> str:
    """The first encoding that the beginning of a file fits, which may end within a character."""
    return next((e for e in ENCODINGS if _decodes(head, e)), "latin-1")


def _decodes(head: bytes, name: str) -> bool:
    try:
        codecs.getincrementaldecoder(name)().decode(head)
    except UnicodeDecodeError:
        return False
    return True


def read_rows(text: str, sep: str | None = None) -> list[list[str]]:
    """Header and rows of a delimited text, by the first delimiter under which no row is wider than the header and the first row.

    A comma that never comes makes a table of one column. Under a header of several columns, a first row that is wider has columns
    without a name in front, which are dropped. Rows are filled up to the header; blank lines don't count. Columns without a name
    are numbered, those of one name told apart.
    """
    text = text.removeprefix("\ufeff")
    for d in (sep,) if sep else DELIMITERS:
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=d) if r]
        if not rows:
            return []
        wide = max(map(len, rows[:2])) if len(rows[0]) > 1 else 1
        if all(len(r) <= wide for r in rows):
            break
    else:
        try:
            guess = csv.Sniffer().sniff(text[:65536]).delimiter if not sep else sep
        except csv.Error as e:
            raise ValueError(f"no delimiter fits: {e}") from None
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=guess) if r]
        wide = max(map(len, rows[:2]))
        if any(len(r) > wide for r in rows):
            raise ValueError(f"a row has more than {wide} columns")
    names: list[str] = []
    seen: dict[str, int] = {}
    for i, c in enumerate(rows[0]):
        c = c or f"Unnamed: {i}"
        n = seen[c] = seen.get(c, -1) + 1
        names.append(f"{c}.{n}" if n else c)
    extra = wide - len(names)
    return [names, *([*r[extra:], *[""] * (wide - len(r))] for r in rows[1:])]


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """All columns as text, ``_pos`` the rows' order within the file."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding=encoding).withColumn("_pos", F.monotonically_increasing_id())


def narrative(columns: Sequence[str]) -> Column:
    """``a: 1 | b: 2`` of a row, without columns that are empty."""
    parts = [F.when(T.strip(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), T.strip(F.col(c).cast("string")))) for c in columns]
    return F.concat_ws(" | ", *parts)


def batch_size(rows: DataFrame, columns: Sequence[str], order: str, most: int = MOST) -> DataFrame:
    """``size``: rows a batch so that a batch has about 1600 characters, from the first rows in order."""
    width = sum((F.length(F.lit(c)) + 3 + F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) + 3 for c in columns), F.lit(0))
    sample = rows.orderBy(order).limit(SAMPLE_ROWS).select(width.alias("w"))
    size = F.least(F.greatest(F.lit(1), F.floor(F.lit(float(BATCH_CHARS)) / F.avg("w"))), F.lit(most), F.lit(HARD_MOST))
    return sample.agg(F.coalesce(size, F.lit(1)).cast("int").alias("size"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``_row``, 1-based in order, without one task for all rows: ranges count, then are raised.

    The ranges' borders are drawn from a sample, another one each time they are made, so both readings are of ranges written once.
    """
    parts = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").count()
    base = counts.withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("_at", at).join(F.broadcast(base), "_part").withColumn("_row", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def batches(rows: DataFrame, columns: Sequence[str], order: str, most: int = MOST) -> DataFrame:
    """``batch, first_row, last_row, total, label, content`` of a table in order of a column without ties."""
    size = batch_size(rows, columns, order, most).first()["size"]
    total = rows.count()
    line = numbered(rows.select(narrative(columns).alias("line"), order), order).withColumn("batch", F.ceil(F.col("_row") / size).cast("int"))
    g = line.groupBy("batch").agg(F.min("_row").alias("first_row"), F.max("_row").alias("last_row"), F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("_row", "line")))).alias("x"))
    label = F.concat(F.lit("Batch "), F.col("batch").cast("string"), F.lit(": baris "), F.col("first_row").cast("string"), F.lit("-"), F.col("last_row").cast("string"), F.lit(f" dari {total}"))
    return g.select("batch", "first_row", "last_row", F.lit(total).cast("bigint").alias("total"), label.alias("label"), F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("content"))


def table_elements(rows: DataFrame, doc_id: str, columns: Sequence[str], order: str, as_table: bool = False) -> DataFrame:
    """Elements of one table: its name as heading, then for each batch a heading and a paragraph (or a table with a header row)."""
    spark = rows.sparkSession
    b = batches(rows, columns, order)
    no = {"items": F.expr("cast(null as array<string>)"), "rows": F.expr("cast(null as array<array<string>>)")}
    if as_table:
        size = batch_size(rows, columns, order).first()["size"]
        cells = F.array(*[F.coalesce(T.strip(F.col(c).cast("string")), F.lit("")) for c in columns])
        t = numbered(rows, order).select(F.ceil(F.col("_row") / size).cast("int").alias("batch"), "_row", cells.alias("cells")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_row", "cells"))).alias("x"))
        b = b.join(t.select("batch", F.concat(F.array(F.array(*map(F.lit, columns))), F.transform("x", lambda v: v["cells"])).alias("cells")), "batch")
    one = F.lit(1)
    head = spark.range(1).select(F.lit(doc_id).alias("doc_id"), F.lit(0).alias("ord"), F.lit("heading").alias("type"), F.regexp_replace(F.regexp_extract(F.lit(doc_id), r"([^/\\]*)$", 1), r"\.[^.]*$", "").alias("content"), one.alias("level"), one.alias("page_start"), one.alias("page_end"), no["items"].alias("items"), no["rows"].alias("rows"))
    sub = b.select(F.lit(doc_id).alias("doc_id"), (2 * F.col("batch") - 1).alias("ord"), F.lit("heading").alias("type"), F.col("label").alias("content"), F.lit(2).alias("level"), one.alias("page_start"), one.alias("page_end"), no["items"].alias("items"), no["rows"].alias("rows"))
    body = b.where("content <> ''" if not as_table else "true").select(F.lit(doc_id).alias("doc_id"), (2 * F.col("batch")).alias("ord"), F.lit("table" if as_table else "paragraph").alias("type"), (F.lit("") if as_table else F.col("content")).alias("content"), F.lit(None).cast("int").alias("level"), one.alias("page_start"), one.alias("page_end"), no["items"].alias("items"), (F.col("cells") if as_table else no["rows"]).alias("rows"))
    return head.unionByName(sub).unionByName(body)
