"""Headings by pattern, parents by windows, semantic blocks by one grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T

_PATTERNS = ((r"(?iU)^\s*BAB\s+[IVXLCDM]+\b", 1), (r"(?iU)^\s*(?:LAMPIRAN|ATURAN\s+PERALIHAN)\b", 1), (r"(?iU)^\s*BAGIAN\b", 2), (r"(?iU)^\s*PASAL\s+\d+\b", 2), (r"(?iU)^\s*PASAL\s+[IVXLCDM]+\b", 2))
LEVELS = range(1, 10)
ATOMIC = ("table", "bullet_list", "numbered_list", "caption", "image_caption")


def pattern_level(x: Column | str) -> Column:
    """Level of a regulation heading (its first line, at most 80 characters), else null."""
    line = T.strip(F.substring_index(T.strip(x), "\n", 1))
    out = F.when(F.length(line) > 80, None)
    for pattern, level in _PATTERNS:
        out = out.when(line.rlike(pattern), level)
    return out.cast("int")


def _pieces(content: Column) -> Column:
    """Lines folded into ``text, level``: a regulation heading alone, what stands between headings as one."""

    def step(done: Column, x: Column) -> Column:
        level = pattern_level(x)

        def add(n: Column) -> Column:
            joins = n.isNull() & (F.size(done) > 0) & F.try_element_at(done, F.lit(-1))["level"].isNull()
            longer = F.struct(F.concat_ws("\n", F.try_element_at(done, F.lit(-1))["text"], x).alias("text"), n.alias("level"))
            fresh = F.concat(done, F.array(F.struct(x.alias("text"), n.alias("level"))))
            return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(fresh)

        return T.let(level, add)

    empty = F.array().cast("array<struct<text:string,level:int>>")
    parts = F.aggregate(F.split(content, "\n"), empty, step)
    return F.filter(F.transform(parts, lambda p: F.struct(T.strip(p["text"]).alias("text"), p["level"].alias("level"))), lambda p: p["text"] != "")


def promote_headings(e: DataFrame) -> DataFrame:
    """Paragraphs split at lines that are regulation headings; ``ord`` is numbered anew."""
    maybe = F.coalesce((F.col("type") == "paragraph") & F.exists(T.lines("content"), lambda x: pattern_level(x).isNotNull()), F.lit(False))
    whole = F.array(F.struct(F.col("content").alias("text"), F.col("level").cast("int").alias("level")))
    part = e.withColumn("_dw_split", maybe).select("*", F.posexplode(F.when(maybe, _pieces(F.col("content"))).otherwise(whole)).alias("_dw_part", "_dw_x"))
    kind = F.when(~F.col("_dw_split"), F.col("type")).when(F.col("_dw_x.level").isNotNull(), "heading").otherwise("paragraph")
    part = part.withColumn("type", kind).withColumn("content", F.col("_dw_x.text")).withColumn("level", F.col("_dw_x.level"))
    return part.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "_dw_part")) - 1).select(e.columns)


def parents(e: DataFrame) -> DataFrame:
    """``e`` with ``parent``: of a heading the nearest earlier heading of a smaller level, of all else the latest heading."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    heading = (F.col("type") == "heading") & F.col("level").isNotNull()
    at = {n: F.last(F.when(heading & (F.col("level") == n), F.col("ord")), ignorenulls=True).over(before) for n in LEVELS}
    latest = F.last(F.when(heading, F.col("ord")), ignorenulls=True).over(before)
    above = F.lit(None).cast("int")
    for n in reversed(LEVELS):
        lower = [at[m] for m in LEVELS if m < n]
        above = F.when(F.col("level") == n, F.greatest(*lower) if len(lower) > 1 else lower[0] if lower else F.lit(None).cast("int")).otherwise(above)
    return e.withColumn("parent", F.when(heading, above).otherwise(latest))


def context(e: DataFrame) -> DataFrame:
    """``e`` with ``chapter`` and ``section`` in force at each element."""
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = (F.col("type") == "heading") & F.col("level").isNotNull()
    title = T.strip("content")
    chapter = F.last(F.when(heading & (F.col("level") <= 1), title), ignorenulls=True).over(so_far)
    return e.withColumn("chapter", chapter).withColumn("section", F.last(F.when(heading, title), ignorenulls=True).over(so_far))


def blocks(e: DataFrame) -> DataFrame:
    """``doc_id, block, block_type, title, level, chapter, section, page_start, page_end, elements`` in order of ``block``.

    A heading and what stands directly under it are a block, unless it has nothing but headings below. What
    comes before the first heading makes blocks of its own.
    """
    heading = (F.col("type") == "heading") & F.col("level").isNotNull()
    p = context(parents(e)).withColumn("_dw_h", heading)
    # A heading has headings below it if and only if the next heading is of a greater level.
    later = Window.partitionBy("doc_id").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_dw_subs", F.col("_dw_h") & (F.last(F.when(F.col("_dw_h"), F.col("level")), ignorenulls=True).over(later) > F.col("level")))
    key = F.when(F.col("_dw_h"), F.col("ord")).otherwise(F.coalesce("parent", "ord")).alias("block")
    x = F.struct("ord", "type", "content", "page_start", "items", "rows")
    head = lambda c: F.max(F.when(F.col("_dw_h"), F.col(c)))
    g = p.select("*", key).groupBy("doc_id", "block").agg(
        F.max("_dw_h").alias("headed"), F.max(F.coalesce("_dw_subs", F.lit(False))).alias("has_subs"), head("content").alias("title"), head("level").alias("level"), F.first("chapter").alias("chapter"), F.first("section").alias("section"),
        F.min_by("page_start", "ord").alias("page_start"), F.min_by("page_end", "ord").alias("page_end"), F.min_by("type", "ord").alias("type"),
        F.array_sort(F.collect_list(F.when(~F.col("_dw_h"), x))).alias("elements"),
    )
    g = g.where((F.col("headed") & ((F.size("elements") > 0) | ~F.col("has_subs"))) | (~F.col("headed") & (F.col("type").isin(*ATOMIC) | ~T.is_blank(F.element_at("elements", 1)["content"]))))
    kind = F.when(F.col("headed"), "heading").when(F.col("type").isin(*ATOMIC), F.col("type")).otherwise("paragraph")
    return g.select("doc_id", "block", kind.alias("block_type"), T.strip("title").alias("title"), "level", "chapter", "section", "page_start", "page_end", "elements")


def render(x: Column) -> Column:
    """An element as text: lists with marks, tables with bars."""
    items = F.when(x["type"] == "numbered_list", F.transform(x["items"], lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v))).otherwise(F.transform(x["items"], lambda v: F.concat(F.lit("- "), v)))
    rows = F.transform(F.filter(x["rows"], lambda r: F.size(r) > 0), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, T.strip), " | "), F.lit(" |")))
    return F.when(x["type"].isin("bullet_list", "numbered_list"), F.array_join(items, "\n")).when(x["type"] == "table", F.array_join(rows, "\n")).otherwise(x["content"])


def block_text() -> Column:
    """Title and rendered elements of a block, line by line."""
    return F.array_join(F.filter(F.concat(F.array(F.coalesce("title", F.lit(""))), F.transform("elements", render)), lambda s: s != ""), "\n")
