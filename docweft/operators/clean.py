"""Cleaning rules over the element table, in their fixed order; blank leaves go after every rule."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.config import Cleaning
from docweft.functions import text as T
from docweft.functions.lineage import cut


def prune(e: DataFrame) -> DataFrame:
    """Without blank elements, items and cells; tables and page breaks stay."""
    e = e.withColumn("items", F.filter("items", lambda x: ~T.is_blank(x))).withColumn("rows", F.transform("rows", lambda r: F.filter(r, lambda x: ~T.is_blank(x))))
    return e.where(~T.is_blank("content") | F.col("type").isin("document", "table", "page_break") | (F.coalesce(F.size("items"), F.lit(0)) > 0))


def on_leaves(e: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """``fn`` on content, items and cells."""
    return e.withColumn("content", fn(F.col("content"))).withColumn("items", F.transform("items", fn)).withColumn("rows", F.transform("rows", lambda r: F.transform(r, fn)))


def everywhere(e: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """``fn`` on content, items and cells, then pruned."""
    return prune(on_leaves(e, fn))


def _unicode(e: DataFrame) -> DataFrame:
    return e.withColumn("content", T.normalize_unicode("content")).withColumn("items", T.normalize_items("items")).withColumn("rows", T.normalize_rows("rows"))


def unicode_everywhere(e: DataFrame) -> DataFrame:
    """NFC and no control characters."""
    return prune(_unicode(e))


def _without_page_lines(content: Column) -> Column:
    def body(c: Column) -> Column:
        kept = lambda ls: F.filter(ls, lambda x: ~T.is_page_number_line(x))
        return T.let(T.lines(c), lambda ls: T.let(kept(ls), lambda k: F.when(F.size(k) < F.size(ls), T.strip(F.array_join(k, "\n"))).otherwise(c)))

    return T.let(content, lambda c: F.when(T.may_have_page_lines(c), body(c)).otherwise(c))


def _page_numbers(e: DataFrame) -> DataFrame:
    content = F.when(F.col("type") == "paragraph", _without_page_lines(F.col("content"))).otherwise(F.col("content"))
    return on_leaves(e.withColumn("content", content), lambda x: T.strip(T.strip_page_markers(x)))


def page_numbers(e: DataFrame) -> DataFrame:
    """Lines that are page numbers, in paragraphs; "page 3 of 12" within any text."""
    return prune(_page_numbers(e))


#: Numbers of ``ord`` whose pages one task counts, and bytes of lines that are sent to every executor; more are joined by a shuffle.
STRETCH, BROADCAST_BYTES = 4096, 8 << 20


def _pages(e: DataFrame) -> DataFrame:
    """``e`` with ``page``, the page breaks of its document up to it. Stretches of ``ord`` count theirs, then are raised by those before, so no task takes a whole document."""
    e = e.withColumn("_dw_at", F.coalesce(F.floor(F.col("ord") / STRETCH), F.lit(-(1 << 62)))).withColumn("_dw_b", (F.col("type") == "page_break").cast("int"))
    sums = e.groupBy("doc_id", "_dw_at").agg(F.sum("_dw_b").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("_dw_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(F.col("doc_id").alias("_dw_doc"), F.col("_dw_at").alias("_dw_to"), before.alias("_dw_base"))
    own = F.sum("_dw_b").over(Window.partitionBy("doc_id", "_dw_at").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    j = e.withColumn("page", own).join(base, F.col("doc_id").eqNullSafe(F.col("_dw_doc")) & (F.col("_dw_at") == F.col("_dw_to")))
    return j.withColumn("page", F.col("page") + F.col("_dw_base")).drop("_dw_at", "_dw_b", "_dw_doc", "_dw_to", "_dw_base")


def boilerplate_lines(e: DataFrame, header: bool = True, share: float = 0.5) -> DataFrame:
    """``doc_id, lines``: what stands among the first (or last) two lines of enough pages of a document. Of an element, only the two lines that may count are exchanged, and none of 200 characters or more."""
    some = lambda x: F.when(F.coalesce(F.length(x), F.lit(0)) > 0, T.lines(x)).otherwise(F.array().cast("array<string>"))
    cells = F.flatten(F.transform(F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))), some))
    own = F.concat(some(F.col("content")), F.flatten(F.transform(F.coalesce("items", F.array().cast("array<string>")), some)), cells)
    two = T.let(own, lambda x: F.slice(x, 1, 2) if header else F.slice(x, F.greatest(F.lit(1), F.size(x) - 1), F.lit(2)))
    short = F.transform(two, lambda x: T.let(T.strip(x), lambda s: F.when((s != "") & (F.length(s) < 200), s)))
    paged = _pages(e.select("doc_id", "ord", "type", short.alias("own"))).where("type <> 'page_break'")
    line = paged.select("doc_id", "page", "ord", F.posexplode("own").alias("at", "line"))
    place = [F.col("ord"), F.col("at")] if header else [F.col("ord").desc(), F.col("at").desc()]
    line = line.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*place))).where("n <= 2")
    pages = line.where("n = 1").groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 2")
    count = line.where("line is not null").groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 2").join(pages, "doc_id")
    return count.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(share)))).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def repeated_lines(e: DataFrame, header: bool = True, share: float = 0.5) -> DataFrame:
    """Headers (or footers) that repeat from page to page, cut from every element of their document."""
    found = cut(boilerplate_lines(e, header, share))
    size = found.agg(F.sum(F.octet_length(F.array_join("lines", "\n")) + 64)).first()[0] or 0
    kept = lambda x: T.strip(F.array_join(F.filter(T.lines(x), lambda y: ~F.array_contains("lines", T.strip(y))), "\n"))
    j = e.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "doc_id", "left")  # a few documents are few keys to shuffle by
    out = j.withColumn("content", F.when(F.col("lines").isNotNull() & (F.col("content") != ""), kept(F.col("content"))).otherwise(F.col("content")))
    out = out.withColumn("items", F.when(F.col("lines").isNotNull(), F.transform("items", kept)).otherwise(F.col("items")))
    out = out.withColumn("rows", F.when(F.col("lines").isNotNull(), F.transform("rows", lambda r: F.transform(r, kept))).otherwise(F.col("rows")))
    return prune(out.select(e.columns))


def repeated_headings(e: DataFrame, times: int = 3) -> DataFrame:
    """A heading that a document has at least ``times`` times stays at its first place only."""
    norm = F.when(F.col("type") == "heading", F.lower(F.regexp_replace(T.strip("content"), r"(?U)\s+", " ")))
    e2 = e.withColumn("_dw_norm", norm)
    w = Window.partitionBy("doc_id", "_dw_norm")
    e2 = e2.withColumn("_dw_n", F.count("*").over(w)).withColumn("_dw_rn", F.row_number().over(w.orderBy("ord")))
    return e2.where(F.col("_dw_norm").isNull() | (F.col("_dw_norm") == "") | (F.col("_dw_n") < times) | (F.col("_dw_rn") == 1)).select(e.columns)


def clean(e: DataFrame, cfg: Cleaning = Cleaning(), paged: bool | None = None) -> DataFrame:
    """All rules that are switched on.

    Documents without page breaks have no headers or footers, and those of texts, Markdown, HTML and tables never
    have one. ``paged`` tells whether any has; where it isn't known, the table is written once and asked. Only with page breaks do
    the two rules run, over a table written once before each.
    """
    if cfg.fix_invalid_unicode:
        e = _unicode(e)
    if cfg.fix_broken_ocr:
        e = on_leaves(e, T.fix_broken_ocr)
    if cfg.remove_page_numbers:
        e = _page_numbers(e)
    if cfg.fix_invalid_unicode or cfg.fix_broken_ocr or cfg.remove_page_numbers:
        e = prune(e)  # none of the three fills a blank leaf, so once is as good as after each
    if (cfg.remove_repeated_headers or cfg.remove_repeated_footers) and paged is not False:
        e = cut(e)
        if paged or e.where("type = 'page_break'").limit(1).count():
            if cfg.remove_repeated_headers:
                e = cut(repeated_lines(e, True))
            if cfg.remove_repeated_footers:
                e = repeated_lines(e, False)
    e = repeated_headings(e)
    final = [f for on, f in ((cfg.collapse_whitespace, T.collapse_whitespace), (cfg.collapse_blank_lines, lambda x: T.collapse_blank_lines(x))) if on]
    return everywhere(e, lambda x: reduce(lambda y, f: f(y), final, x)) if final else e
