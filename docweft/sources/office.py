"""DOCX, XLSX and CSV files from their bytes, PDF from its spans; all in Arrow batches, errors as rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T

from . import elements, pdf, tabular

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _element(kind: str, content: str = "", level: int | None = None, items: list | None = None, rows: list | None = None) -> dict:
    return {"type": kind, "content": content, "level": level, "items": items, "rows": rows, "page_start": 1, "page_end": 1}


def _runs(p: ElementTree.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
        elif x.tag == _W + "tab":
            out.append("\t")
    return "".join(out)


def docx(content: bytes) -> list[dict]:
    """Headings by style, one list an item, tables; in body order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
                name = s.find(_W + "name")
                names[s.get(_W + "styleId")] = (name.get(_W + "val") if name is not None else "") or ""
    out = []
    for x in body if body is not None else ():
        if x.tag == _W + "tbl":
            rows = [["\n".join(_runs(p) for p in c.iter(_W + "p")).strip() for c in r.findall(_W + "tc")] for r in x.findall(_W + "tr")]
            rows = [r for r in rows if r]
            if rows:
                out.append(_element("table", rows=rows))
        elif x.tag == _W + "p":
            style = x.find(f"{_W}pPr/{_W}pStyle")
            style = style.get(_W + "val", "") if style is not None else ""
            style = names.get(style, style).lower()
            text = _runs(x).strip()
            if not text:
                continue
            if style.startswith("heading"):
                digits = re.sub(r"\D", "", style)
                out.append(_element("heading", text, int(digits) if digits else 1))
            elif "list" in style or x.find(f"{_W}pPr/{_W}numPr") is not None:
                out.append(_element("numbered_list" if "number" in style else "bullet_list", items=[text]))
            else:
                out.append(_element("paragraph", text))
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(content: bytes) -> list[dict]:
    """A heading and a table for each sheet; blank rows are left out, formulas give their values."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(_S + "si")]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"):
            target = rels[sheet.get(_R + "id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target))
            rows = []
            for r in root.iter(_S + "row"):
                cells: list[str] = []
                for c in r.findall(_S + "c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    v = c.find(_S + "v")
                    value = "".join(t.text or "" for t in c.iter(_S + "t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells.append(strings[int(value)] if c.get("t") == "s" and value else value)
                rows.append(cells)
            wide = max(map(len, rows), default=0)
            rows = [r + [""] * (wide - len(r)) for r in rows if any(c.strip() for c in r)]
            out.append(_element("heading", sheet.get("name") or "", 1))
            if rows:
                out.append(_element("table", rows=[[c.strip() for c in r] for r in rows]))
    return out


def delimited(content: bytes, name: str, sep: str | None = None) -> list[dict]:
    """A CSV file as batches of rows; see ``tabular`` for tables that are too large for one task."""
    data = tabular.read_rows(content.decode(tabular.encoding(content), "replace"), sep)
    if not data:
        raise ValueError("no columns")
    if len(data) == 1:
        return []
    out = [_element("heading", PurePosixPath(name).stem, 1)]
    header, rows = data[0], [["" if v in tabular.EMPTY else v for v in r] for r in data[1:]]
    sample = rows[: tabular.SAMPLE_ROWS]
    width = sum(sum(len(c) + 3 for c in header) + sum(len(v) + 3 for v in r[: len(header)]) for r in sample) / len(sample) if sample else 1
    size = min(max(1, int(tabular.BATCH_CHARS / width)), tabular.MOST, tabular.HARD_MOST)
    for n, lo in enumerate(range(0, len(rows), size), 1):
        hi = min(lo + size, len(rows))
        out.append(_element("heading", f"Batch {n}: baris {lo + 1}-{hi} dari {len(rows)}", 2))
        lines = [" | ".join(f"{c}: {v.strip()}" for c, v in zip(header, r) if v.strip()) for r in rows[lo:hi]]
        if any(lines):
            out.append(_element("paragraph", "\n".join(x for x in lines if x)))
    return out


PARSERS = {"docx": docx, "xlsx": xlsx, "xlsm": xlsx}


def parse_binary(files: DataFrame) -> DataFrame:
    """Elements and ``error`` of ``doc_id, filename, ext, content``; a file that can't be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, name, ext, content in zip(b["doc_id"], b["filename"], b["ext"], b["content"]):
                try:
                    got = delimited(content, name, "\t" if ext == "tsv" else None) if ext in ("csv", "tsv") else PARSERS[ext](content)
                    rows += [{"doc_id": doc, "ord": i, "error": None} | e for i, e in enumerate(got)]
                except Exception as e:  # one bad file must not end the job; its error is a result
                    rows.append(dict.fromkeys(elements.NAMES) | {"doc_id": doc, "error": f"{type(e).__name__}: {e}"})
            if rows:
                yield pd.DataFrame(rows, columns=[*elements.NAMES, "error"]).astype({"ord": "Int32", "level": "Int32", "page_start": "Int32", "page_end": "Int32"})

    return files.select("doc_id", "filename", "ext", "content").mapInPandas(run, elements.SCHEMA + ", error string")


def pdf_lines(files: DataFrame) -> DataFrame:
    """``doc_id, page, line, text, size, error`` of ``doc_id, content``: a row for each line of a PDF, an empty one for a page without text, one row with the error of a file that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, content in zip(b["doc_id"], b["content"]):
                try:
                    rows = [(doc, *x, None) for x in pdf.lines(content)]
                except Exception as e:  # as for other formats
                    rows = [(doc, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "page", "line", "text", "size", "error"]).astype({"page": "Int32", "line": "Int32"})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page int, line int, text string, size double, error string")


def pdf_elements(spans: DataFrame) -> DataFrame:
    """Elements of ``doc_id, page, line, text, size``: lines of a PDF with their largest font size.

    Large short lines are headings (level 1 from 1.6 times the page's upper median, 2 from 1.25 times), list lines are lists of one
    item, page numbers go, other neighbours are one paragraph, and every page ends with a page break.
    """
    by_page = Window.partitionBy("doc_id", "page")
    sizes = F.sort_array(F.collect_list("size").over(by_page))
    line = spans.withColumn("text", T.strip("text")).where("text <> ''").withColumn("median", F.get(sizes, (F.size(sizes) / 2).cast("int")))
    line = line.where(~T.is_pdf_page_number("text"))
    large: Column = (F.col("size") >= 1.25 * F.col("median")) & (F.length("text") <= 120)
    cls = F.when(large, "heading").when(T.list_type("text").isNotNull(), T.list_type("text")).otherwise("paragraph")
    line = line.withColumn("cls", cls).withColumn("level", F.when(large, F.when(F.col("size") >= 1.6 * F.col("median"), 1).otherwise(2)))
    order = by_page.orderBy("line")
    fresh = (F.col("cls") != "paragraph") | (F.lag("cls", 1, "").over(order) != "paragraph")
    line = line.withColumn("run", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = line.groupBy("doc_id", "page", "run").agg(F.first("cls").alias("type"), F.first("level").alias("level"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("x"))
    lists = F.col("type").isin("bullet_list", "numbered_list")
    text = F.array_join(F.transform("x", lambda v: v["text"]), "\n")
    g = g.select("doc_id", "page", "run", "type", "level", F.when(lists, "").otherwise(text).alias("content"), F.when(lists, F.array(T.list_item(text))).alias("items"))
    breaks = spans.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(2**31 - 1).alias("run"), F.lit("page_break").alias("type"), F.lit(None).cast("int").alias("level"), F.lit("").alias("content"), F.expr("cast(null as array<string>)").alias("items"))
    both = g.unionByName(breaks)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "run")) - 1
    return both.select("doc_id", number.alias("ord"), "type", "content", F.col("level").cast("int").alias("level"), F.col("page").cast("int").alias("page_start"), F.col("page").cast("int").alias("page_end"), "items", F.expr("cast(null as array<array<string>>)").alias("rows"))
