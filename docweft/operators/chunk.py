"""Blocks to units to chunks.

Units are built by expressions. Packing is a fold whose state is a growing group with a carry, so it runs over
arrays of numbers in Arrow batches: token counts and two flags in, unit indexes out; texts never leave the JVM for it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.config import Chunking
from docweft.functions import text as T
from docweft.functions import tokens

UNIT = "struct<text:string,kind:string,atomic:boolean,page:int>"


def force_split(x: Column, cfg: Chunking) -> Column:
    """Lines of a text; a line above the maximum is cut between words at about the target."""

    def cut(line: Column) -> Column:
        zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"))

        def step(s: Column, w: Column) -> Column:
            n = T.count_tokens(w)
            full = (F.size(s["buf"]) > 0) & (s["n"] + n > cfg.target_tokens)
            return F.struct(
                F.when(full, F.concat(s["done"], F.array(F.array_join(s["buf"], " ")))).otherwise(s["done"]).alias("done"),
                F.when(full, F.array(w)).otherwise(F.concat(s["buf"], F.array(w))).alias("buf"),
                F.when(full, n).otherwise(s["n"] + n).alias("n"),
            )

        close = lambda s: F.when(F.size(s["buf"]) > 0, F.concat(s["done"], F.array(F.array_join(s["buf"], " ")))).otherwise(s["done"])
        return F.aggregate(T.words(line), zero, step, close)

    each = F.filter(F.transform(F.split(x, "\n"), T.strip), lambda v: v != "")
    return F.flatten(F.transform(each, lambda v: F.when(T.count_tokens(v) <= cfg.max_tokens, F.array(v)).otherwise(cut(v))))


def _unit(text: Column, kind: str, atomic: bool, page: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(atomic).alias("atomic"), page.cast("int").alias("page"))


def _none() -> Column:
    return F.array().cast(f"array<{UNIT}>")


def element_units(x: Column, cfg: Chunking, page_start: Column) -> Column:
    """Units of one element."""
    page = F.coalesce(x["page_start"], page_start, F.lit(1))
    body = T.strip(F.coalesce(x["content"], F.lit("")))
    items = F.filter(x["items"], lambda v: ~T.is_blank(v))
    marked = F.when(x["type"] == "numbered_list", F.transform(items, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v))).otherwise(F.transform(items, lambda v: F.concat(F.lit("- "), v)))
    rows = F.transform(F.filter(x["rows"], lambda r: F.size(r) > 0), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, T.strip), " | "), F.lit(" |")))
    forced = lambda v: F.transform(force_split(v, cfg), lambda p: _unit(p, "paragraph", False, page))
    one = F.when(T.count_tokens(body) > cfg.max_tokens, forced(body)).otherwise(F.array(_unit(body, "paragraph", False, page)))
    many = lambda xs: F.flatten(F.transform(xs, lambda v: F.when(T.count_tokens(v) > cfg.max_tokens, forced(v)).otherwise(F.array(_unit(v, "sentence", False, page)))))
    return (
        F.when(x["type"] == "heading", F.when(body != "", F.array(_unit(body, "heading", True, F.lit(None)))).otherwise(_none()))
        .when(x["type"].isin("bullet_list", "numbered_list"), F.when(F.size(items) > 0, F.array(_unit(F.array_join(marked, "\n"), "list", True, page))).otherwise(_none()))
        .when(x["type"] == "table", F.when(F.size(rows) > 0, F.array(_unit(F.array_join(rows, "\n"), "table", True, page))).otherwise(_none()))
        .when(body == "", _none())
        .when(x["type"].isin("caption", "image_caption"), F.array(_unit(body, "caption", True, page)))
        .otherwise(T.let(T.split_sentences(body), lambda xs: F.when(F.size(xs) <= 1, one).otherwise(many(xs))))
    )


def units(blocks: DataFrame, cfg: Chunking = Chunking()) -> DataFrame:
    """``doc_id, u``: all units of a document in order, each with its page, its block's context and ``n_tok``.

    A block's units stay one array and only blocks are exchanged, so no sentence is a row of its own.
    A vocabulary is no expression, so its counts come from one flat array of texts by document.
    """
    start = F.coalesce("page_start", F.lit(1))
    known = blocks.select(
        "doc_id", "block", F.coalesce("chapter", F.lit("")).alias("chapter"), F.coalesce("section", F.lit("")).alias("section"),
        start.alias("page_start"), F.coalesce("page_end", start).alias("page_end"), "block_type", "title", "elements",
    )
    title = F.when(F.coalesce("title", F.lit("")) != "", F.array(_unit(F.col("title"), "heading", True, F.lit(None)))).otherwise(_none())
    all_units = F.concat(title, F.flatten(F.transform("elements", lambda x: element_units(x, cfg, F.col("page_start")))))
    estimate = T.count_tokens if cfg.encoding == "words" else lambda x: F.lit(0)
    one = lambda v: F.struct(*[v[c].alias(c) for c in ("text", "kind", "atomic", "page")], *map(F.col, ("chapter", "section", "page_start", "page_end", "block_type")), estimate(v["text"]).alias("n_tok"))
    by_block = known.select("doc_id", "block", F.transform(all_units, one).alias("us")).where("size(us) > 0")
    doc = by_block.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "us"))).alias("x")).select("doc_id", F.flatten(F.transform("x", lambda b: b["us"])).alias("u"))
    if cfg.encoding == "words":
        return doc
    counts = tokens.array_counter(cfg.encoding)(F.transform("u", lambda v: v["text"]))
    return doc.withColumn("n", counts).select("doc_id", F.transform("u", lambda v, i: v.withField("n_tok", F.get(F.col("n"), i))).alias("u"))


def pack(n: list[int], atomic: list[bool], heading: list[bool], cfg: Chunking) -> list[list[int]]:
    """Groups of unit indexes: packed up to the maximum, then small neighbours merged."""
    groups: list[list[int]] = []
    cur: list[int] = []
    total = 0
    for i, t in enumerate(n):
        if atomic[i] and (t > cfg.max_tokens or t >= cfg.min_tokens):
            if cur and all(heading[j] for j in cur):
                groups.append([*cur, i])
            else:
                groups += [cur, [i]] if cur else [[i]]
            cur, total = [], 0
            continue
        if cur and heading[i] and (cfg.respect_heading_boundary or total >= cfg.min_tokens):
            groups.append(cur)
            cur, total = [], 0
        if cur and total + t > cfg.max_tokens:
            groups.append(cur)
            cur, total = _carry(cur, n, atomic, heading, cfg.overlap_tokens)
        cur.append(i)
        total += t
    if cur:
        groups.append(cur)
    return _merge(groups, n, heading, cfg)


def _carry(cur: list[int], n: list[int], atomic: list[bool], heading: list[bool], overlap: int) -> tuple[list[int], int]:
    """Last units of a closed group that also begin the next one."""
    out, total = [], 0
    for j in reversed(cur):
        if heading[j]:
            continue
        if atomic[j]:
            break
        out.append(j)
        total += n[j]
        if total >= overlap:
            break
    return out[::-1], total


def _merge(groups: list[list[int]], n: list[int], heading: list[bool], cfg: Chunking) -> list[list[int]]:
    out: list[list[int]] = []
    for g in groups:
        before = sum(n[j] for j in out[-1]) if out else 0
        fits = out and before < cfg.min_tokens and before + sum(n[j] for j in g) <= cfg.max_tokens
        if fits and not (cfg.respect_heading_boundary and heading[g[0]]):
            out[-1] = out[-1] + g
        else:
            out.append(g)
    return out


def pack_column(cfg: Chunking) -> Callable[[Column, Column, Column], Column]:
    @F.pandas_udf("array<array<int>>")
    def run(n: pd.Series, atomic: pd.Series, heading: pd.Series) -> pd.Series:
        return pd.Series([pack(a.tolist(), b.tolist(), c.tolist(), cfg) for a, b, c in zip(n, atomic, heading)])

    return run


def groups(u: DataFrame, cfg: Chunking = Chunking()) -> DataFrame:
    """``doc_id, chunk_index, total_chunk, us``: the units of every chunk, in order."""
    part = lambda f: F.transform("u", f)
    doc = u.withColumn("g", pack_column(cfg)(part(lambda v: v["n_tok"]), part(lambda v: v["atomic"]), part(lambda v: v["kind"] == "heading")))
    # Units are put into their chunks before there is a row a chunk: a row that still had all units would make as many copies of a document as it has chunks.
    own = F.transform("g", lambda at: F.transform(at, lambda i: F.get(F.col("u"), i)))
    return doc.select("doc_id", F.size("g").alias("total_chunk"), F.posexplode(own).alias("chunk_index", "us")).select("doc_id", "chunk_index", "total_chunk", "us")


def context_header(chapter: Column, section: Column) -> Column:
    c, s = T.strip(chapter), T.strip(section)
    return F.when((c != "") & (s != "") & (c != s), F.concat(F.lit("["), c, F.lit(" > "), s, F.lit("]\n"))).when(c != "", F.concat(F.lit("["), c, F.lit("]\n"))).when(s != "", F.concat(F.lit("["), s, F.lit("]\n"))).otherwise("")


def join_units(us: Column) -> Column:
    """Texts line by line, with a mark where the chapter changes within a chunk."""

    def joined(kept: Column) -> Column:
        def line(u: Column, i: Column) -> Column:
            changed = (i > 0) & (u["chapter"] != "") & (u["chapter"] != F.get(kept, i - 1)["chapter"])
            return F.when(changed, F.concat(F.lit("["), u["chapter"], F.lit("]\n"), u["text"])).otherwise(u["text"])

        return F.array_join(F.transform(kept, line), "\n")

    return T.let(F.filter(us, lambda u: ~T.is_blank(u["text"])), joined)


def chunks(blocks: DataFrame, names: DataFrame | None = None, cfg: Chunking = Chunking()) -> DataFrame:
    """One row a chunk: ``id, text, document_id, filename, page_start, …``.

    ``names`` gives ``doc_id, filename`` where the file name isn't the document's id; ids are digests of file names.
    """
    g = groups(units(blocks, cfg), cfg)
    g = g.join(names, "doc_id", "left") if names is not None else g.withColumn("filename", F.col("doc_id"))
    first = F.element_at("us", 1)
    g = g.withColumn("filename", F.coalesce("filename", "doc_id")).withColumn("document_id", T.document_id("filename"))
    g = g.withColumn("chapter", first["chapter"]).withColumn("section", first["section"]).withColumn("block_type", first["block_type"])
    body = join_units(F.col("us"))
    g = g.withColumn("text", F.concat(context_header(F.col("chapter"), F.col("section")), body) if cfg.prepend_context else body)
    count = tokens.counter(cfg.encoding)
    return g.select(
        T.chunk_id("document_id", "chunk_index").alias("id"), "text", "doc_id", "document_id", "filename",
        F.array_min(F.transform("us", lambda u: F.coalesce(u["page"], u["page_start"]))).alias("page_start"), F.array_max(F.transform("us", lambda u: F.coalesce(u["page"], u["page_end"]))).alias("page_end"),
        "chapter", "section", "chunk_index", "total_chunk", count(F.col("text")).alias("token_count"), T.count_words("text").alias("word_count"), F.lit("").alias("language"), "block_type",
    )
