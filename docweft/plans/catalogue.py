"""All queries over the driver's tables, with the SQL that checks them.

Where the tables hold nothing of a kind (headings, lists, tables of Markdown), lines are composed from the star schema.
Every query reads whole tables.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.config import Chunking, Config
from docweft.functions import text as T
from docweft.functions.lineage import shared_folder, small_batches, spread
from docweft.operators import chunk, clean, embed, export, generate, hierarchy, validate, vectors
from docweft.plans import pipelines
from docweft.sources import elements, files, html, tabular

FLAGSHIP = "vector_topk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Tables of texts, whose rows are worth a shuffle where one file part holds them all.
TEXTS = ("documents", "pages", "benchmark")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def _big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# SQL pieces.
WORDS = r"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_ABBR = reduce(lambda x, ia: f"replace({x}, '{ia[1]}', ' __ABBR{ia[0]}__ ')", enumerate(T.ABBREVIATIONS), "{x}")
_BACK = reduce(lambda x, ia: f"replace({x}, ' __ABBR{ia[0]}__ ', '{ia[1]}')", enumerate(T.ABBREVIATIONS), "s")
SENTENCES = (
    "list_filter(list_transform(str_split(regexp_replace(" + _ABBR + r""", '([.!?])\s+([A-Z0-9"''(])', '\1'||chr(1)||'\2', 'g'), chr(1)), lambda s: """
    + STRIP.format(x=_BACK) + "), lambda s: s <> '')"
)
TOKENS = f"trunc(len({WORDS}) * 1.33::DOUBLE)::BIGINT"
COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
SCORE = f"round(greatest(0, (1 + {COS}) / 2), 6)"


# Vectors.


def _first_vector(v: DataFrame) -> list[float]:
    return list(v.orderBy("vec_id").first()["embedding"])


_Q = "WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, {s} AS score, row_number() OVER (ORDER BY {s} DESC, vec_id) AS rank FROM embeddings, q {w} ORDER BY rank LIMIT {k}"
_S = SCORE.format(a="embedding", b="q.e")


@query(_Q.format(s=_S, w="", k=6))
def vector_topk(spark, sf):
    v = _read(spark, sf, "embeddings")
    return vectors.search(v, _first_vector(v), 6, key="vec_id").select("vec_id", "score", *_big("rank"))


@query(_Q.format(s=_S, w="WHERE label = 3", k=6))
def vector_topk_filtered(spark, sf):
    v = _read(spark, sf, "embeddings")
    return vectors.search(v, _first_vector(v), 6, F.col("label") == 3, key="vec_id").select("vec_id", "score", *_big("rank"))


@query(f"SELECT * FROM ({_Q.format(s=_S, w='', k=50)}) WHERE score >= 0.6")
def vector_threshold(spark, sf):
    v = _read(spark, sf, "embeddings")
    q = spark.createDataFrame([(0, _first_vector(v))], "query_id int, embedding array<double>")
    return vectors.retrieve(v, q, 50, 0.6, key="vec_id").select("vec_id", "score", *_big("rank"))


@query(
    f"""
WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, round(avg(x), 9) AS x FROM d GROUP BY label, i),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS e FROM m GROUP BY label),
s AS (SELECT query_id, vec_id, {SCORE.format(a="embedding", b="q.e")} AS score FROM embeddings, q)
SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
)
def vector_batch_topk(spark, sf):
    v = _read(spark, sf, "embeddings")
    m = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    q = m.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    return vectors.batch_search(v, q, 5, key="vec_id").select("query_id", "vec_id", "score", *_big("rank"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) = 1")
def vector_upsert_latest(spark, sf):
    e = _read(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    e = e.withColumnRenamed("event_id", "a_event_id")  # the first of the other columns breaks ties
    return vectors.latest(e, "user_id", "ts").select("user_id", F.col("a_event_id").alias("event_id"), "event_type")


_RECORDS = "WITH r AS (SELECT vec_id::VARCHAR AS id, CASE WHEN label % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))"


def _stored(spark, sf) -> vectors.Store:
    """All vectors put into a store of their own, a third of them put there again with another label, those of toxic documents taken away."""
    v = _read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", "embedding")
    s = vectors.Store(spark, f"{shared_folder(v)}/store-{uuid.uuid4().hex}", "vectors")
    s.upsert(v)
    s.upsert(v.where("label % 3 = 0").withColumn("label", F.col("label") + 100))
    s.delete_where(_read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id")))
    return s


@query(_RECORDS + " SELECT id, label FROM r")
def store_upsert_delete(spark, sf):
    return _stored(spark, sf).read().select("id", "label")


@query(_RECORDS + " SELECT count(*) AS n, 'vectors' AS collections FROM r")
def store_count(spark, sf):
    s = _stored(spark, sf)
    return spark.createDataFrame([(s.count(), ",".join(s.list_collections()))], "n bigint, collections string")


@query(_RECORDS + f""", q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), v AS (SELECT id, r.label, {SCORE.format(a="embedding", b="q.e")} AS score FROM r JOIN embeddings ON vec_id::VARCHAR = id, q)
SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v ORDER BY rank LIMIT 5""")
def store_search(spark, sf):
    return _stored(spark, sf).search(_first_vector(_read(spark, sf, "embeddings")), 5).select("id", "label", "score", *_big("rank"))


@query("SELECT label AS collection, count(*) AS total_chunks FROM embeddings GROUP BY label")
def vector_stats(spark, sf):
    return vectors.stats(_read(spark, sf, "embeddings").withColumnRenamed("label", "collection"))


# Text.


def _scalar(name: str, column, sql: str) -> None:
    def run(spark, sf):
        return _read(spark, sf, "documents").select("doc_id", F.md5(column("text")).alias("digest"))

    run.__name__ = name
    query(f"SELECT doc_id, md5({sql}) AS digest FROM documents")(run)


_scalar("text_collapse_ws", T.collapse_whitespace, r"regexp_replace(text, '[ \t]+', ' ', 'g')")
_scalar("text_blank_lines", T.collapse_blank_lines, r"regexp_replace(regexp_replace(text, '(?:[ \t]*\n){3,}', chr(10)||chr(10), 'g'), '^\n+|\n+$', '', 'g')")
_scalar("text_strip_page_markers", T.strip_page_markers, r"regexp_replace(text, '\b(?:halaman|hal\.?|page)\s+\d+\s*(?:dari|of)\s*\d+\b', '', 'gi')")
_scalar("text_unicode", T.normalize_unicode, r"regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g')")
_scalar("text_ocr_fix", T.fix_broken_ocr, reduce(lambda x, c: f"regexp_replace({x}, '{c}{{7,}}', '{c}', 'g')", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "translate(replace(text, chr(65533), ''), chr(9633)||chr(9744), '  ')"))
_scalar("text_signature", T.signature, f"left(lower({STRIP.format(x=chr(114) + 'egexp_replace(text, ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), 500)")


@query(rf"""
WITH l AS (SELECT doc_id, {STRIP.format(x="unnest(string_split(text, chr(10)))")} AS s FROM documents
  UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'Page '||l_linenumber||' of '||l_quantity::BIGINT WHEN l_linenumber = 2 THEN '- '||l_linenumber||' -' ELSE l_linenumber||'. item' END FROM lineitem)
SELECT doc_id, count(*) AS n FROM l WHERE regexp_full_match(s, '[-–—\s]*\d+[-–—\s]*|(?i:(?:halaman|hal\.?|page)\s+\d+\s*(?:dari|of)\s*\d+)') GROUP BY doc_id
""")
def text_page_number_lines(spark, sf):
    own = _read(spark, sf, "documents").select("doc_id", F.explode(T.lines("text")).alias("line"))
    n = F.col("l_linenumber").cast("string")
    made = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Page "), n, F.lit(" of "), F.col("l_quantity").cast("bigint").cast("string"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("- "), n, F.lit(" -"))).otherwise(F.concat(n, F.lit(". item"))).alias("line"))
    return own.unionByName(made).where(T.is_page_number_line("line")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len({WORDS.format(x='text')})::BIGINT AS words, {TOKENS.format(x='text')} AS tokens FROM documents")
def word_token_counts(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.count_words("text").cast("bigint").alias("words"), T.count_tokens("text").cast("bigint").alias("tokens"))


@query(f"SELECT doc_id, len({SENTENCES.format(x='text')})::BIGINT AS n FROM documents")
def sentence_count(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.size(T.split_sentences("text")).cast("bigint").alias("n"))


@query(f"WITH s AS (SELECT doc_id, {SENTENCES.format(x='text')} AS xs FROM documents) SELECT doc_id, generate_subscripts(xs, 1) AS n, md5(unnest(xs)) AS digest FROM s")
def sentence_explode(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(T.split_sentences("text")).alias("n", "s")).select("doc_id", (F.col("n") + 1).cast("bigint").alias("n"), F.md5("s").alias("digest"))


_LANG = f"""
WITH w AS (SELECT doc_id, lang, {WORDS.format(x="text")} AS ws FROM documents),
b AS (SELECT doc_id, lang, len(ws) AS n, list_distinct(list_transform(ws, lambda w: regexp_replace(lower(w), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g'))) AS bare FROM w),
h AS (SELECT doc_id, lang, n, len(list_intersect(bare, string_split('{T._STOP["id"]}', ' '))) AS i, len(list_intersect(bare, string_split('{T._STOP["en"]}', ' '))) AS e FROM b),
d AS (SELECT doc_id, lang, CASE WHEN n < 5 OR (i = 0 AND e = 0) OR i >= e THEN 'id' ELSE 'en' END AS detected FROM h)
"""


@query(_LANG + "SELECT doc_id, detected FROM d")
def lang_detect_stopword(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.detect_language("text").alias("detected"))


@query(_LANG + "SELECT lang, detected, count(*) AS n FROM d GROUP BY lang, detected")
def lang_confusion(spark, sf):
    return _read(spark, sf, "documents").groupBy("lang", T.detect_language("text").alias("detected")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'doc_'||left(sha256(doc_id::VARCHAR||'.txt'), 16) AS document_id FROM documents")
def doc_ids(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.document_id(F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("document_id"))


@query("SELECT conv_id, turn, 'doc_'||left(sha256(conv_id::VARCHAR), 16)||'_c'||printf('%04d', turn) AS id FROM conversations")
def chunk_ids(spark, sf):
    return _read(spark, sf, "conversations").select("conv_id", "turn", T.chunk_id(T.document_id("conv_id"), "turn").alias("id"))


@query("SELECT page_id, left(sha256(url||'|'||length(html)||'|'||page_id), 16) AS signature FROM pages")
def file_signatures(spark, sf):
    return _read(spark, sf, "pages").select("page_id", T.file_signature("url", F.length("html"), "page_id").alias("signature"))


@query("WITH f AS (SELECT 'f'||doc_id||'.'||CASE lang WHEN 'en' THEN 'TXT' WHEN 'de' THEN 'md' WHEN 'fr' THEN 'rtf' ELSE 'html' END AS p FROM documents) SELECT lower(regexp_extract(p, '\\.([^.]+)$', 1)) AS ext, count(*) AS n FROM f WHERE p NOT LIKE '%.rtf' GROUP BY 1")
def supported_files(spark, sf):
    p = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.when(F.col("lang") == "en", "TXT").when(F.col("lang") == "de", "md").when(F.col("lang") == "fr", "rtf").otherwise("html"))
    return files.group_by_extension(_read(spark, sf, "documents").select(p.alias("path")).where(files.is_supported("path"))).select("ext", "n")


# Elements.

_TXT = rf"""
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, {STRIP.format(x="unnest(string_split(text, chr(10)))")} AS s FROM documents),
c AS (SELECT doc_id, pos, s, CASE WHEN regexp_matches(s, '^#{{1,6}}\s+') OR (length(s) BETWEEN 1 AND 80 AND regexp_full_match(s, '[A-Z0-9 \-–().,:/]{{3,}}')) THEN 'heading'
  WHEN regexp_matches(s, '^[-*+]\s+') THEN 'bullet_list' WHEN regexp_matches(s, '^\d+[.)]\s+') THEN 'numbered_list' WHEN s = '' THEN 'blank' ELSE 'paragraph' END AS cls FROM l),
f AS (SELECT *, CASE WHEN cls = 'heading' OR cls IS DISTINCT FROM lag(cls) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM c),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
g AS (SELECT doc_id, run, any_value(cls) AS type, string_agg(CASE WHEN cls LIKE '%list' THEN regexp_replace(s, '^([-*+]|\d+[.)])\s+', '') WHEN cls = 'heading' THEN regexp_replace(s, '^[# ]+', '') ELSE s END, chr(10) ORDER BY pos) AS content FROM r WHERE cls <> 'blank' GROUP BY doc_id, run),
e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS ord, type, content FROM g)
"""


@query(_TXT + "SELECT cls, count(*) AS n FROM c GROUP BY cls")
def txt_line_classes(spark, sf):
    return elements.classify_txt(_read(spark, sf, "documents")).groupBy("cls").agg(F.count("*").alias("n"))


def _txt(spark, sf):
    return elements.parse_txt(_read(spark, sf, "documents").select("doc_id", "text"))


@query(_TXT + "SELECT doc_id, ord, type, md5(content) AS digest FROM e")
def txt_elements(spark, sf):
    e = _txt(spark, sf).withColumn("content", F.when(F.col("items").isNotNull(), F.array_join("items", "\n")).otherwise(F.col("content")))
    return e.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_big("ord"), "type", F.md5("content").alias("digest"))


@query(_TXT + "SELECT doc_id, ord, content FROM e WHERE type = 'heading'")
def txt_caps_headings(spark, sf):
    return _txt(spark, sf).where("type = 'heading'").select(F.col("doc_id").cast("bigint").alias("doc_id"), *_big("ord"), "content")


def _order_markdown(spark, sf):
    li = _read(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint").cast("string"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", "l_returnflag"))).alias("x"))
    row = lambda v: F.concat(F.lit("| "), v["l_partkey"].cast("string"), F.lit(" | "), v["q"], F.lit(" |"))
    k = F.col("l_orderkey").cast("string")
    text = F.concat(F.lit("# Order "), k, F.lit("\n\n| part | quantity |\n|---|---|\n"), F.array_join(F.transform("x", row), "\n"), F.lit("\n*Table "), k, F.lit("*\n"), F.array_join(F.transform("x", lambda v: F.concat(F.lit("- "), v["l_returnflag"])), "\n"), F.lit("\nFirst line\n  second line\n"))
    return g.select(F.col("l_orderkey").alias("doc_id"), text.alias("text"))


@query("""
WITH o AS (SELECT l_orderkey AS d, count(*) AS n, string_agg('- '||l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT::VARCHAR, l_returnflag) AS flags,
  string_agg(l_partkey||'|'||l_quantity::BIGINT, ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT::VARCHAR, l_returnflag) AS cells FROM lineitem GROUP BY 1)
SELECT d AS doc_id, 0::BIGINT AS ord, 'heading' AS type, 'Order '||d AS shown FROM o
UNION ALL SELECT d, 1, 'table', 'part|quantity;'||cells FROM o
UNION ALL SELECT d, 2, 'caption', '*Table '||d||'*' FROM o
UNION ALL SELECT d, 3, 'bullet_list', replace(flags, '- ', '') FROM o
UNION ALL SELECT d, 4, 'paragraph', 'First line'||chr(10)||'second line' FROM o
""")
def markdown_elements(spark, sf):
    e = elements.parse_markdown(_order_markdown(spark, sf))
    shown = F.when(F.col("type") == "table", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")).when(F.col("items").isNotNull(), F.array_join("items", "\n")).otherwise(F.col("content"))
    return e.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_big("ord"), "type", shown.alias("shown"))


@query("""
WITH l AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS pos, CASE l_returnflag WHEN 'R' THEN 'bullet_list' WHEN 'A' THEN 'numbered_list' ELSE 'blank' END AS cls, l_orderkey FROM lineitem),
f AS (SELECT *, CASE WHEN cls IS DISTINCT FROM lag(cls) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM l),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
g AS (SELECT doc_id, run, any_value(cls) AS type, string_agg('o'||l_orderkey, ',' ORDER BY pos) AS items FROM r WHERE cls <> 'blank' GROUP BY doc_id, run)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS ord, type, items FROM g
""")
def list_groups(spark, sf):
    li = _read(spark, sf, "lineitem")
    mark = F.when(F.col("l_returnflag") == "R", "- ").when(F.col("l_returnflag") == "A", "1. ").otherwise("")
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"))
    lines = li.select(F.col("l_suppkey").alias("doc_id"), pos.alias("pos"), F.concat(mark, F.lit("o"), F.col("l_orderkey").cast("string")).alias("line"))
    return elements.group_list_items(lines).select("doc_id", *_big("ord"), "type", F.array_join("items", ",").alias("items"))


@query("SELECT page_id, len(regexp_extract_all(html, '<h1[ >]'))::BIGINT AS h1, len(regexp_extract_all(html, '<ul[ >]'))::BIGINT AS lists FROM pages")
def html_headings(spark, sf):
    e = html.parse_html(_read(spark, sf, "pages"))
    return e.groupBy(F.col("doc_id").cast("bigint").alias("page_id")).agg(F.count_if((F.col("type") == "heading") & (F.col("level") == 1)).alias("h1"), F.count_if(F.col("type") == "bullet_list").alias("lists"))


@query()
def html_elements(spark, sf):
    return html.parse_html(_read(spark, sf, "pages")).select(F.col("doc_id").cast("bigint").alias("page_id"), "ord", "type", "level", F.md5(F.concat_ws("\n", "content", F.array_join("items", "\n"))).alias("digest"))


# Files, put together from regions and their nations.


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def _file(ext: str, title: str, names: list[str]) -> bytes:
    if ext == "csv":
        return ("key,name\n" + "".join(f'{i},"{n}"\n' for i, n in enumerate(names))).encode()
    if ext == "pdf":
        show = lambda size, text, dy: f"BT /F1 {size} Tf 72 {dy} Td ({text}) Tj ET\n"
        body = (show(24, title, 700) + "".join(show(10, n, 660 - 12 * i) for i, n in enumerate(names)) + show(10, "- 1 -", 40)).encode()
        objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d >> stream\n%s\nendstream" % (len(body), body), b"<< /Type /Font /Subtype /Type1 >>"]
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (i + 1, x) for i, x in enumerate(objects))
    if ext == "docx":
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        one = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
        return _zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{one("Heading1", title)}{"".join(one("Normal", n) for n in names)}</w:body></w:document>'})
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = "".join(f'<row><c r="A{i + 1}"><v>{i}</v></c><c r="B{i + 1}" t="inlineStr"><is><t>{n}</t></is></c></row>' for i, n in enumerate(names))
    return _zipped({"xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="{title}" r:id="i1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="i1" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": f'<worksheet xmlns="{m}"><sheetData>{rows}</sheetData></worksheet>'})


_FILES = """
WITH n AS (SELECT trim(r_name) AS r, trim(n_name) AS n, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY r_name) AS total FROM nation JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT r, any_value(total) AS total, string_agg(n, chr(10) ORDER BY i) AS names, string_agg('key: '||i||' | name: '||n, chr(10) ORDER BY i) AS lines, string_agg(i||','||n, ';' ORDER BY i) AS cells FROM n GROUP BY r)
"""


@query(_FILES + """
SELECT r||'.csv' AS file, 0 AS ord, 'heading' AS type, r AS shown FROM g UNION ALL SELECT r||'.csv', 1, 'heading', 'Batch 1: baris 1-'||total||' dari '||total FROM g UNION ALL SELECT r||'.csv', 2, 'paragraph', lines FROM g
UNION ALL SELECT r||'.pdf', 0, 'heading', r FROM g UNION ALL SELECT r||'.pdf', 1, 'paragraph', names FROM g UNION ALL SELECT r||'.pdf', 2, 'page_break', '' FROM g
UNION ALL SELECT r||'.docx', 0, 'heading', r FROM g UNION ALL SELECT r||'.docx', i + 1, 'paragraph', n FROM n
UNION ALL SELECT r||'.xlsx', 0, 'heading', r FROM g UNION ALL SELECT r||'.xlsx', 1, 'table', cells FROM g
""")
def file_elements(spark, sf):
    n = _read(spark, sf, "nation").join(_read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.groupBy(F.trim("r_name").alias("title")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.trim("n_name").alias("n")))), lambda x: x["n"]).alias("names"))
    make = F.udf(_file, "binary", useArrow=False)
    made = g.withColumn("ext", F.explode(F.array(*map(F.lit, ("csv", "pdf", "docx", "xlsx"))))).withColumn("path", F.concat("title", F.lit("."), "ext"))
    e, _ = files.parse(made.select("path", F.col("path").alias("filename"), "ext", make("ext", "title", "names").alias("content")))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return e.select(F.col("doc_id").alias("file"), *_big("ord"), "type", F.coalesce(cells, "content").alias("shown"))


# Cleaning.


def _source_pages(spark, sf):
    """Every source as one document whose pages are its documents."""
    d = _read(spark, sf, "documents").select(F.col("source").alias("doc_id"), (2 * F.col("doc_id")).alias("ord"), F.lit("paragraph").alias("type"), F.col("text").alias("content"))
    d = d.unionByName(d.select("doc_id", (F.col("ord") + 1).alias("ord"), F.lit("page_break").alias("type"), F.lit("").alias("content")))
    return d.withColumn("items", F.expr("cast(null as array<string>)")).withColumn("rows", F.expr("cast(null as array<array<string>>)")).withColumn("level", F.lit(None).cast("int"))


def _boiler(header: bool) -> str:
    at = "pos" if header else "n - pos + 1"
    return rf"""
WITH l AS (SELECT source, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, {STRIP.format(x="unnest(string_split(text, chr(10)))")} AS line, len(string_split(text, chr(10))) - (text LIKE '%'||chr(10))::INT AS n FROM documents),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source),
h AS (SELECT source, line, count(*) AS c FROM l WHERE pos <= n AND {at} <= 2 AND line <> '' AND length(line) < 200 GROUP BY source, line)
SELECT source, line FROM h JOIN p USING (source) WHERE pages >= 2 AND c >= greatest(2, floor(pages * 0.02::DOUBLE))
"""


@query(_boiler(True))
def repeated_header_lines(spark, sf):
    return clean.boilerplate_lines(_source_pages(spark, sf), True, 0.02).select(F.col("doc_id").alias("source"), F.explode("lines").alias("line"))


@query(_boiler(False))
def repeated_footer_lines(spark, sf):
    return clean.boilerplate_lines(_source_pages(spark, sf), False, 0.02).select(F.col("doc_id").alias("source"), F.explode("lines").alias("line"))


@query(rf"""
WITH h AS (SELECT source, doc_id, lower(regexp_replace({STRIP.format(x="string_split(text, chr(10))[1]")}, '\s+', ' ', 'g')) AS norm FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY source, norm) AS n, row_number() OVER (PARTITION BY source, norm ORDER BY doc_id) AS rn FROM h)
SELECT source, doc_id FROM c WHERE norm = '' OR n < 3 OR rn = 1
""")
def repeated_headings(spark, sf):
    d = _read(spark, sf, "documents").select("source", "doc_id", F.split("text", "\n")[0].alias("content"))
    e = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.lit("heading").alias("type"), "content")
    return clean.repeated_headings(e).select(F.col("doc_id").alias("source"), F.col("ord").alias("doc_id"))


_NFC = r"regexp_replace(nfc_normalize(content), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g')"
_TIDY = reduce(lambda x, c: f"regexp_replace({x}, '{c}{{7,}}', '{c}', 'g')", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", f"translate(replace({_NFC}, chr(65533), ''), chr(9633)||chr(9744), '  ')")
_PAGE_LINE = r"regexp_full_match(trim({x}), '[-–—\s]*\d+[-–—\s]*|(?i:(?:halaman|hal\.?|page)\s+\d+\s*(?:dari|of)\s*\d+)') AND NOT regexp_matches(trim({x}), '^\d+[.)]\s+\S')"
_CLEAN = _TXT + rf""", za AS (SELECT *, {_TIDY} AS x FROM e),
zp AS (SELECT doc_id, ord, type, CASE WHEN type = 'paragraph' AND len(list_filter(string_split(x, chr(10)), lambda l: {_PAGE_LINE.format(x="l")})) > 0
  THEN array_to_string(list_filter(string_split(x, chr(10)), lambda l: NOT ({_PAGE_LINE.format(x="l")})), chr(10)) ELSE x END AS x FROM za),
zm AS (SELECT doc_id, ord, type, {STRIP.format(x="regexp_replace(x, '\\b(?:halaman|hal\\.?|page)\\s+\\d+\\s*(?:dari|of)\\s*\\d+\\b', '', 'gi')")} AS x FROM zp),
zn AS (SELECT *, CASE WHEN type = 'heading' THEN lower(regexp_replace(x, '\s+', ' ', 'g')) END AS norm FROM zm WHERE x <> ''),
zh AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS times, row_number() OVER (PARTITION BY doc_id, norm ORDER BY ord) AS rn FROM zn),
zc AS (SELECT doc_id, ord, type, regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '(?:[ \t]*\n){{3,}}', chr(10)||chr(10), 'g'), '^\n+|\n+$', '', 'g') AS x FROM zh WHERE norm IS NULL OR times < 3 OR rn = 1)
"""


@query(_CLEAN + "SELECT doc_id, ord, type, md5(CASE WHEN type LIKE '%list' THEN '' ELSE x END) AS digest FROM zc")
def cleaned_elements(spark, sf):
    e = clean.clean(_txt(spark, sf))
    return e.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_big("ord"), "type", F.md5("content").alias("digest"))


@query(rf"""
WITH b AS ({_boiler(True).strip()}),
k AS (SELECT d.source, doc_id, text, {STRIP.format(x="array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT list_contains(ls, " + STRIP.format(x="l") + ")), chr(10))")} AS kept FROM documents d JOIN (SELECT source, list(line) AS ls FROM b GROUP BY source) USING (source)
  UNION ALL SELECT source, doc_id, text, text FROM documents WHERE source NOT IN (SELECT source FROM b))
SELECT source, doc_id, md5(kept) AS digest FROM k WHERE {STRIP.format(x="kept")} <> ''
""")
def cleaned_pages(spark, sf):
    """Documents as the pages of their source, without the lines that head many of them."""
    e = clean.repeated_lines(_source_pages(spark, sf), True, 0.02).where("type = 'paragraph'")
    return e.select(F.col("doc_id").alias("source"), (F.col("ord") / 2).cast("bigint").alias("doc_id"), F.md5("content").alias("digest"))


# Hierarchy.

_LEVELS = "CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 WHEN event_type = (SELECT max(event_type) FROM events) THEN 2 WHEN value < 1 THEN 3 END"


def _event_elements(spark, sf):
    e = _read(spark, sf, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()
    level = F.when(F.col("event_type") == ends["lo"], 1).when(F.col("event_type") == ends["hi"], 2).when(F.col("value") < 1, 3)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("doc_id"), number.alias("ord"), level.alias("level"), F.col("event_id").cast("string").alias("content")).withColumn("type", F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph"))


_EV = f"WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, {_LEVELS} AS level FROM events)"


@query(_EV + " SELECT a.user_id, a.ord, (SELECT max(b.ord) FROM v b WHERE b.user_id = a.user_id AND b.ord < a.ord AND b.level IS NOT NULL AND (a.level IS NULL OR b.level < a.level)) AS parent FROM v a")
def nearest_heading(spark, sf):
    return hierarchy.parents(_event_elements(spark, sf)).select(F.col("doc_id").alias("user_id"), *_big("ord", "parent"))


@query(_EV + ", w AS (SELECT user_id, ord, max(CASE WHEN level <= 1 THEN ord END) OVER (PARTITION BY user_id ORDER BY ord) AS c, max(CASE WHEN level IS NOT NULL THEN ord END) OVER (PARTITION BY user_id ORDER BY ord) AS s FROM v) SELECT w.user_id, w.ord, c.event_id::VARCHAR AS chapter, s.event_id::VARCHAR AS section FROM w LEFT JOIN v c ON c.user_id = w.user_id AND c.ord = w.c LEFT JOIN v s ON s.user_id = w.user_id AND s.ord = w.s")
def chapter_section_context(spark, sf):
    return hierarchy.context(_event_elements(spark, sf)).select(F.col("doc_id").alias("user_id"), *_big("ord"), "chapter", "section")


@query("""
WITH n AS (SELECT n_regionkey AS d, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_nationkey AS k, n_name AS name FROM nation)
SELECT d AS doc_id, 4 * i AS ord, 'heading' AS type, 2 AS level, 'Pasal '||k AS content FROM n UNION ALL SELECT d, 4 * i + 1, 'paragraph', NULL, name||chr(10)||'isi' FROM n
UNION ALL SELECT d, 4 * i + 2, 'heading', 1, 'BAB IV' FROM n UNION ALL SELECT d, 4 * i + 3, 'paragraph', NULL, 'penutup '||name FROM n
""")
def pattern_headings(spark, sf):
    n = _read(spark, sf, "nation")
    content = F.concat(F.lit("Pasal "), F.col("n_nationkey").cast("string"), F.lit("\n"), F.col("n_name"), F.lit("\nisi\nBAB IV\npenutup "), F.col("n_name"))
    e = n.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("ord"), F.lit("paragraph").alias("type"), content.alias("content"), F.lit(None).cast("int").alias("level"))
    return hierarchy.promote_headings(e).select("doc_id", *_big("ord"), "type", "level", "content")


_BLOCK = _TXT + """, h AS (SELECT *, CASE WHEN type = 'heading' THEN ord ELSE max(CASE WHEN type = 'heading' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) END AS k FROM e),
b AS (SELECT doc_id, coalesce(k, ord) AS block, max(CASE WHEN type = 'heading' THEN content END) AS title, count(*) FILTER (WHERE type <> 'heading') AS n_elements, min(type) FILTER (WHERE type <> 'heading') AS t FROM h GROUP BY doc_id, coalesce(k, ord))
"""


@query(_BLOCK + "SELECT doc_id, block, CASE WHEN title IS NOT NULL THEN 'heading' ELSE t END AS block_type, title, n_elements FROM b")
def semantic_blocks(spark, sf):
    b = hierarchy.blocks(_txt(spark, sf))
    return b.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_big("block"), "block_type", "title", F.size("elements").cast("bigint").alias("n_elements"))


@query(_BLOCK + """, zr AS (SELECT doc_id, k, ord, type, CASE type WHEN 'bullet_list' THEN array_to_string(list_transform(string_split(content, chr(10)), lambda x: '- '||x), chr(10))
  WHEN 'numbered_list' THEN array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: i||'. '||x), chr(10)) ELSE content END AS x FROM h)
SELECT doc_id, coalesce(k, ord) AS block, md5(array_to_string(list_filter([coalesce(max(CASE WHEN type = 'heading' THEN x END), ''), coalesce(string_agg(x, chr(10) ORDER BY ord) FILTER (WHERE type <> 'heading' AND x <> ''), '')], lambda v: v <> ''), chr(10))) AS digest FROM zr GROUP BY doc_id, coalesce(k, ord)
""")
def block_texts(spark, sf):
    b = hierarchy.blocks(_txt(spark, sf))
    return b.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_big("block"), F.md5(hierarchy.block_text()).alias("digest"))


# Chunks.

_PLAIN = Chunking(min_tokens=0, overlap_tokens=0, max_tokens=300, target_tokens=200)


@query(rf"""
WITH RECURSIVE s AS (SELECT doc_id, {SENTENCES.format(x="text")} AS xs FROM documents),
u AS (SELECT doc_id, generate_subscripts(xs, 1) AS i, unnest(list_transform(xs, lambda x: {TOKENS.format(x="x")})) AS t FROM s),
p AS (SELECT doc_id, i, t, t AS cur, 0 AS g FROM u WHERE i = 1
  UNION ALL SELECT u.doc_id, u.i, u.t, CASE WHEN p.cur + u.t > 300 THEN p.t + u.t ELSE p.cur + u.t END, CASE WHEN p.cur + u.t > 300 THEN p.g + 1 ELSE p.g END FROM p JOIN u ON u.doc_id = p.doc_id AND u.i = p.i + 1)
SELECT doc_id, g AS chunk_index, max(cur) AS tokens FROM p GROUP BY doc_id, g
""")
def chunk_pack(spark, sf):
    """Packing alone: sentences to at most 300 tokens, each group repeating the last sentence of the one before."""
    s = _read(spark, sf, "documents").select("doc_id", T.split_sentences("text").alias("xs")).withColumn("n", F.transform("xs", T.count_tokens)).where("size(xs) > 0")
    no = F.transform("n", lambda _: F.lit(False))
    g = s.select("doc_id", "n", F.posexplode(chunk.pack_column(_PLAIN)(F.col("n"), no, no)).alias("chunk_index", "at"))
    return g.select("doc_id", *_big("chunk_index"), F.aggregate(F.transform("at", lambda i: F.get(F.col("n"), i)), F.lit(0), lambda a, b: a + b).cast("bigint").alias("tokens"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '['||r_name||' > '||n_name||']'||chr(10) WHEN n_nationkey % 4 = 1 THEN '['||r_name||']'||chr(10) WHEN n_nationkey % 4 = 2 THEN '['||n_name||']'||chr(10) ELSE '' END AS header FROM nation JOIN region ON r_regionkey = n_regionkey
""")
def chunk_context_header(spark, sf):
    n = _read(spark, sf, "nation").join(_read(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("n_nationkey") % 4
    chapter, section = F.when(k < 2, F.col("r_name")).otherwise(""), F.when(k == 0, F.col("n_name")).when(k == 1, F.col("r_name")).when(k == 2, F.col("n_name")).otherwise("")
    return n.select("n_nationkey", chunk.context_header(chapter, section).alias("header"))


def _processed(spark, sf) -> pipelines.Processed:
    return pipelines.process_texts(_read(spark, sf, "documents").select("doc_id", "text"))


_TOK = "trunc(len(" + WORDS + ") * 1.33::DOUBLE)::INT"
# A text above the maximum: its lines, a line above it in pieces of as many words as the target has tokens, for a word counts as one.
_FORCED = "flatten(list_transform(list_filter(list_transform(string_split({x}, chr(10)), lambda y: " + STRIP.format(x="y") + "), lambda y: y <> ''), lambda y: CASE WHEN " + _TOK.format(x="y") + " <= 700 THEN [y] ELSE list_transform(range(0, len(" + WORDS.format(x="y") + "), 500), lambda j: array_to_string(" + WORDS.format(x="y") + "[j + 1 : j + 500], ' ')) END))"
_CHUNKS = _CLEAN + rf""", q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS ord, type, x FROM zc),
v AS (SELECT *, max(CASE WHEN type = 'heading' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS at FROM q),
w AS (SELECT v.*, coalesce(t.x, '') AS section, CASE WHEN v.at IS NOT NULL THEN 'heading' ELSE v.type END AS block_type, {SENTENCES.format(x="v.x")} AS xs FROM v LEFT JOIN q t ON t.doc_id = v.doc_id AND t.ord = v.at),
us AS (SELECT *, CASE WHEN type = 'heading' OR type LIKE '%list' THEN [x] WHEN len(xs) <= 1 THEN CASE WHEN {_TOK.format(x="x")} > 700 THEN {_FORCED.format(x="x")} ELSE [x] END
  ELSE flatten(list_transform(xs, lambda s: CASE WHEN {_TOK.format(x="s")} > 700 THEN {_FORCED.format(x="s")} ELSE [s] END)) END AS texts FROM w),
u AS (SELECT doc_id, section, block_type, type = 'heading' AS head, type = 'heading' OR type LIKE '%list' AS atom, ord, generate_subscripts(texts, 1) AS k, unnest(texts) AS x FROM us),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) AS i, {_TOK.format(x="x")} AS n FROM u),
d AS (SELECT doc_id, list(n ORDER BY i) AS ns, list(head ORDER BY i) AS hs, list(atom ORDER BY i) AS atoms FROM n GROUP BY doc_id),
pack AS (SELECT doc_id, 0 AS i, []::INT[] AS cur, 0 AS total, []::INT[][] AS done FROM d
  UNION ALL SELECT doc_id, i, CASE WHEN alone THEN [] ELSE start || [i] END, CASE WHEN alone THEN 0 ELSE coalesce(list_sum(list_transform(start, lambda j: ns[j])), 0) + ns[i] END::INT,
    CASE WHEN alone AND len(cur) > 0 AND list_bool_and(list_transform(cur, lambda j: hs[j])) THEN done || [cur || [i]] WHEN alone AND len(cur) > 0 THEN done || [cur, [i]] WHEN alone THEN done || [[i]] WHEN closed OR full_ THEN done || [cur] ELSE done END
  FROM (SELECT *, CASE WHEN full_ AND NOT closed THEN list_reverse(back[1 : coalesce(list_position(list_transform(range(1, len(back) + 1), lambda m: list_sum(list_transform(back[1:m], lambda j: ns[j])) >= 90), true), len(back))]) WHEN closed THEN []::INT[] ELSE cur END AS start
    FROM (SELECT *, len(cur) > 0 AND hs[i] AND NOT alone AS closed, len(cur) > 0 AND NOT hs[i] AND NOT alone AND total + ns[i] > 700 AS full_,
      list_reverse(list_filter(cur[coalesce(list_max(list_filter(cur, lambda j: atoms[j] AND NOT hs[j]).list_transform(lambda j: list_position(cur, j))), 0) + 1 :], lambda j: NOT hs[j])) AS back
      FROM (SELECT p.doc_id, p.i + 1 AS i, cur, total, done, ns, hs, atoms, atoms[p.i + 1] AND ns[p.i + 1] >= 250 AS alone FROM pack p JOIN d USING (doc_id) WHERE p.i < len(ns))))),
gg AS (SELECT doc_id, CASE WHEN len(cur) > 0 THEN done || [cur] ELSE done END AS gs, ns, hs FROM pack JOIN d USING (doc_id) WHERE i = len(ns)),
merged AS (SELECT doc_id, 1 AS i, gs[1:1] AS out FROM gg
  UNION ALL SELECT doc_id, m.i + 1, CASE WHEN list_sum(list_transform(out[-1], lambda j: ns[j])) < 250 AND list_sum(list_transform(out[-1], lambda j: ns[j])) + list_sum(list_transform(gs[m.i + 1], lambda j: ns[j])) <= 700 AND NOT hs[gs[m.i + 1][1]]
    THEN out[: len(out) - 1] || [out[-1] || gs[m.i + 1]] ELSE out || [gs[m.i + 1]] END FROM merged m JOIN gg USING (doc_id) WHERE m.i < len(gs)),
ch AS (SELECT doc_id, generate_subscripts(out, 1) - 1 AS c, len(out) AS total, unnest(out) AS us FROM merged JOIN gg USING (doc_id) WHERE i = len(gs)),
tx AS (SELECT ch.doc_id, c, any_value(ch.total) AS total, first(n.section ORDER BY z.o) AS section, first(n.block_type ORDER BY z.o) AS block_type, string_agg(n.x, chr(10) ORDER BY z.o) AS body
  FROM ch, LATERAL (SELECT unnest(us) AS i, generate_subscripts(us, 1) AS o) z JOIN n ON n.doc_id = ch.doc_id AND n.i = z.i GROUP BY ch.doc_id, c),
sm AS (SELECT doc_id, left(string_agg(left(x, 500), chr(10) ORDER BY ord) FILTER (WHERE x <> ''), 500) AS text, '' AS lang FROM q GROUP BY doc_id),
{_LANG.strip().removeprefix("WITH ").replace("FROM documents", "FROM sm").replace("w AS (", "lw AS (", 1).replace("FROM w)", "FROM lw)").replace(chr(10) + "b AS (", chr(10) + "lb AS (").replace("FROM b)", "FROM lb)").replace(chr(10) + "h AS (", chr(10) + "lh AS (").replace("FROM h)", "FROM lh)").replace(chr(10) + "d AS (", chr(10) + "ld AS (")},
fin AS (SELECT tx.doc_id, c, total, section, block_type, CASE WHEN section <> '' THEN '['||section||']'||chr(10) ELSE '' END || body AS text, coalesce(detected, '') AS language FROM tx LEFT JOIN ld ON ld.doc_id = tx.doc_id)
"""


@query(_CHUNKS + f"SELECT 'doc_'||left(sha256(doc_id::VARCHAR), 16)||'_c'||printf('%04d', c) AS id, doc_id::VARCHAR AS doc_id, c AS chunk_index, total AS total_chunk, {_TOK.format(x='text')} AS token_count, len({WORDS.format(x='text')}) AS word_count, language, block_type, '' AS chapter, section, md5(text) AS digest FROM fin")
def chunk_documents(spark, sf):
    """The whole way from texts to chunks, at the defaults. The SQL takes headings as of the second level, which lines in capitals are."""
    return _processed(spark, sf).chunks.select("id", "doc_id", *_big("chunk_index", "total_chunk"), "token_count", "word_count", "language", "block_type", "chapter", "section", F.md5("text").alias("digest"))


_QUALITY = _CHUNKS + rf""", kd AS (SELECT *, 'doc_'||left(sha256(doc_id::VARCHAR), 16)||'_c'||printf('%04d', c) AS id, {_TOK.format(x="text")} AS tok, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(x="x")}), lambda x: x <> '') AS ls,
  left(lower({STRIP.format(x="regexp_replace(text, '\\s+', ' ', 'g')")}), 500) AS sig FROM fin),
kc AS (SELECT *, CASE WHEN tok > 700 THEN 'OVERSIZED' WHEN tok < 250 THEN 'UNDERSIZED' WHEN tok NOT BETWEEN 450 AND 550 THEN 'NON_IDEAL_SIZE' END AS c1,
  CASE WHEN regexp_matches(ls[1], '^[a-z]') THEN 'POSSIBLE_TRUNC_START' END AS c2,
  CASE WHEN regexp_matches(ls[-1], '[\pL\pN\pM_]$') AND left(ls[-1], 1) NOT IN ('#', '|', '-') THEN 'POSSIBLE_TRUNC_END' END AS c3,
  CASE WHEN len(list_filter(ls[1:3], lambda x: regexp_full_match(x, '#[# ]*'))) > 0 THEN 'EMPTY_HEADING' END AS c4, 'INCOMPLETE_METADATA' AS c5,
  CASE WHEN row_number() OVER (PARTITION BY doc_id, sig ORDER BY c) = 2 THEN 'DUPLICATE' END AS c6 FROM kd),
kf AS (SELECT id, doc_id, array_to_string(list_filter([c1, c2, c3, c4, c5, c6], lambda x: x IS NOT NULL), ',') AS codes,
  greatest(0, 100 - CASE c1 WHEN 'OVERSIZED' THEN 15 WHEN 'UNDERSIZED' THEN 8 WHEN 'NON_IDEAL_SIZE' THEN 3 ELSE 0 END - 10 * (c2 IS NOT NULL)::INT - 10 * (c3 IS NOT NULL)::INT - 20 * (c4 IS NOT NULL)::INT - 5 - 12 * (c6 IS NOT NULL)::INT)::BIGINT AS score FROM kc)
"""


@query(_QUALITY + "SELECT id AS chunk_id, score AS quality_score, codes FROM kf")
def chunk_quality(spark, sf):
    return _processed(spark, sf).validations.select("chunk_id", *_big("quality_score"), F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


@query(_QUALITY + "SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, round(avg(score), 4) AS mean_score, 0::BIGINT AS failed FROM kf")
def pipeline_summary(spark, sf):
    return _processed(spark, sf).summary()


# Validation: every document as one chunk of its source.


def _as_chunks(spark, sf):
    by = Window.partitionBy("source")
    d = _read(spark, sf, "documents")
    return d.select(
        F.col("source").alias("doc_id"), (F.row_number().over(by.orderBy("doc_id")) - 1).alias("chunk_index"), F.count("*").over(by).cast("int").alias("total_chunk"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("n"),
        T.document_id("source").alias("document_id"), F.col("source").alias("filename"), "text", F.lit("").alias("chapter"), F.col("lang").alias("section"), F.col("lang").alias("language"), T.count_tokens("text").alias("token_count"), T.count_words("text").alias("word_count"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("paragraph").alias("block_type"),
    )


_CHECKS = rf"""
WITH d AS (SELECT *, {TOKENS.format(x="text")} AS tok, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(x="x")}), lambda x: x <> '') AS ls,
  left(lower({STRIP.format(x="regexp_replace(text, '\\s+', ' ', 'g')")}), 500) AS sig FROM documents),
c AS (SELECT *, CASE WHEN tok > 700 THEN 'OVERSIZED' WHEN tok < 250 THEN 'UNDERSIZED' WHEN tok NOT BETWEEN 450 AND 550 THEN 'NON_IDEAL_SIZE' END AS c1,
  CASE WHEN regexp_matches(ls[1], '^[a-z]') THEN 'POSSIBLE_TRUNC_START' END AS c2,
  CASE WHEN regexp_matches(ls[-1], '[\pL\pN\pM_]$') AND left(ls[-1], 1) NOT IN ('#', '|', '-') THEN 'POSSIBLE_TRUNC_END' END AS c3,
  CASE WHEN len(list_filter(ls[1:3], lambda x: regexp_full_match(x, '#[# ]*'))) > 0 THEN 'EMPTY_HEADING' END AS c4, 'INCOMPLETE_METADATA' AS c5,
  CASE WHEN row_number() OVER (PARTITION BY source, sig ORDER BY doc_id) = 2 THEN 'DUPLICATE' END AS c6 FROM d),
f AS (SELECT doc_id, source, array_to_string(list_filter([c1, c2, c3, c4, c5, c6], lambda x: x IS NOT NULL), ',') AS codes,
  greatest(0, 100 - CASE c1 WHEN 'OVERSIZED' THEN 15 WHEN 'UNDERSIZED' THEN 8 WHEN 'NON_IDEAL_SIZE' THEN 3 ELSE 0 END - 10 * (c2 IS NOT NULL)::INT - 10 * (c3 IS NOT NULL)::INT - 20 * (c4 IS NOT NULL)::INT - 5 - 12 * (c6 IS NOT NULL)::INT) AS score FROM c)
"""


@query(_CHECKS + "SELECT doc_id, score::BIGINT AS score, codes FROM f")
def validate_score(spark, sf):
    v = validate.validate(_as_chunks(spark, sf))
    return v.select(F.col("chunk_id").cast("bigint").alias("doc_id"), F.col("quality_score").cast("bigint").alias("score"), F.array_join(F.transform("findings", lambda x: x["code"]), ",").alias("codes"))


@query(_CHECKS + "SELECT code, CASE code WHEN 'NON_IDEAL_SIZE' THEN 'info' WHEN 'EMPTY_HEADING' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM (SELECT unnest(string_split(codes, ',')) AS code FROM f) GROUP BY code")
def validate_findings(spark, sf):
    return validate.validate(_as_chunks(spark, sf)).select(F.explode("findings").alias("f")).groupBy("f.code", "f.severity").agg(F.count("*").alias("n"))


@query(_CHECKS + "SELECT quality, count(*) AS n, round(avg(score), 6) AS mean_score FROM f JOIN labels USING (doc_id) GROUP BY quality")
def quality_vs_labels(spark, sf):
    v = validate.validate(_as_chunks(spark, sf)).select(F.col("chunk_id").cast("bigint").alias("doc_id"), "quality_score")
    return v.join(_read(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"))


@query(_CHECKS + "SELECT doc_id FROM f WHERE score >= 80")
def min_quality_filter(spark, sf):
    c, v = _as_chunks(spark, sf), validate.validate(_as_chunks(spark, sf))
    rows = export.records(c, v)
    return files.flatten_chunks(rows, 80).select(F.col("id").cast("bigint").alias("doc_id"))


# Tables as text.


@query("SELECT p_partkey, concat_ws(' | ', 'p_name: '||p_name, 'p_brand: '||p_brand, 'p_type: '||p_type, 'p_size: '||p_size) AS line FROM part")
def csv_narrative_rows(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", tabular.narrative(["p_name", "p_brand", "p_type", "p_size"]).alias("line"))


@query("""
WITH o AS (SELECT row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS total, c_name AS a, c_mktsegment AS b, c_nationkey::VARCHAR AS c FROM customer),
z AS (SELECT least(greatest(1, floor(1600.0::DOUBLE / avg(length('c_name') + length('c_mktsegment') + length('c_nationkey') + length(a) + length(b) + length(c) + 18))), 50)::BIGINT AS size FROM o WHERE r <= 50),
g AS (SELECT (r + size - 1) // size AS batch, min(r) AS lo, max(r) AS hi, max(total) AS total, string_agg('c_name: '||a||' | c_mktsegment: '||b||' | c_nationkey: '||c, chr(10) ORDER BY r) AS content FROM o, z GROUP BY 1)
SELECT batch, 'Batch '||batch||': baris '||lo||'-'||hi||' dari '||total AS label, md5(content) AS digest FROM g
""")
def csv_batches(spark, sf):
    b = tabular.batches(_read(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_nationkey"], "c_custkey")
    return b.select(*_big("batch"), "label", F.md5("content").alias("digest"))


# Retrieval over hashed words.

_EMBED = """
{n}w AS (SELECT {k} AS k, regexp_replace(unnest({words}), '^[.,;:!?"''()\\[\\]]+|[.,;:!?"''()\\[\\]]+$', '', 'g') AS w FROM {t}),
{n}b AS (SELECT k, (('0x'||right(md5(lower(w)), 2))::INT % 64) AS b, count(*)::DOUBLE AS c FROM {n}w WHERE w <> '' GROUP BY 1, 2),
{n}v AS (SELECT k, b, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS x FROM {n}b)"""
_DOCS = _EMBED.format(n="d", k="doc_id", t="documents", words=WORDS.format(x="text"))
_ITEMS = _EMBED.format(n="q", k="item_id", t="benchmark", words=WORDS.format(x="text"))
_HITS = f"""WITH {_DOCS}, {_ITEMS},
s AS (SELECT q.k AS item_id, d.k AS doc_id, round((1 + sum(q.x * d.x)) / 2, 6) AS score FROM qv q JOIN dv d ON q.b = d.b GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3)
"""


@query(f"WITH {_DOCS} SELECT k AS doc_id, count(*) AS buckets, round(max(x), 6) AS top FROM dv GROUP BY k")
def hash_embed(spark, sf):
    e = _read(spark, sf, "documents").select("doc_id", embed.hashing("text").alias("e"))
    return e.select("doc_id", F.size(F.filter("e", lambda x: x > 0)).cast("bigint").alias("buckets"), F.round(F.array_max("e"), 6).alias("top")).where("buckets > 0")


def _hits(spark, sf):
    d = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), embed.hashing("text").alias("embedding"))
    q = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), embed.hashing("text").alias("embedding"))
    return vectors.batch_search(d, q, 3)


@query(_HITS + "SELECT item_id, doc_id, score, rank FROM h")
def benchmark_passage_retrieval(spark, sf):
    return _hits(spark, sf).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", *_big("rank"))


def _prompted(spark, sf, threshold: float):
    h = _hits(spark, sf).where(F.col("score") >= threshold)
    d = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("chapter"), F.col("lang").alias("section"), F.lit(1).alias("page_start"), F.col("source").alias("filename"))
    q = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return q, h.join(d, "id")


_PROMPT = _HITS + """, c AS (SELECT item_id, string_agg('[Konteks '||rank||'] (Sumber: '||source||' > '||lang||' > hal. 1, skor: '||printf('%.2f', score)||')'||chr(10)||text, chr(10)||chr(10) ORDER BY rank) AS context, count(*) AS n FROM h JOIN documents USING (doc_id) WHERE score >= {t} GROUP BY item_id)
"""


@query(_PROMPT.format(t=0) + "SELECT item_id, md5(context) AS digest FROM c")
def rag_prompt_context(spark, sf):
    _, h = _prompted(spark, sf, 0.0)
    return generate.contexts(h).select(F.col("query_id").alias("item_id"), F.md5("context").alias("digest"))


@query(_PROMPT.format(t=0.9) + f"SELECT item_id, coalesce(n, 0) AS n_hits, CASE WHEN n IS NULL THEN '{generate.NO_ANSWER}' ELSE '[MOCK ANSWER] Berdasarkan konteks, jawaban untuk: Konteks dari dokumen:'||chr(10)||chr(10)||left(context, 50 - 23) END AS answer FROM benchmark LEFT JOIN c USING (item_id)")
def no_context_fallback(spark, sf):
    q, h = _prompted(spark, sf, 0.9)
    a = generate.answers(generate.prompts(q, h), generate.get_llm())
    return a.select(F.col("query_id").alias("item_id"), "n_hits", "answer")


@query(_HITS + "SELECT item_id, rank, round(score, 4) AS score, left(text, 150) AS text FROM h JOIN documents USING (doc_id)")
def answer_sources(spark, sf):
    _, h = _prompted(spark, sf, 0.0)
    return generate.sources(h, "cli").select(F.col("query_id").alias("item_id"), *_big("rank"), "score", "text")


@query("SELECT conv_id, md5(string_agg(upper(role)||':'||chr(10)||text, chr(10)||chr(10) ORDER BY turn)||chr(10)||chr(10)||'ASSISTANT:'||chr(10)) AS digest FROM conversations GROUP BY conv_id")
def chat_template(spark, sf):
    return generate.chat_template(_read(spark, sf, "conversations")).select("conv_id", F.md5("prompt").alias("digest"))


# Exports.


@query(_CHECKS + "SELECT doc_id, source, score::BIGINT AS score, (len(string_split(codes, ',')) - (codes LIKE '%NON_IDEAL%')::INT)::BIGINT AS warnings FROM f")
def export_json_rows(spark, sf):
    c = _as_chunks(spark, sf)
    j = export.json_rows(c, validate.validate(c))
    got = lambda p: F.get_json_object("json", p)
    return j.select(got("$.id").cast("bigint").alias("doc_id"), got("$.metadata.filename").alias("source"), got("$.validation.quality_score").cast("bigint").alias("score"), F.size(F.from_json(got("$.validation.warnings"), "array<struct<code:string>>")).cast("bigint").alias("warnings"))


@query(_CHECKS + rf"""SELECT f.doc_id, md5('## Chunk '||(row_number() OVER (PARTITION BY f.source ORDER BY f.doc_id))||chr(10)||chr(10)||'> `'||f.source||'` · - › '||lang||' · page 1-1 · '||{TOKENS.format(x="text")}||' tok / '||len({WORDS.format(x="text")})||' kata · lang='||lang||chr(10)||chr(10)||text||chr(10)||chr(10)||'*Quality score: '||score||'/100 '||CASE WHEN score >= 90 THEN '🟢' WHEN score >= 70 THEN '🟡' ELSE '🔴' END||'*') AS digest FROM f JOIN documents d ON d.doc_id = f.doc_id""")
def export_markdown_rows(spark, sf):
    c = _as_chunks(spark, sf)
    b = export.markdown_blocks(c, validate.validate(c)).join(c.select("doc_id", "chunk_index", "n"), ["doc_id", "chunk_index"])
    cut = F.length("block") - F.length(F.regexp_extract("block", r"(?s).*(\*Quality score: [^*]*\*)(.*)$", 2))
    return b.withColumn("_cut", cut).select(F.col("n").alias("doc_id"), F.md5(F.substring("block", F.lit(1), F.col("_cut"))).alias("digest"))


# The whole way: documents to chunks to vectors to answers.


_FOUND = _QUALITY + ", " + _EMBED.format(n="x", k="id", t="kd", words=WORDS.format(x="text")).strip() + ", " + _ITEMS.strip() + """,
xs AS (SELECT qv.k AS query_id, xv.k AS id, round((1 + sum(qv.x * xv.x)) / 2, 6) AS score FROM qv JOIN xv ON qv.b = xv.b GROUP BY 1, 2),
xh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM xs QUALIFY rank <= 5)
"""


@query(_FOUND + "SELECT query_id, rank, xh.id, score, left(xh.id, 20) AS document_id, tok AS token_count FROM xh JOIN kd USING (id) WHERE score >= 0.3")
def retrieve_chunks(spark, sf):
    records = pipelines.embedded(_processed(spark, sf).chunks, keep=True)
    q = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return pipelines.retrieve(records, q, Config()).select("query_id", *_big("rank"), "id", "score", "document_id", "token_count")
