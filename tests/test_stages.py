"""Parsing, cleaning, hierarchy, chunks, quality, sinks and the store on small inputs."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docweft import cli, config, serve
from docweft.config import Chunking, Cleaning, Config, Export
from docweft.functions import text as T
from docweft.operators import chunk, clean, embed, export, generate, hierarchy, vectors
from docweft.plans import catalogue, pipelines
from docweft.sources import elements, files, html, office, tabular
from docweft.streaming import ingest

MARKDOWN = """# BAB I
## Pasal 1
Pertama. Kedua kalimat.

- satu
- dua
- tiga

| No | Hak |
|----|-----|
| 1 | Akses |
*Table 1 hak*
## Pasal 2
1. a
2) b
penutup
"""


def one(spark, fn, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first().y


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("ord").select(*columns).collect()]


def element(doc, ord_, kind, content="", level=None, items=None, table=None, page=1):
    return (doc, ord_, kind, content, level, page, page, items, table)


def table(spark, *es):
    return spark.createDataFrame(list(es), elements.SCHEMA)


@pytest.mark.parametrize("text,want", [("Dr. Ali came. He left! Why?", ["Dr. Ali came.", "He left!", "Why?"]), ("no end", ["no end"]), ("", []), (None, []), ("a. b. C", ["a. b.", "C"]), ("One.\n\n(Two) x. 3 y", ["One.", "(Two) x.", "3 y"])])
def test_sentences(spark, text, want):
    assert one(spark, T.split_sentences, text) == want


@pytest.mark.parametrize("text,want", [("Page 3 of 10", True), ("halaman 2 dari 9", True), ("- 7 -", True), ("12", True), ("Page 3", False), ("x 1", False), ("", False), (None, False)])
def test_page_numbers(spark, text, want):
    assert one(spark, T.looks_like_page_number, text) is want


@pytest.mark.parametrize("text,want", [("a\r\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\nb", ["a", "", "b"]), (None, None), ("a b", ["a", "b"])])
def test_lines(spark, text, want):
    assert one(spark, T.lines, text) == want


def test_words_tokens_language_ids(spark):
    assert [one(spark, T.count_tokens, x) for x in (None, "", "a b c", "  ")] == [0, 0, 3, 0]
    assert one(spark, T.detect_language, "the cat is on the mat and it is not in") == "en"
    assert one(spark, T.detect_language, "buku ini yang ada di rumah itu") == "id" and one(spark, T.detect_language, "xx") == "id"
    assert one(spark, lambda c: T.chunk_id(c, F.lit(12345)), "doc_a") == "doc_a_c12345"
    assert one(spark, T.fix_broken_ocr, "kata�rusak aaaaaaaab") == "katarusak ab"
    assert one(spark, T.normalize_unicode, "é\x00\r\n") == "é\n"


def test_text_and_markdown(spark):
    docs = spark.createDataFrame([("d", "JUDUL BESAR\nisi satu\nisi dua\n\n- a\n* b\n1. c\n12.5\n"), ("e", ""), ("f", None)], "doc_id string, text string")
    assert rows(elements.parse_txt(docs), "type", "content", "level", "items") == [("heading", "JUDUL BESAR", 2, None), ("paragraph", "isi satu\nisi dua", None, None), ("bullet_list", "", None, ["a", "b"]), ("numbered_list", "", None, ["c"]), ("heading", "12.5", 2, None)]
    md = elements.parse_markdown(spark.createDataFrame([("d", MARKDOWN)], "doc_id string, text string"))
    assert [r[0] for r in rows(md, "type")] == ["heading", "heading", "paragraph", "bullet_list", "table", "caption", "heading", "numbered_list", "paragraph"]
    assert md.where("type = 'table'").first().rows == [["No", "Hak"], ["1", "Akses"]]


def test_html():
    got = html.parse("<html><head><title>t</title></head><body><!--c--><nav>menu</nav><h2>Judul <b>x</b></h2><p>satu <i>dua</i></p><ul><li>a</li><li>b</li></ul><table><tr><th>k</th><td>v</td></tr></table><img alt='gambar'><script>no</script></body></html>")
    assert [(e["type"], e["content"]) for e in got] == [("paragraph", "c"), ("paragraph", "menu"), ("heading", "Judul x"), ("paragraph", "satu dua"), ("bullet_list", ""), ("table", ""), ("image_caption", "gambar")]
    assert html.parse("") == [] and html.parse(None) == []


def _zip(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, x in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), x)
    return b.getvalue()


def test_office_and_delimited():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, t: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    d = _zip(word__document_DOT_xml=f"<w:document {w}><w:body>{p('Heading2', 'Judul')}{p('Normal', 'isi')}{p('ListNumber', 'butir')}<w:tbl><w:tr><w:tc>{p('Normal', 'k')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    assert [(e["type"], e["level"]) for e in office.docx(d)] == [("heading", 2), ("paragraph", None), ("numbered_list", None), ("table", None)]
    got = office.delimited(b"nama,umur\nAni,3\nBudi,\n", "orang.csv")
    assert [e["content"] for e in got] == ["orang", "Batch 1: baris 1-2 dari 2", "nama: Ani | umur: 3\nnama: Budi"]
    assert office.delimited(b"a,b\n", "h.csv") == []
    with pytest.raises(ValueError):
        office.delimited(b"", "e.csv")
    assert [e["content"] for e in office.delimited("stadt;preis\nKöln;1,5\nBonn;NA\n".encode("latin-1"), "p.csv")][2] == "stadt: Köln | preis: 1,5\nstadt: Bonn"


@pytest.mark.parametrize("text,want", [
    ("a,b\n1,2\n", [["a", "b"], ["1", "2"]]), ("a;b\n1;2\n", [["a;b"], ["1;2"]]), ("a;b\n1;2\n3,5;4,5\n", [["a", "b"], ["1", "2"], ["3,5", "4,5"]]), ("a;b\n1,5;2,5\n3;4\n", [["a", "b"], ["1,5", "2,5"], ["3", "4"]]),
    ("\ufeffa,a,\n1,2,3\n\n4\n", [["a", "a.1", "Unnamed: 2"], ["1", "2", "3"], ["4", "", ""]]), ("a,b\nx,1,2\ny,3,4\n", [["a", "b"], ["1", "2"], ["3", "4"]]), ("a\n1\n", [["a"], ["1"]]), ('a,b\n"x,\ny",2\n', [["a", "b"], ["x,\ny", "2"]]),
])
def test_delimiters(text, want):
    assert tabular.read_rows(text) == want


def test_encoding_of_a_head_that_ends_within_a_character():
    assert tabular.encoding("é".encode() * 10 + b"\xc3") == "utf-8" and tabular.encoding(b"caf\xe9,") == "latin-1"


def test_pdf_spans(spark):
    spans = [("d", p, i, t, s) for p in (1, 2) for i, (t, s) in enumerate([("Judul", 20.0), ("isi satu", 10.0), ("isi dua", 10.0), ("- butir", 10.0), (f"{p}", 10.0)])]
    e = office.pdf_elements(spark.createDataFrame(spans, "doc_id string, page int, line int, text string, size double"))
    assert [r[0] for r in rows(e, "type")] == ["heading", "paragraph", "bullet_list", "page_break"] * 2


def test_cleaning(spark):
    es = []
    for p in range(4):
        es += [element("d", 10 * p, "paragraph", f"KOP SURAT\nisi  {p}\t\tx"), element("d", 10 * p + 1, "heading", "Lampiran", 1), element("d", 10 * p + 2, "paragraph", f"Page {p} of 4\nteks {p}\nkaki"), element("d", 10 * p + 3, "page_break")]
    es += [element("e", 0, "paragraph", "KOP SURAT"), element("e", 1, "bullet_list", "", None, ["a", " "]), element("e", 2, "paragraph", " \n ")]
    got = clean.clean(table(spark, *es))
    d = rows(got.where("doc_id = 'd' and type <> 'page_break'"), "type", "content")
    assert d[:3] == [("paragraph", "isi 0 x"), ("heading", "Lampiran"), ("paragraph", "teks 0")]
    assert d[3:] == [("paragraph", f"{w}") for p in (1, 2, 3) for w in (f"isi {p} x", f"teks {p}")]
    assert rows(got.where("doc_id = 'e'"), "content", "items") == [("KOP SURAT", None), ("", ["a"])]
    off = Cleaning(False, False, False, False, False, False, False)
    assert clean.clean(table(spark, *es), off).count() == len(es) - 3
    assert clean.clean(table(spark)).count() == 0


def test_hierarchy_of_random_levels(spark):
    rng, es, want = random.Random(2), [], {}
    for d in range(30):
        stack: list = []
        for i in range(25):
            level = rng.choice([None, None, 1, 2, 3, 4, 6])
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
            want[str(d), i] = stack[-1][1] if stack else None
            if level:
                stack.append((level, i))
            es.append(element(str(d), i, "heading" if level else "paragraph", f"t{i}", level))
    got = hierarchy.parents(table(spark, *es))
    assert {(r.doc_id, r.ord): r.parent for r in got.collect()} == want
    has_subs = {(d, p) for (d, i), p in want.items() if p is not None and next(e for e in es if e[0] == d and e[1] == i)[4]}
    own = {(d, p) for (d, i), p in want.items() if p is not None and not next(e for e in es if e[0] == d and e[1] == i)[4]}
    heads = {(e[0], e[1]) for e in es if e[4]}
    loose = {(d, i) for (d, i), p in want.items() if p is None and (d, i) not in heads}
    assert {(r.doc_id, r.block) for r in hierarchy.blocks(table(spark, *es)).collect()} == {h for h in heads if h in own or h not in has_subs} | loose


def test_regulation_headings(spark):
    e = table(spark, element("d", 0, "paragraph", "pembuka\nBAB II\nisi\nlagi\nPasal 3\n"), element("d", 1, "table", "", None, None, [["BAB I"]]), element("d", 2, "heading", "Pasal 9", 2))
    assert rows(hierarchy.promote_headings(e), "ord", "type", "content", "level") == [(0, "paragraph", "pembuka", None), (1, "heading", "BAB II", 1), (2, "paragraph", "isi\nlagi", None), (3, "heading", "Pasal 3", 2), (4, "table", "", None), (5, "heading", "Pasal 9", 2)]


def test_packing():
    cfg = Chunking(target_tokens=50, min_tokens=10, max_tokens=80, overlap_tokens=20, respect_heading_boundary=False)
    assert chunk.pack([30, 30, 30, 30], [False] * 4, [False] * 4, cfg) == [[0, 1], [1, 2], [2, 3]]
    assert chunk.pack([5, 90, 5], [True, True, True], [True, False, False], cfg) == [[0, 1], [2]]
    assert chunk.pack([], [], [], cfg) == []
    rng = random.Random(1)
    for _ in range(200):
        n = [rng.randint(1, 120) for _ in range(rng.randint(1, 40))]
        groups = chunk.pack(n, [False] * len(n), [False] * len(n), Chunking(overlap_tokens=0, min_tokens=0, max_tokens=100))
        assert {i for g in groups for i in g} == set(range(len(n))) and all(g == list(range(g[0], g[-1] + 1)) for g in groups)
        assert all(b[0] in (a[-1], a[-1] + 1) for a, b in zip(groups, groups[1:]))  # even then one unit is carried over


def test_documents_to_answers(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "reg.md").write_text(MARKDOWN)
    (tmp_path / "in" / "hewan.txt").write_text("Kucing adalah hewan peliharaan. Anjing menjaga rumah.")
    (tmp_path / "in" / "sub" / "orang.csv").write_text("nama,kota\nAni,Bogor\n")
    (tmp_path / "in" / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "in" / "skip.bin").write_bytes(b"x")
    cfg = Config(store=config.Store(path=str(tmp_path / "store")), chunking=Chunking(30, 5, 80, 10), export=Export(output_dir=str(tmp_path / "out")))
    done, _ = pipelines.run(spark, str(tmp_path / "in"), cfg)
    got = done.chunks.collect()
    assert {r.filename for r in got} == {"reg.md", "hewan.txt", "orang.csv"} and [r.path.endswith("bad.docx") for r in done.errors.collect()] == [True]
    reg = sorted((r for r in got if r.filename == "reg.md"), key=lambda r: r.chunk_index)
    assert reg[0].text.startswith("[BAB I > Pasal 1]\n") and all(r.total_chunk == len(reg) and r.id == f"{r.document_id}_c{r.chunk_index:04d}" for r in reg)
    assert done.summary().first().failed == 1
    n = pipelines.index(spark, str(tmp_path / "in"), cfg)
    assert n == len(got) == pipelines.index(spark, str(tmp_path / "in"), cfg) == vectors.Store(spark, cfg.store.path).count()
    records = vectors.Store(spark, cfg.store.path).read()
    q = spark.createDataFrame([(0, "Kucing hewan peliharaan"), (1, "orang nama Ani kota Bogor Batch baris dari")], "query_id int, question string")
    best = {r.query_id: r.filename for r in pipelines.retrieve(records, q, cfg, top_k=1).collect()}
    assert best == {0: "hewan.txt", 1: "orang.csv"}
    answers = pipelines.answer(records, q, cfg, threshold=0.99).collect()
    assert all(r.answer == generate.NO_ANSWER for r in answers)
    status, out = serve.respond(spark, cfg, "/api/retrieve", {"question": "Kucing", "top_k": 2})
    assert status == 200 and out["total"] == 2 and serve.respond(spark, cfg, "/api/query", {})[0] == 422 and serve.respond(spark, cfg, "/x", {})[0] == 404
    assert ingest.ingest(spark, str(tmp_path / "in" / "sub"), str(tmp_path / "cp"), cfg).awaitTermination(120) is not False
    assert vectors.Store(spark, cfg.store.path).count() == n


def test_sinks(spark, tmp_path):
    done = pipelines.process_texts(spark.createDataFrame([("d", "Satu kalimat saja. Dua kalimat.")], "doc_id string, text string"))
    for kind in ("json", "jsonl", "markdown"):
        export.write(done.chunks, done.validations, Export(format=kind, output_dir=str(tmp_path / kind)))
        body = "".join(p.read_text() for p in (tmp_path / kind).rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
        assert "kalimat" in body
    row = json.loads(export.json_rows(done.chunks, done.validations).first().json)
    assert row["metadata"]["filename"] == "d" and 0 <= row["validation"]["quality_score"] <= 100
    with pytest.raises(ValueError):
        Config(export=Export(format="pdf"))


def test_upload(spark, tmp_path):
    cfg = Config(store=config.Store(path=str(tmp_path / "store")))
    data = b'--b\r\nContent-Disposition: form-data; name="file"; filename="c/notes.txt"\r\nContent-Type: text/plain\r\n\r\nKucing tidur.\r\nDi rumah.\r\n--b\r\nContent-Disposition: form-data; name="min_quality"\r\n\r\n0\r\n--b--\r\n'
    body = serve.form("multipart/form-data; boundary=b", data)
    assert body == {"filename": "notes.txt", "content": b"Kucing tidur.\r\nDi rumah.", "min_quality": "0"} and serve.form("application/json", b"") == {}
    status, out = serve.respond(spark, cfg, "/api/index", body)
    assert status == 200 and out == {"total_indexed": 1, "sources_succeeded": 1, "sources_failed": 0, "errors": [], "filename": "notes.txt"}
    assert vectors.Store(spark, cfg.store.path).read().first().filename == "notes.txt"
    assert serve.respond(spark, cfg, "/api/index", {"filename": "x.exe", "content": b""})[0] == 415
    status, out = serve.respond(spark, cfg, "/api/index", {"filename": "x.pdf", "content": b"no"})
    assert status == 200 and out["total_indexed"] == 0 and out["sources_failed"] == 1
    assert serve.respond(spark, cfg, "/", {})[0] == 200


def test_store(spark, tmp_path):
    s = vectors.Store(spark, str(tmp_path), "c")
    rows_ = lambda *x: spark.createDataFrame(list(x), "id string, text string, document_id string, embedding array<double>")
    assert s.read() is None and s.count() == 0 and s.search([1.0, 0.0]) is None
    s.upsert(rows_(("a", "x", "d", [1.0, 0.0]), ("b", "y", "e", [0.0, 1.0])))
    s.upsert(rows_(("b", "z", "e", [0.6, 0.8])))
    assert s.count() == 2 and s.list_collections() == ["c"]
    assert [(r.id, r.score, r.text) for r in s.search([1.0, 0.0]).orderBy("rank").collect()] == [("a", 1.0, "x"), ("b", 0.8, "z")]
    assert [r.id for r in s.search([1.0, 0.0], where=F.col("document_id") == "e").collect()] == ["b"]
    assert s.delete(["a", "no"]) == 2 and s.count() == 1
    with pytest.raises(embed.EmbeddingError):
        embed.get_embedder(type("E", (), {"provider": "none"})())


def test_batch_search_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, 0.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0])], "id int, embedding array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query_id string, embedding array<double>")
    assert [(r.query_id, r.id, r.score, r["rank"]) for r in vectors.batch_search(v, q, 2).orderBy("rank").collect()] == [("a", 1, 1.0, 1), ("a", 4, 1.0, 2)]
    assert vectors.batch_search(v.limit(0), q, 2).count() == 0 and vectors.batch_search(v, q.limit(0), 2).count() == 0


def test_hashing_embedder(spark):
    import hashlib
    import math

    text = 'The cat, "the" CAT! (sat)'
    want = [0.0] * 64
    for w in ("the", "cat", "the", "cat", "sat"):
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 64] += 1
    norm = math.sqrt(sum(x * x for x in want))
    assert one(spark, embed.hashing, text) == pytest.approx([x / norm for x in want])
    assert one(spark, embed.hashing, None) == [0.0] * 64


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "a.txt").write_text("Kucing tidur. Anjing lari.")
    (tmp_path / "c.yaml").write_text(f"store:\n  path: {tmp_path / 'store'}\n")
    base = ["--config", str(tmp_path / "c.yaml")]
    assert cli.main([*base, "process", str(tmp_path / "a.txt"), "--output", str(tmp_path / "out")]) == 0
    assert cli.main([*base, "query", "x"]) == 1
    assert cli.main([*base, "index", str(tmp_path / "a.txt")]) == 0
    assert cli.main([*base, "query", "Kucing", "--retrieve-only"]) == 0 and cli.main([*base, "stats"]) == 0
    assert "Kucing" in capsys.readouterr().out


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("chunking:\n  max_tokens: 9\nunknown: 1\n")
    assert config.load(tmp_path / "c.yaml").chunking.max_tokens == 9 and config.load(tmp_path / "none").chunking.max_tokens == 700
    with pytest.raises(ValueError):
        config.from_dict({"embedding": {"provider": "custom"}})


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "text": "t", "validation": {"quality_score": 50}}\n\n{"id": "b", "text": "u"}\n')
    assert [r.id for r in files.read_chunks(spark, str(tmp_path / "x.jsonl"), 60).collect()] == ["b"]
    assert files.read_chunks(spark, str(tmp_path / "x.jsonl")).count() == 2


def test_rows_are_numbered_over_ranges_of_one_sample(spark):
    """Ranges made twice have borders of two samples; counts of the one then number the rows of the other wrongly."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        rows = spark.range(40_000, numPartitions=4).select(F.pmod(F.col("id") * 7919, F.lit(40_000)).alias("k"), F.hex("id").alias("name"))
        assert all(r._row == r.k + 1 for r in tabular.numbered(rows, "k").collect())
        got = tabular.batches(rows, ["name"], "k").collect()
        assert len(got) == 800 and all(r.last_row - r.first_row == 49 and r.content.count("\n") == 49 for r in got)
    finally:
        spark.conf.unset(name)


def test_line_classes_of_texts_that_end_with_a_break(spark, duck, compare):
    """The SQL counts a blank line after the last break, and one of an empty text."""
    texts = [(1, "ABC\n"), (2, ""), (3, None), (4, "satu\n\n"), (5, "\n- a")]
    own = duck.cursor()
    own.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
    own.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    got = elements.classify_txt(spark.createDataFrame(texts, "doc_id long, text string")).groupBy("cls").agg(F.count("*").alias("n"))
    compare(got.toPandas(), own.execute(catalogue.ORACLE["txt_line_classes"]).fetchdf())
    assert elements.parse_txt(spark.createDataFrame(texts, "doc_id long, text string")).count() == 3


def test_texts_go_to_python_in_small_batches(spark, small):
    import pyarrow as pa

    @F.arrow_udf("int")
    def rows_at_once(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int32())

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, str(64 << 20))
    try:
        catalogue.QUERIES["text_unicode"](spark, small)
        long = spark.range(24, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
        assert long.select(rows_at_once("text").alias("n")).agg(F.max("n")).first()[0] <= 5
    finally:
        spark.conf.set(name, old or str(64 << 20))


@pytest.mark.parametrize("kind", ["txt", "markdown"])
def test_whole_texts_become_elements_without_an_exchange(spark, kind):
    texts = ["", "\n\n", MARKDOWN, "- a\n\n- b\n1. c\nJUDUL\nJUDUL\n#  x\n| |\n|--|\n\nteks\n", None, "a\n- b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parse, classify = (elements.parse_txt, elements.classify_txt) if kind == "txt" else (elements.parse_markdown, elements.classify_markdown)
    e = parse(docs)
    assert "Exchange" not in e._jdf.queryExecution().executedPlan().toString()
    assert sorted(e.collect(), key=str) == sorted(elements._assemble(classify(docs)).collect(), key=str)


def test_summary_makes_chunks_once_and_chunks_exchange_blocks(spark):
    done = pipelines.process_texts(spark.createDataFrame([("a", MARKDOWN)], "doc_id string, text string"))
    assert done.summary()._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    u = chunk.units(spark.createDataFrame(done.blocks.collect(), done.blocks.schema))
    assert u.count() == 1 and "Window" not in chunk.groups(u)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("header", [True, False])
def test_headers_of_one_document_are_not_one_task(spark, header):
    """The only window by document alone is over sums of stretches; no text goes through it."""
    rows = [("d", 2 * i + k, "page_break" if k else "paragraph", "" if k else f"KOP\n{'x' * 300}\nisi {i}\nKAKI") for i in range(6000) for k in (0, 1)]
    e = spark.createDataFrame(rows, "doc_id string, ord long, type string, content string").withColumn("items", elements.no_items()).withColumn("rows", elements.no_rows())
    found = clean.boilerplate_lines(e, header)
    assert [(r.doc_id, r.lines) for r in found.collect()] == [("d", ["KOP" if header else "KAKI"])]
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "[doc_id#" in x and "], [doc_id#" not in x]
    assert all("content#" not in x for x in windows)
    assert clean._pages(e).select(F.max("page")).first()[0] == 6000
    assert {r.content for r in clean.repeated_lines(e, header).where("type <> 'page_break' and ord < 2").collect()} == {("KOP\n" if not header else "") + "x" * 300 + "\nisi 0" + ("\nKAKI" if header else "")}
