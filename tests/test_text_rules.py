"""Text rules against plain Python over random texts, and files whose bytes are no UTF-8."""

import random
import re

from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.sources import files

BITS = ["a", "Dr.", "No.", "dst.", "Mrs.", ".", "!", "?", " ", "  ", "\n", " ", "A", "B", "7", '"', "(", "the", "dan", "di,", "(di)", "yang", "x", "É", " "]


def sentences(text):
    """Abbreviations hidden, the text cut, abbreviations shown again."""
    for i, a in enumerate(T.ABBREVIATIONS):
        text = text.replace(a, f" __ABBR{i}__ ")
    out = []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", text):
        for i, a in enumerate(T.ABBREVIATIONS):
            s = s.replace(f" __ABBR{i}__ ", a)
        if s.strip():
            out.append(s.strip())
    return out


def language(text):
    words = text.split()
    bare = {re.sub(r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", "", w.lower()) for w in words}
    n = {k: len(bare & set(v.split())) for k, v in T._STOP.items()}
    return "id" if len(words) < 5 or not any(n.values()) or n["id"] >= n["en"] else "en"


def test_sentences_and_language_of_random_texts(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 25))) for _ in range(600)] + [" ".join(rng.choices(BITS, k=rng.randint(4, 12))) for _ in range(400)] + ["word " * 60000 + "the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows.select("i", T.split_sentences("text").alias("s"), T.detect_language("text").alias("l"), T.strip("text").alias("t")).collect()
    for r in got:
        x = texts[r.i]
        assert (r.s, r.l, r.t) == (sentences(x), language(x), x.strip()), x[:200]
    assert rows.limit(1).select(T.split_sentences(F.lit(None).cast("string")).alias("s"), T.detect_language(F.lit(None).cast("string")).alias("l")).first()[:] == ([], "id")


def test_bytes_that_are_no_utf8(spark, tmp_path):
    bad = {"a.txt": b"good\n\xff\xfeline \xe4\n", "b.md": b"# T\xc3\n\ntext \xed\xa0\x80 end\n", "c.html": b"<p>\xf0\x9f\x98 cut</p>", "d.txt": b"", "e.txt": "Straße".encode()}
    for name, raw in bad.items():
        (tmp_path / name).write_bytes(raw)
    e, errors = files.parse(files.read_files(spark, str(tmp_path)))
    got = {}
    for r in e.orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id.rsplit("/", 1)[1], []).append(r.content)
    assert errors.count() == 0
    assert got["a.txt"] == [bad["a.txt"].decode(errors="replace").strip()]
    assert got["b.md"] == [x.removeprefix("# ") for x in bad["b.md"].decode(errors="replace").strip().split("\n\n")]
    assert got["c.html"] == [re.sub("<.*?>", "", bad["c.html"].decode(errors="replace"))] and got["e.txt"] == ["Straße"] and "d.txt" not in got
