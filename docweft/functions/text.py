"""Column expressions over text. All but NFC run inside Catalyst."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: All that (?U)\s matches, for trimming without a regular expression.
BLANKS = "\t\n\u000b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
PAGE_OF = r"(?iU)\b(?:halaman|hal\.?|page)\s+\d+\s*(?:dari|of)\s*\d+\b"
ABBREVIATIONS = ("Mr.", "Mrs.", "Dr.", "No.", "Ps.", "Vs.", "Inc.", "Ltd.", "dll.", "dsb.", "dst.", "hlm.", "tgl.")
HEADING = r"^(#{1,6})\s+(.*)$"
CAPS = r"^[A-Z0-9 \-–\(\)\.\,:/]{3,}$"
CAPTION = r"(?i)^\s*[*_]\s*(?:Figura|Figure|Tabel|Table|Gambar)\s"
_STOP = {
    "id": "dan atau yang di ke dari untuk dengan pada adalah ini itu akan tidak dalam juga oleh sebagai",
    "en": "the and or of to in for with on is are this that a an by as not",
}
_AFTER = "".join(f"(?<!{re.escape(a)})" for a in ABBREVIATIONS)
_SENTENCE = rf"(?U)(?<=[.!?]){_AFTER}\s+(?=[A-Z0-9\"'\(])(?!{'|'.join(map(re.escape, ABBREVIATIONS))})"
_STOPPED = rf"""(?U)(?<!\S)[.,;:!?"'()]*({'|'.join(sorted({w for v in _STOP.values() for w in v.split()}))})[.,;:!?"'()]*(?!\S)"""


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(_col(x), F.lit(BLANKS))


def is_blank(x: Column | str) -> Column:
    return F.coalesce(~_col(x).rlike(r"(?U)\S"), F.lit(True))


def lines(x: Column | str) -> Column:
    """Lines as an array; a line break at the end begins no further line."""

    def body(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return let(F.split(_col(x), LINE_BREAK), body)


def words(x: Column | str) -> Column:
    return F.filter(F.split(_col(x), r"(?U)\s+"), lambda w: w != "")


def count_words(x: Column | str) -> Column:
    return F.when(_col(x).isNull(), 0).otherwise(F.size(words(x)))


def count_tokens(x: Column | str) -> Column:
    """Estimate without a vocabulary: words times 1.33, cut off."""
    return (count_words(x) * F.lit(1.33)).cast("int")


_CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]"


def _tidy(x: pa.Array) -> pa.Array:
    """NFC without control characters other than line feeds and tabs, of all strings however deep in lists."""
    if pa.types.is_list(x.type):
        lo, hi = (x.offsets[0].as_py(), x.offsets[-1].as_py()) if len(x) else (0, 0)
        offsets = pc.subtract(x.offsets, lo) if lo else x.offsets
        return pa.ListArray.from_arrays(offsets.cast(pa.int32()), _tidy(x.values.slice(lo, hi - lo)), mask=x.is_null() if x.null_count else None)
    # The library's own utf8_normalize adds blanks to some texts.
    normal = [v if v is None or v.isascii() else unicodedata.normalize("NFC", v) for v in x.to_pylist()]
    return pc.replace_substring_regex(pa.array(normal, pa.string()), _CONTROLS, "")


@F.arrow_udf(StringType())
def _tidy_text(x: pa.Array) -> pa.Array:
    return _tidy(x)


@F.arrow_udf(ArrayType(StringType()))
def _tidy_items(x: pa.Array) -> pa.Array:
    return _tidy(x)


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def _tidy_rows(x: pa.Array) -> pa.Array:
    return _tidy(x)


def normalize_unicode(x: Column | str) -> Column:
    """NFC without control characters other than line feeds and tabs; null reads as empty. An Arrow function, for Catalyst knows no NFC."""
    return _tidy_text(F.coalesce(_col(x), F.lit("")))


def normalize_items(x: Column | str) -> Column:
    return _tidy_items(_col(x))


def normalize_rows(x: Column | str) -> Column:
    return _tidy_rows(_col(x))


def fix_broken_ocr(x: Column | str) -> Column:
    x = F.coalesce(_col(x), F.lit(""))
    x = F.when(x.rlike("[\ufffd□☐]"), F.translate(F.replace(x, F.lit("\ufffd"), F.lit("")), "□☐", "  ")).otherwise(x)
    return F.regexp_replace(x, r"([a-zA-Z])\1{6,}", "$1")


def looks_like_page_number(x: Column | str) -> Column:
    s = strip(x)
    return F.coalesce(s.rlike(r"(?U)^\d+$") | s.rlike(r"(?U)^[-–—\s]*\d+[-–—\s]*$") | s.rlike(r"(?iU)^(?:halaman|hal\.?|page)\s+\d+\s*(?:dari|of)\s*\d+$"), F.lit(False))


def is_page_number_line(x: Column | str) -> Column:
    """A line that is a page number and not the start of a numbered item."""
    return looks_like_page_number(x) & ~strip(x).rlike(r"(?U)^\d+[.)]\s+\S")


def is_pdf_page_number(x: Column | str) -> Column:
    return _col(x).rlike(r"(?U)^[-–—\s.\d]*\d+[-–—\s.]*$")


def strip_page_markers(x: Column | str) -> Column:
    x = _col(x)  # the words first, for which no boundaries have to be told
    return F.when(x.rlike("[pP][aA][gG][eE]|[hH][aA][lL]"), F.regexp_replace(x, PAGE_OF, "")).otherwise(x)


def may_have_page_lines(x: Column | str) -> Column:
    """False only if no line of a text is a page number."""
    end = r"[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    return _col(x).rlike(rf"(?:^|{end})\s*(?:[^\p{{L}}\d]*\d|[hHpP])")


def collapse_whitespace(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), "[ \t]{2,}|\t", " ")


def collapse_blank_lines(x: Column | str, most: int = 2) -> Column:
    x = _col(x)
    squeezed = F.regexp_replace(x, "(?:[ \t]*\n){%d,}" % (most + 1), "\n" * most)
    return F.when(F.contains(x, F.lit("\n")), F.btrim(squeezed, F.lit("\n"))).otherwise(x)


def heading_level(x: Column | str) -> Column:
    """Number of # before a heading's text, else null."""
    n = F.length(F.regexp_extract(strip(x), HEADING, 1))
    return F.when(n > 0, n)


def heading_text(x: Column | str) -> Column:
    return strip(F.regexp_replace(x, "^[# ]+", ""))


def list_type(x: Column | str) -> Column:
    s = _col(x)
    return F.when(s.rlike(r"(?U)^\s*[-*+]\s+"), "bullet_list").when(s.rlike(r"(?U)^\s*\d+[.)]\s+"), "numbered_list")


def list_item(x: Column | str) -> Column:
    return strip(F.regexp_replace(_col(x), r"(?U)^\s*(?:[-*+]|\d+[.)])\s+", ""))


def split_sentences(x: Column | str) -> Column:
    """Sentences of a text; known abbreviations neither end nor begin one, and a sentence begins with an ASCII capital, digit, quote or bracket."""
    parts = F.split(F.coalesce(_col(x), F.lit("")), _SENTENCE)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def detect_language(x: Column | str, fallback: str = "id") -> Column:
    """id or en by distinct stop words; the fallback for texts of under five words or without any."""
    x = F.coalesce(_col(x), F.lit(""))

    def body(found: Column) -> Column:
        hits = {k: F.size(F.array_intersect(found, F.array(*map(F.lit, v.split())))) for k, v in _STOP.items()}
        return F.when((hits["id"] == 0) & (hits["en"] == 0), fallback).when(hits["id"] >= hits["en"], "id").otherwise("en")

    found = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(_STOPPED), F.lit(1)))
    return F.when(x.rlike(r"(?U)^\s*(?:\S++\s++){4}\S"), let(found, body)).otherwise(fallback)


def document_id(name: Column | str) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(_col(name).cast("string"), 256), 1, 16))


def chunk_id(doc: Column | str, index: Column | str) -> Column:
    return F.format_string("%s_c%04d", _col(doc), _col(index).cast("int"))


def file_signature(path: Column | str, size: Column | str, modified: Column | str) -> Column:
    """Digest of a file's path, size and time of change."""
    return F.substring(F.sha2(F.concat_ws("|", _col(path), _col(size).cast("string"), _col(modified).cast("string")), 256), 1, 16)


def signature(x: Column | str) -> Column:
    """What two texts must share to count as duplicates."""
    return F.substring(F.lower(strip(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"(?U)\s+", " "))), 1, 500)
