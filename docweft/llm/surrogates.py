"""Personal data replaced by keyed surrogates of the same type, format, gender and script.

A surrogate is a function of the key, the type and the normalised entity, so an entity has one surrogate in all
documents. Names are replaced part by part, so that "Anna Weber", "Frau Weber" and a bare "Weber" of the same text stay
one person, and addresses of mail by the part before the @ and the domain. A given name's gender is settled once for the
corpus, from the titles before it. Given names are learned from the corpus as well: what stands after a title and
before a further name is a given name wherever it stands. A small list of given names is where this begins.

A check over all distinct entities finds surrogates that two entities would share, or that are themselves entities of
the corpus; all but the first of them move on to their next surrogate until none collide. From the fourth on
surrogates grow longer, so an exhausted format ends nothing. Only those exceptions and the learned names
travel to the second pass over the texts; all else is derived where it stands.
"""

from __future__ import annotations

import hashlib
import hmac
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import _common as C

#: Exceptions and learned names that are sent to every task; beyond it they are joined to the texts that hold them.
IN_PLAN = 100_000

_GIVEN = {
    "f": "Anna Maria Emma Sophie Julia Laura Sarah Emily Alice Charlotte Claire Camille Juliette Isabelle Katharina Johanna Ingrid Helga Ursula Carmen Lucía Sofía Elena Isabel Olivia Hannah Jessica Jennifer Elizabeth Margaret Susan Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина",
    "m": "John James Robert Michael William David Richard Thomas Charles Daniel Matthew Andrew George Peter Paul Hans Jürgen Klaus Wolfgang Stefan Markus Pierre Jean Jacques François Antoine Carlos José Miguel Antonio Javier Fernando Luis Иван Алексей Дмитрий Сергей Андрей Михаил Владимир Николай Пётр",
}
_GENDER = {n.casefold(): g for g, names in _GIVEN.items() for n in names.split()}
_TITLE = {"mr": "m", "herr": "m", "señor": "m", "sr": "m", "monsieur": "m", "г-н": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "sra": "f", "madame": "f", "mme": "f", "mlle": "f", "г-жа": "f", "dr": "n", "prof": "n"}
_TITLES = "|".join(sorted(("Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme Mlle Г-н Г-жа").split(), key=len, reverse=True))
_NAMES = "|".join(x for names in _GIVEN.values() for n in names.split() for x in (n, n.upper()))
_CAP = r"\p{Lu}[\p{L}'’-]+"
PATTERN = regex.compile(
    rf"""(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)+)
    |(?i:api[_-]?key|key|token|secret|passw(?:or)?d)["']?\s*[:=]\s*["']?(?P<secret>[A-Za-z0-9_\-+/]{{12,}})
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}[ ]?[A-Z0-9]{{1,4}}(?![A-Za-z0-9]))
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))
    |(?P<phone>(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}(?!\d)
        |(?<![\w+])\+(?=\d(?:[ .()-]{{0,2}}\d){{7}})\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{1,4}}(?:[ .-]?\d{{2,4}}){{1,5}}(?!\d)|(?<![\w(])\(\d{{3}}\)[ ]?\d{{3}}[ .-]\d{{4}}(?!\d)|(?<![\w.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-]))
    |(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
    |(?P<account>(?<![\w.-])(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}})(?![\w-]))
    |(?<!\w)(?P<title>{_TITLES})\.?\s+(?P<named>{_CAP}(?:\ {_CAP}){{0,2}})
    |(?<!\w)(?P<name>(?:{_NAMES})\ {_CAP}(?:\ {_CAP})?)""",
    regex.VERBOSE,
)
#: What any entity contains, for the engine that passes over most texts. Its \b, \d and \s are ASCII only, those of PATTERN are not.
_BLANK, _DIGIT = "[^!-~]", r"\p{Nd}"
HINT = rf"@|{_DIGIT}{{3}}|{_DIGIT}\.{_DIGIT}|\+{_DIGIT}|[A-Z]{{2}}{_DIGIT}{{2}} ?[A-Z0-9]{{4}}|(?i:key|token|secret|passw(?:or)?d)[\"']?{_BLANK}*[:=]|(?:{_TITLES})\.?{_BLANK}|(?:{_NAMES}) "
_TITLED = rf"(?:{_TITLES})\.?{_BLANK}"
_RUN = regex.compile(rf"(?<!\w){_CAP}(?:\ {_CAP})+")
_BARE = regex.compile(rf"(?<![\w@.-]){_CAP}(?![\w@])")

_SOUNDS = {
    "latin": (("b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "br", "dr", "gr", "st", "tr"), "aeiou"),
    "cyrillic": (("б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ф", "х", "бр", "др", "ст", "тр"), "аеиоу"),
}
_LAST = {("latin", "f"): ("a", "ia", "ine", "elle"), ("latin", "m"): ("o", "us", "ert", "an"), ("latin", "n"): ("el", "en", "er", "is"), ("latin", "s"): ("mann", "son", "ez", "ard", "ley"), ("cyrillic", "f"): ("а", "ия"), ("cyrillic", "m"): ("ий", "ан"), ("cyrillic", "n"): ("ен", "ис"), ("cyrillic", "s"): ("ов", "ин", "енко")}


class _Stream:
    """Numbers drawn from HMAC-SHA256 of what is to be replaced."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.value = int.from_bytes(hmac.new(key, f"{kind}\0{attempt}\0{entity}".encode(), hashlib.sha512).digest())

    def below(self, n: int) -> int:
        self.value, x = divmod(self.value, n)
        if self.value < 1 << 32:
            self.value = int.from_bytes(hashlib.sha512(str(self.value).encode() + b"more").digest())
        return x


def _like(s: str, draw: _Stream) -> str:
    """Letters for letters of the same case, digits for digits, all else as it is."""
    hexes = all(c in "0123456789abcdefABCDEF" for c in s) and len(s) >= 12
    out = []
    for c in s:
        if c.isdecimal():
            out.append(chr(ord(c) - int(c) + draw.below(10)))  # in its own script
        elif c.isalpha():
            x = "abcdef"[draw.below(6)] if hexes else "abcdefghijklmnopqrstuvwxyz"[draw.below(26)]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """What stands for a normalised entity at its n-th attempt; of an address of mail, for the part before the @."""
    draw = _Stream(key, kind, entity, attempt)
    longer = max(0, attempt - 3)
    letters = lambda n: "".join("abcdefghijklmnopqrstuvwxyz"[draw.below(26)] for _ in range(n))
    digits = lambda n: "".join(str(draw.below(10)) for _ in range(n))
    if kind == "email":
        local = entity.rpartition("@")[0]
        return _like(local, draw) + letters(longer or 4 * (not any(map(str.isalnum, local))))
    if kind == "domain":
        *labels, top = entity.split(".")
        return ".".join([_like(labels[0], draw) + letters(longer or 4 * (not any(map(str.isalnum, "".join(labels))))), *(_like(x, draw) for x in labels[1:]), top])
    if kind == "ip":
        private = next((p for p in ("10.", "192.168.", "127.") if entity.startswith(p) and not longer), "")
        have = private.count(".")
        return private + ".".join(str(1 + draw.below(254)) for _ in range(4 - have)) + (f":{draw.below(65536)}" if attempt > 7 else "")
    if kind == "phone":
        plus = entity[: 0 if entity[0] != "+" else 2 if entity[1] in "17" else 3]  # the country stays
        return plus + _like(entity[len(plus) :], draw) + digits(longer)
    if kind == "account":
        good = luhn(entity)
        while True:
            x = str(1 + draw.below(9)) + digits(len(entity) - 1 + longer)
            if luhn(x) == good:
                return x
    if kind == "iban":
        x = entity[:2] + "00" + _like(entity[4:], draw) + digits(longer)
        check = 98 - int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
        return f"{x[:2]}{check:02d}{x[4:]}"
    if kind.startswith("name"):
        script = "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in entity) else "latin"
        sounds, vowels = _SOUNDS[script]
        ends = _LAST[script, kind[-1]]
        n = 2 + longer + draw.below(2)
        return "".join(sounds[draw.below(len(sounds))] + vowels[draw.below(len(vowels))] for _ in range(n)) + sounds[draw.below(15)] + ends[draw.below(len(ends))]
    return _like(entity, draw) + (digits(longer) if kind == "ssn" else letters(longer))


def _usual(kind: str, entity: str) -> str:
    """The type by which a surrogate is drawn where the corpus says nothing of a given name's gender."""
    return f"name_{_GENDER.get(entity, 'n')}" if kind == "name_g" else kind


class Known:
    """Given names that the corpus taught, in folded case."""

    def __init__(self, names: frozenset[str]):
        self.names = names
        data, offsets = C.strings(pa.array(sorted(names), pa.string()))
        start, end, row = C.words(data, offsets, C.WORD)
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
        self.hashes = np.unique(C.word_hashes(data, start[first], end[first])) if len(row) else np.zeros(0, np.uint64)

    def held(self, text: pa.Array) -> np.ndarray:
        """Whether a text has the first word of any of the names."""
        data, offsets = C.strings(pc.replace_substring(pc.utf8_lower(pc.fill_null(text, "")), "ß", "ss"))
        start, end, row = C.words(data, offsets, C.WORD)
        hit = np.isin(C.word_hashes(data, start, end), self.hashes)
        return np.bincount(row[hit], minlength=len(text)) > 0


_NOBODY = Known(frozenset())
Span = tuple[int, int, str, str, str]


def _core(word: str) -> str:
    """A word of a name without the ending of its genitive and marks behind it."""
    return word[:-2] if word[-2:] in ("'s", "’s") else word.rstrip("'’-")


def _named(text: str, at: int, end: int, gender: str, known: frozenset[str]) -> Iterator[Span]:
    words = text[at:end].split(" ")
    for i, w in enumerate(words):
        core = _core(w)
        low = core.casefold()
        given = i == 0 and (len(words) > 1 or low in _GENDER or low in known)
        yield at, at + len(core), "name_g" if given else "name_s", low, gender
        at += len(w) + 1


def _parts(m: regex.Match, known: frozenset[str] = frozenset()) -> Iterator[Span]:
    """Begin, end, type, normalised form and gender by title of all that one match replaces."""
    if m.group("title"):
        yield from _named(m.string, *m.span("named"), _TITLE[m.group("title").casefold()], known)
    elif m.group("name"):
        yield from _named(m.string, *m.span("name"), "n", known)
    else:
        kind = next(k for k in ("email", "secret", "iban", "ip", "phone", "ssn", "account") if m.group(k))
        lo, hi = m.span(kind)
        s = m.group(kind)
        if kind == "email":
            at = lo + s.rindex("@")
            yield lo, at, kind, s.lower(), "n"
            lo, kind, s = at + 1, "domain", s[at + 1 - lo :].lower()
        elif kind in ("account", "iban"):
            s = s.replace(" ", "").replace("-", "")
        elif kind == "phone":
            s = ("+" if s[0] == "+" else "") + "".join(c for c in s if c.isdigit())
        yield lo, hi, kind, s, "n"


def _common(text: str, low: str) -> bool:
    """Whether a text also has the word in small letters, as it has no name."""
    return low in text and regex.search(rf"(?<!\w){regex.escape(low)}(?!\w)", text) is not None


def spans(text: str, known: frozenset[str] = frozenset()) -> list[Span]:
    """All that is replaced in a text, in order: what ``PATTERN`` finds, names by learned given names, and bare mentions of either's parts."""
    out = [x for m in PATTERN.finditer(text) for x in _parts(m, known)]
    begins, ends = [x[0] for x in out], [x[1] for x in out]

    def free(lo: int, hi: int) -> bool:
        i = bisect_right(begins, lo)
        return (not i or ends[i - 1] <= lo) and (i == len(begins) or begins[i] >= hi)

    if known:
        more = []
        for m in _RUN.finditer(text):
            at, words = m.start(), m.group().split(" ")
            i = 0
            while i < len(words) - 1:
                n = min(3, len(words) - i)
                end = at + sum(map(len, words[i : i + n])) + n - 1
                if _core(words[i]).casefold() in known and free(at, end):
                    more += _named(text, at, end, "n", known)
                    i, at = i + n, end + 1
                else:
                    at += len(words[i]) + 1
                    i += 1
        out = sorted(out + more)
        begins, ends = [x[0] for x in out], [x[1] for x in out]
    names: dict[str, str] = {}
    for _, _, kind, entity, _ in out:
        if kind.startswith("name"):
            names.setdefault(entity, kind)
    names = {k: kind for k, kind in names.items() if not _common(text, k)}
    if names:
        more = []
        for m in _BARE.finditer(text):
            core = _core(m.group())
            kind = names.get(core.casefold())
            if kind and free(m.start(), m.start() + len(core)):
                more.append((m.start(), m.start() + len(core), kind, core.casefold(), "n"))
        out = sorted(out + more)
    return out


def _dress(kind: str, old: str, new: str) -> str:
    """The surrogate in the format in which the entity stands: case, and the places of blanks and signs."""
    if kind.startswith("name"):
        return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:]
    if kind in ("account", "iban", "phone"):
        chars = iter(new.lstrip("+"))
        return "".join(next(chars, "") if c.isalnum() else c for c in old) + "".join(chars)
    if kind in ("email", "domain") and old.isupper():
        return new.upper()
    return new


def replace(text: str, key: bytes, exceptions: dict[tuple[str, str], str], known: frozenset[str] = frozenset()) -> tuple[str, int]:
    """The text with its surrogates, and how many names' parts and other entities were replaced."""
    out, at, n = [], 0, 0
    for lo, hi, kind, entity, _ in spans(text, known):
        new = exceptions.get((kind, entity)) or surrogate(key, _usual(kind, entity), entity)
        out += (text[at:lo], _dress(kind, text[lo:hi], new))
        at = hi
        n += kind != "domain"
    out.append(text[at:])
    return "".join(out), n


def _hinted(text: pa.Array, known: Known = _NOBODY) -> pa.Array:
    hint = pc.fill_null(pc.match_substring_regex(text, HINT), False)
    return pc.or_(hint, pa.array(known.held(text))) if known.names else hint


def given_names(docs: DataFrame) -> DataFrame:
    """``entity``: what stands between a title and a further name more often than not in texts that don't have it in small letters; names of the list are left out."""

    def run(batches):
        for b in C.slices(batches):
            text = b.column("text")
            n: Counter = Counter()
            for t in text.filter(pc.fill_null(pc.match_substring_regex(text, _TITLED), False)).to_pylist():
                for m in PATTERN.finditer(t):
                    first, _, rest = (m.group("named") or "").partition(" ")
                    first = _core(first).casefold()
                    if rest and first not in _GENDER:
                        n[first] += -1 if _common(t, first) else 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["entity", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "entity string, n bigint")
    return found.groupBy("entity").agg(F.sum("n").alias("n")).where("n > 0").select("entity")


def _facts(docs: DataFrame, table: DataFrame) -> tuple:
    """``docs`` with what of ``table`` (``kind, entity, new``; learned names are of the kind ``known``) its texts may need, and a function that gives a batch's.

    Up to IN_PLAN rows go to all tasks. More are joined to the texts by all that a text could ask for, and come as a column at the end.
    """
    if table.count() <= IN_PLAN:
        rows = [(r.kind, r.entity, r.new) for r in table.collect()]
        own = {(k, e): x for k, e, x in rows if k != "known"}
        shared = docs.sparkSession.sparkContext.broadcast((own, Known(frozenset(e for k, e, _ in rows if k == "known"))))

        def every(b: pa.RecordBatch, text: pa.Array):
            own, known = shared.value
            return _hinted(text, known).to_pylist(), [(own, known.names)] * len(text)

        return docs, every

    def asked(batches):
        for b in C.slices(batches):
            for k, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist()):
                words = {w for m in _RUN.finditer(t) for w in m.group().split(" ")}
                x = {("known", _core(w).casefold()) for w in words} | {(k, _core(w).casefold()) for w in words for k in ("name_g", "name_s")}
                for _, _, kind, e, _ in spans(t):  # with further names a part may be of another kind
                    x |= {("name_g", e), ("name_s", e), ("known", e)} if kind.startswith("name") else {(kind, e)}
                x = sorted(x)
                if x:
                    kinds, es = zip(*x)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), pa.string()), pa.array(kinds), pa.array(es)], ["k", "kind", "entity"])

    k = F.sha2(F.col("text").cast("string"), 256)
    hold = docs.where("text is not null").select(k.alias("k"), F.col("text").cast("string")).mapInArrow(asked, "k string, kind string, entity string").distinct()
    mine = hold.join(table, ["kind", "entity"]).groupBy(F.col("k").alias("_dw_k")).agg(F.collect_list(F.struct("kind", "entity", "new")).alias("_dw_own"))
    columns = docs.columns

    def each(b: pa.RecordBatch, text: pa.Array):
        rows = [[(x["kind"], x["entity"], x["new"]) for x in more or ()] for more in b.column(len(columns)).to_pylist()]
        facts = [({(k, e): x for k, e, x in r if k != "known"}, frozenset(e for k, e, _ in r if k == "known")) for r in rows]
        return [h or bool(known) for h, (_, known) in zip(_hinted(text).to_pylist(), facts)], facts

    return docs.withColumn("_dw_k", k).join(mine, "_dw_k", "left").select(*columns, "_dw_own"), each


def entities(docs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``kind, entity, gender``: all distinct normalised entities of the texts; the gender of given names, by the list or by the titles before them."""
    docs = docs.select(F.col("text").cast("string"))
    empty = docs.sparkSession.createDataFrame([], "kind string, entity string, new string")
    docs, facts = _facts(docs, empty if names is None else names.select(F.lit("known").alias("kind"), "entity", F.lit("").alias("new")))

    def run(batches):
        for b in C.slices(batches):
            text = b.column(0)
            hint, own = facts(b, text)
            n: Counter = Counter()
            for t, h, (_, known) in zip(text.to_pylist(), hint, own):
                if h:
                    n.update((kind, e, g if kind == "name_g" else "n") for _, _, kind, e, g in spans(t, known))
            if n:
                kind, e, g = zip(*n)
                f, m = (pa.array([c if x == s else 0 for x, c in zip(g, n.values())], pa.int64()) for s in "fm")
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(e, pa.string()), f, m], ["kind", "entity", "f", "m"])

    found = docs.mapInArrow(run, "kind string, entity string, f bigint, m bigint").groupBy("kind", "entity").agg(F.sum("f").alias("f"), F.sum("m").alias("m"))
    listed = F.create_map(*[F.lit(x) for kv in _GENDER.items() for x in kv])[F.col("entity")]
    gender = F.coalesce(listed, F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n"))
    return found.select("kind", "entity", F.when(F.col("kind") == "name_g", gender).alias("gender"))


def exceptions(found: DataFrame, key: bytes, derive=surrogate) -> DataFrame:
    """``kind, entity, new`` of the entities whose first surrogate another entity has, or is, or whose gender isn't the usual one.

    ``found`` has ``kind, entity`` and perhaps ``gender``. Of equal surrogates that of the smallest entity stays.
    """
    if "gender" not in found.columns:
        found = found.withColumn("gender", F.lit(None).cast("string"))
    schema = "kind string, entity string, gender string, attempt int, new string, odd boolean"

    def run(batches):
        for b in batches:
            kind, entity, gender, attempt, new = (b.column(k).to_pylist() for k in ("kind", "entity", "gender", "attempt", "new"))
            drawn = [f"name_{g}" if k == "name_g" and g else _usual(k, e) for k, e, g in zip(kind, entity, gender)]
            made = [x or derive(key, k, e, a) for x, k, e, a in zip(new, drawn, entity, attempt)]
            odd = [k != _usual(o, e) for k, o, e in zip(drawn, kind, entity)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("kind", "entity", "gender", "attempt")), pa.array(made, pa.string()), pa.array(odd, pa.bool_())], ["kind", "entity", "gender", "attempt", "new", "odd"])

    # What a surrogate of its kind is compared with: of addresses of mail, the part before the @.
    form = F.when(F.col("kind") == "email", F.regexp_extract("entity", "^(.*)@", 1)).otherwise(F.col("entity"))
    real = found.select("kind", form.alias("new"), F.lit(True).alias("real")).distinct()
    rank = F.row_number().over(Window.partitionBy("kind", "new").orderBy("attempt", "entity"))
    now = found.select("kind", "entity", "gender", F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("new"))
    while True:
        made = now.mapInArrow(run, schema).withColumn("rank", rank).join(real, ["kind", "new"], "left")
        made = C.cut(made.withColumn("bad", (F.col("rank") > 1) | F.col("real").isNotNull()).drop("rank", "real"))
        if not made.where("bad").limit(1).count():
            return made.where("attempt > 0 or odd").select("kind", "entity", "new")
        now = made.select("kind", "entity", "gender", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"), F.when(~F.col("bad"), F.col("new")).alias("new"))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities of ``text`` replaced, and ``n_replaced`` (in place of a column of that name).

    Null and empty texts stay so, with 0. Rows, their other columns and their number stay as they are; repeated
    rows get equal texts. Entities: addresses of mail, IPv4 addresses, telephone numbers, account and card numbers
    (their Luhn check stays true or false), IBANs (their surrogates' check digits are right), social security numbers,
    secrets after ``token =`` and the like, names after a title or beginning with a listed or learned given name, and
    capitalised bare mentions of such a name's parts in the same text, unless the text has the word in small letters too.
    A word that is both given name and surname has a surrogate as either; bare, it is what it is first. Names that never
    stand after a title or a given name in the corpus are not found.
    """
    secret = key.encode()
    names = C.cut(given_names(docs))
    own = C.cut(exceptions(C.cut(entities(docs, names)), secret))
    schema = StructType([*(f for f in docs.schema.fields if f.name != "n_replaced"), StructField("n_replaced", IntegerType())])
    docs = docs.drop("n_replaced")
    columns = docs.columns
    docs, facts = _facts(docs, own.unionByName(names.select(F.lit("known").alias("kind"), "entity", F.lit("").alias("new"))))

    def run(batches):
        for b in C.slices(batches):
            text = b.column(columns.index("text")).cast(pa.string())
            news, counts = [], []
            for t, h, (moved, known) in zip(text.to_pylist(), *facts(b, text)):
                t, n = replace(t, secret, moved, known) if h else (t, 0)
                news.append(t)
                counts.append(n)
            out = {k: b.column(i) for i, k in enumerate(columns)} | {"text": pa.array(news, pa.string()), "n_replaced": pa.array(counts, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return docs.mapInArrow(run, schema)
