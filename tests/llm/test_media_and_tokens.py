"""FLAC, SentencePiece, conversation trees and surrogates by round trips and brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from docweft.llm import chat_tree, flac, flac_write, pieces, surrogates

RNG = np.random.default_rng(7)


def signal(channels, n, bits):
    t = np.arange(n)
    top = 1 << bits - 2
    x = [(np.sin(t / (9 + c)) * top * 0.5 + RNG.normal(0, top / 60, n)).astype(np.int64) for c in range(channels)]
    return np.array(x)


@pytest.mark.parametrize("kind,order", [("verbatim", 0), ("fixed", 0), ("fixed", 1), ("fixed", 2), ("fixed", 3), ("fixed", 4), ("lpc", 1), ("lpc", 8), ("lpc", 32)])
@pytest.mark.parametrize("bits,channels,mode", [(16, 1, None), (8, 2, 8), (24, 2, 9), (16, 2, 10), (12, 3, None)])
def test_flac_round_trip(kind, order, bits, channels, mode):
    x = signal(channels, 1000, bits)
    data = flac_write.encode(x, bits, 44100, 256, kind, order, parts=3, mode=mode, escape=order == 3)
    assert flac.whole_checksum(data)
    got = np.concatenate([b[4] for b in flac.decode(data)], axis=1)
    assert np.array_equal(got, x)


def test_flac_of_constant_and_wasted_bits():
    for x in (np.zeros((1, 600), np.int64), np.full((2, 600), -77), signal(1, 600, 16) << 3 & 0x7FF8):
        data = flac_write.encode(x, 16, 8000, 192)
        assert np.array_equal(np.concatenate([b[4] for b in flac.decode(data)], axis=1), x)


def test_broken_frames_and_seeking(spark):
    x = signal(1, 2000, 16)
    good = flac_write.encode(x, 16, 16000, 400)
    starts = [b[0] for b in flac.decode(good)]
    broken = bytearray(good)
    broken[starts[2] + 40] ^= 0x55
    rows = [(1, good), (2, bytes(broken)), (3, None), (4, b""), (5, b"RIFF...."), (1, good), (None, good), (6, good[: starts[3] + 20])]
    found = flac.blocks(spark.createDataFrame(rows, "id bigint, media binary"), "id", "media").cache()
    by = {}
    for r in found.collect():
        by.setdefault(r.id, []).append(r)
    assert len(by[1]) == 10 and len(by[None]) == 5 and 3 not in by and 4 not in by
    assert [r.status for r in by[5]] == ["not flac"]
    two = sorted(by[2], key=lambda r: r.first_sample)
    assert [(r.first_sample, r.n_samples, r.status) for r in two] == [(0, 400, "ok"), (400, 400, "ok"), (800, 400, "bad"), (1200, 400, "ok"), (1600, 400, "ok")]
    assert [r.status for r in sorted(by[6], key=lambda r: r.first_sample)] == ["ok", "ok", "ok", "bad"]
    hit = flac.seek(found.where("id = 2"), 1234).first()
    assert int.from_bytes(hit.pcm[2 * hit["at"] : 2 * hit["at"] + 2], "little", signed=True) == x[0, 1234]
    assert flac.blocks(spark.createDataFrame([], "id bigint, media binary"), "id", "media").count() == 0


def test_long_blocks_are_those_of_single_steps(monkeypatch):
    """Arrays of codes and of subframes against one code and one sample at a time."""
    x = signal(2, 9000, 16)
    for kind, order, parts in (("lpc", 8, 0), ("lpc", 2, 4), ("fixed", 2, 3)):
        data = flac_write.encode(x, 16, 44100, 512, kind, order, parts=parts, mode=10)
        monkeypatch.setattr(flac, "MANY_CODES", 2)
        fast = np.concatenate([b[4] for b in flac.decode(data)], axis=1)
        monkeypatch.setattr(flac, "MANY_CODES", 1 << 30)
        monkeypatch.setattr(flac, "MANY_SUBFRAMES", 1 << 30)
        assert np.array_equal(fast, x) and np.array_equal(np.concatenate([b[4] for b in flac.decode(data)], axis=1), x)
        monkeypatch.undo()
    for n in (0, 1, 127, 129, 1000):
        data, state = RNG.bytes(n), 0
        for b in data:
            state = (state << 8 & 0xFFFF) ^ flac._T16[state >> 8 ^ b]
        assert flac.crc16(data) == state


def test_streams_that_break_off_or_hold_junk(spark):
    x = signal(1, 2000, 16)
    good = flac_write.encode(x, 16, 16000, 400)
    starts = [b[0] for b in flac.decode(good)]
    long = bytearray(good[: starts[1] + 30])
    long[21:26] = (int.from_bytes(long[21:26]) & ~(2**36 - 1) | 15 << 32).to_bytes(5)  # STREAMINFO's total
    false = bytes([0xFF, 0xF8, 0x70, 0x08, 0xFE, 0xBF, 0xBF, 0xBF, 0xBF, 0xBF, 0xBF, 1, 1])
    false += bytes([flac.crc8(false)])  # a header whose CRC-8 holds, far ahead, without a frame
    rows = [(1, bytes(long)), (2, good[: starts[3]]), (3, good[: starts[2]] + b"junk" + good[starts[2] :]), (4, good[: starts[2] + 9] + false + good[starts[3] :]), (5, good[: starts[2]] + good[starts[3] :]), (6, good[:20]), (7, good[:4] + b"\x84" + good[5:])]
    media = spark.createDataFrame([(*r, "s", 5) for r in rows], "id bigint, media binary, status string, block int")
    by = {}
    for r in sorted(flac.blocks(media, "id", "media").collect(), key=lambda r: r.block):
        by.setdefault(r.id, []).append((r.first_sample, r.n_samples, r.status))
    assert by[1] == [(0, 400, "ok"), (400, (15 << 32) - 400, "bad")]
    assert by[2] == [(0, 400, "ok"), (400, 400, "ok"), (800, 400, "ok"), (1200, 800, "bad")]
    assert [r for r in by[3] if r[2] == "ok"] == [(i, 400, "ok") for i in range(0, 2000, 400)] and (800, 0, "bad") in by[3]
    assert by[4] == by[5] == [(0, 400, "ok"), (400, 400, "ok"), (800, 400, "bad"), (1200, 400, "ok"), (1600, 400, "ok")]
    assert by[6][0][2] == by[7][0][2] == "not flac"


TEXTS = [
    "Hello world", "  two  blanks ", "", " ", "a", "\n", "line\nbreak\tand tab", "Straße für Ökonomie, naïve café", "日本語のテキスト", "emoji 😀😀 end", "▁mark ▁▁ here", "x" * 3000,
    "http://example.com/a?b=c&d=e#f", "1234567890 12.5 3,000", "the the the the", "\u0000ctrl", "<s> </s> <unk>", "Москва Россия", "    indented = code(1)\n        return", "ALL CAPS AND MiXeD", "don't can't won't", "é combining", "…—–“quotes”",
]


def test_encoding_is_that_of_the_public_library(spark, small):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(150).collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choices("abcdeé ñ.,\n▁0123", k=rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "null id", "n"), (5000, None, "n"), (0, "repeated", "n"), (0, "repeated", "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = pieces.encoded(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (0, None)}
    for i, t in enumerate(texts[1:], 1):
        assert by[i].ids == lib.encode(t), repr(t)[:80]
        assert by[i].n_tokens == len(by[i].ids)
    assert by[5000].ids is None and by[5000].round_trip is None and by[5000].n_tokens == 0
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs)).collect()}
    for i, t in enumerate(texts[1:], 1):
        if by[i].round_trip:
            assert back[i] == t
        assert back[i] == lib.decode(by[i].ids) or "▁" in t or not by[i].round_trip
    assert sum(r.round_trip is True for r in got) >= len(texts) * 0.5
    assert back[5000] is None
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_long_words_take_memory_in_proportion():
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(8)
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=8000))
    m = pieces.Model(open(pieces.MODEL, "rb").read())
    m.encode(pa.array(["a b"]))
    for text in (base64, "".join(chr(rng.randint(0x12000, 0x12300)) for _ in range(4000))):
        tracemalloc.start()
        ids, _ = m.encode(pa.array([text]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert ids.tolist() == lib.encode(text)
        assert peak < 40e6


def test_long_words_are_not_kept_without_end(monkeypatch):
    monkeypatch.setattr(pieces, "IDS_KEPT", 100)
    m = pieces.Model(open(pieces.MODEL, "rb").read())
    for i in range(5):
        m.encode(pa.array([f"{i}" + "q7" * 100]))
    assert len(m.index) == 1


def test_unigram_takes_the_best_path():
    vocab = {"▁": -3.0, "a": -4.0, "b": -4.0, "c": -4.0, "ab": -5.0, "bc": -4.5, "▁a": -4.2, "▁ab": -6.5, "abc": -9.0, "cab": -6.0}

    def field(n, kind, x):
        return bytes([n << 3 | kind]) + x

    def sized(n, x):
        return field(n, 2, bytes([len(x)]) + x)

    raw = sized(1, sized(1, b"<unk>") + field(3, 0, bytes([2])))
    for p, s in vocab.items():
        raw += sized(1, sized(1, p.encode()) + field(2, 5, np.float32(s).tobytes()))
    raw += sized(2, field(3, 0, b"\x01")) + sized(3, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    m = pieces.Model(raw)
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(200)]
    m.learn(sorted(set(words)))

    def best(w):
        score = [0.0] + [-1e9] * len(w)
        for j in range(1, len(w) + 1):
            score[j] = max(score[i] + vocab.get(w[i:j], -1e9) for i in range(j))
        return score[-1]

    for w in words:
        at = m.index[w]
        ids = m.flat[m.start[at] : m.start[at + 1]]
        assert "".join(m.pieces[i] for i in ids) == w
        assert abs(sum(m.scores[i] for i in ids) - best(w)) < 1e-4


def test_chat_trees(spark):
    rng = random.Random(5)
    said = ["Hi there", "What is it?", "Tell me more", "", "Grüße"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, ["system", "user", "assistant"][min(t, 2)], "You help." if t == 0 and c % 2 else rng.choice(said)))
    rows += [(100, 0, None, None), (100, 1, "user", "x"), (101, 0, "", ""), (None, 0, "user", "lost"), rows[0], (102, None, "user", "first"), (102, 0, "user", "second")]
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, path string")
    check_trees(chat_tree.packed(turns).collect(), rows)
    assert chat_tree.packed(turns.limit(0)).count() == 0


def check_trees(got, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    convs: dict = {}
    for c, t, r, x in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((-1 if t is None else t, r, x))
    want: dict = {}
    for c, turns_ in convs.items():
        path = ()
        for t in sorted(turns_, key=str):
            path = (*path, t[1:])
            want.setdefault(path, []).append(c)
    members, got = [r for r in got if r.kind == "conversation"], [r for r in got if r.kind == "turn"]
    assert len(got) == len(want) == len({r.node for r in got})
    tokens = {p: lib.encode(chat_tree.rendered(*p[-1])) for p in want}
    by_tree: dict = {}
    for r in got:
        by_tree.setdefault(r.tree_id, []).append(r)
    assert len(by_tree) == len({p[0] for p in want})
    # Walk every tree: what a token attends to must be exactly its ancestors' tokens, in order.
    whole = {}
    for tree, nodes in by_tree.items():
        nodes.sort(key=lambda r: (r.offset, r.depth))
        sequence = [i for r in nodes for i in r.ids]
        assert [r.offset for r in nodes] == list(np.concatenate(([0], np.cumsum([r.n_tokens for r in nodes])))[:-1])
        for r in nodes:
            above = [i for a, b in zip(r.attend_from, r.attend_to) for i in sequence[a:b]]
            assert all(b < a for b, a in zip(r.attend_to, r.attend_from[1:]))
            assert r.position_ids == list(range(len(above), len(above) + r.n_tokens))
            whole[r.node] = (tree, above + r.ids, r.depth)
    assert sorted(r.conv_id for r in members) == sorted(convs)
    ends = {r.conv_id: r for r in members}
    for p, cs in want.items():
        for c in cs:
            if len(p) == len(convs[c]):
                assert whole[ends[c].node] == (ends[c].tree_id, [i for k in range(1, len(p) + 1) for i in tokens[p[:k]]], len(p)) and ends[c].depth == len(p)
    assert sum(r.n_tokens for r in got) == sum(map(len, tokens.values()))
    assert sorted(r.n_conversations for r in got) == sorted(map(len, want.values()))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_chat_trees_over_ranges(spark, parts):
    """Deep shared paths, equal conversations and one prompt for all, over more and fewer ranges than there are conversations."""
    rng = random.Random(parts)
    rows = []
    for c in range(50):
        rows.append((c, 0, "system", "One prompt."))
        rows += [(c, t, "user", rng.choice("ab")) for t in range(1, rng.randint(2, 10))]
    rows += [(60 + c, t, "user", f"{t}") for c in range(3) for t in range(9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        check_trees(chat_tree.packed(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_long_conversation_and_a_long_text(spark):
    rows = [(c, t, "user", f"turn {t if t < 5990 else t + c}") for c in range(2) for t in range(6000)] + [(2, 0, "user", "word " * 60000)]
    got = chat_tree.packed(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    turns = got.where("kind = 'turn'").select("depth", "n_tokens", "n_conversations", "offset", F.size("attend_from").alias("n")).collect()
    assert len(turns) == 6011 and max(r.depth for r in turns) == 6000 and {r.n for r in turns if r.depth > 5991} == {1, 2} and max(r.n_tokens for r in turns) > 60000
    assert sorted(r.n_conversations for r in turns) == [1] * 21 + [2] * 5990


PERSONAL = [
    "Mail anna.weber@example.org or call +49 30 1234567.", "Card 4111 1111 1111 1111, IBAN DE89 3704 0044 0532 0130 00.", "Frau Anna Weber met Herr Klaus Weber; Anna Weber left.", "Host 10.1.2.3 and 8.8.8.8, SSN 123-45-6789",
    'api_key = "sk_live_abcdef123456"', "Анна Петрова и Иван Петров", "ANNA WEBER wrote. anna.weber@example.org", "Nothing here at all.", "Mr. John Smith (555) 123-4567",
]


def test_surrogates(spark):
    rows = [(i, t, 3, "k") for i, t in enumerate(PERSONAL)] + [(50, None, 1, "k"), (51, "", 1, "k"), (None, PERSONAL[0], 1, "k"), (0, PERSONAL[0], 1, "k"), (52, "word " * 40000 + PERSONAL[0], 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_replaced int, kind string")
    out = surrogates.pseudonymised(docs, "secret").collect()
    assert len(out) == len(rows)
    text = {r.doc_id: r.text for r in out}
    assert text[50] is None and text[51] == "" and text[7] == PERSONAL[7] and text[52].endswith(text[0])
    whole = "\n".join(t or "" for t in text.values())
    for gone in ("anna.weber", "1234567", "4111 1111", "0532 0130", "123-45-6789", "sk_live", "Weber", "WEBER", "Петров", "John", "8.8.8.8"):
        assert gone not in whole, gone
    mail = re.match(r"Mail (\S+@\S+\.org) or call (\+49 \d\d \d{7})\.", text[0])
    assert mail and mail.group(1) in text[6]  # one entity, one surrogate everywhere
    card = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}), IBAN (DE\d\d(?: \d{4}){4} \d\d)\.", text[1])
    assert card and surrogates.luhn(card.group(1).replace(" ", ""))
    iban = card.group(2).replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    names = re.match(r"Frau (\w+) (\w+) met Herr (\w+) (\w+); (\w+) (\w+) left\.", text[2]).groups()
    assert names[1] == names[3] == names[5] and names[0] == names[4] != names[2]
    assert text[6].startswith(f"{names[0].upper()} {names[1].upper()} wrote")
    assert re.match(r"Host 10\.\d+\.\d+\.\d+ and \d+\.\d+\.\d+\.\d+, SSN \d{3}-\d{2}-\d{4}", text[3])
    assert re.fullmatch(r"[а-яА-Я]+ [а-яА-Я]+ и [а-яА-Я]+ [а-яА-Я]+", text[5])
    assert surrogates.pseudonymised(docs, "other").where("doc_id = 1").first().text != text[1]
    assert surrogates.pseudonymised(docs.limit(0), "secret").count() == 0


def test_surrogates_stay_distinct_when_they_collide(spark):
    found = spark.createDataFrame([("phone", f"+1{i:03d}") for i in range(200)] + [("ssn", "5"), ("ssn", "7")], "kind string, entity string")

    def weak(key, kind, entity, attempt):
        return str((hash((kind, entity)) if kind == "ssn" else int(entity[1:])) * 7 % 13 + attempt * 13) if kind == "phone" else str(5 + attempt)

    moved = {(r.kind, r.entity): r.new for r in surrogates.exceptions(found, b"k", weak).collect()}
    all_of = [(r.kind, moved.get((r.kind, r.entity)) or weak(b"k", r.kind, r.entity, 0)) for r in found.collect()]
    assert len(set(all_of)) == len(all_of)
    assert not {n for k, n in all_of if k == "ssn"} & {"5", "7"}


def test_many_exceptions_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PERSONAL)] + [(60, None)] + [(100 + i, v[0]) for i, v in PEOPLE.items()], "doc_id bigint, text string")
    plain = sorted(map(str, surrogates.pseudonymised(docs, "secret").collect()))
    monkeypatch.setattr(surrogates, "IN_PLAN", -1)
    assert sorted(map(str, surrogates.pseudonymised(docs, "secret").collect())) == plain


PEOPLE = {
    1: ("Dr. Kim Lee met Ms. Kim Lee. Later Kim Lee left, and Lee's coat stayed.", "Kim Lee", 3, 4),
    2: ("Anna Weber called. Weber said no; the weberin did not.", "Anna Weber", 1, 2),
    3: ("Yesterday Kim Weber wrote to Jo Lee.", "Kim Weber", 1, 1),
    4: ("Mr. Best was best. Best of all: nobody.", "Best", 1, 1),
}


def test_one_person_has_one_surrogate(spark):
    """Titles don't split a person, bare parts follow the whole name, and a learned given name is found without a title."""
    docs = spark.createDataFrame([(k, v[0]) for k, v in PEOPLE.items()], "doc_id bigint, text string")
    text = {r.doc_id: r.text for r in surrogates.pseudonymised(docs, "secret").collect()}
    m = re.fullmatch(r"Dr\. (\w+) (\w+) met Ms\. (\w+) (\w+)\. Later (\w+) (\w+) left, and (\w+)'s coat stayed\.", text[1])
    kim, lee = m.group(1, 2)
    assert m.groups() == (kim, lee, kim, lee, kim, lee, lee) and "Kim" not in text[1] and "Lee" not in text[1]
    m = re.fullmatch(r"(\w+) (\w+) called\. (\w+) said no; the weberin did not\.", text[2])
    assert m and m.group(2) == m.group(3) != "Weber"
    weber = m.group(2)
    m = re.fullmatch(r"Yesterday (\w+) (\w+) wrote to Jo Lee\.", text[3])
    assert m and m.groups() == (kim, weber)
    assert re.fullmatch(r"Mr\. \w+ was best\. Best of all: nobody\.", text[4])
    gender = {r.entity: r.gender for r in surrogates.entities(docs, surrogates.given_names(docs)).where("kind = 'name_g'").collect()}
    assert gender == {"kim": "f", "anna": "f"}


def test_surrogates_end_where_a_format_is_exhausted(spark):
    mails = [f"_@{c}.io" for c in "acm"] + ["-@-.io"]
    docs = spark.createDataFrame([(i, f"To {m} now") for i, m in enumerate(mails)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in surrogates.pseudonymised(docs, "secret").collect()}
    assert len(set(got.values())) == 4 and not any(m in got[i] for i, m in enumerate(mails))
    everyone = spark.createDataFrame([("phone", f"+49{i}") for i in range(10)] + [("ip", f"127.0.0.{i}") for i in range(3)], "kind string, entity string")
    new = {(r.kind, r.entity): r.new for r in surrogates.exceptions(everyone, b"k").collect()}
    all_of = [new.get((r.kind, r.entity)) or surrogates.surrogate(b"k", r.kind, r.entity) for r in everyone.collect()]
    assert len(set(all_of)) == 13 and not {r.entity for r in everyone.collect()} & set(all_of)


def test_spans_against_every_substring():
    """Names in texts put together at random, against a search of all pairs of words."""
    rng = random.Random(4)
    given, family = ["Kim", "Zed", "Oma"], ["Lee", "Park", "Ode"]
    for _ in range(300):
        words = rng.choices([*given, *family, "and", "went", "park"], k=rng.randint(1, 14))
        text = " ".join(words)
        out = {(lo, hi) for lo, hi, *_ in surrogates.spans(text, frozenset(g.casefold() for g in given))}
        at = [sum(map(len, words[:i])) + i for i in range(len(words))]
        cap = [w[0].isupper() for w in words]
        hit, i = set(), 0
        while i < len(words):
            if words[i] in given and i + 1 < len(words) and cap[i + 1]:
                n = 3 if i + 2 < len(words) and cap[i + 2] else 2
                hit |= set(range(i, i + n))
                i += n
            else:
                i += 1
        names = {words[j] for j in hit if words[j].lower() not in words}
        hit |= {j for j, w in enumerate(words) if w in names}
        assert out == {(at[j], at[j] + len(words[j])) for j in hit}, text


HIDDEN = [
    "+33 1 23 45 67 89", "API_KEY=abcdefghijklm", "+49 30 12 34 56", "+1 (20) 30 40 50", "Г-н Иванов пришёл", "Г-жа Смирнова и Г-н. Орлов", "Mr.\u00a0Weber", "DE89 ABCD EFGH IJKL MN", "token\u00a0= abcdefghijklm", "secret\x0b: abcdefghijklm", "+٤٩ ٣٠ ١٢ ٣٤ ٥٦", "MARIA GARCÍA", "a_b@c.de", "1.2.3.4",
]


def test_every_entity_is_hinted(spark):
    assert all(surrogates.PATTERN.search(t) for t in HIDDEN)
    assert surrogates._hinted(pa.array(HIDDEN)).to_pylist() == [True] * len(HIDDEN)
    rng = random.Random(9)
    bits = [" ", ".", "+", "-", "(", ")", "\u00a0", "\n", "1", "23", "٤", "DE", "ABCD", "Г-н", "Иванов", "Mr", "Dr", "Weber", "Anna", "key", "token", "=", ":", "abcdefghijklm", "@", "c"]
    texts = ["".join(rng.choices(bits, k=rng.randint(2, 12))) for _ in range(10000)]
    found = [t for t in texts if surrogates.PATTERN.search(t)]
    assert len(found) > 100 and all(surrogates._hinted(pa.array(found)).to_pylist())
    docs = spark.createDataFrame(list(enumerate(HIDDEN)), "doc_id bigint, text string")
    got = surrogates.pseudonymised(docs, "secret").collect()
    assert all(r.n_replaced and r.text != HIDDEN[r.doc_id] for r in got)
