"""Decontamination, line dedup, near-dedup and passages against brute force."""

import itertools
import random
import re

import pytest

from docweft.llm import decontaminate, line_dedup, near_dup, suffix_dedup

RNG = random.Random(5)
VOCAB = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(3, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(VOCAB, k=n))


def changed(text, edits, rng=RNG):
    s = list(text)
    for _ in range(edits):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("xyz")
        elif kind == 1:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def docs_of(spark, rows):
    """Documents with columns that clash with names used within."""
    return spark.createDataFrame([(i, t, "a", 1, "x") for i, t in rows], "doc_id bigint, text string, h string, line int, rep string")


def fewest_edits(item, text):
    """Of the item against the best part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    items = [(k, prose(RNG.randint(5, 14))) for k in range(12)] + [(50, None), (51, ""), (52, "short"), (None, prose(9))]
    items.append((60, items[0][1]))  # two items of one text
    rows = []
    for d in range(60):
        text = prose(25)
        if d % 2:
            k, item = items[d % 12]
            text += " " + changed(item, RNG.randint(0, max(1, len(item) // 18))) + " " + prose(10)
        rows.append((d, text))
    rows += [(100, None), (101, ""), (None, items[1][1]), (1, rows[1][1]), (102, (prose(4000) + " " + items[3][1].upper().replace(" ", "\n")))]
    got = decontaminate.contaminated(docs_of(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in got}
    want = {}
    for d, t in rows:
        for k, item in items:
            if d is None or k is None or not t or not item or len(item) < 12:
                continue
            budget = min(int(len(item) * 0.05), (len(item) - 12) // 12)
            body = re.sub(r"\s", " ", t.lower())
            if len(body) > 3000:
                body = body[-300:]
            n = fewest_edits(item, body)
            if n <= budget:
                want[d, k] = n
    assert len(want) > 20 and (102, 3) in want
    assert got == want


def test_decontamination_of_empty_tables(spark):
    d, b = docs_of(spark, []), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(d, b).count() == 0
    assert decontaminate.contaminated(docs_of(spark, [(1, prose(20))]), b).count() == 0


def test_long_items_with_many_candidates_align_in_parts(spark, monkeypatch):
    items = [(k, prose(n)) for k, n in enumerate([8, 9, 12, 60, 900])]
    rows = [(10 * k + i, prose(40) + " " + changed(t, i % 3) + " " + prose(7)) for k, t in items for i in range(6)] + [(900, " ".join(t for _, t in items) * 3)]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(str, decontaminate.contaminated(docs, bench).collect()))
    assert len(whole) > 25
    for cells in (1, 3000):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        index = decontaminate.Index(items, 12, 0.05)
        got = set()
        for d, t in rows:
            cp, offsets = decontaminate.code_points([t])
            for _, i, e in zip(*index.search(cp, offsets)):
                got.add((d, int(index.ids[i]), int(e), int(index.e[i])))
        best = {}
        for d, i, e, most in got:
            best[d, i] = min(best.get((d, i), (e, most)), (e, most))
        assert sorted(f"Row(doc_id={d}, item_id={i}, edits={e}, max_edits={m})" for (d, i), (e, m) in best.items()) == whole


def test_decontamination_in_several_passes(spark, monkeypatch):
    items = [(k, prose(10)) for k in range(6)]
    rows = [(k, prose(5) + " " + t) for k, t in items]
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 150)
    got = decontaminate.contaminated(docs_of(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k) for k in range(6)}


@pytest.mark.parametrize("joined", [False, True])
def test_line_dedup(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(line_dedup, "IN_PLAN", 0)
    rows = []
    for site in range(14):
        lines = [f"own line {site}", "Subscribe now!" if site < 10 else " subscribe ", "  Cookie notice\t" if site < 9 else "other", ""]
        rows += [(site, "\n".join(lines), f"s{site}"), (100 + site, "Subscribe now!", f"s{site}")]
    rows += [(200, "Subscribe now!\nCookie notice", None), (201, None, "s1"), (202, "", "s1"), (203, "\n\n", "s2"), (200, "Subscribe now!\nCookie notice", None)]
    rows += [(k, "one site only", "s1") for k in range(300, 340)]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id bigint, text string, source string, n_chars bigint, h string")
    got = line_dedup.remove_boilerplate(docs).collect()
    assert len(got) == len(rows)
    sites: dict = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if s and x.strip():
                sites.setdefault(x.strip(), set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= 10}
    assert bad == {"Subscribe now!"}
    want = []
    for d, t, s in rows:
        kept = None if t is None else [x for x in t.split("\n") if x.strip() not in bad]
        want.append((d, None if kept is None else "\n".join(kept), s, 0 if t is None else t.count("\n") + 1 - len(kept)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.source, r.n_removed_lines)) for r in got)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.h == "k" for r in got)


def grams(text, n=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups_by_force(rows, threshold=0.6):
    sets = [(d, grams(t)) for d, t in rows if d is not None and t]
    root = {d: d for d, s in sets if s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[1]], 2):
        if a != b and len(x & y) >= threshold * len(x | y) - 1e-9:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    size: dict = {}
    for d in root:
        size[find(d)] = size.get(find(d), 0) + 1
    return {(d, find(d), size[find(d)]) for d in root if size[find(d)] > 1}


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows, shared = [], prose(40, rng)
    for k in range(40):
        words = prose(rng.randint(30, 200), rng).split()
        rows.append((k, " ".join(words)))
        for c in range(rng.randrange(4)):
            w = list(words)
            for _ in range(int(len(w) * rng.choice([0, 0.02, 0.05, 0.12]))):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            rows.append((1000 + 10 * k + c, " ".join(w)))
    rows += [(2000 + k, prose(60, rng) + " " + shared) for k in range(30)]  # a passage in common is not a copy
    rows += [(3000 + k, prose(80, random.Random(1))) for k in range(50)]  # many exact copies
    rows += [(4000, None), (4001, ""), (4002, "..."), (4003, "two words"), (4004, "Two, words!"), (None, rows[0][1]), (0, rows[0][1])]
    got = {(r.doc_id, r.kept_doc_id, r.group_size) for r in near_dup.near_duplicates(docs_of(spark, rows)).collect()}
    want = groups_by_force(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert {(3000 + k, 3000, 50) for k in range(50)} <= got and (4004, 4003, 2) in got


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(3)
    rows, long = [], [prose(n, rng) for n in (50, 51, 90, 49)]
    for d in range(30):
        parts = [prose(rng.randint(0, 70), rng)]
        if d % 3:
            parts += [long[d % 4], prose(rng.randint(0, 40), rng)]
        if d % 5 == 0:
            parts.append(long[(d + 1) % 4])
        rows.append((d, "  ".join(parts)))
    rows += [(50, " ".join(["same"] * 200)), (51, "\n".join(["same"] * 120)), (60, None), (61, ""), (None, long[0]), (0, rows[0][1]), (0, rows[0][1])]
    got = sorted((r.doc_id, r.start_word, r.end_word, r.n_words) for r in suffix_dedup.repeated_passages(docs_of(spark, rows)).collect())
    want = passages_by_force(rows)
    assert len(want) > 10
    assert got == want


def passages_by_force(rows):
    where: dict = {}
    for d, t in rows:
        w = (t or "").split()
        for p in range(len(w) - 49):
            if d is not None:
                where.setdefault(tuple(w[p : p + 50]), set()).add((d, p))
    want: list = []
    for d, p in sorted({x for s in where.values() if len({d for d, _ in s}) > 1 for x in s}):
        if want and want[-1][0] == d and p <= want[-1][2]:
            want[-1][2] = p + 50
        else:
            want.append([d, p, p + 50])
    return [(d, a, b, b - a) for d, a, b in want]


def test_passages_of_hot_groups_over_many_ranges(spark, monkeypatch):
    """A passage of every document, equal documents within and across runs, and more ranges than groups, against brute force; borders don't matter."""
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 3000)
    rng = random.Random(12)
    hot = [f"h{i}" for i in range(90)]
    rows = [(d, " ".join([f"u{d}_{i}" for i in range(rng.randint(0, 9))] + hot[rng.randint(0, 5) : 90 - rng.randint(0, 5)] + rng.choices("xyz", k=60) * (d % 2))) for d in range(40)]
    rows += [(100 + d, rows[3][1]) for d in range(20)] + [(200, " ".join(rng.choices("xyz", k=400)))] + [(3, rows[3][1])]
    docs = docs_of(spark, rows)
    want = passages_by_force(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("2", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = sorted((r.doc_id, r.start_word, r.end_word, r.n_words) for r in suffix_dedup.repeated_passages(docs).collect())
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_passages_of_an_empty_table(spark):
    assert suffix_dedup.repeated_passages(docs_of(spark, [])).count() == 0


def test_merge_of_front_coded_runs():
    rng = random.Random(2)
    for _ in range(50):
        runs = [sorted((bytes(rng.choices(b"ab ", k=rng.randint(1, 12))), b"", i, j) for j in range(rng.randint(0, 20))) for i in range(rng.randint(1, 7))]
        coded = [suffix_dedup.unpack(suffix_dedup.pack(r)) for r in runs]
        out = list(suffix_dedup.merge(coded))
        assert [x[0] for x in out] == sorted(x[0] for r in runs for x in r)
        before = None
        for s, k, *_ in out:
            if before is not None:
                assert k == suffix_dedup.shared(before, s)
            before = s
