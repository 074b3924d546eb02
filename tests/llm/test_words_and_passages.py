"""Spelling variants, ranked search and repeated passages against plain versions, on small tables of awkward rows."""

import hashlib
import math
import random
import re
import tempfile
import zlib

import numpy as np
import pytest

from docloom.llm import search, spelling, suffixes

SCHEMA = "doc_id bigint, text string, word string, n string, rank int, score string, spans string, id string, _text string, _marks int"
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make_rows():
    rng = random.Random(17)
    stems = ["planet", "planets", "plänet", "harbour", "harbor", "colours", "letters", "éclairs", "ÉCLAIRS", "window", "aaaaaaa", "aaaaaaaa", "×÷×÷×÷×"]
    word = lambda: rng.choice(stems) if rng.random() < 0.9 else (lambda w, i: w[:i] + rng.choice("abcdéz") + w[i + rng.randrange(2) :])(rng.choice(stems), rng.randrange(7))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", " 7", "-x"]) for _ in range(n))
    passage, other = prose(60), prose(45)
    texts = [None, "", " \n", "word", prose(4000), "a" * 1500, "naïve Ωmega 日本 " * 200, "x1" * 90, passage, other[:199], other[:200]]
    for k in range(30):
        texts.append(f"{prose(rng.randrange(60))} {passage} {prose(rng.randrange(40))}" if k % 3 else f"{prose(5)}{other}{prose(9)}")
    texts += [texts[12]] * 4 + [texts[12].upper(), texts[4][:700] + prose(20) + texts[4][900:]]
    rows = [(i, t, "w", "n", 1, "s", "x", "i", "t", 5) for i, t in enumerate(texts)]
    rows += [(3, prose(100), *[None] * 8), (3, prose(100), *[None] * 8), (None, prose(50), *[None] * 8), (None, None, *[None] * 8), rows[12]]
    return rows, [(4, passage), (2, "planet HARBOR planet window"), (2, "colours zzz"), (None, "letters"), (5, ""), (6, None), (7, "nowhere at all"), (8, "日本 x1x1"), (9, prose(80))]


ROWS, ITEMS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(rows, drop_every):
    counts = {}
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {w: min(own, key=lambda v: (-counts[v], v)) for w, own in near.items() if own}
    form = {w: v for w, v in form.items() if counts[v] >= 5 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n, form.get(w), root(w), counts.get(form.get(w)), len(near[w])) for w, n in counts.items()}


@pytest.mark.parametrize(("symbols", "drop_every"), [(2, 3), (8, 199), (8, 7)])
def test_spelling_is_the_plain_version(docs, symbols, drop_every):
    got = spelling.spelling_groups(docs, symbols=symbols, drop_every=drop_every).collect()
    want = plain_groups(ROWS, drop_every)
    assert {(r.word, r.n, r.form, r.root, r.form_n, r.n_near) for r in got} == want and len(got) == len(want)
    assert any(r.form for r in got)


def test_spelling_follows_chains_and_breaks_ties(spark):
    counts = {"abcdefg": 700, "abcdef": 130, "abcdefz": 700, "abcde": 9000, "abcdxf": 26, "abcyxf": 5}
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())], "doc_id bigint, text string")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.spelling_groups(docs, drop_every=0).collect()}
    assert got == {"abcdefg": (None, "abcdefg", 2), "abcdefz": (None, "abcdefz", 2), "abcdef": ("abcdefg", "abcdefg", 3), "abcdxf": ("abcdef", "abcdefg", 2), "abcyxf": ("abcdxf", "abcdefg", 1)}


def test_neighbourhoods_are_whole(spark):
    forms = ["a", "aab", "bbbb", "abcab"]
    got = {}
    for r in spelling.neighbourhoods(spark.createDataFrame([(f,) for f in forms], "form string"), 3).collect():
        got.setdefault(r.form, []).append(r.around)
    for f in forms:
        want = {f} | {f[:i] + f[i + 1 :] for i in range(len(f))} | {f[:i] + c + f[i + k :] for k in (0, 1) for i in range(len(f) + 1 - k) for c in "abc"}
        assert sorted(got[f]) == sorted(want)


def plain_ranks(rows, items, k):
    terms = lambda text: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode("utf-8").lower()) if text else []
    docs = [(i, terms(t)) for i, t, *_ in rows]
    docs = [(i, t) for i, t in docs if t]
    n_docs, length = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in docs:
            m = 25 + 75 * len(t) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in terms(text) if w in df)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"part_postings": 40}, {"block_terms": 20, "part_postings": 7}, {"k": 3}])
def test_search_is_the_plain_version(spark, docs, how):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = search.ranked_search(docs, items, **how).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks(ROWS, ITEMS, how.get("k", 10))


def test_search_without_rows(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert search.ranked_search(none, items).count() == 0
    assert search.ranked_search(docs, items.limit(0)).count() == 0


def test_nra_stops_before_the_ends_of_lists():
    """What a list still holds cannot change the answer: documents far down one long list are never read."""

    class Counted(np.ndarray):
        reads = 0

        def __getitem__(self, key):
            if isinstance(key, slice) and key.step is None:
                Counted.reads = max(Counted.reads, key.stop or 0)
            return super().__getitem__(key)

    long = (np.arange(1000), np.array([900, 800, *[10] * 998]).view(Counted))
    assert search.nra([long], np.arange(1000), 2) == [(900, 0), (800, 1)]
    assert Counted.reads == 2


def covered(texts, length):
    places = {}
    for n, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            places.setdefault(t[s : s + length], []).append((n, s))
    gone = [bytearray(len(t)) for t in texts]
    for own in places.values():
        if len(own) > 1:
            for n, s in own:
                gone[n][s : s + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("how", [{}, {"bucket_bytes": 3000}, {"length": 64}])
def test_repeats_are_those_of_the_plain_version(docs, how):
    raw = [(r[1] or "").encode() for r in ROWS]
    want = []
    for (i, *_), t, g in zip(ROWS, raw, covered(raw, how.get("length", 200)), strict=True):
        spans = [m.span() for m in re.finditer(b"\1+", bytes(g))]
        want.append((i, len(t), sum(g), spans, bytes(b for b, x in zip(t, g, strict=True) if not x)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffixes.without_repeats(docs, **how).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_texts_are_read_in_parts(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(300)
    long = letters((1 << 19) - 150) + passage + letters(400_000)
    docs = spark.createDataFrame([(1, long), (2, letters(50) + passage)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.without_repeats(docs).collect()}
    assert got[1][0] == got[2][0] >= 300 and got[1][1] == hashlib.sha256(long.replace(passage, "").encode()).hexdigest()


def test_repeats_without_rows(none):
    assert suffixes.without_repeats(none).count() == 0
    with pytest.raises(ValueError, match="length"):
        suffixes.without_repeats(none, length=8)


def test_columns_find_what_lies_alike():
    rng = random.Random(2)
    for _ in range(150):
        length, letters = rng.choice([3, 5, 8]), rng.choice([b"ab", b"abcd", b"a"])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(length, length + 40))) for _ in range(rng.randrange(1, 30))]
        anchors = np.array([rng.randrange(len(s)) for s in strings])
        with tempfile.TemporaryDirectory() as folder:
            own, start = suffixes.repeated_starts(strings, anchors, length, folder)
        places = {}
        for i, s in enumerate(strings):
            for at in range(len(s) - length + 1):
                places.setdefault((s[at : at + length], int(at - anchors[i])), []).append((i, at))
        assert sorted(zip(own.tolist(), start.tolist(), strict=True)) == sorted(x for p in places.values() if len(p) > 1 for x in p)
