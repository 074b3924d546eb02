"""The operators over documents against plain versions, on a small table of awkward rows."""

import base64
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docloom.llm import bpe, common, decontam, licenses, linededup, neardup, quality, secrets, shards

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, id string, component_id int, shard string, _text string"


def make_rows():
    rng = random.Random(3)
    words = ["the", "of", "alpha", "béta", "Gamma", "delta9", "x-y", "naïve", "日本", "#tag", "%", "end."]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed", str(rng.randrange(40))]) for _ in range(n))
    texts = [None, "", " \t\n", "word", "two words", "a\n\na\n a \nA line of text here\nA line of text here", prose(60000), "x" * 200_000, "one " * 400]
    base = prose(300)
    parts = base.split(" ")
    for k in range(12):  # near copies: some within 0.8 of the base, some only of each other
        p = list(parts)
        for _ in range(k * 6):
            p[rng.randrange(len(p))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(p))
    texts += [base] * 5 + [base.upper(), base.replace(" ", "\n")]
    shared = "This line Is shared by many documents. " + prose(6)
    for k in range(25):
        texts.append(f"{prose(70)}\n{shared if k % 2 else '  ' + shared.upper() + '\t'}\n{prose(40)}\nshort\nshort")
    passage = prose(30)
    texts += [f"{prose(20)} {passage} {prose(10)}", f"See: {passage.upper()}!", passage.replace(" ", "--"), " ".join(passage.split()[:9])]
    crc = "ghp_" + "A" * 30
    crc += secrets._base62_crc(b"A" * 30).decode()
    texts += [
        f"é password = 'hunter22' and AKIA{'Q' * 20} then token:abc PASSWORD:\"a.b/c+d=e\" {'0af' * 9}", f"secret=token=abcdefgh apikey: api_key=1234567 {crc} ghp_{'B' * 36}",
        "pAsSwD:short1 AKIAABC deadbeef" + "f" * 23, "tok\u212aen=abcdefg \u017fecret=abcdefg", "eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2ln and eyJub3QiOjF9.a.b",
    ]
    texts += ["Released under the MIT  license", "Some text.\n(c) 2020 Somebody\n\tReleased under the MIT Licence!\nCopyright me\nMore text.", licenses.LICENSES["MIT"].upper().replace(",", " "), "Copyright 2024\n" + licenses.LICENSES["ISC"]]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), "w", "k", "i", 7, "s", "t") for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows, [(10, passage), (9, passage), (2, "Two words"), (3, ""), (4, None), (5, prose(12))]


ROWS, ITEMS = make_rows()
OWN = [(r[0], r[1]) for r in ROWS if r[0] is not None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def own(df, name="doc_id"):
    return {r[name]: r for r in df.filter(f"{name} is not null").collect()}


def test_quality(spark, docs):
    out = quality.quality_rules(docs)
    assert out.count() == len(ROWS)
    got = own(out)
    for i, t in OWN:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_quality(t), i
    assert all(r.kept == (not r.base_failed and not r.depleted) for r in got.values())


def test_quality_removes_frequent_lines(spark):
    spell = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits are all the same to a normalised line
    body = lambda k: f"own{spell(k)} " * 10
    frequent = " ".join(f"boiler{j}" for j in range(60))
    rows = [(k, f"{frequent.upper() if k % 2 else frequent}\n{body(k)}", "a") for k in range(20)] + [(100 + k, " ".join(f"w{spell(k)}x{spell(j)}" for j in range(80)), "a") for k in range(50)]
    rows += [(200 + k, "same " + " ".join(f"s{spell(j)}" for j in range(80)), "a") for k in range(30)]
    got = own(quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), count_copies=False))
    assert got[0].kept and not any(got[k].kept for k in range(1, 20)), "all but the first holder are depleted"
    assert all(got[k].removed_words == 60 for k in range(1, 20)) and all(r.kept for k, r in got.items() if k >= 100), "copies are one document"
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), count_copies=False)
    assert kept.columns == ["doc_id", "text", "source"] and kept.count() == 81


def test_quality_takes_frequent_lines_out_of_the_text(spark):
    """Lines above the limit leave the texts of all holders but the first; other lines and rows stay as they are."""
    spell = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    body = lambda k: "\n".join(" ".join(f"o{spell(k)}x{spell(j)}y{i}" for j in range(20)) for i in range(4))
    rows = [(k, f"Page {10 + k} of 30\n{body(k)}\n\n  Menu ", "a", 1000 + k) for k in range(20)] + [(50, f"Page 1 of 30\n{body(50)}", "b", 7), (50, body(51), "a", 8), (None, f"Menu\n{body(60)}", "a", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    got = {(r.doc_id, r.source): r for r in quality.keep_good(df).collect()}
    assert len(got) == len(rows) and quality.keep_good(df).columns == df.columns
    assert got[0, "a"].text == rows[0][1] and got[0, "a"].n_chars == 1000
    for k in range(1, 20):
        assert got[k, "a"].text == f"{body(k)}\n" and got[k, "a"].n_chars == len(body(k)) + 1
    assert got[50, "b"].text == rows[20][1] and got[50, "b"].n_chars == 7 and got[50, "a"].text == rows[21][1] and got[None, "a"].text == body(60)


def test_quality_limits_do_not_grow_with_the_host(spark):
    """A line in very many documents is above the limit in a host of any size, and copies count where that is asked for."""
    rows = [(k, f"same boilerplate line\n{'own' + chr(97 + k % 26) * (1 + k // 26)}", "a") for k in range(60)] + [(100 + k, f"u{'x' * k}", "a") for k in range(2000)]
    rows += [(5000 + k, "one copied text", "b") for k in range(40)] + [(6000, "another text", "b"), (None, "one copied text", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    removed = lambda **how: {i: r.removed_lines for i, r in own(quality.quality_rules(df, **how)).items() if r.removed_lines}
    assert removed(count_copies=False) == {}
    assert removed(line_docs_most=50, count_copies=False) == dict.fromkeys(range(1, 60), 1)
    assert removed() == dict.fromkeys(range(5001, 5040), 1)


def test_quality_is_the_plain_version(spark):
    """Verdicts, removed lines and cleaned texts are those of a plain program, for shared and null ids and null hosts too."""
    rng = random.Random(8)
    common = [" ".join(f"c{rng.randrange(10**6)}" for _ in range(n)) for n in (2, 2, 30, 40, 60)]
    rows = []
    for k in range(260):
        lines = [" ".join(f"w{rng.randrange(10**6)}x{chr(97 + rng.randrange(26))}" for _ in range(20)) for _ in range(3)]
        lines += [x.upper() if rng.random() < 0.5 else f"  {x} " for x in common if rng.random() < 0.2]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows += [(600 + k, "\n".join([*common, f"own {k}"]), "ab"[k % 2]) for k in range(6)]
    rows += [(900 + k, "the one copied text " * 30, "a") for k in range(14)] + [(3, rows[3][1], rows[3][2]), (3, "another text of document three", "a"), (None, rows[7][1], "a"), (None, None, "b"), (7, "", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    expected = brute.quality(rows, share=0.05, least=10, most=1000, depleted=0.3)
    got = sorted(map(tuple, quality.quality_rules(df).select("doc_id", "removed_lines", "removed_words", "base_failed", "depleted", "kept").collect()), key=str)
    assert got == sorted((e[:6] for e in expected), key=str)
    assert any(e[4] and not e[3] for e in expected) and any(e[1] and e[5] for e in expected), "the method decides something"
    texts = sorted(map(tuple, quality.keep_good(df).select("doc_id", "text").collect()), key=str)
    assert texts == sorted(((e[0], e[6]) for e in expected if e[5]), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, width):
    out = neardup.near_duplicates(docs, width=width, block=2)
    assert out.count() == len(ROWS)
    expected = brute.near(OWN, width)
    got = own(out)
    assert {i: (got[i].n_shingles, got[i].component_id) for i, _ in OWN} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert all(r.component_id is None and r.kept for r in out.filter("doc_id is null").collect())
    left = neardup.one_of_each(docs, width=width)
    assert left.columns == docs.columns and left.count() == len({c for _, c in expected.values()}) + 2


def test_near_group_without_a_centre(spark):
    """A chain of texts, each near the next only, and a large group where every text differs from every other."""
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join(words[:i] + [f"c{j}" for j in range(i)] + words[i:][: 200 - i]) for i in range(0, 100, 9)]
    star = [" ".join(words[:50] + [f"s{k}_{j}" for j in range(4)] + words[50:100]) for k in range(60)]
    rows = list(enumerate(chain + star))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, width=2, block=4).collect()}
    assert got == {i: c for i, (_, c) in brute.near(rows, 2).items()}


def test_near_documents_with_several_texts(spark):
    """Rows that share an id are one document: links of any of its texts are its links. Repeated rows change nothing."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (9, text("b")), (9, text("b")), (9, text("c")), (4, text("c") + " more"), (20, text("d")), (21, ""), (21, text("e")), (None, text("a")), (30, text("f")), (30, text("g"))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 3, True), (5, 3, False), (9, 3, False), (4, 3, False), (20, 20, True), (21, 21, True), (None, None, True), (30, 30, True)}
    assert len(got) == len(rows)


def test_line_dedup(spark, docs):
    out = linededup.line_dedup(docs, bits=22)
    got, expected = own(out), brute.line_dedup(OWN)
    assert out.count() == len(ROWS) and set(out.columns) == set(docs.columns) | {"n_lines", "n_dropped"}
    assert {i: (got[i].n_lines, got[i].n_dropped, got[i].text or "") for i, _ in OWN} == expected
    assert out.filter("doc_id is null and n_dropped = 0").count() == 2
    left = linededup.without_repeated_lines(docs, bits=22)
    assert left.columns == docs.columns and left.filter("doc_id is not null and length(text) <> n_chars").isEmpty()
    assert {r.doc_id for r in left.collect()} == {None} | {i for i, (_, n, t) in expected.items() if not n or t.split()}


def test_documents_with_several_texts(spark):
    """Rows that share an id are one document for lines and benchmark passages; each keeps a row of its own."""
    line = "a line that is long enough"
    rows = [(5, f"{line}\nx"), (5, f"other\n{line}"), (6, f"{line}\ny"), (7, "alone in its document"), (7, "alone in its document")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in linededup.line_dedup(df).collect())
    assert got == [(5, f"{line}\nx", 0), (5, f"other\n{line}", 0), (6, "y", 1), (7, "alone in its document", 0), (7, "alone in its document", 0)]
    left = decontam.uncontaminated(df, spark.createDataFrame([(1, "other a")], "item_id bigint, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [6, 7, 7]


def test_line_dedup_with_a_full_filter(spark, docs):
    """Filters that suspect everything change nothing."""
    assert sorted(map(str, linededup.line_dedup(docs, bits=20).select("doc_id", "text").collect())) == sorted(map(str, linededup.line_dedup(docs, bits=28).select("doc_id", "text").collect()))


def test_line_dedup_with_doubtful_documents(spark, docs, monkeypatch):
    """A filter of dropped lines that holds everything sends all documents to the exact join, and changes nothing."""
    plain = sorted(map(str, linededup.line_dedup(docs, bits=20).collect()))
    monkeypatch.setattr(linededup, "bits_for", lambda keys, least=15: 3)
    assert sorted(map(str, linededup.line_dedup(docs, bits=20).collect())) == plain


def test_line_dedup_with_documents_that_collide_with_doubtful_ones(spark, docs, monkeypatch):
    """Documents that the bitmap of doubtful ones holds by a collision lose their lines too."""
    plain = sorted(map(str, linededup.line_dedup(docs, bits=20).collect()))
    monkeypatch.setattr(linededup, "lost_lines", lambda gone, bits: b"\xff" * (1 << (bits - 3)))
    monkeypatch.setattr(common, "bits_for", lambda keys, least=15: 1)
    assert sorted(map(str, linededup.line_dedup(docs, bits=20).collect())) == plain


@pytest.mark.parametrize("width", [1, 2, 5, 6])
def test_half_windows_find_all_windows(width):
    """Runs followed from half-windows are those of all windows, also in texts that repeat in themselves."""
    rng = random.Random(width)

    class Sent:
        value = None

    for trial in range(300):
        text = lambda n: b" ".join(rng.choice([b"a", b"b", b"cc"][: rng.choice([1, 2, 3])]) for _ in range(n))
        sent = Sent()
        sent.value = [(f"i{k}", decontam.normal(text(rng.randrange(1, 14)))) for k in range(rng.randrange(1, 5))]
        flat = decontam.normal(text(rng.randrange(0, 40)))
        own, covered, found = flat.split(), set(), set()
        for name, item in sent.value:
            words = item.split()
            n = min(width, len(words))
            for i in range(len(words) - n + 1):
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == words[i : i + n]:
                        covered |= set(range(at, at + n))
                        found.add(name)
        runs, items = decontam._hits(flat, decontam._automaton(sent, f"{width}-{trial}", width), width)
        assert ({w for a, b in runs for w in range(a, b)}, items) == (covered, found)


@pytest.mark.parametrize("size", [64 << 20, 700])
def test_contamination(spark, docs, size):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = decontam.contamination(docs, bench, automaton_bytes=size)
    got, expected = own(out), brute.contamination(OWN, ITEMS)
    assert out.count() == len(ROWS)
    for i, t in OWN:
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (*expected[i], expected[i][1] > 0)
        inside = sum(len(brute.re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t[s.start : s.end])) for s in r.spans)
        assert inside == r.n_hit, "spans are of the original text"
    clean = decontam.uncontaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {None} | {i for i, v in expected.items() if not v[1]}
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").isEmpty()
    with_null = docs.unionByName(docs.filter("doc_id is not null").limit(3).withColumn("text", F.lit(ITEMS[0][1])).withColumn("doc_id", F.lit(None).cast("bigint")))
    assert decontam.uncontaminated(with_null, bench).filter("doc_id is null").isEmpty(), "a null id is an id of its own"


def test_bpe(spark, docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(path, pattern)
    encoded = own(bpe.bpe_encode(docs, path, pattern))
    digests = own(bpe.bpe_digests(docs, path, pattern))
    decoded = own(bpe.bpe_decode(bpe.bpe_encode(docs, path, pattern), path, pattern))
    for i, t in OWN:
        ids = enc.encode_ordinary(t or "")
        assert encoded[i].tokens == ids and bytes(decoded[i].bytes) == (t or "").encode()
        assert (digests[i].n_tokens, digests[i].ids_sha256, digests[i].decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or ""))


def test_safe_pieces_change_no_token():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    rng = random.Random(5)
    for alphabet in ("ab '1 ", " \n\t.", "é日a1 '’s ", "a1", " ", "'sd  ll", "日本，。「」 x", "½Ⅷ٣a-'", "e\u0301n\u00a0\u3000x1", "''ss--"):
        for _ in range(30):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300)))
            pieces = list(bpe.safe_pieces(text, 8))
            assert "".join(pieces) == text
            assert [t for p in pieces for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text), repr(text)
    chinese = "日本語の文。" * 100_000
    assert max(map(len, bpe.safe_pieces(chinese))) < (1 << 17) + 10, "a text without white space is cut too"


def test_secrets(spark, docs):
    out = own(secrets.secret_scan(docs))
    for i, t in OWN:
        assert [(s.kind, s.start, s.end) for s in out[i].secrets if s.kind in ("assign", "access", "hex")] == brute.secrets(t), i
    kinds = [s.kind for r in out.values() for s in r.secrets]
    assert kinds.count("forge") == 1 and kinds.count("jwt") == 1, "checksums and headers decide"
    assert all("hunter22" not in (r.redacted or "") for r in out.values()) and any("[assign]" in (r.redacted or "") for r in out.values())


def test_secrets_on_random_text():
    rng, found = random.Random(11), 0
    keywords = secrets.automaton()
    for _ in range(400):
        text = "".join(rng.choice(["token", "PASSWD", "secret", "api_key", "ApiKey", "AKIA", "=", ": ", "'", '"', " ", "abc", "0f9e", "Z9Z9Z9Z9", "é", "\n", "deadbeefdeadbeef"]) for _ in range(40))
        raw = text.encode()
        base = [x for x in secrets._points(raw, secrets.scan(raw, keywords)) if x[0] in ("assign", "access", "hex")]
        assert base == brute.secrets(text), text
        found += len(base)
    assert found > 400


def test_added_secrets_are_the_plain_version():
    """Tokens, headers and keys, good and spoiled, against whole-text expressions with the checks written anew."""
    rng, keywords, found = random.Random(4), secrets.automaton(), 0
    token = lambda n: "".join(rng.choice("ABCxyz019") for _ in range(n))
    encoded = lambda raw: base64.urlsafe_b64encode(raw).decode().rstrip("=")
    for _ in range(300):
        parts = []
        for _ in range(12):
            body = token(30)
            der = rng.choice([b"\x30\x05hello", b"\x30\x81\x80" + b"k" * 128, b"\x30\x06hello", b"\x31\x05hello", b"openssh-key-v1\0x"])
            parts.append(rng.choice([
                f"ghp_{body}{brute.base62(zlib.crc32(body.encode()))}", f"npm_{body}{brute.base62(zlib.crc32(body.encode()) ^ rng.choice([0, 0, 1]))}", f"gho_{token(36)}", f"ghs_{body}{brute.base62(zlib.crc32(body.encode()))}A",
                f"{encoded(rng.choice([b'{"alg":"RS256"}', b'{"alg":5}', b'[1]', b'{"typ":"x"}']))}.{token(9)}.{token(9)}", "é", " ", "\n", "=", "eyJ", "-----BEGIN ", "x",
                f"-----BEGIN {(k := rng.choice(['RSA PRIVATE KEY', 'PRIVATE KEY']))}-----\n{base64.b64encode(der).decode()}\n-----END {rng.choice([k, k, 'EC PRIVATE KEY'])}-----",
            ]))
        text = "".join(parts)
        raw = text.encode()
        added = [x for x in secrets._points(raw, secrets.scan(raw, keywords)) if x[0] in ("forge", "registry", "jwt", "pem")]
        assert added == brute.added_secrets(text), text
        found += len(added)
    assert found > 300


def test_secrets_in_hostile_texts(spark):
    """Headers that nest without end, and very long tokens, fail no task."""
    deep = base64.urlsafe_b64encode(b'{"a":' * 200_000).decode().rstrip("=")
    rows = [(1, f"{deep}.a.b"), (2, "eyJ" + "A" * 3_000_000 + ".b.c"), (3, "-----BEGIN PRIVATE KEY-----" + "A" * 1_000_000), (4, "token" * 200_000 + "=abcdefg"), (5, "eyJ" * 400_000), (6, "AKIA" * 400_000)]
    got = own(secrets.secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [len(got[i].secrets) for i in range(1, 7)] == [0, 0, 0, 1, 0, 1]


def test_shards(spark, docs):
    from zlib import crc32

    out = shards.kd_shards(docs, dimensions=["n_chars", "lang", "source"], n_shards=8, block_rows=3)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    texts = dict(OWN)
    assert all((r["size"], r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, crc32((texts[r.doc_id] or "").encode())) for r in rows if r.doc_id is not None)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(map(str, out.collect())) == sorted(map(str, rows)), "the same each time"


def test_shards_are_even(spark):
    """One value of every dimension holds all rows, most of them copies; shards differ by less than a text or so."""
    rows = [(i, "copy " * 20 if i % 3 else f"text {i} " * (5 + i % 30), "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for how in ({"n_shards": 8}, {"n_shards": 5}, {"target_bytes": 60_000}):
        sizes = [r["b"] for r in shards.kd_shards(df, dimensions=["lang"], **how).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
        assert max(sizes) - min(sizes) < 2000, sizes
    assert shards.kd_shards(df.limit(0), dimensions=["lang"], n_shards=8).count() == 0
    assert shards.kd_shards(df.limit(3), dimensions=[], n_shards=8).count() == 3
    with pytest.raises(ValueError):
        shards.kd_shards(df, dimensions=[])


@pytest.mark.parametrize(("n", "copies_of_7"), [(8, 60), (5, 60), (8, 8)])
def test_shards_are_the_plain_tree(spark, n, copies_of_7):
    """The same dealing and k-d tree from sorted lists; every group of equal texts lies in one shard unless no shard has room for it."""
    rng = random.Random(6)
    rows = []
    for k in range(600):
        copies = {7: copies_of_7, 11: 60, 13: 5, 17: 3}.get(k) or rng.choice([1, 1, 1, 2, 3])
        text = None if k == 11 else f"text {k} " * (200 if k in (7, 13, 17) else rng.randrange(1, 60))
        rows += [(1000 * k + c, text, rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "c"]), rng.choice([5, 50, 500, None])) for c in range(copies)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    dims = ["n_chars", "lang", "source"]
    coded = df.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 1, F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.array(*[shards._code(df, c) for c in dims])).collect()
    got = {r.doc_id: r.shard for r in shards.kd_shards(df, dimensions=dims, n_shards=n).collect()}
    plain, split = brute.kd_tree([tuple(r) for r in coded], n, [True, False, False], 0.05)
    assert got == plain
    where, sizes, filled = {}, {}, {}
    for i, size, text, _, _ in map(tuple, coded):
        where.setdefault(text, set()).add(got[i])
        sizes[text] = sizes.get(text, 0) + size
        filled[got[i]] = filled.get(got[i], 0) + size
    shard = sum(sizes.values()) / n
    assert {t for t, w in where.items() if len(w) > 1} == split == {t for t in where if sizes[t] > shard}
    assert len(split) == (copies_of_7 == 60) and sum(sizes[t] > 0.05 * shard for t in where) > 2
    assert max(filled.values()) - min(filled.values()) < 0.05 * shard


def test_shards_keep_large_groups_whole(spark):
    """Groups of a third of a shard and more stay whole, and others make up for them; what fits nowhere is split."""
    rows = [(100 * k + c, f"group {k} " * 100, "en") for k in range(10) for c in range(9)] + [(10_000 + i, f"text {i} " * 3, "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = shards.kd_shards(df, dimensions=["lang"], n_shards=8).collect()
    where, sizes = {}, {}
    for r in out:
        where.setdefault(r.doc_id // 100 if r.doc_id < 10_000 else r.doc_id, set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert all(len(w) == 1 for w in where.values()) and len(out) == len(rows)
    assert max(sizes.values()) - min(sizes.values()) < 200 and len(sizes) == 8


def test_licenses(spark, docs):
    out = own(licenses.license_scan(docs, licenses.known_licenses(spark)))
    found = [(r.license_id, list(r.notices)) for r in out.values() if r.license_id or r.notices]
    assert sorted(found, key=str) == sorted([("MIT-notice", ["MIT-notice"]), (None, ["MIT-notice"]), ("MIT", ["MIT"]), ("ISC", ["ISC"])], key=str)
    assert all(out[i].text_digest is None for i, t in OWN if not (t or "").strip())
    assert licenses.license_scan(docs, licenses.known_licenses(spark)).count() == len(ROWS)


def _canonical(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = own(licenses.license_scan(rows, licenses.known_licenses(spark)))
    return [got[i] for i in range(len(texts))]


def test_license_texts_in_any_shape(spark):
    """Wrapping, titles, comment marks, spellings and copyright lines do not matter; other words do."""
    import textwrap

    wrap = lambda t, n, mark="": "\n".join(mark + x for p in t.split("\n") for x in textwrap.wrap(p, n))
    shapes, ids = [], []
    for i, text in licenses.LICENSES.items():
        title = (*licenses.TITLES.get(i, ()), "")[0]
        for n in (23, 40, 60, 78):
            shapes += [wrap(text, n), f"{title}\n\n// Copyright (c) 2020, 2021 X Y\n" + wrap(text, n, "// "), f"/*\n * {title}\n * COPYRIGHT 1999 Z\n * All rights reserved.\n" + wrap(text.upper(), n, " * ") + "\n */"]
            ids += [i] * 3
    assert [r.license_id for r in _canonical(spark, shapes)] == ids
    same = [("licence licence", "license license"), ("whilst whilst, per cent per cent", "While while percent percent"), ("copyright owner copyright owner", "copyright holder copyright holder")]
    for a, b in same:
        x, y = _canonical(spark, [a, b])
        assert x.text_digest == y.text_digest is not None
    left = _canonical(spark, [licenses.LICENSES["MIT"] + " not", "copyright notice and this\npermission", "permission", "Copyright 2020 " + licenses.LICENSES["MIT"].replace("\n", " ")])
    assert [r.license_id for r in left] == [None] * 4 and left[1].text_digest != left[2].text_digest and left[3].text_digest is not None


def test_license_digests_are_those_of_the_texts(spark):
    """Longer licences, from the folder where Debian keeps them."""
    from pathlib import Path

    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {i: Path("/usr/share/common-licenses", f) for i, f in files.items()}
    if not all(p.exists() for p in found.values()):
        pytest.skip("the texts are not on this machine")
    texts = [p.read_text("utf-8") for p in found.values()]
    assert [r.license_id for r in _canonical(spark, texts + ["# " + t.replace("\n", "\n# ") for t in texts])] == list(found) * 2


OPERATORS = {
    "quality": lambda d: quality.quality_rules(d), "near": lambda d: neardup.near_duplicates(d), "lines": lambda d: linededup.line_dedup(d, bits=20), "secrets": lambda d: secrets.secret_scan(d),
    "shards": lambda d: shards.kd_shards(d, dimensions=["n_chars"], n_shards=3), "licenses": lambda d: licenses.license_scan(d, licenses.known_licenses(d.sparkSession)),
    "contamination": lambda d: decontam.contamination(d, d.sparkSession.createDataFrame(ITEMS, "item_id bigint, text string")),
    "bpe": lambda d: bpe.bpe_digests(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows(spark, name):
    """Every row has a result, and equal rows have equal ones (but for their slots)."""
    rows = spark.createDataFrame([(r[0], r[1], r[3], r[4]) for r in ROWS[9:30]], "doc_id bigint, text string, source string, n_chars bigint")
    out = OPERATORS[name](rows.union(rows))
    assert out.count() == 42
    if name != "shards":
        assert out.distinct().count() <= 21
