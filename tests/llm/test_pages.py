import gzip
import hashlib
import io
import random
import zlib
from base64 import b32encode
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.llm import urls, warc
from docloom.llm.queries import URL_RULES

PAGES = [
    (1, "http://a.example/x", "<p>hé</p>"), (2, None, "<p>hé</p>"), (3, "http://b.example/ä b\n", None), (4, "x", ""), (5, "http://c/", "<p>other</p>" * 50_000), (6, "http://c/", "<p>hé</p>"),
    (None, "http://d/", "<p>hé</p>"), (7, "http://e/", "inner \x1f\x8b\x08 magic"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, sha1 string, path int").repartition(2)


def expected(least):
    out = {}
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == raw and p is not None]
        first = min(same, default=None)
        kind = "revisit" if len(raw) >= least and page is not None and page != first else "response"
        out[page] = (len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), kind, first if kind == "revisit" else None)
    return out


@pytest.mark.parametrize("least, split", [(0, 16 << 20), (0, 100), (5, 1000), (5, 7)])
def test_round_trip(spark, pages, least, split):
    rows = warc.warc_round_trip(pages, least_bytes=least, split_bytes=split).collect()
    assert len(rows) == len(PAGES)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == expected(least)


def test_files_are_standard(spark, pages, tmp_path):
    """Any gzip reader sees the records, and payloads come back whole."""
    files = warc.write_warc(pages, str(tmp_path), max_file_bytes=300)
    named = files.collect()
    assert len(named) > 2 and sum(f.records for f in named) == len(PAGES)
    text = b"".join(gzip.decompress(Path(f.path).read_bytes()) for f in named)
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and b"WARC-Target-URI: http://b.example/%C3%A4%20b%0A" in text
    rows = warc.read_warc(spark, files).collect()
    assert {r.page_id: bytes(r.payload) for r in rows if r.record_type == "response"}[5] == PAGES[4][2].encode()
    assert all(r.payload is None for r in rows if r.record_type == "revisit")


def test_empty(spark, pages):
    assert warc.warc_round_trip(pages.limit(0)).collect() == []


def test_ranges_own_each_record_once():
    """Stored (uncompressed) members that hold magic bytes and whole gzip members of other records mislead no range."""
    inner = warc.member(warc.record("response", 99, None, b"inner", "D", 5, None))
    contents = [warc.record("response", n, None, inner + b"\x1f\x8b\x08\x00tail" * n, "D", 3, None) for n in range(6)]

    def stored(data):
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    raw = b"".join(stored(c) if n % 2 else warc.member(c) for n, c in enumerate(contents))
    for size in (1, 13, 100, 1000, len(raw)):
        found = []
        for start in range(0, len(raw), size):
            found += [c for _, c in warc.members(io.BytesIO(raw), start, min(start + size, len(raw)), len(raw))]
        assert found == contents, size


@pytest.mark.parametrize("count", [30, 700])
def test_archives_inside_payloads_invent_no_record(count):
    """However many whole records a stored payload holds, in one stored block or in several, no range takes one for its own."""
    inner = b"".join(warc.member(warc.record("response", 1000 + n, None, bytes(random.Random(n).randbytes(150)), "D", 150, None)) for n in range(count))
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    holder = warc.record("response", 1, None, inner, "D", len(inner), None)
    contents = [warc.record("response", 0, None, b"first", "D", 5, None), holder, warc.record("response", 2, None, b"last", "D", 4, None)]
    raw = warc.member(contents[0]) + z.compress(holder) + z.flush() + warc.member(contents[2])
    assert (len(inner) > 65_535) == (count == 700)
    for size in (777, 1000, 3000, 4096, 65_536, len(raw)):
        found = []
        for start in range(0, len(raw), size):
            found += [c for _, c in warc.members(io.BytesIO(raw), start, min(start + size, len(raw)), len(raw))]
        assert found == contents, size


def test_broken_member_is_passed_over():
    good = [warc.member(warc.record("response", n, None, b"payload", "D", 7, None)) for n in range(3)]
    raw = good[0] + good[1][:-20] + b"\x00" * 20 + good[2]
    assert len([1 for _ in warc.members(io.BytesIO(raw), 0, len(raw), len(raw))]) >= 1


def plain_records(raw):
    """(offset, content) of whole records, read one after another from the beginning; damaged bytes are passed over."""
    out, at = [], 0
    while at < len(raw):
        z = zlib.decompressobj(31)
        try:
            content = z.decompress(raw[at:])
            good = z.eof and content.startswith(b"WARC/1.")
        except zlib.error:
            good = False
        if good:
            out.append((at, content))
            at = len(raw) - len(z.unused_data)
        else:
            at += 1
    return out


@pytest.mark.parametrize("broken", [(3,), (0,), (5,), (1, 2, 4), ()])
def test_damage_costs_only_the_damaged(broken):
    """Whatever the ranges, all whole records around damaged ones are found once, and each damaged stretch is told once."""
    raw = b""
    for n in range(6):
        data = warc.member(warc.record("response", n, None, bytes(range(256)) * (n + 1), "D", 3, None))
        raw += data[: len(data) // 2] + b"\x00" * 9 + data[len(data) // 2 + 9 :] if n in broken else data
    expected = plain_records(raw)
    assert len(expected) == 6 - len(broken)
    for size in [*range(1, 60, 7), *range(60, len(raw) + 1, 97)]:
        found, told = [], []
        for start in range(0, len(raw), size):
            for offset, content in warc.members(io.BytesIO(raw), start, min(start + size, len(raw)), len(raw)):
                (told if content is None else found).append((offset, content))
        assert found == expected, size
        assert len(told) == len({o for o, _ in told}) == sum(b - 1 not in broken for b in broken), size


def test_damage_is_told(spark, pages, tmp_path):
    (f,) = warc.write_warc(pages.coalesce(1), str(tmp_path)).collect()
    raw = bytearray(Path(f.path).read_bytes())
    second = [o for o, _ in plain_records(bytes(raw))][1]
    raw[second + 40] ^= 0xFF
    Path(f.path).write_bytes(raw)
    files = spark.createDataFrame([(f.path, f.length)], "path string, length bigint")
    for split in (100, 16 << 20):
        rows = warc.read_warc(spark, files, split_bytes=split, damaged=True).collect()
        assert [r.offset for r in rows if r.record_type == "damaged"] == [second] and len(rows) == len(PAGES)
        assert warc.read_warc(spark, files, split_bytes=split).count() == len(PAGES) - 1


URLS = [
    "http://Sub.Example.ORG/es/1", "https://example.org/en/12?x", "http://example.org/en/2#y", "http://x.com/de/1", "http://x.com/fr/1", "http://x.com/es/1", "ftp://x.net", "http://y.net?a/b", None, "no scheme",
    "http://com/fr/", "http://notexample.org/es/", "a://b://c/d", "http://x.com/fr", "http://ÀÉ.com/de/x",
]


def test_rules(spark):
    df = spark.createDataFrame([(n, u, "h", "r") for n, u in enumerate(URLS)], "page_id int, url string, host string, rule string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(df, URL_RULES).collect()}
    assert rows[0] == ("sub.example.org", "/es/1", "example.org/es/", "block") and rows[1][2:] == ("example.org/en/1", "block") and rows[2][2:] == ("org/", "allow")
    assert rows[3][2:] == ("com/de/", "block") and rows[4][2:] == ("com/fr/", "allow") and rows[5][2] is None
    assert rows[6] == ("x.net", "", None, "allow") and rows[7][:2] == ("y.net", "") and rows[8] == rows[9] == ("", "", None, "allow")
    assert rows[10][2] == "com/fr/" and rows[11][2] == "org/" and rows[12][:2] == ("b:", "//c/d") and rows[13][2] is None and rows[14][0] == "ÀÉ.com"
    assert urls.url_filter(df.limit(0), URL_RULES).count() == 0


def test_templates(spark):
    """Bad branches are blocked as a whole, mixed ones are not, and names that never repeat become wildcards."""
    rows = [(f"http://h/{kind}/{n}.html", 1 if kind == "ads" else 0) for kind in ("ads", "news") for n in range(40)]
    rows += [("http://h/ads/999.html", None), ("http://h/news/999.html", None), ("http://h/other/1.html", None)]
    rows += [(f"http://u/user-{chr(97 + n)}x/wall", 1 if n % 2 else 0) for n in range(12)]
    rows += [("http://deep/" + "/".join("abcdefghijkl"), None)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id int, url string, bad int")
    got = {rows[r.page_id][0]: r for r in urls.url_filter(df, [], label_col="bad", max_depth=8).collect()}
    assert got["http://h/ads/999.html"].verdict == "block" and got["http://h/news/999.html"].verdict == "allow" and got["http://h/other/1.html"].verdict == "allow"
    assert got["http://u/user-ax/wall"].template == "*/wall" and got["http://u/user-ax/wall"].verdict == "allow"
    assert got["http://deep/a/b/c/d/e/f/g/h/i/j/k/l"].template == "a/b/c/d/e/f/g/h/**"


def test_templates_below_a_variable_level(spark):
    """What lies below a variable level is counted together, level by level, and keeps its own purity."""
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    rows = [(f"http://h/user/u{name(n)}/{kind}/{kind}-{name(n)}", int(kind == "casino")) for n in range(40) for kind in ("casino", "blog")]
    rows += [("http://h/user/newcomer/casino/casino-x", None), ("http://h/user/newcomer/blog/blog-x", None)]
    rows += [(f"http://v/{'same/' * 30}v{name(n)}/w{name(n)}", None) for n in range(40)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id int, url string, bad int")
    got = {rows[r.page_id][0]: (r.template, r.verdict) for r in urls.url_filter(df, [], label_col="bad", max_depth=40).collect()}
    assert len(got) == len(rows)
    assert {t for u, (t, _) in got.items() if u.startswith("http://h/")} == {"user/*/casino/*", "user/*/blog/*"}
    assert got["http://h/user/newcomer/casino/casino-x"][1] == "block" and got["http://h/user/newcomer/blog/blog-x"][1] == "allow"
    assert {t for u, (t, _) in got.items() if u.startswith("http://v/")} == {"same/" * 30 + "*/*"}


def test_deep_paths_are_judged_whole(spark):
    rows = [(f"http://h/{'d/' * 11}{kind}/{n}.html", int(kind == "ads")) for kind in ("ads", "news") for n in range(40)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id int, url string, bad int")
    got = {(r.template, r.verdict) for r in urls.url_filter(df.withColumn("bad", F.when(F.col("page_id") % 8 != 0, F.col("bad"))), [], label_col="bad", max_depth=None).collect()}
    assert got == {("d/" * 11 + "ads/{n}.html", "block"), ("d/" * 11 + "news/{n}.html", "allow")}


def test_evidence_backs_off_along_the_tree(spark):
    """Templates without labels take the purity of what lies above them: a branch, the host, its domain; similar siblings are merged."""
    rows = [(f"http://bad.spam.example/{kind}/{n}/x", 1) for kind in ("a", "b", "c") for n in range(12)] + [("http://bad.spam.example/new/1/x", None), ("http://other.spam.example/y", None)]
    rows += [(f"http://h.good.example/{kind}/{n}", int(kind == "ads")) for kind in ("ads", "p", "q", "r") for n in range(30)] + [("http://h.good.example/ads/new/deal", None), ("http://h.good.example/z", None), ("http://x.good.example/z", None)]
    rows += [(f"http://m.good.example/{kind}/{n}", 0) for kind in ("p", "q", "r") for n in range(30)] + [("http://m.good.example/s/1", 0), ("http://m.good.example/u/1", None)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id int, url string, bad int")
    got = {rows[r.page_id][0]: r for r in urls.url_filter(df, [], label_col="bad").collect()}
    blocked = {u for u, r in got.items() if r.verdict == "block"}
    assert blocked == {u for u, label in rows if label == 1} | {"http://bad.spam.example/new/1/x", "http://other.spam.example/y", "http://h.good.example/ads/new/deal"}
    assert got["http://h.good.example/z"].evidence == 0 and got["http://h.good.example/p/1"].evidence == 30
    few, many, none = (got[f"http://m.good.example/{k}/1"].purity for k in "spu")
    assert abs(few - many) < 0.001 < none - few, "one label, merged with its similar siblings, counts as much as theirs; no label is merged with nobody"


def test_merged_branches_share_what_lies_below(spark):
    """Two branches that are alike are one: /a/x has the evidence of /b/x; a branch that differs keeps its own."""
    rows = [(f"http://h.example/{kind}/{leaf}/{n}", int(leaf == "x")) for kind in ("a", "b") for leaf in "xy" for n in range(40)]
    rows += [(f"http://h.example/c/{leaf}/{n}", 0) for leaf in "xy" for n in range(8)]
    rows += [(f"http://h.example/b/only/{n}", 1 if n < 4 else None) for n in range(40)] + [(f"http://h.example/a/only/{n}", None if n else 1) for n in range(40)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id int, url string, bad int")
    got = {rows[r.page_id][0].removeprefix("http://h.example"): r for r in urls.url_filter(df, [], label_col="bad").collect()}
    assert got["/a/only/3"].evidence == 1 and got["/a/only/3"].purity == got["/b/only/3"].purity > 0.8, "one label of its own, four of its twin"
    assert got["/a/x/1"].verdict == got["/b/x/1"].verdict == got["/a/only/3"].verdict == "block"
    assert got["/c/x/1"].verdict == got["/a/y/1"].verdict == "allow"


def test_branches_are_the_plain_tree(spark):
    """Levels of every template against a recursive tree, with deep, shared, empty and equal segments."""
    from random import Random

    from . import brute

    rng = Random(5)
    templates = {}
    for _ in range(400):
        path = tuple(rng.choice(["", "a", "b", "c", "*"]) for _ in range(rng.randrange(1, 5))) + rng.choice([(), (), ("t",) * 30])
        known = rng.choice([0, 0, 1, 5, 40])
        templates[rng.choice(["h", "i.j"]), path] = (known, sum(rng.random() < (0.9 if path[0] == "c" else 0.1) for _ in range(known)))
    df = spark.createDataFrame([(h, "/".join(p), list(p), *labels) for (h, p), labels in templates.items()], "host string, template string, path array<string>, known bigint, bad bigint").repartition(3)
    got = {(r.host, tuple(r.template.split("/"))): (r.evidence, [tuple(x) for x in r.levels]) for r in urls._branches(df, 2.0).collect()}
    plain = brute.branch_levels(templates, 2.0)
    assert got == {t: (templates[t][0], levels) for t, levels in plain.items()}
    apart = {t: sum(k for (h, p), (k, _) in templates.items() if h == t[0] and p[:2] == t[1][:2]) for t in templates}
    assert any(levels[1][0] > apart[t] for t, (_, levels) in got.items() if len(levels) > 1), "subtrees were merged"
