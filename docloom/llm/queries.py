"""The operators' queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .decontam import contamination
from .licenses import DIGESTS, LICENSES, SPELLINGS, TITLES, known_licenses, license_scan
from .linededup import line_dedup
from .neardup import near_duplicates
from .quality import quality_rules
from .search import ranked_search
from .secrets import secret_scan
from .shards import kd_shards
from .spelling import spelling_groups
from .suffixes import without_repeats
from .urls import url_filter
from .warc import warc_round_trip

RANKS = "byte_bpe_50k.tiktoken"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES, max_depth=None).select("page_id", "host", "path", "rule", "verdict", "template")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"), dimensions=["n_chars", "lang", "source"], n_shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    kept = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(joined, "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"), known_licenses(spark))
    return out.select("doc_id", "text_digest", "license_id", F.array_join("notices", ",").alias("notices"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_warc,
        op3_url_filter,
        op4_byte_bpe,
        op5_minhash_near_dedup,
        op6_kd_sharding,
        op7_line_dedup,
        op8_benchmark_decontamination,
        op9_secret_scan,
        op10_license_scan,
        op11_spelling_variants,
        op12_ranked_search,
        op13_suffix_dedup,
    )
}

_KNOWN = ", ".join(
    "('{}', '{}')".format(i, text.replace("'", "''")) for i, t in LICENSES.items() for text in (t, *(f"{title}\n{t}" for title in TITLES.get(i, ())))
)
_DIGESTS = ", ".join(f"('{i}', '{d}')" for i, own in DIGESTS.items() for d in own)
_WORD_FOR = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items() if " " not in a) + "}"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULE_FITS = [
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{r}'"
    for r in sorted((r for _, r in URL_RULES), key=lambda r: (-len(r), r))
    for h, _, p in [r.partition("/")]
]
_BLOCKS = ", ".join(f"'{r}'" for v, r in URL_RULES if v == "block")

#: Levels of a path that the SQL generalises, one after another; no given page has as many.
_LEVELS = 8
_GENERALISED = ",\n".join(
    f"v{k} as (select host, way from g{k - 1} where len(segments) >= {k} group by host, way having count(distinct segments[{k}]) >= 10 and sum(n) < 3.0 * count(distinct segments[{k}])), "
    f"g{k} as (select g.* exclude (way), case when len(segments) < {k} then g.way else list_append(g.way, case when v.host is not null then '*' else segments[{k}] end) end as way "
    f"from g{k - 1} g left join v{k} v on v.host = g.host and v.way = g.way)"
    for k in range(1, _LEVELS + 1)
)


def _crc_table() -> str:
    """The 256 steps of CRC-32, as an SQL list."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return f"{out}::bigint[]"


ORACLE_SQL = {
    "op1_quality_rules": r"""
with docs as (select doc_id, source, coalesce(text, '') as text from documents),
split as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, string_split(text, chr(10)) as ls from docs),
words as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from split),
three as (select doc_id, i, w || ' ' || lead(w) over p || ' ' || lead(w, 2) over p as win from words window p as (partition by doc_id order by i)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from three where win is not null) where n > 1),
covered as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from again, (values (0), (1), (2)) as k(k) group by doc_id),
chars as (select doc_id, sum(length(w))::bigint as word_chars, sum(length(regexp_replace(w, '[^#*$%&|<>]', '', 'g')))::bigint as n_symbols from words group by doc_id),
lines as (select doc_id, source, unnest(ls) as line, generate_subscripts(ls, 1) as i from split),
worded as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select doc_id, sum(n - 1)::bigint as n_dup_lines from (select doc_id, line, count(*) as n from worded group by 1, 2) group by doc_id),
held as (select doc_id, source, key, sum(n)::bigint as words from (
  select doc_id, source, len(ws) as n, regexp_replace(translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') as key
  from worded) group by 1, 2, 3),
hosts as (select source, count(distinct doc_id) as host_docs from docs group by source),
above as (select h.source, h.key, min(h.doc_id) as first from held h join hosts on hosts.source = h.source
  group by h.source, h.key, host_docs having count(distinct h.doc_id) > 10 and (count(distinct h.doc_id) > 0.05 * host_docs or count(distinct h.doc_id) > 1000)),
removed as (select h.doc_id, count(*)::bigint as removed_lines, sum(words)::bigint as removed_words
  from held h join above a on h.source = a.source and h.key = a.key and h.doc_id <> a.first group by h.doc_id),
whole as (select s.doc_id, len(ws)::bigint as n_words, coalesce(word_chars, 0) as word_chars, coalesce(n_symbols, 0) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(removed_lines, 0) as removed_lines, coalesce(removed_words, 0) as removed_words
  from split s left join chars using (doc_id) left join dups using (doc_id) left join covered using (doc_id) left join removed using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_words - removed_words < 0.3 * n_words as depleted from whole)
select *, not base_failed and not depleted as kept from judged
""",
    "op2_warc": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as h, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((strpos('0123456789abcdef', substr(h || '0', (i * 5) // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h || '0', (i * 5) // 4 + 2, 1)) - 1) >> (3 - (i * 5) % 4)) % 32 + 1, 1)), '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to
from d
""",
    "op3_url_filter": r"""
with recursive u as (select page_id, """ + _LOWERED.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')") + r""" as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
r as (select *, case """ + " ".join(_RULE_FITS) + r""" end as rule from u),
t as (select *, case when rule is not null then case when rule in (""" + _BLOCKS + r""") then 1 else 0 end end as label,
  list_transform(string_split(ltrim(path, '/'), '/'), lambda x: case when regexp_matches(x, '^[0-9]+') then regexp_replace(x, '^[0-9]+', '{n}')
    when regexp_matches(x, '^[0-9a-f]{8,}') then regexp_replace(x, '^[0-9a-f]{8,}', '{x}') else x end) as segments from r),
g0 as (select host, segments, count(*) as n, count(label) as known, coalesce(sum(label), 0) as bad, []::varchar[] as way from t group by host, segments),
""" + _GENERALISED + r""",
forms as (select host, segments, known, bad, list_concat(way, segments[""" + str(_LEVELS + 1) + r""":]) as way from g""" + str(_LEVELS) + r"""),
steps as (select host, known, bad, way[1:d] as node, way[1:d - 1] as parent from (select *, unnest(range(1, len(way) + 1)) as d from forms)),
plain as (select host, node, parent, sum(known) as known, sum(bad) as bad from steps group by all),
pools as (select host, parent, sum(bad) / sum(known) as common from plain where known > 0 group by all),
marked as (select plain.*, known > 0 and abs(bad / known - common) <= 2.0 * sqrt(common * (1 - common) / known) as alike from plain left join pools using (host, parent)),
joint as (select host, parent, sum(known) as all_known, sum(bad) as all_bad from marked where alike group by all),
nodes as (select host, node, parent, case when alike then all_known else known end as known, case when alike then all_bad else bad end as bad from marked left join joint using (host, parent)),
hosts as (select host, string_split(host, '.') as labels, sum(known) as known, sum(bad) as bad from forms group by all),
suffixes as (select host, d, array_to_string(labels[len(labels) - d + 1:], '.') as domain, known, bad from (select *, unnest(range(1, len(labels) + 1)) as d from hosts)),
domains as (select domain, sum(known) as known, sum(bad) as bad from suffixes group by all),
down as (select host, 0 as d, (select coalesce(sum(bad) / nullif(sum(known), 0), 0) from hosts)::double as p from hosts
  union all select w.host, w.d + 1, (x.bad + 5.0 * p)::double / (x.known + 5.0) from down w join suffixes s on s.host = w.host and s.d = w.d + 1 join domains x using (domain)),
walk as (select host, []::varchar[] as node, p from down join hosts using (host) where d = len(labels)
  union all select w.host, n.node, (n.bad + 5.0 * p)::double / (n.known + 5.0) from walk w join nodes n on n.host = w.host and n.parent = w.node and len(n.node) = len(w.node) + 1)
select page_id, t.host, path, rule, case label when 1 then 'block' when 0 then 'allow' else case when p >= 0.8 then 'block' else 'allow' end end as verdict, array_to_string(way, '/') as template
from t join forms using (host, segments) join walk on walk.host = t.host and walk.node = way
""",
    # Word lists and a map of spellings, where the operator works on padded text.
    "op10_license_scan": r"""
with texts as (select 'd' as kind, doc_id as id, null as license_id, text from documents union all select 'k', row_number() over (), license_id, text from (values """ + _KNOWN + r""") as v(license_id, text)),
cut as (select kind, id, generate_subscripts(ls, 1) as pos, unnest(ls) as line from (select kind, id, string_split(text, chr(10)) as ls from texts where text is not null)),
low as (select kind, id, pos, """ + _LOWERED.format("line") + r""" as x from cut),
listed as (select kind, id, pos, case when length(x) <= 200 and (regexp_matches(x, '^[^a-z0-9(©]*copyright[ \t,:]*([0-9]{4}|\(c\)|©|\[|<|\{|by )') or regexp_matches(x, '^[^a-z0-9(©]*(©|\(c\)[ \t]*[0-9]{4})'))
  then [] else regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') end as ws from low),
kept as (select kind, id, pos, case when ws = ['all', 'rights', 'reserved'] then [] else ws end as ws from listed),
units as (select kind, id, 0 as pos, flatten(list(ws order by pos)) as ws from kept group by kind, id union all select * from kept where kind = 'd'),
spelt as (select kind, id, pos, regexp_replace(regexp_replace(array_to_string(list_transform(ws, lambda w: coalesce((""" + _WORD_FOR + r""")[w], w)), ' '),
  '\bcopyright owner\b', 'copyright holder', 'g'), '\bper cent\b', 'percent', 'g') as form from units),
digests as (select kind, id, pos, sha256(form) as digest from spelt where form <> ''),
known as (select digest, min(license_id) as license_id from (select digest, license_id from digests join texts using (kind, id) where kind = 'k' union all select d, i from (values """ + _DIGESTS + r""") as v(i, d)) group by digest),
hits as (select id, string_agg(distinct license_id, ',' order by license_id) as notices from digests join known using (digest) where kind = 'd' group by id)
select d.doc_id, w.digest as text_digest, k.license_id, coalesce(notices, '') as notices
from documents d left join digests w on w.kind = 'd' and w.pos = 0 and w.id = d.doc_id left join known k on k.digest = w.digest left join hits on hits.id = d.doc_id
""",
    "op7_line_dedup": r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from docs),
keyed as (select doc_id, i, line, lower_ascii as key from (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from lines)),
repeated as (select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (select k.doc_id, k.i, k.line, (r.first is not null and r.first <> k.doc_id) as gone from keyed k left join repeated r on k.key = r.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op8_benchmark_decontamination": r"""
with norm as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
split as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from norm),
item_windows as (select id as item_id, least(10, len(ws)) as w, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as win
  from (select *, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as i from split where kind = 'b' and len(ws) > 0)),
widths as (select distinct w from item_windows),
doc_windows as (select id as doc_id, i, w, array_to_string(ws[i:i + w - 1], ' ') as win
  from (select s.*, w.w, unnest(range(1, greatest(len(ws) - w.w, -1) + 2)) as i from split s, widths w where kind = 'd')),
hits as (select doc_id, i, d.w, item_id from doc_windows d join item_windows b on d.win = b.win and d.w = b.w),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + w)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select s.id as doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from split s left join words on words.doc_id = s.id left join items on items.doc_id = s.id where s.kind = 'd'
""",
    "op11_spelling_variants": r"""
with recursive runs as (select doc_id, """ + _LOWERED.format("run") + r""" as run, count(*)::bigint as n from (
  select coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) where length(run) >= 6 group by all),
steps as (select """ + _crc_table() + r""" as crc),
bytes as (select doc_id, run, n, hex(encode(doc_id || ':' || run)) as hexed from runs),
summed as (select doc_id, run, n, xor(4294967295, list_reduce(list_transform(range(0, length(hexed) // 2), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::bigint),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::bigint)) as h from bytes, steps),
words as (select word, sum(n)::bigint as n from (
  select n, case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word from summed) where length(word) >= 6 group by word having sum(n) >= 5),
cuts as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (select distinct * from (
  select a.word, a.n, b.word as other, b.n as other_n from cuts a join cuts b using (i, cut) where a.word <> b.word
  union all select w.word, w.n, c.word, c.n from words w join cuts c on c.cut = w.word
  union all select c.word, c.n, w.word, w.n from words w join cuts c on c.cut = w.word)),
ranked as (select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other collate "C") as r from near),
forms as (select word, n_near, case when other_n >= 5 * n then other end as form, case when other_n >= 5 * n then other_n end as form_n from ranked where r = 1),
walk as (select word, form as root from forms where form is not null union all select w.word, f.form from walk w join forms f on f.word = w.root where f.form is not null),
ends as (select w.word, w.root from walk w join forms f on f.word = w.root where f.form is null)
select w.word, f.form, coalesce(e.root, w.word) as root, w.n, coalesce(f.n_near, 0)::bigint as n_near, f.form_n from words w left join forms f using (word) left join ends e using (word)
""",
    "op12_ranked_search": r"""
with d as (select doc_id, row_number() over () as row, regexp_extract_all(""" + _LOWERED.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ts from documents),
total as (select count(*)::bigint as docs, sum(len(ts))::bigint as length from d where len(ts) > 0),
i as (select item_id, row_number() over () as item, unnest(regexp_extract_all(""" + _LOWERED.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item_id, item, term, count(*)::bigint as q from i group by all),
p as (select row, doc_id, n, term, count(*)::bigint as tf from (select row, doc_id, len(ts)::bigint as n, unnest(ts) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::double))::bigint as w from p, total group by term, docs),
s as (select item, item_id, row, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // length)))))::bigint as score from q join p using (term) join w using (term), total group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
""",
    # Texts as hexadecimal digits, cut into parts of 200 starts before windows are taken from them.
    "op13_suffix_dedup": r"""
with d as (select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
parts as (select row, a, substr(h, 2 * a + 1, 800) as part from (select row, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 200)) as a from d)),
windows as (select row, a + i as s, md5(substr(part, 2 * i + 1, 400)) as w from (select row, a, part, unnest(range(0, least(200, length(part) // 2 - 199))) as i from parts)),
twice as (select w from windows group by w having count(*) > 1),
starts as (select row, s, s - lag(s) over (partition by row order by s) as gap from windows join twice using (w)),
islands as (select row, s, sum(case when gap <= 200 then 0 else 1 end) over (partition by row order by s) as k from starts),
spans as (select row, k, min(s) as low, max(s) + 200 as high from islands group by row, k),
edges as (select row, 0 as low, coalesce(min(low), max(n)) as high from (select d.row, length(h) // 2 as n, low from d left join spans using (row)) group by row
  union all select row, high, coalesce(lead(low) over (partition by row order by k), length(h) // 2) from spans join d using (row)),
kept as (select row, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' order by low) as h from edges join d using (row) group by row)
select doc_id, length(d.h)::bigint // 2 as n_bytes, (length(d.h) - length(kept.h))::bigint // 2 as n_removed, (select count(*) from spans where spans.row = d.row)::bigint as n_spans,
  sha256(unhex(kept.h)) as kept_sha256
from d join kept using (row)
""",
}
