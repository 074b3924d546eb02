"""The pipeline's stages against plain versions of each, on the smallest table."""

import base64

import public_tokenizers
import tiktoken

import corpus_pipeline
from docloom.llm.common import written

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    rows = {r.doc_id: r.text for r in docs.collect()}

    good = written(stages["quality"](spark, docs, SF))
    kept = {r.doc_id for r in good.collect()}
    passed = {i for i, t in rows.items() if not brute.base_quality(t)[-1]}
    assert kept <= passed and len(passed - kept) <= 0.02 * len(passed) and good.columns == docs.columns
    rows = {i: rows[i] for i in kept}

    deduped = written(stages["line_dedup"](spark, good, SF))
    plain = brute.line_dedup(rows.items())
    rows = {i: t for i, (_, n, t) in plain.items() if not n or t.split()}
    assert {r.doc_id: r.text for r in deduped.collect()} == rows

    unique = written(stages["near_dedup"](spark, deduped, SF))
    components = brute.near(list(rows.items()), 5)
    rows = {i: t for i, t in rows.items() if components[i][1] == i}
    assert {r.doc_id for r in unique.collect()} == set(rows)

    clean = written(stages["decontamination"](spark, unique, SF))
    hits = brute.contamination(rows.items(), bench)
    rows = {i: t for i, t in rows.items() if not hits[i][1]}
    assert {r.doc_id for r in clean.collect()} == set(rows) and clean.columns == docs.columns

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {i: (len(ids := enc.encode_ordinary(t)), brute.sha(" ".join(map(str, ids))), brute.sha(t)) for i, t in rows.items()}
    assert {r.doc_id: tuple(r)[1:] for r in stages["byte_bpe"](spark, clean, SF).collect()} == expected
    assert {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()} == expected
