"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, which each worker reads once from its own disk."""
    if (rank_file, pattern) not in _encodings:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _encodings[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[rank_file, pattern]


def safe_pieces(text: str, target: int = 1 << 17) -> Iterator[str]:
    """text in pieces of about target characters, cut only where no match of the pattern can reach across.

    No alternative of the pattern holds a letter or number followed by something of another kind (letters, numbers, white
    space, the rest), and none looks back; so a match ends there in any case, and the rest is split as it would be at a
    text's start. A run of spaces is cut before its last one, where \\s+(?!\\S) ends if something follows. What has no
    such place is one match (an endless word, number or line of dashes), which is encoded whole by definition, or a run
    of white space and signs."""
    start, n = 0, len(text)
    while n - start > target:
        at = start + target
        while at < n and not _safe(text, at):
            at += 1
        yield text[start:at]
        start = at
    if start < n:
        yield text[start:]


def _safe(text: str, at: int) -> bool:
    before, after = text[at - 1], text[at]
    kind, other = unicodedata.category(before)[0], unicodedata.category(after)[0]
    if kind in "LN":
        return other != kind and (other in "LNPSZ" or after in " \t\n\r")
    # between the last two characters of a run of spaces: the first part is one match, the rest begins anew
    return before == after == " " and at + 1 < len(text) and unicodedata.category(text[at + 1])[0] in "LN"


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """What encode_ordinary gives for the whole text, by safe pieces."""
    ids: list[int] = []
    for piece in safe_pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def _encoder(rank_file: str, pattern: str):
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in slices(batches):
            tokens = [pa.array(encode_text(enc, t) if t else [], pa.int32()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays([0, *accumulate(map(len, tokens))], pa.concat_arrays(tokens))], schema=schema)

    return run


def _decoder(rank_file: str, pattern: str):
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int32())), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in slices(batches):
            raw = [None if t is None else enc.decode_bytes(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tokens"), pa.array(raw, pa.binary())], schema=schema)

    return run


def _digester(rank_file: str, pattern: str):
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in slices(batches):
            sizes, shas, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = encode_text(enc, text) if text else []
                sizes.append(len(tokens))
                shas.append(hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode_bytes(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    return run


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and tokens (array<int>) for each row of docs.

    Each match of pattern is encoded by itself, without special tokens, as the tiktoken library does; texts are cut at
    safe places first, which keeps its memory bounded and changes no token. pattern must be the one that safe_pieces is made for.

    Cases: null and empty texts have no tokens; a null id stays null; repeated rows are encoded alike; texts of any
    length are encoded whole; an empty table gives an empty result; other columns are ignored. No shuffle."""
    return _base(docs, id_col, text_col).mapInArrow(_encoder(rank_file, pattern), "id bigint, tokens array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """id_col, tokens and the raw bytes they stand for. Bytes, since tokens may end inside a character. Null tokens give null bytes."""
    base = encoded.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{tokens_col}`").cast("array<int>").alias("tokens"))
    return base.mapInArrow(_decoder(rank_file, pattern), "id bigint, tokens array<int>, bytes binary").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids joined by spaces) and decoded_sha256 (of the decoded bytes).

    Encoding, decoding and digests in one pass where the text is read, so that tokens don't leave the task. Cases as for bpe_encode."""
    ddl = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _base(docs, id_col, text_col).mapInArrow(_digester(rank_file, pattern), ddl).withColumnRenamed("id", id_col)
