"""Vectorised word hashing: words of many texts as 64-bit hashes, in a few numpy passes over the bytes.

A word is a run of bytes outside [\\x20\\x09-\\x0D]. Its hash is a polynomial over random 64-bit values of its
bytes, taken from prefix sums, so that no Python code runs for each word. Two different words share a hash with a
chance of about 2**-64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SPACE

U = np.uint64
CHUNK = 1 << 19
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[list(SPACE)] = True
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWERED = _VALUES.copy()
_LOWERED[0x41:0x5B] = _VALUES[0x61:0x7B]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, r in enumerate((_R, _RINV)):
                out = np.full(n, r, np.uint64)
                out[0] = 1
                _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (index, piece) of about CHUNK bytes; long texts are cut at white space."""
    group, size = [], 0
    for i, text in enumerate(texts):
        start = 0
        while len(text) - start > CHUNK:
            end = start + CHUNK
            while end < len(text) and not _SPACES[text[end]]:
                end += 1
            yield [(i, text[start:end])]
            start = end
        piece = text[start:] if start else text
        group.append((i, piece))
        size += len(piece) + 1
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, text after text, and for each the index of its text."""
    values = _LOWERED if lower else _VALUES
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        for group in _pieces(texts):
            data = np.frombuffer(b"\n" + b"\n".join(p for _, p in group) + b"\n", np.uint8)
            word = ~_SPACES[data]
            edges = np.flatnonzero(word[1:] != word[:-1]) + 1
            starts, ends = edges[0::2], edges[1::2]
            if not len(starts):
                continue
            power, inverse = _power_tables(len(data))
            sums = np.cumsum(values[data] * power[: len(data)])
            hashes.append(mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts]))
            begins = np.cumsum([1] + [len(p) + 1 for _, p in group[:-1]])
            at = np.searchsorted(begins, starts, "right") - 1
            owners.append(np.array([i for i, _ in group], np.int64)[at])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def windows(hashes: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of width consecutive words inside one text, and the index of each one's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = hashes[:n].copy()
        for k in range(1, width):
            h = mix(h + U(0x9E3779B97F4A7C15)) + hashes[k : k + n]
        h = mix(h)
    first = np.flatnonzero(owners[:n] == owners[width - 1 : width - 1 + n])
    return h[first], first


def sum_sorted(owners: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owners, weights, minlength=n).astype(np.int64)
