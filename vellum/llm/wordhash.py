"""Keyed hashes of the words and word n-grams of many whole texts at once.

Texts may be chosen so that hashes which anybody can compute collide, so every hash here depends on a key that is drawn anew for each
run (``new_key``) and handed to its tasks: two words of at most LONG bytes then have one hash with a chance of 2^-64, whatever they
are (a random number for each byte at each place, added up), and longer ones that of a keyed BLAKE2.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text worked on at once, where texts are shorter; bytes of a word that are hashed by place.
SOME, LONG = 1 << 19, 64


def new_key() -> int:
    """A key for one run; drawn on the driver, as all tasks of a run need the same one."""
    return secrets.randbits(63)


@lru_cache(4)
def _table(key: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(key)).integers(0, 2**64, LONG * 256, dtype=np.uint64)


@lru_cache(4)
def odd_numbers(key: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([key, n])).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: text k has hashes[bounds[k]:bounds[k + 1]]; starts and ends are places in data."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words(texts: list[bytes], lower: bool, key: int) -> Words:
    """Words are runs of bytes that are not ASCII white space; ``lower`` folds A-Z."""
    data = b" ".join([*texts, b""])
    b = np.frombuffer(data, np.uint8)
    if lower:
        b = _LOWER[b]
    word = ~_SPACE[b]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    place = np.arange(len(b), dtype=np.int32)[word] - np.repeat(starts.astype(np.int32), size)
    value = _table(key)[np.minimum(place, LONG - 1) * 256 + b[word]]
    first = np.cumsum(size) - size
    hashes = mix(np.add.reduceat(value, first) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)
    for k in np.flatnonzero(size > LONG).tolist():
        whole = b[starts[k] : ends[k]].tobytes()
        hashes[k] = int.from_bytes(hashlib.blake2b(whole, digest_size=8, key=key.to_bytes(8, "big")).digest(), "big")
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return Words(data, hashes, starts, ends, bounds)


def grouped(rows: Iterator[tuple[int | None, bytes]]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Rows in groups of about SOME bytes."""
    ids, texts, size = [], [], 0
    for i, t in rows:
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size > SOME or len(ids) == 2048:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encoded(batches) -> Iterator[tuple[int | None, bytes]]:
    """Id and UTF-8 text of Arrow batches (id, text); null is empty."""
    for b in batches:
        texts = b.column(1)
        for at in range(0, b.num_rows, 512):
            for i, t in zip(b.column(0)[at : at + 512].to_pylist(), texts[at : at + 512].to_pylist(), strict=True):
                yield i, (t or "").encode("utf-8", "replace")


_K = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: Words, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending; a text with fewer words has one of them all, one without words none."""
    h = w.hashes
    every = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        every = every * _K[0] + mix(h[j : j + len(every)] + _K[1])
    every = mix(every)
    for a, z in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        n = z - a
        if n >= size:
            yield np.unique(every[a : z - size + 1])
        elif n:
            x = np.uint64(n)
            with np.errstate(over="ignore"):
                for v in h[a:z]:
                    x = x * _K[2] + v
            yield mix(np.array([x], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
