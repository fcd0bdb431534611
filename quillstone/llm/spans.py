"""Words, lines and their identities over the concatenated UTF-8 bytes of many texts.

Spans are told apart by their bytes: each distinct span of a batch has a number, and where numbers must mean the same in
all tasks, a BLAKE2b digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillstone.llm.common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in any of the inclusive ranges."""
    out = np.zeros(256, bool)
    for i, j in ranges:
        out[i : j + 1] = True
    return out


#: Bytes of spans that are told apart at once.
SLICE = 4_000_000
#: Bytes of a word: all but space and U+0009 to U+000D.
NOT_WHITE = ~byte_table((0x20, 0x20), (0x09, 0x0D))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def per_text(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The number of True flags in each text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(flags.view(np.uint8), offsets[full], dtype=np.int64)
    return out


def powers(base: np.uint64, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; the longest table so far is kept."""
    if len(kept.get(base, ())) < n:
        table = np.full(n + n // 4, base, np.uint64)
        table[0] = 1
        kept[base] = np.multiply.accumulate(table)
    return kept[base][:n]


def numbered_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each span, the same for the same bytes, and the distinct spans by number. Spans are in order and apart."""
    sizes = ends - starts
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1  # a span may start where another ends
    edge[ends] -= 1
    packed = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def span_slices(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of spans that cover about SLICE bytes, one span at least."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        yield i, j
        i = j


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The digest of each span; a slice is worked on at a time."""
    out = np.empty(len(starts), np.uint64)
    for i, j in span_slices(starts, ends):
        base = starts[i]
        codes, distinct = numbered_spans(data[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base)
        out[i:j] = digests(distinct)[codes]
    return out


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, the same for the same bytes; those of long buffers by their digests."""
    if len(data) <= SLICE:
        return numbered_spans(data, starts, ends)[0]
    return np.unique(span_digests(data, starts, ends), return_inverse=True)[1]


def digests(distinct: pa.Array) -> np.ndarray:
    """64 bits of the BLAKE2b digest of each span."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in distinct.to_pylist()), np.uint64)


def owners(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text that each span belongs to."""
    return np.searchsorted(offsets, starts, "right") - 1


def pair_numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, the same for the same pair."""
    if not len(a):
        return np.zeros(0, np.int64)
    key = a * (int(b.max()) + 1)
    key += b
    if len(key) > SLICE // 8:  # sorting takes less memory than a hash table
        return np.unique(key, return_inverse=True)[1]
    return pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)


def windows(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for the three in a row at each of the places, the same for the same three."""
    a, b, c = numbers[at], numbers[at + 1], numbers[at + 2]
    if len(numbers) and int(numbers.max()) < 1 << 21:
        return (a << 42) | (b << 21) | c
    return pair_numbers(pair_numbers(a, b), c)


def repeated(text: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the item's text has its number elsewhere too."""
    order = np.lexsort((codes, text))
    codes, text = codes[order], text[order]
    same = np.zeros(len(codes) + 1, bool)
    same[1:-1] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    out = np.empty(len(codes), bool)
    out[order] = same[1:] | same[:-1]
    return out


def further(text: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """All but the first item of each number in a text."""
    out = np.ones(len(codes), bool)
    out[np.unique(pair_numbers(text, codes), return_index=True)[1]] = False
    return out
