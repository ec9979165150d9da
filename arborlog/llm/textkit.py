"""Word tables over Arrow string columns, in numpy: where words are, a quick hash of each, and codes that tell which are equal.

A word is a run of bytes outside space and 0x09..0x0D; in UTF-8 these bytes stand for themselves
only, so the words are those of the text. Quick hashes are polynomials over bytes modulo 2**64, finally mixed: equal words have equal
hashes, and different ones seldom do, but some long texts of few letters do by construction. So hashes only say which words are
worth a comparison; codes, which compare bytes, decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_rng.integers(1, 2**62)) * 4 + 1
_BACK = pow(_STEP, -1, 2**64)
#: Odd multipliers of the words of a window, by place.
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes hashed at a time, so few that their numbers stay in the processor's cache.
SEGMENT = 1 << 15
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        x = np.full(max(n, SEGMENT + 1), base, dtype=np.uint64)
        x[0] = 1
        _powers[kind] = np.cumprod(x, dtype=np.uint64)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; spans are sorted and don't overlap. Works through segments of the data."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, back = _power("up", _STEP, hi - lo + 1), _power("back", _BACK, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        i = j
    return out


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A code for each byte span, equal exactly if the spans are, and the distinct spans by code. Spans are sorted and don't overlap."""
    edges = np.zeros(len(data) + 1, dtype=np.int8)
    edges[starts] += 1
    edges[ends] -= 1  # a span may begin where the one before it ends
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    found = spans.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A code for each pair of codes (below 2**31), equal exactly if both are."""
    return pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0].astype(np.int64)


def window_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A code for the k words that start at each word, equal exactly if the words are; also across texts: mask those with ``fits``."""
    if len(codes) < k:
        return np.zeros(0, dtype=np.int64)
    have, out = 1, codes
    while 2 * have <= k:
        out, have = pairs(out[:-have], out[have:]), 2 * have
    n = len(codes) - k + 1
    return pairs(out[:n], out[k - have : k - have + n]) if have < k else out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each starts (one more at the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a column of texts. starts, ends: byte places; first: the first word of each text, and the total."""

    def __init__(self, column: pa.Array):
        self.data, self.at = flat(column)
        inside = ~SPACE[self.data]
        n = len(inside)
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cut = self.at[(self.at > 0) & (self.at < n)]
            before[cut], after[cut - 1] = False, False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, k: int, places: np.ndarray) -> np.ndarray:
    """Hash of the k words that start at each of these places."""
    return level_windows(hashes, [k], places)[0]


def level_windows(hashes: np.ndarray, levels: list[int], places: np.ndarray) -> list[np.ndarray]:
    """For each k of the rising levels, the hash of the k words that start at each of these places (sorted), a segment at a time."""
    out = [np.empty(len(places), dtype=np.uint64) for _ in levels]
    step = SEGMENT >> 1
    for i in range(0, len(places), step):
        at = places[i : i + step]
        lo, hi = int(at[0]), int(at[-1]) + 1
        near = hi - lo <= 2 * len(at)  # then sums over all words between are cheaper than picking each
        sums = np.zeros(hi - lo if near else len(at), dtype=np.uint64)
        have = 0
        for k, row in zip(levels, out):
            for j in range(have, k):
                if near:
                    part = hashes[lo + j : hi + j]
                    sums[: len(part)] += part * _PLACE[j]
                else:
                    sums += hashes[at + j] * _PLACE[j]
            have = k
            row[i : i + step] = mix(sums[at - lo] if near else sums)
    return out


def fits(words: Words, k: int) -> np.ndarray:
    """For each word with k - 1 words after it in the column: are those in the same text?"""
    n = len(words.starts) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    left = np.repeat(words.first[1:], words.counts)[:n] - np.arange(n)
    return left >= k


class Covered:
    """The words of some windows of k words alone, with codes of their words and of the windows."""

    def __init__(self, words: Words, places: np.ndarray, k: int):
        edges = np.zeros(len(words.starts) + 1, dtype=np.int64)
        edges[places] += 1  # no window is named twice, so neither is an end
        edges[places + k] -= 1
        inside = np.cumsum(edges[:-1]) > 0
        self.place = (np.cumsum(inside) - 1)[places]  # where each window begins among the covered words
        self.starts, self.ends = words.starts[inside], words.ends[inside]
        self.codes, self.known = coded(words.data, self.starts, self.ends)
        # words that are neighbours here but not in the text are in no window of these places
        self.windows = window_codes(self.codes, k)[self.place] if len(places) else np.zeros(0, dtype=np.int64)
