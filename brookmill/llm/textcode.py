"""Numeric codes of characters, words and word shingles, by numpy over whole texts.

Texts of any length are handled in blocks, so that a block's arrays stay a few
megabytes.
"""

from __future__ import annotations

import functools

import numpy as np

#: Bytes of a text coded at a time.
BLOCK = 1 << 18
MULTIPLIER = 0x9E3779B97F4A7C13
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def seeded(count: int, seed: int) -> np.ndarray:
    """count 64-bit numbers, the same on every machine."""
    return mixed_bits(mixed_bits(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(MULTIPLIER))


BYTE_CODE = seeded(256, 1)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    up = np.cumprod(np.full(n, MULTIPLIER, np.uint64))
    down = np.cumprod(np.full(n, inverse, np.uint64))
    return up, down


def _blocks(raw: np.ndarray):
    """Parts of raw, cut at white space; a word longer than a block is not cut."""
    at = 0
    while at < len(raw):
        end = at + BLOCK
        if end < len(raw):
            back = np.flatnonzero(WHITE[raw[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(WHITE[raw[end:]])
                end = end + int(ahead[0]) if len(ahead) else len(raw)
        yield raw[at:end]
        at = end


def word_codes(text: str) -> np.ndarray:
    """A 64-bit code for each word (a run without ASCII white space), in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    found = []
    for part in _blocks(raw):
        inside = ~WHITE[part]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = max(BLOCK, 1 << int(len(part)).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_CODE[part] * up[: len(part)], out=sums[1:])
        found.append(mixed_bits((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_codes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A code for each run of `size` words; of all words where there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed_bits(out * np.uint64(MULTIPLIER) + words[k : n - width + 1 + k])
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
