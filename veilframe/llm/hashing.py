"""64-bit hashes of all words of a text at once, by numpy.

A word's hash is a polynomial over random 64-bit byte values, modulo 2**64, taken from one
running sum over the text: sum(v[b[i]] * r**i) over the word, times r**-start. Words equal as
bytes (ASCII letters in either case) have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_ROOT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_SPAN = 1 << 21  # bytes hashed at once, so that long texts need bounded memory

_value = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_value[65:91] = _value[97:123]  # A-Z count as a-z

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def separators(word_bytes: bool = False) -> np.ndarray:
    """Byte table of what stands between words: white space, or with word_bytes all ASCII but letters, digits and _."""
    table = np.zeros(256, bool)
    if word_bytes:
        table[:128] = [not (chr(c).isalnum() or c == 95) for c in range(128)]
    else:
        table[[32, *range(9, 14)]] = True
    return table


SPACES, NON_WORDS = separators(), separators(word_bytes=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, root in enumerate((_ROOT, _INVERSE)):
            steps = np.full(size, root, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _hash_span(data: np.ndarray, sep: np.ndarray) -> np.ndarray:
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(sep[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_value[data] * up[: len(data)], out=sums[1:])
    starts, ends = edges[::2], edges[1::2]
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str, sep: np.ndarray = SPACES) -> np.ndarray:
    """uint64 hash of each word, in order. A word longer than the span is hashed whole all the same."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= _SPAN:
        return _hash_span(data, sep)
    found, start = [], 0
    while start < len(data):
        end = min(start + _SPAN, len(data))
        while end < len(data):  # a span ends at a separator
            gap = np.flatnonzero(sep[data[end : end + _SPAN]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + _SPAN, len(data))
        found.append(_hash_span(data[start:end], sep))
        start = end
    return np.concatenate(found)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; with fewer words than width, of the whole sequence; no words: empty."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    acc = np.full(count, np.uint64(width))
    for k in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count]
        acc ^= acc >> np.uint64(32)
    return np.unique(mix(acc))
