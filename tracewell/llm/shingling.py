"""Sets of five-word shingles as sorted 64-bit hashes, a batch of texts at a time.

Words are runs of characters other than ASCII white space, A-Z lower-cased.  A word's hash is a polynomial over random
values of its bytes, taken from running sums over the whole batch and mixed; a shingle's hash combines five of them.
A text of fewer words is one shingle of all its words; one without words has none.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text hashed at a time; longer texts are cut between words, and the hash of a longer word is carried on.
PIECE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NEXT_SPACE = re.compile(rb"[\x20\x09-\x0D]").search
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The public 64-bit finalizer of MurmurHash3."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes (A-Z as a-z), powers of the base and of its inverse modulo 2**64, and a factor for each place in a shingle."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    values[65:91] = values[97:123]
    n = PIECE + 1
    power, inverse = (np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return values, power, inverse, mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another, and the index of each text's first word (and the end)."""
    values, power, inverse, _ = _tables()
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    fresh = before.copy()
    fresh[inner] = False
    starts = np.flatnonzero(solid & ~fresh)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, cuts)


def _of_words(words: np.ndarray) -> np.ndarray:
    factors = _tables()[3]
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        total = np.zeros(n, np.uint64)
        for k in range(WORDS):
            total += words[k : k + n] * factors[k]
        return np.unique(mix(total))
    if not len(words):
        return words
    total = np.uint64(len(words))
    for w in words:
        total = mix(np.array([total * np.uint64(31) + w], np.uint64))[0]
    return np.array([total], np.uint64)


def _one_word(data: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, carried on from piece to piece."""
    values, power, _, _ = _tables()
    total = len(data)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        total += int((values[piece] * power[: len(piece)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return mix(np.array([total % (1 << 64)], np.uint64))


def _long(raw: bytes) -> np.ndarray:
    """Word hashes of one text longer than a piece."""
    data = np.frombuffer(raw, np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            if not len(spaces):
                space = _NEXT_SPACE(raw, end)
                end = space.start() if space else len(raw)
                out.append(_one_word(data[at:end]))
                at = end
                continue
            end = at + int(spaces[-1]) + 1
        out.append(_word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The shingle set of each text, sorted; texts: strings without null."""
    raw = texts.cast(pa.large_binary()).to_pylist()
    out: list[np.ndarray] = []
    at = 0
    with np.errstate(over="ignore"):
        while at < len(raw):
            if len(raw[at]) > PIECE:
                out.append(_of_words(_long(raw[at])))
                at += 1
                continue
            end, size = at, 0
            while end < len(raw) and size + len(raw[end]) <= PIECE:
                size += len(raw[end])
                end += 1
            cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw[at:end]], dtype=np.int64)])
            words, first = _word_hashes(np.frombuffer(b"".join(raw[at:end]), np.uint8), cuts)
            out += [_of_words(words[first[i] : first[i + 1]]) for i in range(end - at)]
            at = end
    return out


def set_hash(s: np.ndarray) -> int:
    """One signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ np.uint64(0xA0761D6478BD642F)), mix(s * np.uint64(0xE7037ED1A0B428DB) + np.uint64(1))
        return int(mix(np.array([a.sum(dtype=np.uint64) + np.bitwise_xor.reduce(b) * np.uint64(3) if len(s) else 0], np.uint64))[0].astype(np.int64))
