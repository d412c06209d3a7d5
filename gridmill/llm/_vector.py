"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from ._common import BLOCK_BYTES

U = np.uint64
#: An odd multiplier, its inverse modulo 2**64, and odd weights for the words of a shingle.
P = 0x9E3779B97F4A7C15 | 1
P_INVERSE = pow(P, -1, 1 << 64)
SPACES = b" \t\n\x0b\x0c\r"


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), which is a bijection."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@lru_cache(maxsize=1)
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    values = mixed(np.arange(1, 257, dtype=U) * U(P))
    values[65:91] = values[97:123]  # A-Z count as a-z
    space = np.zeros(256, dtype=bool)
    space[list(SPACES)] = True
    return values, space


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * BLOCK_BYTES
    up, down = np.full(n, P, dtype=U), np.full(n, P_INVERSE, dtype=U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _chunks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, part) with every cut at white space, of about a block each."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield at, data[at:end]
        at = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word of ``data``; A-Z count as a-z."""
    out = []
    values, is_space = _byte_values()
    for offset, part in _chunks(data):
        a = np.frombuffer(part, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(~is_space[a], prepend=False, append=False))
        first, end = edge[::2], edge[1::2]
        if len(a) <= 2 * BLOCK_BYTES:
            up, down = _powers()
        else:  # one word of more than a block
            up, down = (np.cumprod(np.concatenate(([U(1)], np.full(len(a), x, dtype=U)))) for x in (P, P_INVERSE))
        total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(values[a] * up[: len(a)])))
        h = (total[end] - total[first]) * down[first]
        out.append((mixed(h + (end - first).astype(U) * U(P)), first + offset, end + offset))
    if not out:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))


def blocks(texts: Iterable[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(texts joined by line feeds, first byte of each), about a block at a time."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BLOCK_BYTES:
            yield _joined(held)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield _joined(held)


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    sizes = np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts))
    return b"\n".join(texts), np.concatenate(([0], np.cumsum(sizes)[:-1]))


def words_by_text(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for data, starts in blocks(texts):
        h, first, _ = word_hashes(data)
        yield from np.split(h, np.searchsorted(first, starts[1:]))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of ``size`` words as ascending 63-bit hashes; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.int64)
    width = min(n, size)
    h = np.zeros(n - width + 1, dtype=U)
    for k in range(width):
        h = h * U(P) + words[k : n - width + 1 + k]
    return np.unique((mixed(h + U(width)) >> U(1)).astype(np.int64))
