"""Hashed n-gram indicators of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from ._common import BLOCK_BYTES
from ._vector import P, U, _byte_values, blocks, mixed, word_hashes

BITS = 18
#: Bits of a word's shape: letters and other, digits, then one for each mark.
MARKS = b"#*$%&|<>{}[]()=/\\_~^@"


@lru_cache(maxsize=1)
def _shape_bits() -> np.ndarray:
    bits = np.ones(256, dtype=np.uint32)
    bits[48:58] = 2
    for k, c in enumerate(MARKS):
        bits[c] = 4 << k
    return bits


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(h + U(kind * 0x632BE59BD9B4E019 % (1 << 64))) >> U(64 - BITS)).astype(np.int32)


def word_indicators(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Distinct slots of each text: words, word pairs, shapes, shape pairs and repetition.

    A pair of equal words is one n-gram whatever the word, and so is a five-gram that occurred before in
    the text; the latter comes with the share of words it covers, in steps.
    """
    bits = _shape_bits()
    for data, starts in blocks(texts):
        h, first, end = word_hashes(data)
        a = np.frombuffer(data, dtype=np.uint8)
        if len(h):
            edges = np.stack((first, end), 1).ravel()
            if edges[-1] == len(a):
                edges = edges[:-1]
            shape = np.bitwise_or.reduceat(bits[a], edges)[::2].astype(U)
        else:
            shape = h
        cut = np.searchsorted(first, starts[1:])
        for w, s in zip(np.split(h, cut), np.split(shape, cut)):
            if not len(w):
                yield np.empty(0, dtype=np.int32)
                continue
            same = w[1:] == w[:-1]
            pair = np.where(same, U(7), w[:-1] * U(P) + w[1:])
            found = [_slots(w, 1), _slots(pair, 2), _slots(np.unique(s), 3), _slots(np.unique(s[:-1] * U(P) + s[1:]), 4)]
            marks = [int(10 * np.mean(same))] if len(same) else [0]
            if len(w) >= 5:
                five = w[:-4]
                for k in range(1, 5):
                    five = five * U(P) + w[k : len(w) - 4 + k]
                marks.append(100 + int(20 * (1 - len(np.unique(five)) / len(five))))
            found.append(_slots(np.array(marks, dtype=U), 5))
            yield np.unique(np.concatenate(found))


def char_indicators(texts: Iterable[bytes], sizes: tuple[int, ...] = (3, 4, 5)) -> Iterator[np.ndarray]:
    """Distinct slots of each text's n-grams of UTF-8 bytes; A-Z count as a-z."""
    values, is_space = _byte_values()
    blank = values[32]
    for text in texts:
        seen = np.zeros(1 << BITS, dtype=bool)
        for at in range(0, max(len(text), 1), BLOCK_BYTES):
            a = np.frombuffer(text[max(at - max(sizes), 0) : at + BLOCK_BYTES], dtype=np.uint8)
            v = np.concatenate(([blank], np.where(is_space[a], blank, values[a]), [blank]))
            h = v
            for n in range(2, max(sizes) + 1):
                h = h[:-1] * U(P) + v[n - 1 :]
                if n in sizes:
                    seen[_slots(h, n)] = True
                if len(h) < 2:
                    break
        yield np.flatnonzero(seen).astype(np.int32) if len(text) else np.empty(0, dtype=np.int32)


EXTRACTORS = {"word": word_indicators, "char": char_indicators}
