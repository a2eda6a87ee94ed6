"""md5 of very many texts that are put together from few, in numpy."""

from __future__ import annotations

import math

import numpy as np

_K = [np.array(int(abs(math.sin(i + 1)) * 2**32), np.uint32) for i in range(64)]
_LEFT = [np.array(s, np.uint32) for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_RIGHT = [np.array(32 - s, np.uint32) for s in _LEFT]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16, 32)), *((3 * i + 5) % 16 for i in range(32, 48)), *(7 * i % 16 for i in range(48, 64))]
_ZERO = np.zeros((1, 1), np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _mixed(state: list, words: list, steps: int, shape: tuple) -> list:
    """The state after so many steps of a block.  What prefixes alone decide stays one column."""
    a, b, c, d = state
    wide = None
    for i in range(steps):
        own, other = words[_WORD[i]]  # their sum is the word
        if wide is None and np.broadcast_shapes(*(x.shape for x in (a, b, c, d, own, other))) == shape:
            wide = True
        if wide is True:
            a, b, c, d = (np.array(np.broadcast_to(x, shape)) for x in (a, b, c, d))
            f, t, wide = np.empty(shape, np.uint32), np.empty(shape, np.uint32), False
        if wide is None:
            f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
            f = f + a + (own + other + _K[i])
            a, b, c, d = d, b + ((f << _LEFT[i]) | (f >> _RIGHT[i])), b, c
            continue
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, other + _K[i], out=f)
        if own is not _ZERO:
            np.add(f, own, out=f)
        np.left_shift(f, _LEFT[i], out=t), np.right_shift(f, _RIGHT[i], out=f), np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [a, b, c, d]


def md5_heads(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of each row of ``before`` followed by each of ``after``:
    bytes as uint8 matrices, so that all rows of a side are of one length."""
    shape = len(before), len(after)
    at, n = before.shape[1], before.shape[1] + after.shape[1]
    size = (n + 72) // 64 * 64
    head, tail = np.zeros((shape[0], size), np.uint8), np.zeros((shape[1], size), np.uint8)
    head[:, :at], tail[:, at:n], tail[:, n] = before, after, 0x80
    tail[:, -8:] = np.frombuffer((8 * n).to_bytes(8, "little"), np.uint8)
    head, tail = head.view("<u4"), tail.view("<u4")
    state = [np.full((1, 1), x, np.uint32) for x in _START]
    for block in range(0, size // 4, 16):
        words = []
        for k in range(block, block + 16):
            own, other = np.ascontiguousarray(head[:, k])[:, None], np.ascontiguousarray(tail[: shape[1] if 4 * k < n else 1, k])[None, :]
            words.append((_ZERO, own) if 4 * k + 4 <= at else (_ZERO, other) if 4 * k >= at else (own, other))
        if block + 16 == size // 4:  # nothing after the first word is asked for
            return np.broadcast_to((_mixed(state, words, 61, shape)[1] + state[0]).byteswap(), shape)
        state = [x + y for x, y in zip(state, _mixed(state, words, 64, shape), strict=True)]
