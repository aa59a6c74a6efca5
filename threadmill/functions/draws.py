"""The draws of a resample in numpy: many keyed MD5 values at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

# The constants of MD5 (RFC 1321).
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def spans(first: int, last: int, step: int) -> Iterator[np.ndarray]:
    """The numbers from ``first`` to ``last`` in arrays of at most ``step`` that have as many digits."""
    while first <= last:
        end = min(last, first + step - 1, 10 ** len(str(first)) - 1)
        yield np.arange(first, end + 1)
        first = end + 1


def _digits(numbers: np.ndarray) -> list[np.ndarray]:
    n = len(str(numbers[0]))
    return [(numbers // 10 ** (n - 1 - k) % 10 + ord("0")).astype(np.uint32) for k in range(n)]


def md5_draws(seed: int, runs: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The first 13 hex digits of ``md5('<seed>|<run>|<position>')`` as a number, by run and position.

    Either array is one of :func:`spans`, so that all texts have the same length and layout.
    """
    u = np.uint32
    text = [u(b) for b in f"{seed}|".encode()]
    text += [*[d[:, None] for d in _digits(runs)], u(ord("|")), *[d[None] for d in _digits(positions)]]
    if len(text) > 55:
        raise ValueError("a text of more than one MD5 block")
    words = [u(0)] * 16
    for k, byte in enumerate([*text, u(128)]):
        words[k // 4] = words[k // 4] | (byte << u(8 * (k % 4)))
    words[14] = u(8 * len(text))

    shape = (len(runs), len(positions))
    a, b, c, d = (np.full(shape, s, u) for s in _START)
    f, other = np.empty(shape, u), np.empty(shape, u)
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                at = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                at = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                at = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                at = 7 * i % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            f += a
            f += words[at] + u(_SINES[i])
            turn = _TURNS[i // 16][i % 4]
            np.left_shift(f, u(turn), out=other)
            np.right_shift(f, u(32 - turn), out=f)
            np.bitwise_or(f, other, out=f)
            f += b
            a, b, c, d, f = d, f, b, c, a
        a += u(_START[0])
        b += u(_START[1])
    # Words are written from their lowest byte.
    return (a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap() >> u(12))
