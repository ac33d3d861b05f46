"""The bootstrap's draws in numpy: the first 28 bits of the MD5 of ``seed|replicate|draw``, as ``bootstrap.draw_hash`` has them.

A message is shorter than one MD5 block. Draws that differ in their last four digits only share all other bytes, so the
rounds run over whole arrays of such draws, with two or three words that vary.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np

# Fixed values of MD5: start, shifts, constants and the order of words.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def _first_word(words: list, size: int) -> np.ndarray:
    """The first word of the MD5 of ``size`` one-block messages; words: 16, each a number or an array."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, g = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i, (s, k, w) in enumerate(zip(_SHIFTS, _SINES, _WORDS)):
        if i < 16:
            np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f)
            f ^= d
        elif i < 32:
            np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f)
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_or(b, np.bitwise_not(d, out=f), out=f)
            f ^= c
        a += f
        if isinstance(words[w], np.ndarray):
            a += words[w]
            a += np.uint32(k)
        else:
            a += np.uint32((k + words[w]) & 0xFFFFFFFF)
        np.left_shift(a, np.uint32(s), out=g)
        a >>= np.uint32(32 - s)
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    return a


@functools.cache
def _endings(digits: int, least: int, offset: int) -> list[np.ndarray]:
    """Three words each of the numbers of so many digits from ``least`` on, leading zeros included, from byte ``offset`` on, and MD5's end mark."""
    numbers = np.arange(least, 10**digits)
    out = np.zeros((len(numbers), 12), np.uint8)
    for i in range(digits):
        out[:, offset + i] = ord("0") + numbers // 10 ** (digits - 1 - i) % 10
    out[:, offset + digits] = 0x80
    return [np.ascontiguousarray(w) for w in out.view("<u4").T]


def _bits(head: bytes, digits: int, least: int, count: int) -> np.ndarray:
    """28 bits for head followed by each of ``count`` numbers of so many digits from ``least`` on."""
    size, offset = len(head) + digits, len(head) % 4
    if size > 55:
        raise ValueError("seed, replicate and draw must fit one block of MD5")
    whole = np.frombuffer(head.ljust(56, b"\0"), "<u4").tolist() + [8 * size, 0]
    for i, w in enumerate(_endings(digits, least, offset)):
        at = len(head) // 4 + i
        if at < 14 and w.any():
            whole[at] = w[:count] | np.uint32(whole[at])
    return _first_word(whole, count).byteswap() >> np.uint32(4)


def positions(seed: int, rep: int, n: int, piece: int = 100) -> Iterator[np.ndarray]:
    """The n draws of a replicate, below n each, in arrays of at most ``piece`` times 10,000."""
    head, out = f"{seed}|{rep}|", []
    for digits in (1, 2, 3, 4):
        least = 10 ** (digits - 1) if digits > 1 else 0
        if n > least:
            out.append(_bits(head.encode(), digits, least, min(n, 10**digits) - least))
    for k in range(1, -(-n // 10_000)):
        out.append(_bits(f"{head}{k}".encode(), 4, 0, min(10_000, n - 10_000 * k)))
        if len(out) >= piece:
            yield np.concatenate(out).astype(np.int64) % n
            out = []
    if out:
        yield np.concatenate(out).astype(np.int64) % n
