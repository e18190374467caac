"""MD5 of many short byte strings at a time, in numpy, for Arrow batches."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_STEP = np.array([int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)], np.uint32)
_TURN = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that fit one MD5 block beside its padding, and strings that are worked on at a time (their arrays fit a core's cache).
ONE_BLOCK, AT_ONCE = 55, 8192
# for 0 to 8 bytes of a string in an eight-byte word: the bits that are its own, and the padding that follows
_OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")
_PAD = np.array([0x80 << 8 * n for n in range(8)] + [0, 0], "<u8")


def md5_head(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes, as a big-endian number, of the MD5 of each `raw[start : start + size]`."""
    out = np.empty(len(starts), np.uint64)
    # an eight-byte word at every offset of the padded text
    padded = np.frombuffer(raw + bytes(64), np.uint8)
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    for at in range(0, len(starts), AT_ONCE):
        out[at : at + AT_ONCE] = _one_block(words, starts[at : at + AT_ONCE], np.minimum(sizes[at : at + AT_ONCE], ONE_BLOCK))
    for k in np.flatnonzero(sizes > ONE_BLOCK).tolist():
        own = raw[starts[k] : starts[k] + sizes[k]]
        out[k] = int.from_bytes(hashlib.md5(own, usedforsecurity=False).digest()[:8], "big")
    return out


def _one_block(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n = len(starts)
    block = np.empty((8, n), "<u8")
    for k in range(7):
        left = sizes - 8 * k
        block[k] = words[starts + 8 * k] & _OWN[np.clip(left, 0, 8)]
        block[k] |= _PAD[np.where(left < 0, 8, np.minimum(left, 8))]
    block[7] = sizes * 8
    m = np.ascontiguousarray(block.view("<u4").reshape(8, n, 2).transpose(0, 2, 1)).reshape(16, n)
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        f += _STEP[i]
        f += m[_WORD[i]]
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=g)
        np.left_shift(f, np.uint32(_TURN[i]), out=f)
        f |= g
        f += b
        # the array of a is free now
        a, b, c, d, f = d, f, b, c, a
    head = (a + np.uint32(_START[0])).astype("<u8") | (b + np.uint32(_START[1])).astype("<u8") << np.uint64(32)
    return head.byteswap()
