"""Deterministic pseudo-random numbers: the same row gets the same draw on any
cluster layout, after any task retry, and in any engine that has MD5."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts) -> Column:
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) from the first 32 bits of the MD5 of ``a|b|c``."""
    return F.conv(F.substring(F.md5(_text(parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_order(*parts) -> Column:
    """A shuffle key: sort by it, then by the row id."""
    return F.md5(_text(parts))


#: The distribution function of Poisson(1). The chance of a draw above 12 is
#: below 1e-10, past the 32-bit resolution of the uniform it is made from.
POISSON_STEPS = list(accumulate(accumulate(range(1, 12), lambda term, n: term / n, initial=0.36787944117144233)))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw by inversion of its distribution function."""
    return reduce(lambda a, b: a + b, [(u >= F.lit(step)).cast("int") for step in POISSON_STEPS])


_SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_STARTS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_words(prefixes: list[bytes], texts: list[bytes]) -> np.ndarray:
    """The MD5 of every prefix followed by every text, as four big-endian numbers: ``(prefixes, texts, 4)``.

    All prefixes are equally long, and so are all texts: the hashes are then
    made together, a step of all at a time.
    """
    shape, head, size = (len(prefixes), len(texts)), len(prefixes[0]), len(prefixes[0]) + len(texts[0])
    blocks = (size + 8) // 64 + 1
    left, right = (np.zeros((n, 64 * blocks), np.uint8) for n in shape)
    left[:, :head] = np.frombuffer(b"".join(prefixes), np.uint8).reshape(shape[0], head)
    right[:, head:size] = np.frombuffer(b"".join(texts), np.uint8).reshape(shape[1], size - head)
    right[:, size] = 0x80
    right[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    both = [np.ascontiguousarray(x.view("<u4").T) for x in (left, right)]
    words = [np.bitwise_or.outer(p, t).ravel() if p.any() or t.any() else None for p, t in zip(*both)]  # None: zero
    state = [np.full(shape[0] * shape[1], x, np.uint32) for x in _STARTS]
    f, s = np.empty_like(state[0]), np.empty_like(state[0])
    for block in range(blocks):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            kind = i // 16
            if kind == 0:
                j = i
                np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
            elif kind == 1:
                j = (5 * i + 1) % 16
                np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
            elif kind == 2:
                j = (3 * i + 5) % 16
                np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
            else:
                j = (7 * i) % 16
                np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
            a += f
            a += _SINES[i]
            if words[16 * block + j] is not None:
                a += words[16 * block + j]
            turn = _TURNS[kind][i % 4]
            np.left_shift(a, turn, s), np.right_shift(a, 32 - turn, a)
            a |= s
            a += b
            a, b, c, d = d, a, b, c
        for x, y in zip(state, (a, b, c, d)):
            x += y
    return np.stack(state, axis=1).byteswap().reshape(*shape, 4)


_POISSON_LIMITS = np.ceil(np.array(POISSON_STEPS) * 2.0**32).astype(np.int64)  # a 32-bit number is past a step from here on
_POISSON_TABLE = np.searchsorted(_POISSON_LIMITS, np.arange(65536) << 16, side="right").astype(np.uint8)
_POISSON_MIXED = np.zeros(65536, bool)
_POISSON_MIXED[_POISSON_LIMITS[_POISSON_LIMITS < 2**32] >> 16] = True


def poisson_weights(bits: np.ndarray) -> np.ndarray:
    """``poisson_weight`` of 32-bit numbers divided by 2**32: by their upper half, and exactly where a step lies in it."""
    upper = (bits >> np.uint32(16)).astype(np.intp)
    weights, mixed = _POISSON_TABLE.take(upper), _POISSON_MIXED.take(upper)
    if mixed.any():
        weights[mixed] = np.searchsorted(_POISSON_LIMITS, bits[mixed].astype(np.int64), side="right")
    return weights
