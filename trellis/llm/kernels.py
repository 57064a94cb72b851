"""Vectorised byte and word kernels shared by the corpus operators.

Everything here works on a bounded buffer inside one task: callers cut their
rows into chunks of about ``CHUNK_BYTES`` first, so the peak memory of a
kernel does not depend on the size of a partition.  All hashes are 64 bits
wide and depend on content only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
CHUNK_BYTES = 1 << 19
#: Random odd multipliers; fixed so that every executor hashes alike.
_A = U(0x9E3779B97F4A7C15)
_B = U(0xC2B2AE3D27D4EB4F)
_C = U(0x165667B19E3779F9)
_D = U(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the whole word (in place)."""
    x ^= x >> U(32)
    x *= _D
    x ^= x >> U(29)
    x *= _B
    x ^= x >> U(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of the concatenation of two parts with known identifiers."""
    out = a * _A
    out += b * _C
    out ^= out >> U(31)
    out *= _D
    out ^= out >> U(33)
    return out


_BYTE_ID = mix(np.arange(1, 257, dtype=U) * _A)


def gram_ids(buf: np.ndarray, length: int) -> np.ndarray:
    """Identifier of the ``length``-byte string at each start of ``buf``.

    Built by doubling: the identifier of a string comes from the identifiers
    at its start and at a later offset, never from its bytes again.
    """
    n = len(buf) - length + 1
    if n <= 0:
        return np.empty(0, U)
    ids, width = _BYTE_ID[buf], 1
    while width * 2 <= length:
        ids = pair(ids[:-width], ids[width:])
        width *= 2
    rest = length - width
    return pair(ids[:n], ids[rest : rest + n]) if rest else ids[:n]


def widen(ids: np.ndarray, length: int, target: int) -> np.ndarray:
    """From the identifiers of ``length``-byte strings to those of ``target`` bytes."""
    while length * 2 <= target:
        ids = pair(ids[:-length], ids[length:]) if len(ids) > length else ids[:0]
        length *= 2
    rest = target - length
    return ids if not rest else pair(ids[:-rest], ids[rest:]) if len(ids) > rest else ids[:0]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` consecutive values."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n]) if width > have else x[:n]


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive rows of at most ``limit`` bytes together; a
    larger row is a range of its own."""
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW: dict[int, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """Powers of the odd base, and those of its inverse, modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POW:
        out = np.empty(size, U)
        out[0] = 1
        have = 1
        base = int(_A)
        while have < size:
            out[have : 2 * have] = out[:have] * U(base)
            base = base * base % (1 << 64)
            have *= 2
        _POW.clear()
        _POW[size] = out
    return _POW[size]


def word_ids(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers, starts and ends of the words of ``buf`` (A-Z lower-cased).

    Words are runs of bytes other than the six white-space bytes 9-13 and 32.
    """
    start, end = spans(~_SPACE[buf])
    if not len(start):
        return np.empty(0, U), start, end
    val = _BYTE_ID[_LOWER[buf]]
    # Horner sums per word: sum(val[i] * base**(i - start)), by reduceat over
    # values weighted with the power of their place in the word.
    place = np.arange(len(buf), dtype=np.int64)
    inside = np.repeat(start, np.diff(np.append(start, len(buf))))
    place[start[0] :] -= inside
    place[: start[0]] = 0
    val *= _powers(int(place.max()) + 1)[place]
    val[_SPACE[buf]] = 0
    ids = np.add.reduceat(val, start)
    ids += (end - start).astype(U) * _C
    return mix(ids), start, end


def shingle_ids(words: np.ndarray, n: int) -> np.ndarray:
    """Identifier of every run of ``n`` words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, U)
    out = words[:m].copy()
    for k in range(1, n):
        out = pair(out, words[k : k + m])
    return out
