"""Vectorised text primitives shared by the operators that run Python inside tasks.

A text is handled as an array of code points.  Words are the maximal runs
outside ``[\\x20\\x09-\\x0D]``; a word's 64-bit hash is a polynomial over its code
points (``sum (c_j + 1) * B^j mod 2^64``) followed by a bit mix, so all words of a
text are hashed by one ``reduceat`` without creating a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 18   # code points hashed at once; bounds the memory of very long texts

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    p = _powers.get(key)
    if p is None or len(p) < n:
        size = max(CHUNK, 1 << int(n).bit_length())
        f = np.full(size, base, dtype=np.uint64)
        f[0] = 1
        p = _powers[key] = np.cumprod(f)
    return p


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)


def space_mask(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13))


def run_hashes(cp: np.ndarray, starts: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Hash of every run ``cp[starts[i]:starts[i+1]]``; positions with ``keep`` false count as absent."""
    n = len(cp)
    v = cp.astype(np.uint64)
    v += np.uint64(1)
    if keep is not None:
        v *= keep
    v *= _power(_BASE, n, "p")[:n]
    return mix(np.add.reduceat(v, starts) * _power(_INV, n, "i")[starts])


def _word_chunks(cp: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of at most ``limit`` code points cut at white space (a longer word stays whole)."""
    at, n = 0, len(cp)
    while at < n:
        end = min(n, at + limit)
        if end < n:
            sp = np.flatnonzero(space_mask(cp[at:end]))
            if len(sp):
                end = at + int(sp[-1]) + 1
            else:
                while end < n:
                    more = np.flatnonzero(space_mask(cp[end:end + limit]))
                    if len(more):
                        end += int(more[0]) + 1
                        break
                    end = min(n, end + limit)
        yield at, cp[at:end]
        at = end


def word_hashes(cp: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    out = []
    for _, part in _word_chunks(cp, CHUNK):
        word = ~space_mask(part)
        if not word.any():
            continue
        first = word.copy()
        first[1:] &= ~word[:-1]
        out.append(run_hashes(part, np.flatnonzero(first), word))
    if not out:
        return np.zeros(0, dtype=np.uint64)
    return out[0] if len(out) == 1 else np.concatenate(out)
