"""Word shingles as 64-bit numbers and their fast similarity sketch, in NumPy, for one block of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * _M1
    x = x ^ (x >> U(33))
    x = x * _M2
    return x ^ (x >> U(33))


class WordHash(dict):
    """Word bytes to 64 bits of BLAKE2b; forgets everything when `limit` words are held, so memory stays bounded."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


def shingle_sets(texts: list[str | None], words: WordHash, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; with fewer words than `width`, the whole sequence as one.

    bytes.split() cuts at exactly the six ASCII white-space characters and bytes.lower() changes A-Z alone.
    """
    found = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = [len(f) for f in found]
    h = np.fromiter((words[w] for f in found for w in f), U, sum(counts))
    n = len(h) - width + 1
    rolled = np.full(max(n, 0), U(width))
    for k in range(width):
        rolled = mix((rolled ^ h[k : k + max(n, 0)]) + np.array([_STEP]) * U(k + 1))
    out, at = [], 0
    for c in counts:
        if c >= width:
            s = np.sort(rolled[at : at + c - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            x = np.full(1, U(c))
            for k in range(c):
                x = mix((x ^ h[at + k : at + k + 1]) + np.array([_STEP]) * U(k + 1))
            out.append(x)
        else:
            out.append(np.empty(0, U))
        at += c
    return out


def fast_sketch(sets: list[np.ndarray], t: int, seed: int = 1) -> np.ndarray:
    """Fast similarity sketches, one row of `t` numbers for each non-empty set.

    Round i throws every element into one hashed bin and keeps the least value i + u of each bin; a later round can
    only fill bins that are still empty. From round t on, round i throws every element into bin i - t, so that after
    2t rounds each coordinate is filled. Two sets agree in a coordinate with the probability of their Jaccard
    similarity, and the number of agreements is concentrated as for independent minima. A large set fills all bins
    in a round or two, which makes the cost O(set size + t log t).
    """
    sizes = np.array([len(s) for s in sets])
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, U)
    elements = np.concatenate(sets) if len(sets) else np.empty(0, U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    empty = np.ones(len(sets) * t, bool)
    for i in range(2 * t):
        if not len(elements):
            break
        h = mix(elements + (np.array([U(seed)]) * _STEP + np.array([U(i + 1)]) * _M2))
        # the low 24 bits choose the bin, the high 40 the value; the round stands above the value
        bins = (h & U(0xFFFFFF)) % U(t) if i < t else np.full(len(h), U(i - t))
        at = owner * t + bins.astype(np.int64)
        value = (U(i) << U(40)) | (h >> U(24))
        open_ = empty[at]
        np.minimum.at(out, at[open_], value[open_])
        empty[at[open_]] = False
        if not (i & (i + 1)) or i >= t:  # look for finished sets after rounds 0, 1, 3, 7, ...
            left = empty.reshape(-1, t).any(axis=1)
            if not left.all():
                keep = left[owner]
                elements, owner = elements[keep], owner[keep]
    return out.reshape(-1, t)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` coordinates."""
    n, t = sketches.shape
    parts = sketches.reshape(n, t // rows, rows)
    out = np.broadcast_to(np.arange(t // rows, dtype=np.uint64) * _STEP, (n, t // rows)).copy()
    for k in range(rows):
        out = mix((out ^ parts[:, :, k]) + _STEP)
    return out
