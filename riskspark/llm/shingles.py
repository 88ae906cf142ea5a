"""Sets of hashed word shingles, vectorised over a batch of texts."""

from __future__ import annotations

from functools import cache

import numpy as np

PRIME = 0x100000001B3  # odd, so it has an inverse modulo 2 ** 64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scrambled(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    if n > 1 << 20:
        return _powers.__wrapped__(base, int(n).bit_length())[:n]
    return _powers(base, 20)[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (A-Z lower-cased; separated by ASCII white space), and its text's number."""
    raw = [t.encode("utf-8", "surrogatepass").lower() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.r_[True, IS_SPACE[data]]))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(pow(PRIME, -1, 1 << 64), len(data))[starts]
    owner = np.searchsorted(np.cumsum([len(r) for r in raw]), starts, side="right")
    return scrambled(hashes ^ (ends - starts).astype(np.uint64) << np.uint64(48)), owner


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text.

    A text with fewer words than ``size`` has its whole sequence as one shingle; without words, none."""
    words, owner = word_hashes(texts)
    rolled = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        rolled = scrambled(rolled * np.uint64(PRIME) ^ words[k : len(words) - size + 1 + k])
    out = []
    stops = np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
    for first, stop in zip([0, *stops], stops):
        if stop - first >= size:
            own = np.sort(rolled[first : stop - size + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif stop > first:
            whole = np.array([stop - first], np.uint64)
            for w in words[first:stop]:
                whole = scrambled(whole * np.uint64(PRIME) ^ w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
