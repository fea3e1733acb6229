"""Vectorised text primitives that the corpus operators share: word hashes, character n-gram slots, batching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_CHUNK = 1 << 20  # code points handled at once; longer texts are cut at a word edge, so memory doesn't follow their length
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _is_word() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalnum() for c in range(0x110000)), np.bool_)


@lru_cache(1)
def _powers() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash_chunk(joined: str, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hash and the first code point's place of every word, and the hashes of its first so many letters (0 where it has no more)."""
    cp = codes(joined)
    inside = _is_word()[cp]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first = np.flatnonzero(edge == 1)
    if not len(first):
        return np.empty(0, np.uint64), first, np.empty((len(stems), 0), np.uint64)
    n = np.flatnonzero(edge == -1) - first
    begin = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(begin, n)
    c = (cp[inside].astype(np.uint64) + np.uint64(1)) * _M1
    c ^= c >> np.uint64(29)
    c *= _powers()[place & 255]
    cut = np.zeros((len(stems), len(n)), np.uint64)
    if stems:
        upto = np.append(np.uint64(0), np.cumsum(c))
        for k, m in enumerate(stems):
            longer = np.flatnonzero(n > m)
            cut[k, longer] = mix64(upto[begin[longer] + m] - upto[begin[longer]] + np.uint64(m << 32)) | np.uint64(1)
    return mix64(np.add.reduceat(c, begin) + n.astype(np.uint64)), first, cut


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of at most _CHUNK code points, cut beside white space where there is any."""
    at = 0
    while len(text) - at > _CHUNK:
        cut = max(text.rfind(" ", at + 1, at + _CHUNK), text.rfind("\n", at + 1, at + _CHUNK))
        cut = cut if cut > 0 else at + _CHUNK
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits, lower-cased); those of text i are at off[i]:off[i + 1]."""
    h, off, _ = stem_hashes(texts, ())
    return h, off


def stem_hashes(texts: list[str | None], stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes() and, a row for each number in stems, the hashes of the words' first so many letters; 0 for words of no more."""
    out: list[np.ndarray] = []
    cuts: list[np.ndarray] = [np.empty((len(stems), 0), np.uint64)]
    counts = np.zeros(len(texts), np.int64)
    held: list[str] = []
    size, since = 0, 0

    def flush(to: int) -> None:
        nonlocal held, size
        if held:
            h, first, cut = _hash_chunk("\n".join(held), stems)
            starts = np.cumsum([0] + [len(t) + 1 for t in held])
            counts[since:to] = np.diff(np.searchsorted(first, starts))
            out.append(h)
            cuts.append(cut)
            held, size = [], 0

    for i, t in enumerate(texts):
        t = (t or "").lower()
        if len(t) > _CHUNK:
            flush(i)
            for piece in _pieces(t):
                h, _, cut = _hash_chunk(piece, stems)
                out.append(h)
                cuts.append(cut)
                counts[i] += len(h)
            since = i + 1
            continue
        if size + len(t) > _CHUNK:
            flush(i)
            since = i
        held.append(t)
        size += len(t) + 1
    flush(len(texts))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)]), np.concatenate(cuts, 1)


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums (along axis 0) of values[off[i]:off[i + 1]]; zero where that is empty."""
    n = len(off) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[full], axis=0, dtype=np.float64)
    return out


def char_slots(text: str, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """The hashed slots of all character n-grams of a text (lower-cased, one blank on either side), an array for each order and piece."""
    lower = f" {text.lower()} "
    most = max(orders)
    for at in range(0, len(lower), _CHUNK):
        c = (codes(lower[at : at + _CHUNK + most - 1]).astype(np.uint64) + np.uint64(1)) * _M1
        c ^= c >> np.uint64(32)
        here = min(_CHUNK, len(lower) - at)
        for n in orders:
            k = min(here, len(c) - n + 1)
            if k <= 0:
                continue
            h = np.full(k, n, np.uint64)
            for j in range(n):
                h = (h + c[j : j + k]) * _M2
                h ^= h >> np.uint64(29)
            yield (h >> np.uint64(64 - bits)).astype(np.int64)
