"""Byte-level BPE: corpus-level merge replay.

The pieces of a batch of texts that no earlier batch of the worker has held are gathered, each once, and laid out
as one row of byte tokens. An inverted index leads from a merge's rank to the places of its token pairs; the merges
are replayed in rank order over all pieces together, and a merge touches its two neighbours only, whose new pairs
join the index. The ids are those of a longest-first lookup followed by lowest-rank-first merging, place by place
from the left, hence equal to any byte-level BPE encoder with the same ranks and pattern.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers between batches; beyond it, it forgets them all. Bounds memory only: results don't depend on it.
REMEMBERED = 500_000
#: New pieces replayed together at most.
TOGETHER = 50_000
#: Code points beyond which a text isn't split all at once.
LONG = 1 << 20


class MergeReplay:
    """Encodes and decodes by a table of ranks. A token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self.base = [ranks[bytes([b])] for b in range(256)]
        self.bits = max(ranks.values()).bit_length()
        self.pair: dict[int, int] = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.pair[a << self.bits | b] = r
        #: The rank of a pair of bytes or -1; row and column 256 (that is -1) stand for a piece's end.
        self.first = np.full((257, 257), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.pair.get(self.base[a] << self.bits | self.base[b], -1)
        self.known: dict[str, bytes] = {}

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of the pieces."""
        pair, bits = self.pair.get, self.bits
        tok: list[int] = []
        for p in pieces:
            tok += p
            tok.append(-1)
        size = len(tok)
        nxt, prv = list(range(1, size + 1)), list(range(-1, size - 1))
        index: dict[int, list[int]] = {}
        t = np.array(tok, np.int64)
        tok = np.append(self.base, -1)[t].tolist()
        rank = self.first[t[:-1], t[1:]]  # a piece's last byte has the row and column of no pair
        here = np.flatnonzero(rank >= 0)
        by_rank = here[np.argsort(rank[here], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[by_rank], prepend=-1)) if len(by_rank) else by_rank
        for part in np.split(by_rank, cuts[1:]) if len(by_rank) else ():
            index[int(rank[part[0]])] = part.tolist()
        ranks = sorted(index)  # a sorted list is a heap
        below: list[tuple[int, int]] = []
        while ranks:
            r = heappop(ranks)
            places = index.pop(r)
            if len(places) > 1:
                places.sort()
            for i in places:
                rank = r
                while True:
                    a, j = tok[i], nxt[i]
                    b = tok[j]
                    if a >= 0 and b >= 0 and pair(a << bits | b) == rank:
                        k = nxt[i] = nxt[j]
                        tok[i], tok[j], prv[k] = rank, -2, i
                        for at, q in ((i, pair(rank << bits | tok[k]) if tok[k] >= 0 else None), (prv[i], pair(tok[prv[i]] << bits | rank) if i and tok[prv[i]] >= 0 else None)):
                            if q is None:
                                continue
                            if q < r:  # due at once, before r's other places in this piece
                                heappush(below, (q, at))
                            elif q in index:
                                index[q].append(at)
                            else:
                                index[q] = [at]
                                heappush(ranks, q)
                    if not below:
                        break
                    rank, i = heappop(below)
        out, i = [], 0
        for p in pieces:
            end, ids = i + len(p), []
            k = i
            while k < end:
                ids.append(tok[k])
                k = nxt[k]
            out.append(ids)
            i = end + 1
        return out

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            for s, ids in zip(part, self.replay([s.encode("utf-8", "surrogatepass") for s in part]), strict=True):
                self.known[s] = np.array(ids, "<u4").tobytes()

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        distinct: set[str] = set()
        for pieces in split:
            distinct.update(pieces)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, new = self.known, []
        for s in distinct:
            if s not in known:
                r = self.ranks.get(s.encode("utf-8", "surrogatepass"))
                if r is None:
                    new.append(s)
                else:
                    known[s] = r.to_bytes(4, "little")
        self._learn(new)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def _encode_long(self, text: str) -> bytes:
        found, out = (m[0] for m in self.pattern.finditer(text)), []
        while pieces := list(islice(found, TOGETHER)):
            out += self._ids([pieces])
        return b"".join(out)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Long texts are taken a part at a time."""
        out = self._ids([self.pattern.findall(t) if t and len(t) <= LONG else [] for t in texts])
        return [self._encode_long(t) if t and len(t) > LONG else x for t, x in zip(texts, out, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def load(path: str, pattern: str) -> MergeReplay:
    """From a file of lines `base64 rank`, once in each worker."""
    with open(path, "rb") as f:
        return MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of each whole text (binary: little-endian unsigned 32-bit) and the bytes that they decode to.

    The vocabulary file is a public one that every machine has at the same path. A null text counts as empty; an empty
    one has no ids. Texts of any length are encoded whole. Repeated rows and null ids are rows like any others, and all
    columns stay; columns that already bear an output name are replaced. An empty table gives an empty table.
    """
    kept = docs.drop(ids, decoded)
    names = kept.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                out = coder.encode_batch(part.column(at).to_pylist())
                more = [pa.array(out, pa.binary()), pa.array([coder.decode(x) for x in out], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, ids, decoded])

    return kept.mapInArrow(run, f"{schema}, `{ids}` binary, `{decoded}` binary")


def digests(encoded: DataFrame, key: str = "doc_id", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """The id counts and SHA-256 digests of what encode_decode() gave."""
    return encoded.select(key, (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
