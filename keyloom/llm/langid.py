"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-gram slots of every labelled text in the executors (dense count arrays of a few languages at a
time, emitted sparsely), sums them in Spark, and gives the driver a sparse matrix of slots x languages: an entry for each
slot that a language has, so its size follows the languages' number and not the corpus. The log-probabilities are broadcast: one for the
slots that a language lacks, and by how much each entry exceeds it. Texts are scored in batches: a sparse matrix of texts
x slots times that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name
from ._text import char_slots

_LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
#: Languages that a task counts at once, and cells that a worker scores at once. Bound memory only.
HELD, TOGETHER = 64, 4_000_000


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    prior: np.ndarray  # log-probabilities of the languages
    unseen: np.ndarray  # log-probability of a slot that a language lacks
    begin: np.ndarray  # where the entries of each slot begin, and their end
    lang: np.ndarray  # of each entry
    more: np.ndarray  # by how much an entry's log-probability exceeds the unseen one
    orders: tuple[int, ...]
    bits: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior probability."""
        return self.predict_batch([text])[0]

    def predict_batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of each text. Memory follows TOGETHER, the longest text's different slots and the number of languages."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        at: list[int] = []
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for i, t in enumerate(texts):
            if t is None or not self.langs or not _LETTER.search(t):
                continue
            n = np.zeros(1 << self.bits, np.int64)
            for slots in char_slots(t, self.orders, self.bits):
                n += np.bincount(slots, minlength=len(n))
            slot = np.flatnonzero(n)
            at.append(i)
            rows.append((slot, n[slot]))
            if len(rows) * len(self.langs) > TOGETHER or sum(len(s) for s, _ in rows) * len(self.langs) > TOGETHER:
                self._settle(at, rows, out)
        self._settle(at, rows, out)
        return out

    def _settle(self, at: list[int], rows: list, out: list) -> None:
        if not rows:
            return
        size, k = np.array([len(s) for s, _ in rows]), len(self.langs)
        slot, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        text = np.repeat(np.arange(len(rows)), size)
        first, many = self.begin[slot], self.begin[slot + 1] - self.begin[slot]
        entry = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell = np.repeat(text, many) * k + self.lang[entry]
        total = np.bincount(cell, np.repeat(n, many) * self.more[entry], len(rows) * k).reshape(-1, k)
        total += self.prior + np.bincount(text, n, len(rows))[:, None] * self.unseen
        best = total.argmax(axis=1)
        sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, s in zip(at, best.tolist(), sure.tolist(), strict=True):
            out[i] = self.langs[b], s
        at.clear()
        rows.clear()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, alpha: float = 0.1) -> LanguageModel:
    """Learns from all rows whose text and language are not null; the rows may be empty, then nothing is ever predicted.

    The model takes 12 bytes for each different slot of each language, 12 * 2**bits a language at most.
    """
    slots = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for name, c in seen.items():
                at = np.flatnonzero(c)
                values = [np.append(at, -1), np.append(c[at], rows[name])]  # slot -1: the number of texts
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values[0]), pa.string()), pa.array(values[0], pa.int32()), pa.array(values[1], pa.int64())], ["lang", "slot", "n"])
            seen.clear()
            rows.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                t, name = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if name not in seen and len(seen) >= HELD:
                    yield from emit()
                into = seen.get(name)
                if into is None:
                    into = seen[name] = np.zeros(slots, np.int64)
                rows[name] = rows.get(name, 0) + 1
                for s in char_slots(t, orders, bits):
                    into += np.bincount(s, minlength=slots)
        yield from emit()

    labelled = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    summed = labelled.mapInArrow(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    names, slot, n = found.column("lang").combine_chunks(), found.column("slot").to_numpy(), found.column("n").to_numpy()
    langs = tuple(sorted(names.unique().to_pylist()))
    at = pc.index_in(names, pa.array(langs, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = np.bincount(at[slot < 0], n[slot < 0], len(langs))
    order = np.lexsort((at, slot))[np.count_nonzero(slot < 0) :]
    slot, at, n = slot[order], at[order], n[order]
    total = np.bincount(at, n, len(langs)) + alpha * slots
    prior = np.log(texts / texts.sum()) if len(langs) else np.zeros(0)
    return LanguageModel(langs, prior, np.log(alpha / total), np.searchsorted(slot, np.arange(slots + 1)), at.astype(np.int32), np.log((n + alpha) / alpha), orders, bits)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score for every whole text.

    A text that is null or has no letter is `und` with score 0, as is every text if no language was learned. Equally
    likely languages: the first in alphabetical order. Repeated rows and null ids are predicted like any others.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    source = docs.select(*keep, F.col(text).alias(free_name(kept.columns, "text")))
    names = source.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = own.predict_batch(part.column(len(names)).to_pylist())
                more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], [*names, "lang_pred", "score"])

    return source.mapInArrow(run, f"{schema + ', ' if schema else ''}lang_pred string, score double")
