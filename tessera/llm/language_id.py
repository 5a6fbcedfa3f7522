"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row of bits for each slot and one column for
each language.  An n-gram of bytes picks a few slots, and the AND of their rows
is the set of all languages that contain it.  For a text the set bits are
counted for each language; what false positives add on average is taken off
(a language whose column is filled to f answers f**k of foreign n-grams), and
the language with the highest corrected count wins.

Learnt from a bounded sample: about ``sample_rows`` rows a language, taken by
chance.  An n-gram that the sample has ``least`` times (4) in a language belongs to
the languages in which it is at least ``share`` as frequent as where it is most
frequent; each language keeps its ``most_grams`` (60,000) most frequent ones.  Both
bound the filters, which every task holds, and nothing that is identified.

Edge cases: a text that is null or without a letter is ``und`` with score 0; a
very long text is counted whole, in a slice of its own; repeated rows give a row each; without a row to learn from every text is
``und``; equal counts go to the language first in order; other columns are
ignored; null languages aren't learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .textbatch import TextSlice, grams, mix, slices

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Filters:
    """slots: a row of bits for each slot, in 64-bit words."""

    languages: list[str]
    sizes: tuple[int, ...]
    hashes: int
    slots: np.ndarray

    @staticmethod
    def build(members: dict[str, np.ndarray], sizes: tuple[int, ...], hashes: int = 3) -> Filters:
        languages = sorted(members)
        most = max([1, *map(len, members.values())])
        bits = max(16, int(np.ceil(np.log2(most * 8))))
        slots = np.zeros((1 << bits, (len(languages) + 63) // 64 or 1), _U)
        out = Filters(languages, sizes, hashes, slots)
        for i, name in enumerate(languages):
            for rows in out._rows(members[name].astype(_U)):
                slots[rows, i // 64] |= _U(1) << _U(i % 64)
        return out

    def _rows(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """Slots of each key, by double hashing."""
        bits = _U(len(self.slots).bit_length() - 1)
        h = mix(keys * _U(0x9E3779B97F4A7C15) + _U(1))
        step = (h >> _U(32)) | _U(1)
        for k in range(self.hashes):
            yield ((h + _U(k) * step) & ((_U(1) << bits) - _U(1))).astype(np.intp)

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """A bitmask row for each key."""
        first, *rest = self._rows(keys)
        out = self.slots[first]
        for rows in rest:
            out &= self.slots[rows]
        return out

    @property
    def false_rates(self) -> np.ndarray:
        fill = [float((self.slots[:, i // 64] >> _U(i % 64) & _U(1)).mean()) for i in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def predict(self, s: TextSlice) -> tuple[list[str], np.ndarray]:
        hits, total = np.zeros((len(self.languages), s.n)), np.zeros(s.n)
        data = _LOWER[s.data]
        for n in self.sizes:
            keys, whole = grams(s, data, n)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            edges = np.searchsorted(at, s.offsets)
            masks = self.languages_of(_tagged(keys[at], n))
            total += np.diff(edges)
            for i in range(len(self.languages)):
                found = np.flatnonzero(masks[:, i // 64] & (_U(1) << _U(i % 64)))
                hits[i] += np.diff(np.searchsorted(found, edges))
        rates = self.false_rates[:, None]
        corrected = np.maximum(0, (hits - total * rates) / np.maximum(1e-9, 1 - rates))
        letters = s.per_text(_LETTER[s.data]) > 0
        for i in np.flatnonzero(~letters & (s.per_text(s.data >= 0x80) > 0)):
            letters[i] = any(c.isalpha() for c in s.text(i))
        if not self.languages:
            return ["und"] * s.n, np.zeros(s.n)
        best = corrected.argmax(0)
        top = corrected[best, np.arange(s.n)]
        score = np.where(letters, top / np.maximum(1e-9, corrected.sum(0)), 0.0)
        return [self.languages[b] if x else "und" for b, x in zip(best, letters, strict=True)], np.clip(score, 0, 1)


def _tagged(keys: np.ndarray, n: int) -> np.ndarray:
    return keys.astype(_U) | _U(n) << _U(56)


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sizes: tuple[int, ...] = (3, 5), sample_rows: int = 3000, share: float = 0.3, least: int = 4, most_grams: int = 60_000) -> Filters:
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    # The row that stands for each language has its share; few rows, for languages are few.
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.count("*")).alias("share"))
    taken = {r.lang: r.share for r in shares.collect()}
    if not taken:
        return Filters.build({}, sizes)
    part = F.create_map(*[F.lit(x) for pair in taken.items() for x in pair])
    wanted = F.rand(seed=7) < F.element_at(part, F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                langs = part.column(1).to_pylist()
                owner = np.repeat(np.unique(langs, return_inverse=True)[1], s.sizes)
                names, data = sorted(set(langs)), _LOWER[s.data]
                for n in sizes:
                    keys, whole = grams(s, data, n)
                    for i, name in enumerate(names):
                        found, times = np.unique(_tagged(keys[whole & (owner[: len(keys)] == i)], n), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["lang", "gram", "n"])

    counts = rows.where(wanted).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = Window.partitionBy("lang")
    rate = counts.withColumn("rate", F.col("n") / F.sum("n").over(totals)).where(F.col("n") >= least)
    member = rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= share * F.col("top"))
    chosen = member.withColumn("k", F.row_number().over(totals.orderBy(F.desc("n"), "gram"))).where(F.col("k") <= most_grams)
    members: dict[str, list[int]] = {}
    for lang, gram in chosen.select("lang", "gram").toArrow().to_pandas().itertuples(index=False):
        members.setdefault(lang, []).append(gram)
    return Filters.build({k: np.array(v, np.int64) for k, v in members.items()}, sizes)


def identify(docs: DataFrame, filters: Filters, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to keep, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # at most a few MB: slots follow most_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                langs, score = shared.value.predict(s)
                rest = [i for i, name in enumerate(part.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], pa.array(langs, pa.string()), pa.array(score)], [*[part.schema.names[i] for i in rest], "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")
