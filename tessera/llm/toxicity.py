"""Toxicity by a linear classifier on character n-grams.

Features are the n-grams of 4, 5, 6 and 8 characters of the lower-cased text,
hashed; a text has a feature or not.  Each is scaled by its naive Bayes log-count
ratio between toxic and clean documents, and a logistic regression weighs the
scaled ones.

Learnt from a bounded sample: about ``sample_rows`` labelled rows, dealt by a
hash of the doc_id.  Of the hashed features the ``most_features`` that tell
the classes apart best (by the G-test, then by number) stay; a text is scored
whole.  For the fit the driver holds the chosen features of the sample, of which a
row can have no more than ``most_features``: 4 bytes each.

Edge cases: null counts as an empty text, which has the score of the bias; a very
long text is scored whole, in a slice of its own; repeated rows give a row each; a
doc_id with several labels is toxic if one says so; without labels, or with one
class only, the score follows the share of toxic rows; a score of exactly 0.5 is
predicted toxic; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .storage import persist
from .textbatch import TextSlice, slices

SIZES = (4, 5, 6, 8)
BITS = 20
_U = np.uint64
#: A multiplier for each place of an n-gram and a salt for each size.
_PLACE = [_U(k * 0x9E3779B97F4A7C15 % (1 << 64) | 1) for k in range(1, max(SIZES) + 1)]
_SALT = {n: _U(n * 0xD6E8FEB86659FD93 % (1 << 64)) for n in SIZES}


def characters(s: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the lower-cased texts, and where each text starts."""
    low = TextSlice(pc.utf8_lower(s.texts))
    points = np.frombuffer(low.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(low.texts).to_numpy(zero_copy_only=False)
    return points, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def feature_places(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places within the slice and the hashed features there."""
    wide, total = points.astype(_U), np.zeros(len(points), _U)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(points))  # characters from here to the end of the text
    for n in range(1, max(SIZES) + 1):
        count = max(0, len(points) - n + 1)
        total = total[:count] + wide[n - 1 :] * _PLACE[n - 1]
        if n in SIZES:
            at = np.flatnonzero(left[:count] >= n)
            yield at, ((total[at] + _SALT[n]) * _U(0xBF58476D1CE4E5B9) >> _U(64 - BITS)).astype(np.int64)


def features(s: TextSlice, chosen: np.ndarray | None = None) -> np.ndarray:
    """Distinct (text << BITS | feature) of the slice, in order; with
    ``chosen`` only of the features that it flags."""
    out = []
    points, offsets = characters(s)
    for at, index in feature_places(points, offsets):
        if chosen is not None:
            good = np.flatnonzero(chosen[index])
            at, index = at[good], index[good]
        owner = np.searchsorted(offsets, at, side="right") - 1
        out.append(owner << BITS | index)
    return np.unique(np.concatenate(out))


@dataclass
class Model:
    """weight: of each hashed feature, 0 for those left out."""

    bias: float
    weight: np.ndarray

    def score(self, s: TextSlice) -> np.ndarray:
        found = features(s, self.weight != 0)
        logit = self.bias + np.bincount(found >> BITS, self.weight[found & ((1 << BITS) - 1)], minlength=s.n)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _gatherer(places: np.ndarray, lengths: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What sums the values at ``places`` over runs of these lengths, which may be 0."""
    full = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[full]
    held = np.empty(len(places))  # fresh memory in every step would take longer than the sums

    def add(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lengths))
        if len(full):
            out[full] = np.add.reduceat(np.take(values, places, mode="clip", out=held), starts)
        return out

    return add


def _logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Weights by accelerated gradient descent on the mean log-loss."""
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.intp)
    owner = np.repeat(np.arange(len(rows)), lengths)[np.argsort(flat, kind="stable")]  # by feature
    by_row, by_feature = _gatherer(flat, lengths), _gatherer(owner, np.bincount(flat, minlength=len(scale)))
    w, b, seen_w, seen_b = np.zeros(len(scale)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(len(scale)), 0.0
    seen_b = b
    norm = max(1.0, float(by_row(scale * scale).max(initial=0.0))) + 1
    rate = 4 / norm
    for k in range(steps):
        z = seen_b + by_row(scale * seen_w)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        gradient = scale * by_feature(error) + penalty * seen_w
        new_w, new_b = seen_w - rate * gradient, seen_b - rate * error.sum()
        pull = k / (k + 3)
        seen_w, seen_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    return b, w


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000, most_features: int = 8192, penalty: float = 1e-5, steps: int = 1000) -> Model:
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    share = max(1, known.count() // sample_rows)
    sample = known.where(F.pmod(F.xxhash64(id_col), F.lit(share)) == 0).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    # About sample_rows rows of two numbers: small by that parameter, whatever the table.
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), id_col).select("text", "y")
    # Written, for two steps read it and all documents are looked through to find it.
    rows = persist(rows, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BITS
        totals = np.zeros((2, size), np.int32)
        docs_seen = np.zeros(2, np.int64)
        for batch in batches:
            for part, s in slices(batch):
                y = part.column(1).to_numpy(zero_copy_only=False)
                docs_seen += np.bincount(y, minlength=2)
                found = features(s)
                for c in (0, 1):
                    mine = found[y[found >> BITS] == c] & (size - 1)
                    totals[c] += np.bincount(mine, minlength=size).astype(np.int32)
        index = np.flatnonzero(totals.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1)), *[pa.array(np.append(totals[c][index], docs_seen[c]).astype(np.int64)) for c in (0, 1)]], ["feature", "clean", "toxic"])

    counts = persist(rows.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "feature-counts")
    seen = counts.where("feature = -1").collect()
    clean, toxic = (seen[0].clean, seen[0].toxic) if seen else (0, 0)
    weight = np.zeros(1 << BITS)
    if not clean or not toxic:
        return Model(float(np.log((toxic + 0.5) / (clean + 0.5))) if seen else 0.0, weight)
    p, n = F.col("toxic"), F.col("clean")
    expected = (p + n) * (toxic / (clean + toxic))
    g = p * F.log((p + 1e-9) / expected) + n * F.log((n + 1e-9) / (p + n - expected))
    top = counts.where("feature >= 0 and clean + toxic >= 3").withColumn("g", g).orderBy(F.desc("g"), "feature").limit(most_features).toPandas()
    ratio = np.log((top.toxic + 1) / (toxic + 2)) - np.log((top.clean + 1) / (clean + 2))
    chosen = np.zeros(1 << BITS, bool)
    place = np.zeros(1 << BITS, np.int64)
    chosen[top.feature], place[top.feature] = True, np.arange(len(top))
    flags = spark.sparkContext.broadcast(chosen)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                found = features(s, flags.value)
                cuts = np.searchsorted(found >> BITS, np.arange(s.n + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((found & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(1), lists], ["y", "found"])

    held = rows.mapInArrow(pick, "y int, found array<int>").toArrow()
    lists = held.column("found").combine_chunks()
    offsets, values = np.asarray(lists.offsets), place[np.asarray(lists.values)]
    parts = [values[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    bias, w = _logistic(parts, held.column("y").to_numpy().astype(float), ratio.to_numpy(), penalty, steps)
    weight[top.feature] = w * ratio.to_numpy()
    return Model(bias, weight)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to keep, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, by BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                found = shared.value.score(s)
                rest = [i for i, name in enumerate(part.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*[part.schema.names[i] for i in rest], "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")
