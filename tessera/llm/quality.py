"""Quality rules as a short-circuit cascade.

Every rule measures the texts that are still in and rejects some.  On a bounded
sample the time each rule takes and the share it rejects are estimated, and the
rules run in the order of rejections per second.  The verdict is that no rule
rejects, so the order changes the cost and never the result.

Words are the runs ``[^\\x20\\x09-\\x0D]+``.  Edge cases: null counts as an empty
text, which has no words and fails ``few_words``; a very long text is judged whole,
in a slice of its own; rules of equal worth run in the order of ``RULES``; repeated
rows are judged each by itself; an empty table gives no rows; other columns pass
through ``keep``, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbatch import TextSlice, mix, slices

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True


def n_symbols(s: TextSlice) -> np.ndarray:
    return s.per_text(_SYMBOL[s.data])


def n_dup_lines(s: TextSlice) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    out = np.zeros(s.n, np.int64)
    for i in np.flatnonzero(s.per_text(s.data == 10)):
        lines = [x for x in s.raw(i).split(b"\n") if x.strip(b" \t\n\v\f\r")]
        out[i] = len(lines) - len(set(lines))
    return out


def n_repeat_words(s: TextSlice) -> np.ndarray:
    """Words in 3-word windows that the text has twice or more."""
    at = s.window_starts(3)
    if not len(at):
        return np.zeros(s.n, np.int64)
    owner = s.word_text[at].astype(_U)
    keys = s.window_hash(at, 3) ^ mix(owner + _U(1))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(s.starts), bool)
    hit = at[again]
    for k in range(3):
        covered[hit + k] = True
    sums = np.concatenate([[0], np.cumsum(covered)])
    return sums[s.word_offsets[1:]] - sums[s.word_offsets[:-1]]


def _few_words(s: TextSlice) -> np.ndarray:
    return s.n_words < 50


def _repeated_words(s: TextSlice) -> np.ndarray:
    return 100 * n_repeat_words(s) > 50 * s.n_words


def _symbols(s: TextSlice) -> np.ndarray:
    return 10 * n_symbols(s) > 3 * s.n_words


def _duplicate_lines(s: TextSlice) -> np.ndarray:
    lines = s.per_text(s.data == 10) + 1
    return 100 * n_dup_lines(s) > 40 * lines


def _shouting(s: TextSlice) -> np.ndarray:
    return s.per_text(_UPPER[s.data]) > s.per_text(_LOWER[s.data])


def _word_length(s: TextSlice) -> np.ndarray:
    return (s.word_chars > 15 * s.n_words) | (s.word_chars < 2 * s.n_words)


#: Rules by name; each returns True for the texts that it rejects.  The first two are the base rules.
RULES: dict[str, Callable[[TextSlice], np.ndarray]] = {
    "few_words": _few_words,
    "repeated_words": _repeated_words,
    "symbols": _symbols,
    "duplicate_lines": _duplicate_lines,
    "shouting": _shouting,
    "word_length": _word_length,
}
BASE_RULES = ("few_words", "repeated_words")


def plan_rules(docs: DataFrame, *, text_col: str = "text", sample_rows: int = 2000) -> list[str]:
    """The names of the rules, most rejections per second first.

    Each rule runs alone on about ``sample_rows`` rows, taken by chance and not
    by their text, so that many copies of one are no larger sample; the driver
    gets a few numbers for each task.
    """
    names = list(RULES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 3))
        for batch in batches:
            for part, _ in slices(batch):
                for i, name in enumerate(names):
                    fresh = TextSlice(part.column(0))
                    begun = time.thread_time()
                    rejected = RULES[name](fresh)
                    total[i] += (time.thread_time() - begun, fresh.n, rejected.sum())
        yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(total[:, k]) for k in range(3)]], ["rule", "seconds", "n", "rejected"])

    n = docs.count()
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    sample = docs.select(text).sample(min(1.0, sample_rows / max(1, n)), seed=8)
    found = sample.mapInArrow(measure, "rule string, seconds double, n double, rejected double").groupBy("rule").agg(F.sum("seconds"), F.sum("n"), F.sum("rejected")).collect()
    worth = {r[0]: (r[3] + 0.5) / (r[1] + 1e-9) for r in found}
    return sorted(names, key=lambda name: -worth.get(name, 0.0))


def cascade(s: TextSlice, order: list[str]) -> np.ndarray:
    """True for the texts that every rule lets through; each rule sees only
    what the rules before it left."""
    kept, left = np.ones(s.n, bool), s
    for name in order:
        rejected = RULES[name](left)
        if rejected.any():
            kept[np.flatnonzero(kept)[rejected]] = False
            left = left.keep(~rejected)
        if not left.n:
            break
    return kept


def keep(docs: DataFrame, *, text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    order, at = plan_rules(docs, text_col=text_col, sample_rows=sample_rows), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])
            for part, texts in slices(named, f"c{at}"):
                good = part.filter(pa.array(cascade(texts, order)))
                yield pa.RecordBatch.from_arrays(good.columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """Base figures and verdict of every row of ``docs``."""
    order = plan_rules(docs, text_col=text_col, sample_rows=sample_rows)
    rest = [name for name in order if name not in BASE_RULES]
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                repeat = n_repeat_words(s)
                failed = (s.n_words < 50) | (100 * repeat > 50 * s.n_words)
                kept = ~failed
                kept[~failed] = cascade(s.keep(~failed), rest)
                values = [s.n_words, s.word_chars, n_symbols(s), n_dup_lines(s), repeat]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v.astype(np.int64)) for v in values], pa.array(failed), pa.array(kept)], ["doc_id", *figures, "base_failed", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, " + ", ".join(f"{f} long" for f in figures) + ", base_failed boolean, kept boolean")
