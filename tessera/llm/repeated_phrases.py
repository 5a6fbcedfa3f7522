"""Removal of repeated passages by sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of a document.  A word goes if a window
over it also starts, word for word, in a document with a smaller doc_id.

1. Every window names its least gram of ``GRAM`` words, by hash.  Equal windows
   name equal grams, and neighbours mostly the same one, so only about a quarter
   of the words give a row.  Grams that two different texts name are recurring.
2. Runs of windows that name one recurring gram are cut out and dealt to shards
   of grams.  A task takes the windows of a gram that two documents seem to have
   (by hash), for it sees all of them; compiles an automaton over their words;
   streams the runs through it; and marks every occurrence after the first
   document among those that the automaton found, so words decide and not hashes.
3. The grams of a shard that too many runs name are dealt by window, and a window
   that too many documents have by document also.  Which windows recur, and where
   first, an aggregation over (gram, window) tells; its row goes along with each
   occurrence, so a part has no windows but its own.
4. Marks go back to their texts.  Exact copies of a text need none of this: all
   windows of a later copy start in the first.

Which grams recur is told to the tasks by a Bloom filter of at most
``FILTER_MB``; if more grams recur than it can hold, a join tells them instead.

Edge cases: null counts as an empty text; a very long text is one row of its
own run and is taken whole; rows that share a doc_id take nothing from each
other (a window first in two of them has that doc_id as its first); null doc_ids
are no source and lose nothing; texts under ``WINDOW`` words stay; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import persist, release, scratch
from .textbatch import TextSlice, mix, slices

WINDOW, GRAM = 13, 7
FILTER_MB = 32
SHARD_RUNS, BLOCK_BYTES = 20_000, 1 << 20
_U = np.uint64
_BLOCKS = 64


def named_grams(s: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first words of all windows of the slice, the word at which the gram
    that each names starts, and the gram's hash."""
    at = s.window_starts(WINDOW)
    if not len(at):
        return at, at, np.zeros(0, _U)
    hashes = s.run_hash(GRAM)
    best, place = hashes[at], at.copy()
    for k in range(1, WINDOW - GRAM + 1):
        other = hashes[at + k]
        less = other < best
        best[less] = other[less]
        place[less] = at[less] + k
    return at, place, best


def _runs(at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (first and last index) of the runs of windows with one gram."""
    new = np.append(True, place[1:] != place[:-1]) if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], len(at)) - 1


class Filter:
    """A Bloom filter in 64 blocks; a gram's block is in its lower bits, for the
    upper ones of a least hash are mostly zero."""

    def __init__(self, blocks: list[np.ndarray]):
        self.blocks = np.stack(blocks)

    @staticmethod
    def places(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        h = mix(grams)
        for k in range(3):
            yield (h >> _U(20 * k)) * _U(0x9E3779B97F4A7C15) >> _U(64 - bits)

    @staticmethod
    def block(grams: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, bool)
        for p in Filter.places(grams, bits):
            out[p.astype(np.intp)] = True
        return np.packbits(out, bitorder="little")

    def has(self, grams: np.ndarray) -> np.ndarray:
        bits = (self.blocks.shape[1] * 8).bit_length() - 1
        block = (grams & _U(_BLOCKS - 1)).astype(np.intp)
        out = np.ones(len(grams), bool)
        for p in Filter.places(grams, bits):
            out &= self.blocks[block, (p >> _U(3)).astype(np.intp)] >> (p & _U(7)).astype(np.uint8) & 1 == 1
        return out


def _filter(grams: DataFrame, n: int) -> Filter:
    """Built a block a task; the driver gets at most FILTER_MB."""
    bits = max(10, int(np.ceil(np.log2(max(1, n) * 12 / _BLOCKS))))

    def build(table: pa.Table) -> pa.Table:
        found = table.column("gram").to_numpy().view(_U)
        return pa.table({"block": pa.array([int(found[0] & _U(_BLOCKS - 1))], pa.int32()), "bits": pa.array([Filter.block(found, bits).tobytes()], pa.binary())})

    keyed = grams.select("gram", F.col("gram").bitwiseAND(_BLOCKS - 1).cast("int").alias("block"))
    rows = keyed.groupBy("block").applyInArrow(build, "block int, bits binary").collect()
    blocks = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(_BLOCKS)]
    for r in rows:
        blocks[r.block] = np.frombuffer(r.bits, np.uint8)
    return Filter(blocks)


def _recurring(known: DataFrame) -> DataFrame:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                at, place, best = named_grams(s)
                begin, _ = _runs(at, place)
                content = part.column(1).to_numpy()[s.word_text[at[begin]]] if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(best[begin].view(np.int64)), pa.array(content)], ["gram", "content"])

    named = known.mapInArrow(name, "gram long, content long")
    return named.groupBy("gram").agg(F.min("content").alias("x"), F.max("content").alias("y"), F.count("*").alias("n")).where("x < y").select("gram", "n")


def _cut(known: DataFrame, emit: Callable, schema: str, grams: DataFrame) -> DataFrame:
    """``emit(part, s, at, runs)`` over all runs that name a recurring gram."""
    spark, grams = known.sparkSession, grams.select("gram")
    n = grams.count()
    if n * 1.5 <= FILTER_MB << 20:
        shared = spark.sparkContext.broadcast(_filter(grams, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, s in slices(batch):
                    at, place, best = named_grams(s)
                    begin, end = _runs(at, place)
                    good = shared.value.has(best[begin]) if len(begin) else np.zeros(0, bool)
                    yield emit(part, s, at, begin[good], end[good], best)

        return known.mapInArrow(run, schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                at, place, best = named_grams(s)
                begin, _ = _runs(at, place)
                owner = s.word_text[at[begin]] if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(best[begin].view(np.int64)), part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner))], ["gram", "doc_id", "content"])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                at, place, best = named_grams(s)
                begin, end = _runs(at, place)
                owner = s.word_text[at[begin]] if len(at) else at
                lists = part.column(3).to_pylist()
                good = np.array([best[b].view(np.int64) in x for b, x in zip(begin, [frozenset(lists[o]) for o in owner], strict=True)], bool)
                yield emit(part, s, at, begin[good], end[good], best)

    named = known.mapInArrow(pairs, "gram long, doc_id long, content long").distinct().join(grams, "gram")
    lists = named.groupBy("doc_id", "content").agg(F.collect_set("gram").alias("grams"))
    return known.join(lists, ["doc_id", "content"]).select("doc_id", "content", "text", "grams").mapInArrow(run_joined, schema)


def _pieces(s: TextSlice, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The source from the first to the last word of each run."""
    raw = s.data.tobytes()
    return pa.array([raw[a:b] for a, b in zip(s.starts[first], s.ends[last], strict=True)], pa.binary()).cast(pa.string())


def _emit_windows(part, s: TextSlice, at, begin, end, best) -> pa.RecordBatch:
    length = end - begin + 1
    index = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(begin) else begin
    first = at[index]
    owner = s.word_text[first]
    start = (first - s.word_offsets[:-1][owner]).astype(np.int64)
    take = pa.array(owner)
    return pa.RecordBatch.from_arrays([pa.array(best[index].view(np.int64)), pa.array(s.window_hash(first, WINDOW).view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(start, pa.int64()), _pieces(s, first, first + WINDOW - 1)], ["gram", "window", "doc_id", "content", "start", "text"])


def _emit_runs(part, s: TextSlice, at, begin, end, best) -> pa.RecordBatch:
    first, last = at[begin], at[end] + WINDOW - 1
    owner = s.word_text[first]
    start = (first - s.word_offsets[:-1][owner]).astype(np.int64) if len(first) else first
    take = pa.array(owner)
    return pa.RecordBatch.from_arrays([pa.array(best[begin].view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(start, pa.int64()), _pieces(s, first, last)], ["gram", "doc_id", "content", "start", "text"])


def _confirmed(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Windows that two documents have, in order."""
    order = np.argsort(hashes)
    hashes, docs = hashes[order], docs[order]
    begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[begin[np.minimum.reduceat(docs, begin) < np.maximum.reduceat(docs, begin)]]


def scan(s: TextSlice, docs: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[int]]:
    """The words at which a window starts that a smaller doc_id has, for each run.

    Without ``known`` the runs have all windows of their grams, and what the
    automaton finds tells the least doc_id of each window.  Otherwise ``known``
    has the windows and their least doc_ids.
    """
    at = s.window_starts(WINDOW)
    hashes = s.window_hash(at, WINDOW)
    owner = s.word_text[at]
    windows = known[0] if known is not None else _confirmed(hashes, docs[owner]) if len(at) else hashes
    out: list[list[int]] = [[] for _ in range(s.n)]
    if not len(windows):
        return out
    found = np.minimum(np.searchsorted(windows, hashes), len(windows) - 1)
    hit = np.flatnonzero(windows[found] == hashes)
    _, sample = np.unique(found[hit], return_index=True)  # one occurrence of each, to spell it
    runs = np.unique(owner[hit])
    symbols: dict[bytes, str] = {}
    spelled: dict[int, str] = {}
    for i in runs.tolist():
        letters = []
        for w in s.raw(i).split():
            if (c := symbols.get(w)) is None:
                code = 0x100 + len(symbols)
                c = symbols[w] = chr(code if code < 0xD800 else code + 0x800)
            letters.append(c)
        spelled[i] = "".join(letters)
    automaton = ahocorasick.Automaton()
    chosen = hit[sample]
    owners, places = owner[chosen], at[chosen]
    places = places - s.word_offsets[:-1][owners]
    for i, p, k in zip(owners.tolist(), places.tolist(), found[chosen].tolist(), strict=True):
        automaton.add_word(spelled[i][p : p + WINDOW], k)
    automaton.make_automaton()
    seen = [(i, end - WINDOW + 1, k) for i in runs.tolist() for end, k in automaton.iter(spelled[i])]
    which, place, window = np.array(seen, np.int64).reshape(-1, 3).T
    if known is not None:
        first = known[1]
    else:
        first = np.full(len(windows), np.iinfo(np.int64).max)
        np.minimum.at(first, window, docs[which])
    later = first[window] < docs[which]
    for i, p in zip(which[later].tolist(), place[later].tolist(), strict=True):
        out[i].append(p)
    return out


def _locate(rows: DataFrame) -> DataFrame:
    """doc_id, content, begin, end: stretches of words to remove, of rows (gram,
    doc_id, content, start, text, window, first) in order of shard, part and
    gram; first is null unless the shard is split."""

    def marked(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(block).combine_chunks()
        doc, content, start = (table.column(n).to_numpy() for n in ("doc_id", "content", "start"))
        known = None
        if table.column("first").null_count == 0:
            windows, index = np.unique(table.column("window").to_numpy().view(_U), return_index=True)
            known = windows, table.column("first").to_numpy()[index]
        out: list[tuple[int, int, int, int]] = []
        for i, found in enumerate(scan(TextSlice(table.column("text").combine_chunks()), doc, known)):
            begin = end = None
            for p in found:
                if end is not None and p <= end:
                    end = p + WINDOW
                    continue
                if end is not None:
                    out.append((doc[i], content[i], start[i] + begin, start[i] + end))
                begin, end = p, p + WINDOW
            if end is not None:
                out.append((doc[i], content[i], start[i] + begin, start[i] + end))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["doc_id", "content", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            gram, split = batch.column(0).to_numpy(), batch.column(6).is_valid().to_numpy(zero_copy_only=False)
            sizes = np.concatenate([[0], np.cumsum(np.diff(TextSlice(batch.column(4)).offsets))])
            # What belongs together: all runs of a gram, or a single window of a split shard.
            cuts = np.append(np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | split[1:] | split[:-1])), batch.num_rows)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                # A block ends between grams once it is large, and where split shards begin or end.
                if block and (size >= BLOCK_BYTES and (split[a] or last[0] != gram[a]) or last[1] != split[a]):
                    yield marked(block)
                    block, size = [], 0
                block.append(batch.slice(a, b - a))
                size += int(sizes[b] - sizes[a])
                last = gram[a], split[a]
        if block:
            yield marked(block)

    return rows.mapInArrow(run, "doc_id long, content long, begin long, end long")


def marks(known: DataFrame) -> DataFrame:
    """doc_id, content, begin, end for rows (doc_id, content, text)."""
    spark = known.sparkSession
    grams = persist(_recurring(known), "grams")
    release(spark)
    shards = max(1, -(-(grams.agg(F.sum("n")).first()[0] or 0) // SHARD_RUNS))
    shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int").alias("shard")
    parts = F.when(F.sum("n") > 3 * SHARD_RUNS, F.ceil(F.sum("n") / SHARD_RUNS)).otherwise(1).cast("int")
    large = persist(grams.groupBy(shard).agg(parts.alias("parts")).where("parts > 1"), "large")
    none = F.lit(None).cast("long")
    runs = _cut(known, _emit_runs, "gram long, doc_id long, content long, start long, text string", grams)
    # A row for each large shard: fewer than one in three of all.
    whole = runs.withColumn("shard", shard).join(large, "shard", "left_anti")
    rows = whole.select("shard", F.lit(0).alias("part"), "gram", "doc_id", "content", "start", "text", none.alias("window"), none.alias("first"))
    if not large.isEmpty():
        hot = grams.select("gram", shard).join(large, "shard").select("gram")
        # The filter may let other grams through; those of whole shards are dealt with above.
        windows = _cut(known, _emit_windows, "gram long, window long, doc_id long, content long, start long, text string", hot)
        windows = persist(windows.withColumn("shard", shard).join(large, "shard"), "windows")
        found = windows.groupBy("gram", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.ceil(F.count("*") / SHARD_RUNS).alias("parts_of_it"))
        found = persist(found.where("first < last").select("gram", "window", "first", "parts_of_it"), "found")
        place = F.pmod(F.xxhash64("window", F.pmod(F.xxhash64("doc_id", "start"), "parts_of_it")), "parts").cast("int")
        rows = rows.union(windows.join(found, ["gram", "window"]).select("shard", place, "gram", "doc_id", "content", "start", "text", "window", "first"))
    dealt = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "gram")
    return persist(_locate(dealt.drop("shard", "part")), "marks")


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, with ``texts``
    also the kept words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))
    known = rows.where("doc_id is not null")
    with scratch(docs.sparkSession) as keep:
        lists = keep(_spans(known), "spans")
    release(docs.sparkSession)
    return _finished(rows, lists, texts)


def _spans(known: DataFrame) -> DataFrame:
    """d, c (doc_id and content) and the list of stretches of words to remove."""
    found = marks(known)
    digests = known.select("doc_id", "content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    first = persist(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "firsts")
    later = digests.join(first, "digest").where("doc_id > first").select("doc_id", "content", F.lit(0).cast("long").alias("begin"), F.lit(1 << 60).alias("end"))
    lists = found.union(later).groupBy("doc_id", "content").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return lists.withColumnsRenamed({"doc_id": "d", "content": "c"})


def _finished(rows: DataFrame, lists: DataFrame, texts: bool) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                out = []
                for i, spans in enumerate(part.column(2).to_pylist()):
                    words = s.raw(i).split()
                    gone = np.zeros(len(words), bool)
                    for span in spans or ():
                        if len(words) >= WINDOW:
                            gone[span["begin"] : span["end"]] = True
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if spans else b" ".join(words)
                    out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
                columns = [part.column(0), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    columns.append(pa.array([r[3].decode() for r in out], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    joined = rows.join(lists, (F.col("doc_id") == F.col("d")) & (F.col("content") == F.col("c")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
