"""Token ids in wavelet matrices, one a shard.

A shard file is one binary value: a header (magic, counts, sizes), the documents'
ids and token offsets, a rank directory (set bits before every 512 bits of each
plane), then one bit-plane for each bit of the largest token id, from the highest.
A plane is cut into blocks of 32 KB, each a zstd frame of packed bits.  ``access``,
``count`` and ``occurrences`` find their way by the directory and unpack only the
blocks that they touch; ``tokens`` restores the whole sequence.

Spark's Parquet writer carries the values, one shard in a file: it is the one
writer here that commits to any store and survives a lost executor.

Edge cases: null counts as an empty text, which has the end id only; a very long
text is encoded whole and stays within one shard; rows that
repeat a doc_id are put in order of their text; null doc_ids come first; an
empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .memo import Memo
from .storage import persist
from .textbatch import slices

MAGIC = b"WVM2"
_HEAD = struct.Struct("<4sIQQ")
_BLOCK = 512
_FRAME = 32 << 10
_encoders: dict[tuple[str, int], WordEncoder] = {}


def pack(doc_ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """The shard file of some documents."""
    press = zstandard.ZstdCompressor(level=1)
    bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    ids = np.array([0 if i is None else i for i in doc_ids], "<i8")
    null = np.packbits(np.array([i is None for i in doc_ids], bool))
    parts = [ids.tobytes(), null.tobytes(), np.asarray(lengths, "<u4").tobytes()]
    row = tokens.astype(np.uint32 if bits > 16 else np.uint16)
    planes, ranks = [], []
    for b in range(bits - 1, -1, -1):
        plane = (row & row.dtype.type(1 << b)).astype(bool)
        packed = np.packbits(plane)
        ranks.append(_ranks_of(packed))
        planes += [packed[k : k + _FRAME].tobytes() for k in range(0, len(packed), _FRAME)]
        row = np.concatenate([np.compress(~plane, row), np.compress(plane, row)])
    frames = [press.compress(p) for p in [*parts, np.concatenate(ranks).astype("<u8").tobytes(), *planes]]
    return _HEAD.pack(MAGIC, bits, len(ids), len(tokens)) + struct.pack(f"<{len(frames)}Q", *map(len, frames)) + b"".join(frames)


def _ranks_of(packed: np.ndarray) -> np.ndarray:
    """Set bits before every block of 512, and in all."""
    ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (_BLOCK // 8))).view("<u8")).reshape(-1, _BLOCK // 64).sum(1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)])


class Shard:
    def __init__(self, blob: bytes):
        magic, self.bits, self.n_docs, self.n = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        each = -(-(-(-self.n // 8)) // _FRAME)
        count = 4 + self.bits * each
        sizes = struct.unpack_from(f"<{count}Q", blob, _HEAD.size)
        begins = _HEAD.size + 8 * count + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self._blob, self._at, self._each, self._expand = blob, begins.tolist(), each, zstandard.ZstdDecompressor()
        self._open: dict[tuple[int, int], np.ndarray] = {}
        ids, nulls, lengths, ranks = (self._frame(k) for k in range(4))
        null = np.unpackbits(np.frombuffer(nulls, np.uint8), count=self.n_docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(np.frombuffer(ids, "<i8"), null, strict=True)]
        self.lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self._ranks = np.frombuffer(ranks, "<u8").astype(np.int64).reshape(self.bits, -1)

    def _frame(self, k: int) -> bytes:
        return self._expand.decompress(self._blob[self._at[k] : self._at[k + 1]])

    def _part(self, k: int, j: int) -> np.ndarray:
        """Bytes of block j of plane k, unpacked when first asked for."""
        if (k, j) not in self._open:
            self._open[k, j] = np.frombuffer(self._frame(4 + k * self._each + j), np.uint8)
        return self._open[k, j]

    def _byte(self, k: int, i: int) -> int:
        return int(self._part(k, i // _FRAME)[i % _FRAME])

    def plane(self, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(self._frame(4 + k * self._each + j), np.uint8) for j in range(self._each)]])

    @cached_property
    def _zeros(self) -> list[int]:
        return [self.n - int(r[-1]) for r in self._ranks]

    def _bit(self, k: int, i: int) -> int:
        return self._byte(k, i >> 3) >> (7 - (i & 7)) & 1

    def rank1(self, k: int, i: int) -> int:
        """Set bits among the first i of plane k."""
        block = i // _BLOCK
        first, last = block * _BLOCK // 8, i >> 3  # a block of 512 bits lies within one frame
        out = int(self._ranks[k][block])
        if last > first:
            out += int(np.bitwise_count(self._part(k, first // _FRAME)[first % _FRAME : first % _FRAME + last - first]).sum())
        return out + (self._byte(k, last) >> (8 - (i & 7))).bit_count() if i & 7 else out

    def select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) bit of that value in plane k."""
        ranks = self._ranks[k]
        # The directory narrows it down to one block of 512 bits.
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * _BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, j, side="right")) - 1
        first = block * _BLOCK // 8
        bits = np.unpackbits(self._part(k, first // _FRAME)[first % _FRAME : first % _FRAME + _BLOCK // 8])
        places = np.flatnonzero(bits == bit)
        return block * _BLOCK + int(places[j - int(before[block])])

    def access(self, i: int) -> int:
        out = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self.rank1(k, i)
            out = out << 1 | bit
            i = self._zeros[k] + ones if bit else i - ones
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self.rank1(k, start), self.rank1(k, end)
            start, end = (self._zeros[k] + a, self._zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> list[int]:
        """Places of a token, in order."""
        out = []
        for i in range(*self._range(token, start, self.n if end is None else end)):
            for k in range(self.bits - 1, -1, -1):
                bit = token >> (self.bits - 1 - k) & 1
                i = self.select(k, bit, i - self._zeros[k] if bit else i)
            out.append(i)
        return sorted(out)

    def tokens(self) -> np.ndarray:
        row = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for b in range(self.bits):
            plane = np.unpackbits(self.plane(self.bits - 1 - b), count=self.n).view(bool)
            zeros, above = self.n - int(plane.sum()), np.empty_like(row)
            above[~plane] = row[:zeros]
            above[plane] = row[zeros:] | row.dtype.type(1 << b)
            row = above
        return row


class WordEncoder:
    """Ids by the ``tokenizers`` library, for a vocabulary whose normaliser and
    pre-tokenizer work within words.

    Texts are cut at spaces, which such a tokenizer drops; known words come from
    a bounded memo.  A new word of characters below U+0300 without controls is
    lower-cased and split by the tokenizer's own pattern (such characters are
    composed already), and the library's merge model encodes the pieces; any
    other word goes through the whole library.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        from pathlib import Path

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(Path(path).read_text())
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern", {}).get("Regex") == self.PATTERN and cuts[0].get("invert") is True
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile(self.PATTERN).findall
        self.simple = regex.compile("[\x21-\x7e\xa1-˿]*").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.words = Memo(self._words)
        self.signs = {c: self._piece(c) for c in ".,;:!?\"()-"} if self.by_word else {}

    def _piece(self, piece: str) -> bytes:
        shown = self.shown
        spelled = piece if piece.isascii() else "".join([shown[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        piece, signs, simple, out, rest = self._piece, self.signs, self.simple, [], []
        for w in words:
            low = w.lower()
            if len(low) == len(w) and w and max(low) < "\u0250":
                # Mostly a run of letters, or one and a sign: no pattern is needed to split those.
                if w.isalpha():
                    out.append(piece(low))
                    continue
                if w[-1] in signs and w[:-1].isalpha():
                    out.append(piece(low[:-1]) + signs[w[-1]])
                    continue
            if simple(w) and simple(low) and not any(x in w for x in self.special):
                out.append(b"".join([piece(p) for p in self.split(low)]))
            else:
                rest.append(len(out))
                out.append(b"")
        for i, ids in zip(rest, self._library([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._library(texts)
        # Arrow finds the distinct words, so Python touches each of them once a call.
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.words.learn(words)
        found = list(map(self.words.young.__getitem__, words))
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        sizes = size[word]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(begin[word] - (ends - sizes), sizes)
        raw = np.frombuffer(b"".join(found), "<u4")[place].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[parts.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def word_encoder(path: str) -> WordEncoder:
    key = (path, os.getpid())
    if key not in _encoders:
        _encoders[key] = WordEncoder(path)
    return _encoders[key]


def write_shards(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, shard_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shard files; returns the table of them as read back.

    Rows are dealt by ranges of doc_id and sorted; a task packs a shard for
    about every ``shard_tokens`` ids, so its memory doesn't grow with its rows.
    Columns: part and seq (their order is that of doc_id), before (ids of the
    same part in earlier shards), n_tokens, shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, size
            blob = pack(ids, np.array([len(x) // 4 for x in raw]), np.frombuffer(b"".join(raw), "<u4"))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "before", "n_tokens", "shard"])
            seq, before, size = seq + 1, before + size, 0
            ids.clear()
            raw.clear()
            return row

        for batch in batches:
            for rows, s in slices(batch, most=8 << 20):
                found = [x + end for x in encoder.encode(s.texts.to_pylist())]
                for i, x in zip(rows.column(0).to_pylist(), found, strict=True):
                    ids.append(i)
                    raw.append(x)
                    size += len(x) // 4
                    if size >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    table = dealt.mapInArrow(run, "part int, seq int, before long, n_tokens long, shard binary")
    return persist(table, "wavelet", maxRecordsPerFile=1, compression="none")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards.

    The driver sees one sum for each task that wrote; where a document starts
    within those follows from the shards themselves.
    """
    spark = shards.sparkSession
    sums = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, total = [], 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(blob.as_py())
                tokens, cuts = shard.tokens().astype("<u4"), shard.offsets
                crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(cuts[:-1] + at), pa.array(shard.lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("at"), "shard")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
