"""SentencePiece encoding and decoding by a score-ordered agenda.

A merge-type vocabulary is applied as its definition says: all pairs of adjacent
symbols that form a piece stand on an agenda ordered by the piece's score, then
by position; the best is merged, and its new neighbours join the agenda.

A text is cut where a run of the space mark begins after another character.  No
piece of such a vocabulary has the mark after another character (``Agenda``
looks), so no merge crosses a cut, and each segment is encoded once and kept in
a bounded memo.  Each Arrow batch of new segments is checked against the
sentencepiece library, and so is the first whole text of every batch; a
difference raises.

Edge cases: null counts as an empty text, whose ids are begin and end; a very long
text is encoded whole, in a batch of its own; pairs of equal score merge from the
left; repeated
rows give a row each; an empty table gives no rows; other columns are ignored.
Characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .memo import Memo
from .textbatch import slices

MARK = "▁"
_BETWEEN = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_agendas: dict[str, Agenda] = {}


class Agenda:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.cost = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.separable = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.memo = Memo(self._fill, most=32 << 20)

    def merge(self, segment: str) -> list[str]:
        """The pieces of a segment that already has its marks."""
        cost = self.cost
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[p], i, p) for i in range(n - 1) if (p := segment[i : i + 2]) in cost]
        heapq.heapify(agenda)
        while agenda:
            _, left, piece = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] is None or right >= n or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (p := piece + symbols[following]) in cost:
                    heapq.heappush(agenda, (cost[p], left, p))
            if (previous := before[left]) >= 0 and (p := symbols[previous] + piece) in cost:
                heapq.heappush(agenda, (cost[p], previous, p))
        return [s for s in symbols if s is not None]

    def segment_ids(self, segment: str) -> list[int]:
        out, ids = [], self.ids
        for s in self.merge(segment):
            if (i := ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def _fill(self, segments: list[str]) -> list[bytes]:
        found = [self.segment_ids(s) for s in segments]
        # The library puts a mark before every text but an empty one, so it is given what follows the first one.
        given = [(s[1:], x) for s, x in zip(segments, found, strict=True) if s != MARK]
        if self.library.encode([s for s, _ in given], num_threads=1) != [x for _, x in given]:
            raise ValueError("agenda and library differ on a segment")
        return [np.array(x, "<u4").tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids with begin and end, little-endian 32-bit, of each text."""
        head, tail = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif not self.separable:
                split.append([MARK + t.replace(" ", MARK)])
            elif MARK in t or "  " in t or t[0] == " " or t[-1] == " ":
                split.append(_BETWEEN.split(MARK + t.replace(" ", MARK)))
            else:
                split.append([MARK + w for w in t.split(" ")])
        self.memo.learn(p for parts in split for p in parts)
        get = self.memo.young.__getitem__
        return [head + b"".join(map(get, parts)) + tail for parts in split]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


def agenda(path: str) -> Agenda:
    if path not in _agendas:
        _agendas[path] = Agenda(path)
    return _agendas[path]


def encode_texts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``ids``
    also the ids and the decoded text."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = agenda(model_path)
        pa.default_memory_pool().release_unused()  # what the steps before left in this worker
        for batch in batches:
            checked = False
            for part, s in slices(batch):
                texts = s.texts.to_pylist()
                raw = own.encode(texts)
                lists = [np.frombuffer(x, "<u4").tolist() for x in raw]
                if not checked:
                    if own.library.encode(texts[0], add_bos=True, add_eos=True) != lists[0]:
                        raise ValueError("agenda and library differ on a text")
                    checked = True
                decoded = own.decode(lists)
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in raw], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return rows.mapInArrow(run, schema)
