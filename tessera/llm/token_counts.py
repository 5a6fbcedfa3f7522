"""Token counts behind a digest cache.

Each text is known by the SHA-256 digest of its normalised content, each
tokenizer by the digest of its file and library version.  Counts that the cache
holds are joined in; only distinct texts that it lacks are encoded, once each,
and appended.  Normalisation is what the tokenizer itself does before its
merges: none for the byte-level vocabulary, so here it maps null to the empty
text and nothing else.

Inside the encoder a second, bounded memo works on pieces of a text that the
tokenizer provably never joins: for a byte-level pre-tokenizer, a text may be
cut at a single space that stands between two characters that aren't white
space.  Pieces that aren't known yet go to the library in one batch.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a very long text is
encoded whole, in a batch of its own; repeated rows and
repeated doc_ids each give a row; an empty table gives no rows; other columns
than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .memo import Memo
from .storage import persist
from .textbatch import slices

_CUT = re.compile(r"(?<=\S) (?=\S)")
_counters: dict[str, PieceCounter] = {}


def tokenizer_digest(path: str) -> str:
    import tokenizers

    return hashlib.sha256(Path(path).read_bytes() + tokenizers.__version__.encode()).hexdigest()


class PieceCounter:
    """Counts the tokens of texts with the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = Memo(self._fill)
        self.by_piece = self._separable(path)

    @staticmethod
    def _separable(path: str) -> bool:
        """True for a byte-level pre-tokenizer with its usual pattern and no
        normaliser: then a text may be cut at ``_CUT``."""
        import json

        spec = json.loads(Path(path).read_text())
        pre = spec.get("pre_tokenizer") or {}
        added = [t for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]]
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not added

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, pieces: list[str]) -> list[int]:
        """-1: white space at an edge, or an empty piece, so the space before
        or after it isn't a place to cut."""
        good = [p for p in pieces if p.strip() == p and p != "" or p[1:].strip() == p[1:] != "" and p[0] == " "]
        counts = dict(zip(good, self._library(good), strict=True))
        return [counts.get(p, -1) for p in pieces]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self._library(texts)
        split = []
        for t in texts:
            first, *rest = t.split(" ")
            split.append([first, *[" " + p for p in rest]])
        self.memo.learn(p for parts in split for p in parts)
        get, out = self.memo.young.__getitem__, []
        for t, parts in zip(texts, split, strict=True):
            counts = list(map(get, parts))
            out.append(sum(counts) if -1 not in counts else None if t else 0)
        odd = [i for i, n in enumerate(out) if n is None]
        for i in odd:
            first, *rest = _CUT.split(texts[i])
            parts = [first, *[" " + p for p in rest]]
            out[i] = sum(self._library(parts))
        return out


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part, texts in slices(batch, most=2 << 20):
                n = count.count(texts.texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return encode


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    ``cache_path`` is a folder of Parquet files (content, tokenizer, n_tokens)
    in a store that all executors share; it is made on first use.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"))

    def stored() -> DataFrame:
        known = spark.read.schema("content binary, tokenizer string, n_tokens long").parquet(cache_path)
        return known.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    spark.createDataFrame([], "content binary, tokenizer string, n_tokens long").write.mode("append").parquet(cache_path)
    missing = keyed.select("content", "text")
    if not stored().isEmpty():
        missing = missing.join(stored(), "content", "left_anti")
    distinct = missing.groupBy("content").agg(F.first("text").alias("text"))
    fresh = distinct.mapInArrow(_encoder(tokenizer_path), "content binary, n_tokens long")
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)

    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    # Written, so that the join is of two plain shuffles, of which Spark can split the parts with many copies.
    return rows.join(persist(stored(), "token-counts"), "content", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
