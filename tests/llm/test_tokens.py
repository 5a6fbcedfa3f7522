import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import quality, sentencepieces, token_counts, wavelet
from tests.llm import edge

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def noise(seed, n):
    r = random.Random(seed)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "The", "'s", "'S", "été", "É", "é", "12", "½", "²", "_", "...", "\xa0", "\u0085", " ", "\x1c", "\x00", "İ", "ß", "Σ", "中", "😀", "▁", "<|endoftext|>", "<s>", "<0x0A>", "ªº", "ŉ", "Ǆ", "µ"]
    return ["".join(r.choices(bits, k=r.randrange(1, 30))) for _ in range(n)]


def texts():
    return [t or "" for t in edge.TEXTS] + noise(1, 400)


def test_piece_counts_equal_the_library():
    whole = library("byte_bpe_50k.json")
    want = [len(e) for e in whole.encode_batch(texts(), add_special_tokens=False)]
    assert token_counts.PieceCounter(P.path("byte_bpe_50k.json")).count(texts()) == want


def test_word_ids_equal_the_library():
    whole = library("word_bpe_49k.json")
    want = [e.ids for e in whole.encode_batch(texts(), add_special_tokens=False)]
    got = wavelet.WordEncoder(P.path("word_bpe_49k.json")).encode(texts())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_agenda_equals_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = sentencepieces.Agenda(P.path("piece_bpe_32k.model"))
    want = sp.encode(texts(), add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts())] == want


def test_wavelet_shard_answers():
    r = np.random.default_rng(3)
    tokens = r.integers(0, 50, 2000)
    shard = wavelet.Shard(wavelet.pack([5, None, 7], np.array([1000, 0, 1000]), tokens))
    assert shard.doc_ids == [5, None, 7] and (shard.tokens() == tokens).all()
    assert [shard.access(i) for i in range(0, 2000, 97)] == tokens[::97].tolist()
    for t in (0, 7, 49, 63, 1000):
        assert shard.occurrences(t) == np.flatnonzero(tokens == t).tolist()
        assert shard.count(t, 100, 1700) == (tokens[100:1700] == t).sum()
    none = wavelet.Shard(wavelet.pack([1], np.array([0]), np.zeros(0, np.uint32)))
    assert none.tokens().tolist() == [] and none.count(3) == 0


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_op2_counts_and_cache(spark, tmp_path, rows):
    docs, path = rows(spark), P.path("byte_bpe_50k.json")
    whole = library("byte_bpe_50k.json")
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
    for _ in range(2):  # the second call finds every count in the cache
        got = token_counts.count_tokens(docs, path, str(tmp_path / "cache")).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    kept = spark.read.parquet(str(tmp_path / "cache"))
    assert kept.count() == kept.select("content", "tokenizer").distinct().count() == docs.selectExpr("coalesce(text, '')").distinct().count()


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_op5_round_trip(spark, rows):
    docs, whole = rows(spark), library("word_bpe_49k.json")
    own = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in own:
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    shards = wavelet.write_shards(docs, P.path("word_bpe_49k.json"), shard_tokens=1000)
    got = wavelet.read_shards(shards).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_op10_ids_and_text(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = []
    for r in rows(spark).collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = sentencepieces.encode_texts(rows(spark), P.path("piece_bpe_32k.model")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def brute_quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(3))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_op8_figures(spark, rows):
    docs = rows(spark)
    want = sorted((str(r.doc_id), *brute_quality(r.text)) for r in docs.collect())
    got = quality.judge(docs).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_cascade_ignores_order():
    import pyarrow as pa

    from tessera.llm.textbatch import TextSlice

    s = TextSlice(pa.array([t or "" for t in edge.TEXTS] + ["good " + " ".join(f"w{i}" for i in range(80))]))
    names = list(quality.RULES)
    first = quality.cascade(s, names)
    assert (quality.cascade(s, names[::-1]) == first).all() and first[-1]


def test_shard_of_several_frames():
    r = np.random.default_rng(4)
    tokens = r.integers(0, 40_000, 600_000).astype(np.uint32)
    tokens[r.integers(0, len(tokens), 5000)] = 7
    shard = wavelet.Shard(wavelet.pack([1], np.array([len(tokens)]), tokens))
    assert [shard.access(i) for i in (0, 262_143, 262_144, 511, 512, 599_999)] == tokens[[0, 262_143, 262_144, 511, 512, 599_999]].tolist()
    assert len(shard._open) < shard.bits * shard._each  # only what was touched is unpacked
    want = np.flatnonzero(tokens == 7)
    assert shard.count(7) == len(want) and shard.occurrences(7) == want.tolist() and shard.count(7, 1000, 300_000) == ((want >= 1000) & (want < 300_000)).sum()
    assert (shard.tokens() == tokens).all()
