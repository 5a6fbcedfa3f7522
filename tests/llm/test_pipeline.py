import random

import corpus_pipeline
from tessera.llm import personal_data, quality
from tests.llm import test_decontamination, test_near_duplicates
from tests.llm.test_tokens import P, hashlib, np


def corpus():
    r = random.Random(12)
    vocabulary = [f"Word{i}x" for i in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=25))) for i in range(5)]
    docs = []
    for d in range(60):
        words = r.choices(vocabulary, k=r.choice([20, 60, 90, 150]))
        if d % 7 == 0:
            words[10:10] = items[d % 5][1].split()
        if d % 5 == 0:
            words[3:3] = ["mail", "joe.doe@example.com", "or", "jane", "(at)", "example", "[dot]", "org"]
        if d % 11 == 0:
            words = [w + "###" for w in words]
        docs.append((d, " ".join(words)))
    docs += [(100 + d, docs[d][1]) for d in range(0, 60, 6)]
    for d in range(0, 60, 9):
        w = docs[d][1].split()
        w[len(w) // 2] = "changed"
        docs.append((200 + d, " ".join(w)))
    docs += [(300, None), (301, ""), (302, docs[5][1])]
    return docs, items


def brute(docs, items):
    import pyarrow as pa
    import sentencepiece

    from tessera.llm.textbatch import TextSlice

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    s = TextSlice(pa.array([t or "" for _, t in docs]))
    bad = np.any([rule(s) for rule in quality.RULES.values()], 0)
    docs = [x for x, b in zip(docs, bad, strict=True) if not b]
    classes = {d: c for d, c in test_near_duplicates.brute(docs)}
    docs = [x for x in docs if classes[str(x[0])] == x[0]]
    hits = test_decontamination.brute(docs, items)
    docs = [(d, t) for d, t in docs if not hits[d]]
    out = []
    for d, t in docs:
        text = personal_data.redacted(t, personal_data.all_spans(t))
        ids = sp.encode(text, add_bos=True, add_eos=True)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return sorted(out)


def test_run_equals_brute_force(spark, tmp_path):
    docs, items = corpus()
    rows = [(d, t, "en", "src", len(t or "")) for d, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(docs, items)
    assert 10 < len(want) < 60
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    read = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        read = stage(spark, read, str(tmp_path))
        assert read.columns == frame.columns


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
