import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, queries, toxicity
from tests.llm import edge

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_edge_rows_toxicity(spark, rows):
    docs = rows(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model, keep=("lang",)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} <= {0.5}


def test_features_equal_brute_force():
    import pyarrow as pa

    from tessera.llm.textbatch import TextSlice

    texts = ["Hello hello", "", "abc", "ÀB cd efgh", "ÉTÉ 中文字符很多", "é" * 9]
    s = TextSlice(pa.array(texts))
    found = toxicity.features(s)
    for i, t in enumerate(texts):
        low = t.lower()
        distinct = {low[k : k + n] for n in toxicity.SIZES for k in range(len(low) - n + 1)}
        assert (found >> toxicity.BITS == i).sum() == len(distinct)


def test_model_equals_brute_force(spark):
    """Ratios, choice and fit, over the same features as sets."""
    import pyarrow as pa

    from tessera.llm.textbatch import TextSlice

    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["good", "fine", "day", "sun"] + ["awful", "vile"] * (i % 3 == 0), k=12)), int(i % 3 == 0)) for i in range(60)]
    model = toxicity.learn(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int"), most_features=50, steps=300)
    mask = (1 << toxicity.BITS) - 1
    sets = [set((toxicity.features(TextSlice(pa.array([t]))) & mask).tolist()) for _, t, _ in rows]
    y = np.array([x[2] for x in rows], float)
    p, q = y.sum(), len(y) - y.sum()
    tally = {f: (sum(f in s for s, c in zip(sets, y, strict=True) if c), sum(f in s for s, c in zip(sets, y, strict=True) if not c)) for f in set().union(*sets)}

    def g(a, b):
        e = (a + b) * p / (p + q)
        return a * np.log((a + 1e-9) / e) + b * np.log((b + 1e-9) / (a + b - e))

    top = sorted((f for f, (a, b) in tally.items() if a + b >= 3), key=lambda f: (-round(g(*tally[f]), 9), f))
    chosen = set(np.flatnonzero(model.weight).tolist())
    worst = min(g(*tally[f]) for f in chosen)
    assert len(chosen) == 50 and sum(g(*tally[f]) > worst + 1e-6 for f in top) <= 50 and chosen <= set(top)
    order = sorted(chosen)
    ratio = np.array([np.log((tally[f][0] + 1) / (p + 2)) - np.log((tally[f][1] + 1) / (q + 2)) for f in order])
    x = np.array([[f in s for f in order] for s in sets]) * ratio
    w, b = model.weight[order] / ratio, model.bias
    error = 1 / (1 + np.exp(-(x @ w + b))) - y
    slope = np.append(x.T @ error / len(y) + 1e-5 * w, error.mean())
    start = np.append(x.T @ (y.mean() - y) / len(y), 0)
    assert np.abs(slope).max() < 0.05 * np.abs(start).max()  # the fit has come to rest
    scores = model.score(TextSlice(pa.array([t for _, t, _ in rows])))
    assert np.allclose(scores, 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))) and ((scores >= 0.5) == (y == 1)).all()


def test_language_counts_equal_brute_force(spark):
    texts = [("en", "the cat and the dog and the cow"), ("en", "and then the end"), ("de", "der hund und die katze und der"), ("de", "und dann das ende")] * 3
    filters = language_id.learn(spark.createDataFrame([(t, x) for x, t in texts], "text string, lang string"), sizes=(3,), least=2)
    counts = {}
    for x, t in texts:
        for k in range(len(t) - 2):
            counts.setdefault(x, {}).setdefault(t[k : k + 3], 0)
            counts[x][t[k : k + 3]] += 1
    rates = {x: {gram: n / sum(c.values()) for gram, n in c.items()} for x, c in counts.items()}
    for i, x in enumerate(("de", "en")):
        want = {gram for gram, r in rates[x].items() if counts[x][gram] >= 2 and r >= 0.3 * max(rates[o].get(gram, 0) for o in rates)}
        keys = np.array([int.from_bytes(gram.encode(), "big") for gram in sorted(want)], np.uint64)
        assert (filters.languages_of(language_id._tagged(keys, 3))[:, 0] >> np.uint64(i) & np.uint64(1)).all()
        other = sorted(set(rates["en"]) | set(rates["de"]) - want)
        keys = np.array([int.from_bytes(gram.encode(), "big") for gram in other if gram not in want], np.uint64)
        assert (filters.languages_of(language_id._tagged(keys, 3))[:, 0] >> np.uint64(i) & np.uint64(1)).mean() < 0.2


def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1].score, got[got.toxic == 0].score
    wins = (toxic.to_numpy()[:, None] > clean.to_numpy()[None]).mean()
    assert wins > 0.9 and (clean < 0.5).mean() > 0.97


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_edge_rows_language(spark, rows):
    docs = rows(spark)
    got = language_id.identify(docs, language_id.learn(docs, least=1)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert not by or by[0] == by[1] == by[2] == "und" != by[9]
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(docs.limit(0))).collect()} <= {"und"}


def test_filters_return_every_language_of_a_gram():
    r = np.random.default_rng(1)
    members = {f"l{i}": r.integers(0, 1 << 40, 500) for i in range(70)}  # more than one word of bits
    filters = language_id.Filters.build(members, (5,))
    for i, name in enumerate(filters.languages):
        assert (filters.languages_of(members[name].astype(np.uint64))[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    strange = filters.languages_of(r.integers(1 << 41, 1 << 42, 20_000).astype(np.uint64))
    rates = filters.false_rates
    for i in range(0, 70, 10):
        seen = (strange[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()
        assert abs(seen - rates[i]) < 0.01


def test_language_held_out(spark):
    got = queries.op3_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_random_texts_do_not_fail():
    import pyarrow as pa

    from tessera.llm.textbatch import TextSlice

    r = random.Random(5)
    texts = ["".join(chr(r.choice([65, 97, 233, 20013, 128512, 32, 48])) for _ in range(r.randrange(0, 12))) for _ in range(300)]
    filters = language_id.Filters.build({"a": np.array([5, 6])}, (3, 5))
    langs, _ = filters.predict(TextSlice(pa.array(texts)))
    assert [x == "und" for x in langs] == [not any(c.isalpha() for c in t) for t in texts]
