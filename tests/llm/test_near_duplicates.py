import random
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_duplicates as nd, storage
from tessera.llm.components import components
from tessera.llm.textbatch import TextSlice
from tests.llm import edge


def sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").split()
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (Counter([tuple(w)]) if w else Counter()))
    return out


def brute(rows):
    """Classes by the weighted similarity of all pairs."""
    bags = sets(rows)
    n, df = len(rows), Counter(x for b in bags for x in b)
    weight = {x: 1 + nd.SPAN * (min(1, log(n / c) / log(1 / nd.RARE)) if c >= nd.RARE * n else 1) for x, c in df.items()}
    root = {d: d for d, _ in rows if d is not None}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b, x, y = rows[j][0], bags[i], bags[j]
            if a is None or b is None or not x or not y:
                continue
            shared = sum(min(x[s], y[s]) * weight[s] for s in x.keys() & y.keys())
            if shared >= nd.SIMILAR * (sum(weight[s] * c for s, c in x.items()) + sum(weight[s] * c for s, c in y.items()) - shared):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((str(d), None if d is None else find(d)) for d, _ in rows)


def corpus():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(30):
        base = r.choices(vocabulary, k=r.choice([3, 6, 30, 120]))
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = "edit"
            rows.append((len(rows), " ".join(w)))
    shared = r.choices(vocabulary, k=60)  # two in three of what many documents say, and chains of edits
    rows += [(len(rows) + i, " ".join(shared + r.choices(vocabulary, k=25))) for i in range(25)]
    chain = r.choices(vocabulary, k=100)
    for i in range(12):
        chain[8 * i] = f"link{i}"
        rows.append((300 + i, " ".join(chain)))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (None, rows[3][1]), (501, ""), (502, None), (503, " ")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [nd.BLOCK, 2])
def test_classes_equal_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(nd, "BLOCK", small)
    rows = corpus()
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.class_id) for r in got) == brute(rows)
    kept = nd.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(c) for _, c in brute(rows)})


@pytest.mark.parametrize("small", [nd.BLOCK, 8])
def test_edited_copies_join_around_an_original_of_any_id(spark, monkeypatch, small):
    """Copies are similar to the original, not to each other."""
    monkeypatch.setattr(nd, "BLOCK", small)
    r = random.Random(31)
    rows = []
    for k in range(3):
        original = [f"w{r.randrange(5000)}" for _ in range(300)]
        for i in range(40):
            w = list(original)
            for at in r.sample(range(10), 5) if i != 25 else ():
                w[30 * at + r.randrange(5, 25)] = f"edit{r.randrange(10**6)}"
            rows.append((100 * k + i, " ".join(w)))
    want = brute(rows)
    assert len({c for _, c in want}) == 3
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(x.doc_id), x.class_id) for x in got) == want


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_edge_rows(spark, rows):
    docs = rows(spark)
    got = {(r.doc_id, r.class_id) for r in nd.classes(docs).collect()}
    assert {d for d, _ in got} == {r.doc_id for r in docs.collect()}
    assert not got or {(9, 9), (10, 9), (0, 0), (1, 1), (2, 2), (None, None)} <= got
    assert nd.keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("small", [nd.BLOCK, 2])
def test_every_text_of_a_doc_id_is_compared(spark, monkeypatch, small):
    monkeypatch.setattr(nd, "BLOCK", small)
    r = random.Random(5)
    rows = []
    for k in range(8):
        for part in range(3):  # three texts of one doc_id, which is the least, a middle or the greatest one
            w = [f"w{r.randrange(5000)}" for _ in range(200)]
            rows.append((10 * k + (0, 5, 9)[k % 3], " ".join(w)))
            for copy in range(2):
                w[50 + 70 * copy] = "edit"
                rows.append((10 * k + 1 + part + (0, 0, 5)[copy], " ".join(w)))
    want = sorted(set(brute(rows)))
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).distinct().collect()
    assert sorted((str(x.doc_id), x.class_id) for x in got) == want
    assert len({c for _, c in want}) == 8


def test_samples_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:220], r.integers(0, 1 << 62, 80).astype(np.uint64)])
    wa, wb = r.uniform(1, 4, 300), r.uniform(1, 4, 300)
    x, y = nd.sample(np.zeros(300, np.int64), a, wa, 1, 2000), nd.sample(np.zeros(300, np.int64), b, wb, 1, 2000)
    shared = np.minimum(wa[:220], wb[:220]).sum()
    assert abs((x == y).mean() - shared / (wa.sum() + wb.sum() - shared)) < 0.04


def test_frequent_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(nd, "RARE", 0.2)
    monkeypatch.setattr(nd, "_RUN", 50)
    r = random.Random(3)
    texts = [" ".join(r.choice(["a b c d e", "f g h i j", "k l m n o", "p q r s t"]) for _ in range(3)) for _ in range(100)]
    hashes, counts = nd._frequent(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 100)
    df = Counter()
    for t in texts:
        df.update(nd.shingles(TextSlice(pa.array([t])))[1].tolist())
    assert dict(zip(hashes.tolist(), counts.tolist(), strict=True)) == {h: c for h, c in df.items() if c >= 20}


def test_shingles_of_half_a_percent_are_counted(spark):
    texts = [f"a{i} b c d e" if i % 200 else "often said in some texts" for i in range(2000)]
    hashes, counts = nd._frequent(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 2000)
    h = nd.shingles(TextSlice(pa.array(["often said in some texts"])))[1]
    assert counts[hashes == h].tolist() == [10]
    assert 1 < nd.Weights(hashes, counts, 2000).of(h, np.ones(1))[0] < 1 + nd.SPAN


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    root = {v: v for e in links for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = {(v, find(v)) for e in links for v in e if e[0] != e[1]}
    assert {tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Each round costs the driver memory; that which changes nothing isn't needed to know the end."""
    rounds, whole = [], storage.persist
    monkeypatch.setattr("tessera.llm.components.persist", lambda df, name: rounds.append(name) or whole(df, name))
    stars = [(i, i - i % 10) for i in range(200)]
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    assert {tuple(x) for x in components(frame(stars)).collect()} == set(stars)
    assert not rounds
    assert {tuple(x) for x in components(frame([*stars, (15, 27), (60, 193)])).collect()} == {(a, {20: 10, 190: 60}.get(b, b)) for a, b in stars}
    assert 1 <= len(rounds) <= 2


def test_template_families_below_the_threshold_end(spark, monkeypatch):
    """85 % of each text is shared, which is a similarity of 0.74: nothing links, and no pair is compared after the stars."""
    r = random.Random(9)
    template, compared = [f"t{i}" for i in range(170)], []
    rows = [(i, " ".join([*[f"u{i}x{k}" for k in range(30)], *template])) for i in range(5000)]
    rows += [(6000 + i, " ".join([*[f"v{i // 2}x{k}" for k in range(30)], *template[: 169 + i % 2]])) for i in range(200)]
    r.shuffle(rows)
    whole = nd._verified
    monkeypatch.setattr(nd, "_verified", lambda docs, dealt, shared: compared.append(dealt.count()) or whole(docs, dealt, shared))
    got = {x.doc_id: x for x in nd.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i].class_id == i and got[i].n_links == 0 for i in range(5000))
    assert all(got[6000 + i].class_id == 6000 + i // 2 * 2 and got[6000 + i].n_links == 1 for i in range(200))
    assert len(compared) == 3 and compared[1] < 1000 and compared[2] == 0


def test_recall_against_all_pairs(spark):
    """All similar pairs of real documents, by the same weights: within one class."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    roots = {x.doc_id: x.class_id for x in nd.classes(frame).collect()}
    hashes, counts = nd._frequent(frame, len(rows))
    weights, bags = nd.Weights(hashes, counts, len(rows)), {}
    for d, t in rows:
        _, h, times = nd.shingles(TextSlice(pa.array([t])))
        bags[d] = (h, weights.of(h, times))
    pairs = [(a, b) for a in bags for b in bags if a < b and nd.similarity(bags[a], bags[b]) >= nd.SIMILAR]
    assert len(pairs) > 10
    assert sum(roots[a] == roots[b] for a, b in pairs) == len(pairs)
