import hashlib
import random
import re

import pytest

from tessera.llm import repeated_phrases
from tests.llm import edge


def brute(rows):
    docs = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - 12):
                key = tuple(w[i : i + 13])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus():
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "中文", "a|b"]
    passages = [r.choices(vocabulary, k=n) for n in (13, 14, 20, 60, 200)]
    rows = []
    for d in range(150):
        words = r.choices(vocabulary, k=r.randrange(0, 80))
        for _ in range(r.randrange(0, 3)):
            at, p = r.randrange(len(words) + 1), r.choice(passages)
            a = r.randrange(0, len(p) - 11)
            words[at:at] = p[a : a + r.randrange(5, 80)]
        rows.append((d, "".join(w + r.choice([" ", "  ", "\n"]) for w in words)))
    rows += [(d + 200, rows[d][1]) for d in range(40)] + [(900, rows[7][1]), (901, rows[7][1]), (901, rows[7][1]), (901, "other " * 40)]
    rows += [(902, "other " * 40), (None, rows[7][1]), (3, rows[149][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("megabytes", "block", "runs"), [(32, 1 << 20, 20_000), (0, 200, 10)])
def test_equals_brute_force(spark, monkeypatch, megabytes, block, runs):
    monkeypatch.setattr(repeated_phrases, "FILTER_MB", megabytes)
    monkeypatch.setattr(repeated_phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeated_phrases, "SHARD_RUNS", runs)
    rows = corpus()
    got = repeated_phrases.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_edge_rows(spark, rows):
    docs = rows(spark)
    got = repeated_phrases.remove(docs, texts=True).collect()
    assert sorted((str(r[0]), *r[1:4]) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
