import random
import re
import time

import pytest

from tessera.llm import decontamination
from tests.llm import edge


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for d, text in docs:
        a, found = words(text), set()
        for item, t in items:
            b = words(t)
            w = min(13, len(b))
            need = 11 if len(b) >= 13 else len(b)
            if len(b) >= 8 and any(sum(x == y for x, y in zip(a[i : i + w], b[j : j + w], strict=True)) >= need for i in range(len(a) - w + 1) for j in range(len(b) - w + 1)):
                found.add(item)
        out.setdefault(d, set()).update(found)
    return out


@pytest.mark.parametrize("bound", [64, 0])
def test_equals_all_alignments(spark, bound):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([5, 8, 10, 12, 13, 14, 20, 40])))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(120):
        text = r.choices(vocabulary, k=r.randrange(0, 60))
        b = words(r.choice(items[:30])[1])
        for _ in range(r.randrange(0, 5)):
            b[r.randrange(len(b))] = "changed"
        at = r.randrange(len(text) + 1)
        docs.append((d // 2 if d % 10 == 0 else d, r.choice([", ", " ", "\n"]).join(text[:at] + b + text[at:])))
    docs += [(None, items[8][1]), (None, "clean")]
    got = decontamination.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_mb=bound).collect()
    want = brute(docs, items)
    assert len(got) == len(docs) and sum(x.contaminated for x in got) > 20
    short = {i: words(t) for i, t in items if 0 < len(words(t)) < 8}
    for x in got:
        texts = [words(t) for d, t in docs if d == x.doc_id]
        assert x.short_item_ids == [i for i, b in short.items() if any(w[k : k + len(b)] == b for w in texts for k in range(len(w)))]
        assert set(x.item_ids) == want[x.doc_id] and x.contaminated == bool(want[x.doc_id]) and x.n_items == len(want[x.doc_id])


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_edge_rows(spark, rows):
    docs = rows(spark)
    items = spark.createDataFrame([(1, "the cat the dog it s endoftext here startoftext x"), (2, None)], "item_id long, text string")
    got = decontamination.find(docs, items).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    assert {r.doc_id for r in got if r.contaminated} == ({5} if got else set())
    assert decontamination.clean(docs, items).count() == len([r for r in got if not r.contaminated])
    assert decontamination.clean(docs, items).columns == docs.columns
    assert decontamination.find(docs, items.limit(0)).where("contaminated").count() == 0


def test_repeated_tokens_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "a " * 100_000), (2, "a b " * 50_000), (3, "a " * 39 + "b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a " * 40), (2, "c " * 40)], "item_id long, text string")
    begun = time.monotonic()
    got = {r.doc_id: (r.item_ids, r.matched) for r in decontamination.find(docs, items).collect()}
    assert got == {1: ([1], 13), 2: ([], None), 3: ([1], 13)} and time.monotonic() - begun < 60


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    links = decontamination._links(docs, docs.withColumnRenamed("doc_id", "item_id"), "doc_id", "text", 64)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert not any("text" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line) and "Python" not in plan
