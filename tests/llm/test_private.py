import hashlib
import random
import re

import pytest

from tessera.llm import personal_data as p
from tests.llm import edge


def brute(text):
    def digits(x):
        return re.sub("[^0-9]", "", x)

    found = []
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(y) <= 255 for y in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits(x)[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ):
        found += [(m.start(), p.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return ",".join(f"{p.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_equals_the_patterns():
    r = random.Random(2)
    bits = ["a.b", "@", "x-y", ".", "com", " ", "+", "1", "25", "4111", "1111", "-", "(", ")", "255.", "@d.e", "٣", "é", "300.", "4111 1111 1111 1111", "+49 170 1234567", "0.0.0.0", "\n"]
    for _ in range(4000):
        t = "".join(r.choices(bits, k=r.randrange(1, 25)))
        base = p.base_spans(t)
        assert p.written(base) == brute(t), t
        spans = p.all_spans(t, base)
        assert all(set(base[k]) <= set(spans[k]) for k in p.KINDS)
        for found in spans.values():
            assert all(0 <= s < e <= len(t) for s, e in found)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail joe.doe (at) example [dot] com now", "email:5:35"),
        ("joe at example dot com", "email:0:22"),
        ("so jоe@exаmple.com", "email:3:18"),
        ("call plus four nine one seven two three four five six seven", "phone:5:59"),
        ("see 192[.]168[.]0[.]1", "ip:4:21"),
        ("four one one one one one one one one one one one one one one one", "card:0:64"),
        ("٤١١١ 1111 1111 1111", "card:0:19"),
        ("ｊoe＠ｅx.ｃom", "email:0:10"),
        ("joe (\u00a0at\u00a0) example [\u3000dot\u3000] com", "email:0:30"),
        ("joe@example\u00a0dot\u00a0com", "email:0:19"),
        ("look at this dot and at the dots", ""),
        ("one of the two or three, one two", ""),
        ("Ünï cødé „quotes“ – and dashes", ""),
    ],
)
def test_disguises(text, want):
    assert p.written(p.all_spans(text)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("at one nine two dot one six eight dot zero dot one now", "ip:3:50"),
        ("one zero.zero.zero.one", "ip:0:22"),
        ("10.zero.zero.one", "ip:0:16"),
        ("see one dot two dot three dot four", "ip:4:34"),
        ("one[dot]two[dot]three[dot]four", "ip:0:30"),
        ("jane at example dot pl", "email:0:22"),
        ("jane at mail dot example dot dev", "email:0:32"),
        ("one, two, three, four. five", ""),
        ("nine nine nine dot one dot one dot one", ""),
    ],
)
def test_short_spoken_forms(text, want):
    assert p.written(p.all_spans(text)) == want


def test_redaction():
    t = "a joe@x.org b 1.2.3.4 c"
    assert p.redacted(t, p.all_spans(t)) == "a [EMAIL] b [IP] c"


@pytest.mark.parametrize("rows", [edge.frame, edge.empty])
def test_op7_rows(spark, rows):
    docs = rows(spark)
    want = sorted((str(r.doc_id), hashlib.sha256(brute(r.text or "").encode()).hexdigest()) for r in docs.collect())
    got = p.scan(docs).collect()
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in r.spans.split(",") if x]) for r in got)
    redacted = p.redact(docs)
    assert redacted.schema == docs.schema and redacted.count() == docs.count()
    assert redacted.where("text is null").count() == docs.where("text is null").count()
