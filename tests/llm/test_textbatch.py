import random

import pyarrow as pa
import pytest

from tessera.llm import quality, repeated_phrases
from tessera.llm.textbatch import TextSlice

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    """2**n letters; such words and their complements collide under every polynomial hash mod 2**64."""
    out = "a"
    for _ in range(n):
        out += out.translate(SWAP)
    return out


def test_equal_words_and_runs_have_equal_hashes_and_others_not():
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abé中", k=r.choice([1, 3, 7, 8, 9, 16, 17, 64, 256, 257, 300]))) for _ in range(30)) for _ in range(40)]
    texts += ["", "a", "x y z x y z x y z"]
    s, known = TextSlice(pa.array(texts)), {}
    words = [w for t in texts for w in t.split()]
    for k in (1, 2, 3, 5, 7, 13):
        for i, h in enumerate(s.run_hash(k).tolist()):
            assert known.setdefault((*words[i : i + k],), h) == h
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("n", range(3, 14))
def test_thue_morse_words(n):
    x = thue_morse(n)
    y = x.translate(SWAP)
    s = TextSlice(pa.array([f"{x} {y}", " ".join(x + y)]))
    assert s.word_hash[0] != s.word_hash[1]
    runs = s.run_hash(len(x))
    assert runs[2] != runs[2 + len(x)]
    text = " ".join(f"p{i} {x if i % 2 else y} q" for i in range(2)) + f" p0 {x} q p1 {y} q"
    assert quality.n_repeat_words(TextSlice(pa.array([text]))).tolist() == [0]


def test_thue_morse_words_are_no_repeated_passage(spark):
    rows = []
    for n in (10, 13):
        x = thue_morse(n)
        for k, word in enumerate((x, x.translate(SWAP))):
            rows.append((2 * n + 1 - k, " ".join([f"n{n}", "a b c d e f", word, "g h i j k"])))
    for order in (rows, rows[::-1]):
        got = repeated_phrases.remove(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert [r.n_removed for r in got] == [0] * 4 and {r.n_words for r in got} == {13}
