"""Rows that every operator must take: nulls, empty, long, repeated, clashing names."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("n_tokens", T.StringType()),
    ]
)
LONG = " ".join(f"word{i % 97} été {i}," for i in range(30_000))
TEXTS = [
    None,
    "",
    " ",
    "a",
    "  two  spaces \n and\tlines \n\n",
    "The cat, the dog; it's <|endoftext|> here <|startoftext|> x",
    "ÉTÉ İstanbul ﬁne é ½ ² ß ΑΣ Σ \u0085 \xa0   \x1c \x00 ​",
    "mark ▁ in ▁▁text <s> </s> <0x41> 中文 😀😀",
    "one line\none line\nother | line\n",
    LONG,
    LONG,
    "x" * 50_000,
    "don't we'll I'D 'S 123 45.6 a_b",
]


def rows():
    out = [(i, t, "en" if i % 3 else None, None if i % 4 == 1 else "src", None, "c", "n") for i, t in enumerate(TEXTS)]
    return [*out, (3, "a", "en", "src", 1, None, None), (None, "the cat", None, None, None, None, None)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
