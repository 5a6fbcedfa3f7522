import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.plans.compiler import Compiler, Typed, source_of
from tessera.plans.evaluate import Evaluator, apply_update, project
from tessera.plans.parser import parse_condition, parse_key_condition, parse_projection, parse_update
from tessera.sources.tagged_json import read_items
from tessera.values import ValidationError, canonical_number, item_size, tagged, validate

NUMBERS = [("1.0", "1"), ("+5", "5"), ("-0", "0"), ("1.50", "1.5"), ("007", "7"), ("1e2", "100"), ("1.5e-3", "0.0015"), ("-2.50e1", "-25"), ("0.000", "0"), (".5", "0.5")]


@pytest.mark.parametrize(("text", "want"), NUMBERS)
def test_canonical_numbers(text, want):
    assert canonical_number(text) == want


@pytest.mark.parametrize("text", ["", "x", "1.x", "--1", "1e", "."])
def test_bad_numbers(text):
    with pytest.raises(ValidationError):
        canonical_number(text)


@pytest.mark.parametrize("text", ["a =", "a = :b AND", "(a = :b", "a BETWEEN :x", "a IN :x", "SET a = :b", "a = :b c", "a = 5", "a[x] = :b", "NOT", "a IN (" + ",".join([":x"] * 129) + ")", "(" * 60 + "a = :b" + ")" * 60, "a = :" + "b" * 300])
def test_malformed(text):
    with pytest.raises(ValidationError):
        parse_condition(text)


def test_key_conditions():
    c = parse_key_condition("pk = :a AND begins_with(#s, :b)", {"#s": "sk"})
    assert (c.hash_name, c.range_name, c.op) == ("pk", "sk", "begins_with")
    assert parse_key_condition("pk = :a AND sk BETWEEN :b AND :c").op == "BETWEEN"
    for bad in ("pk > :a", "sk < :a AND pk = :b", "pk = :a AND sk <> :b", "pk = :a OR sk = :b", "pk = :a AND sk = other"):
        with pytest.raises(ValidationError):
            parse_key_condition(bad)


ITEMS = [
    {},
    {"a": {"N": "1"}, "b": {"N": "2"}, "s": {"S": "abc"}, "t": {"BOOL": True}, "z": {"NULL": True}},
    {"a": {"N": "2"}, "b": {"N": "2"}, "s": {"S": "été"}, "t": {"BOOL": False}, "u": {"SS": ["x", "abc"]}, "n": {"NS": ["1", "2"]}},
    {"a": {"S": "1"}, "b": {"N": "1.5"}, "s": {"S": ""}, "m": {"M": {"x": {"N": "1"}, "l": {"L": [{"S": "q"}, {"N": "3"}]}}}},
    {"a": {"NULL": True}, "b": {"NULL": True}, "y": {"B": "AAEC"}, "s": {"B": "AAE="}, "m": {"L": [{"N": "1"}]}},
    {"a": {"N": "-3"}, "s": {"S": "b"}, "y": {"B": "AA=="}, "u": {"SS": ["b"]}, "z": {"N": "1"}},
]
VALUES = {":one": {"N": "1"}, ":two": {"N": "2.0"}, ":s": {"S": "abc"}, ":b": {"S": "b"}, ":t": {"BOOL": True}, ":z": {"NULL": True}, ":bin": {"B": "AAE="}, ":tag": {"S": "N"}, ":null": {"S": "NULL"}, ":ss": {"S": "SS"}, ":x": {"S": "x"}}
OPERANDS = ["a", "b", "s", "t", "z", "y", "m.x", "m.l[1]", "m[0]", "#p", "none", "u", ":one", ":two", ":s", ":b", ":t", ":z", ":bin", ":missing", "size(s)", "size(u)", "size(m)", "size(a)", "m"]
NAMES = {"#p": "a", "#bad": "no good"}


def random_condition(r, depth=0):
    k = r.randrange(9) if depth < 3 else r.randrange(6)
    one = lambda: r.choice(OPERANDS)
    path = lambda: r.choice([o for o in OPERANDS if o[0] not in ":" and not o.startswith("size")])
    if k < 2:
        return f"{one()} {r.choice(['=', '<>', '<', '<=', '>', '>='])} {one()}"
    if k == 2:
        return f"{one()} BETWEEN {one()} AND {one()}"
    if k == 3:
        return f"{one()} IN ({', '.join(one() for _ in range(r.randrange(1, 4)))})"
    if k == 4:
        return f"attribute_{r.choice(['', 'not_'])}exists({path()})"
    if k == 5:
        return f"{r.choice(['begins_with', 'contains'])}({path()}, {r.choice([':s', ':b', ':x', ':one', ':bin', ':missing'])})" if r.random() < 0.7 else f"attribute_type({path()}, {r.choice([':tag', ':null', ':ss'])})"
    if k == 6:
        return f"NOT ({random_condition(r, depth + 1)})"
    return f"({random_condition(r, depth + 1)}) {r.choice(['AND', 'OR', 'and'])} ({random_condition(r, depth + 1)})"


def test_documents_agree_with_the_model(spark):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(ITEMS)], "i int, value string")
    items = rows.select("i", F.parse_json("value").alias("item"))
    r = random.Random(11)
    texts = [random_condition(r) for _ in range(150)]
    compiler = Compiler(source_of(items), VALUES)
    trees = [parse_condition(t, NAMES) for t in texts]
    for start in range(0, len(trees), 25):
        part = trees[start : start + 25]
        # As filters are used: null counts as false, at the top and below NOT.
        got = items.select("i", *[F.coalesce(compiler.where(t), F.lit(False)).alias(f"c{k}") for k, t in enumerate(part)]).collect()
        for row in got:
            for k, t in enumerate(part):
                assert row[f"c{k}"] == Evaluator(ITEMS[row.i], VALUES).true(t), (texts[start + k], ITEMS[row.i])


def test_typed_columns_agree_with_the_model(spark):
    schema = "i int, a long, b double, s string, t boolean, m struct<x:long,l:array<string>>, u array<string>"
    data = [(0, None, None, None, None, None, None), (1, 1, 2.0, "abc", True, (1, ["q", "b"]), ["x", "abc"]), (2, 2, 2.0, "été", False, (None, []), ["b"]), (3, 1, None, "b", None, (5, None), None), (4, None, 1.0, "", True, None, [])]
    df = spark.createDataFrame(data, schema)
    sets = frozenset({"u"})

    def item(row):
        out = {k: tagged(v) for k, v in row.asDict().items() if v is not None and k not in ("i", "m", "u")}
        if row.u is not None:
            out["u"] = {"SS": row.u}
        if row.m is not None:
            inner = {k: tagged(v) for k, v in row.m.asDict().items() if v is not None}
            out["m"] = {"M": inner}
        return out

    items = {r.i: item(r) for r in df.collect()}
    compiler = Compiler(Typed(df.schema, sets), VALUES)
    r = random.Random(5)
    texts = [t for t in (random_condition(r) for _ in range(400)) if "size(m)" not in t and "z" not in t.replace("size", "")][:200]
    for start in range(0, len(texts), 25):
        part = [parse_condition(t, NAMES) for t in texts[start : start + 25]]
        for row in df.select("i", *[F.coalesce(compiler.where(t), F.lit(False)).alias(f"c{k}") for k, t in enumerate(part)]).collect():
            for k, t in enumerate(part):
                assert row[f"c{k}"] == Evaluator(items[row.i], VALUES).true(t), (texts[start + k], items[row.i])


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for text, pushed in (("id = :k", "EqualTo(id,7)"), ("NOT id = :k", "Not(EqualNullSafe(id,7))"), ("NOT id < :k", "Or(IsNull(id),GreaterThanOrEqual(id,7))"), ("id IN (:k, :l)", "In(id"), ("NOT attribute_exists(v)", "IsNull(v)")):
        plan = df.where(Compiler(Typed(df.schema), {":k": 7, ":l": 9}).where(parse_condition(text)))._jdf.queryExecution().toString()
        assert pushed in plan, plan


def test_update_expressions():
    item = {"n": {"N": "1"}, "l": {"L": [{"N": "1"}, {"N": "2"}, {"N": "3"}]}, "s": {"SS": ["a", "b"]}, "m": {"M": {}}}
    up = lambda text, values=None: apply_update(item, parse_update(text), values)
    assert up("SET n = n + :a - :b", {":a": 5, ":b": 2})["n"] == {"N": "4"}
    assert up("SET n = if_not_exists(q, :a), q = n", {":a": 9})["q"] == {"N": "9"}
    assert up("REMOVE l[0], l[0]")["l"] == {"L": [{"N": "3"}]}
    assert up("SET l = list_append(l, :x), l[3] = :y", {":x": [1], ":y": "z"})["l"]["L"][3] == {"S": "z"}
    assert up("ADD n :a, s :c, k :a", {":a": 2, ":c": {"SS": ["b", "c"]}}) | {"l": 0, "m": 0} == {"n": {"N": "3"}, "s": {"SS": ["a", "b", "c"]}, "k": {"N": "2"}, "l": 0, "m": 0}
    assert "s" not in up("DELETE s :c", {":c": {"SS": ["a", "b"]}})
    assert up("SET m.x = :a", {":a": 1})["m"] == {"M": {"x": {"N": "1"}}}
    for bad in ("SET q.x = :a", "SET n = s + :a", "ADD n :t", "SET l[9] = :a", "SET n = :none"):
        with pytest.raises(ValidationError):
            up(bad, {":a": 1, ":t": "text"})
    assert item["n"] == {"N": "1"} and len(item["l"]["L"]) == 3


def test_projection_shapes():
    item = {"a": {"L": [{"M": {"b": {"N": "1"}, "c": {"N": "2"}}}]}, "d": {"M": {"e": {"S": "x"}, "f": {"S": "y"}}}}
    assert project(item, parse_projection("a[0].b, a[0].c, d.e, none.x")) == {"a": {"L": [{"M": {"b": {"N": "1"}}}, {"M": {"c": {"N": "2"}}}]}, "d": {"M": {"e": {"S": "x"}}}}


def test_sizes_and_limits():
    assert item_size({"ab": {"S": "é"}, "n": {"N": "12"}, "l": {"L": [{"BOOL": True}]}, "m": {"M": {"k": {"NULL": True}}}}) == 4 + 3 + (1 + 3 + 2) + (1 + 3 + 1 + 1 + 1)
    validate({"k": {"S": "a"}, "x": {"S": "y" * (400_000 - 3)}}, {"k": "S"})
    deep = {"N": "1"}
    for _ in range(40):
        deep = {"L": [deep]}
    for bad in ({"k": {"S": "a"}, "x": {"S": "y" * 400_000}}, {"k": {"S": ""}}, {"k": {"N": "1"}}, {}, {"k": {"S": "a"}, "x": deep}, {"k": {"S": "a"}, "x" * 256: {"N": "1"}}, {"k": {"S": "a"}, "x": {"SS": []}}, {"k": {"S": "a"}, "x": {"SS": ["a", "a"]}}, {"k": {"S": "a"}, "x": {"N": "1" * 39}}):
        with pytest.raises(ValidationError):
            validate(bad, {"k": "S"})


def test_items_from_json_lines(spark):
    lines = spark.createDataFrame([('{"k":{"S":"a"},"n":{"N":"5"}}',), ("broken",)], "value string")
    got = read_items(lines, {"k": "S", "n": "N"}).select("k", "n").collect()
    assert [tuple(r) for r in got] == [("a", 5.0), (None, None)]
