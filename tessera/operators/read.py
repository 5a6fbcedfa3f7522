"""Reads: get, query, scan, pages, segments, batches; all lazy, on any table.

A table is a DataFrame whose key columns are native columns.  Null in a native
column means that the item lacks the attribute.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import columns as C
from ..plans.compiler import Compiler, Typed, literal, source_of
from ..plans.parser import KeyCondition, NOWHERE, parse_condition, parse_key_condition, parse_projection
from ..values import ValidationError

PAGE_BYTES, PAGE_ITEMS = 1 << 20, 1000


@dataclass
class Request:
    """What a query or scan asks for, beside its key condition."""

    filter: str | None = None
    projection: str | None = None
    names: dict[str, str] = field(default_factory=dict)
    values: dict[str, Any] = field(default_factory=dict)
    forward: bool = True
    limit: int | None = None
    start: dict[str, Any] | None = None
    segment: tuple[int, int] | None = None
    ttl: str | None = None
    now: int | None = None
    sets: frozenset[str] = frozenset()


def key_column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValidationError(f"no attribute {name!r}")
    return F.col(f"`{name}`")


def _literal(df: DataFrame, name: str, value: Any) -> Column:
    return next(iter(literal(value, df.schema[name].dataType).columns.values()))


def get_item(df: DataFrame, key: dict[str, Any], request: Request | None = None) -> DataFrame:
    """The item of one key; expired ones are hidden."""
    r = request or Request()
    same = [key_column(df, k) == _literal(df, k, v) for k, v in key.items()]
    return project(alive(df.where(reduce(lambda a, b: a & b, same)), r), r)


def alive(df: DataFrame, r: Request) -> DataFrame:
    return df.where(C.live(F.col(f"`{r.ttl}`"), r.now)) if r.ttl and r.now is not None and r.ttl in df.columns else df


def filtered(df: DataFrame, r: Request) -> DataFrame:
    if not r.filter:
        return df
    return df.where(Compiler(source_of(df, r.sets), r.values).where(parse_condition(r.filter, r.names)))


def key_filter(df: DataFrame, condition: KeyCondition, keys: list[str], values: dict[str, Any]) -> Column:
    if condition.hash_name != keys[0]:
        raise ValidationError(f"the partition key is {keys[0]}")
    if condition.range_name is not None and condition.range_name not in keys[1:2]:
        raise ValidationError(f"{condition.range_name} isn't the sort key")
    for v in (condition.hash_value, *condition.values):
        if v.name not in values:
            raise ValidationError(f"no value {v.name}")
    out = key_column(df, keys[0]) == _literal(df, keys[0], values[condition.hash_value.name])
    if condition.op is None:
        return out
    column = key_column(df, condition.range_name)
    given = [_literal(df, condition.range_name, values[v.name]) for v in condition.values]
    if condition.op == "BETWEEN":
        return out & column.between(*given)
    if condition.op == "begins_with":
        if not isinstance(df.schema[condition.range_name].dataType, T.StringType):
            raise ValidationError("begins_with is for text")
        return out & F.startswith(column, given[0])
    compare = {"=": column == given[0], "<": column < given[0], "<=": column <= given[0], ">": column > given[0], ">=": column >= given[0]}
    return out & compare[condition.op]


def ordered(df: DataFrame, order: list[str], forward: bool = True) -> DataFrame:
    cols = [key_column(df, k) for k in order]
    return df.orderBy(*[c.asc() if forward else c.desc() for c in cols])


def after(df: DataFrame, order: list[str], start: dict[str, Any], forward: bool = True) -> Column:
    """Strictly past the key ``start`` in that order."""
    out = F.lit(False)
    for k in reversed(order):
        column, value = key_column(df, k), _literal(df, k, start[k])
        out = (column > value if forward else column < value) | ((column == value) & out)
    return out


def _read(df: DataFrame, order: list[str], r: Request) -> DataFrame:
    """Order, cursor and limit; the limit counts rows before the filter."""
    if r.start:
        df = df.where(after(df, order, r.start, r.forward))
    df = ordered(df, order, r.forward)
    return df.limit(min(r.limit, PAGE_ITEMS)) if r.limit and r.limit > 0 else df


def query(df: DataFrame, keys: list[str], condition: str, request: Request | None = None, tail: list[str] | None = None) -> DataFrame:
    """One partition in order of the sort key.  ``tail`` orders items of equal
    keys: for an index, the table's own keys."""
    r = request or Request()
    found = df.where(key_filter(df, parse_key_condition(condition, r.names), keys, r.values))
    order = [k for k in [*keys[1:], *(tail or [])] if k not in keys[:1]] or keys
    return project(filtered(_read(alive(found, r), order, r), r), r)


def scan(df: DataFrame, keys: list[str], request: Request | None = None) -> DataFrame:
    """The whole table; in order only if a limit or a cursor needs it."""
    r = request or Request()
    rows = df
    if r.limit or r.start:
        rows = _read(rows, keys, r)
    if r.segment:
        rows = segment(rows, keys, *r.segment)
    return project(filtered(alive(rows, r), r), r)


def key_conditions(conditions: dict[str, tuple[str, list[Any]]]) -> tuple[str, dict[str, str], dict[str, Any]]:
    """The legacy form {name: (operator, values)} as a key condition with its
    names and values."""
    signs = {"EQ": "=", "LT": "<", "LE": "<=", "GT": ">", "GE": ">="}
    parts, names, values = [], {}, {}
    for i, (name, (op, given)) in enumerate(conditions.items()):
        names[f"#k{i}"] = name
        marks = [f":k{i}{j}" for j in range(len(given))]
        values |= dict(zip(marks, given, strict=True))
        if len(given) != (2 if op == "BETWEEN" else 1) or op not in (*signs, "BETWEEN", "BEGINS_WITH"):
            raise ValidationError(f"no key condition {op}")
        parts.append(f"#k{i} BETWEEN {marks[0]} AND {marks[1]}" if op == "BETWEEN" else f"begins_with(#k{i}, {marks[0]})" if op == "BEGINS_WITH" else f"#k{i} {signs[op]} {marks[0]}")
    return " AND ".join(parts), names, values


def selected(df: DataFrame, select: str, request: Request, index: list[str] | None = None) -> DataFrame:
    """What Select asks for: ALL_ATTRIBUTES, ALL_PROJECTED_ATTRIBUTES (of an
    index, whose columns are given), SPECIFIC_ATTRIBUTES or COUNT."""
    if select == "COUNT":
        if request.projection:
            raise ValidationError("COUNT takes no projection")
        return count(df, request)
    if select == "SPECIFIC_ATTRIBUTES" and not request.projection:
        raise ValidationError("SPECIFIC_ATTRIBUTES takes a projection")
    rows = scan(df, list(df.columns[:1]), request)
    return rows.select(*index) if select == "ALL_PROJECTED_ATTRIBUTES" and index else rows


def count(df: DataFrame, request: Request) -> DataFrame:
    """Count and ScannedCount in one pass."""
    pred = Compiler(source_of(df, request.sets), request.values).where(parse_condition(request.filter, request.names)) if request.filter else F.lit(True)
    return df.agg(F.count_if(F.coalesce(pred, F.lit(False))).alias("Count"), F.count("*").alias("ScannedCount"))


def segment_hash(df: DataFrame, keys: list[str]) -> Column:
    typed = Typed(df.schema)
    parts = [C.encoded_key(key_column(df, k), typed.tag(df.schema[k].dataType)) for k in keys]
    return C.fnv1a(F.concat(*parts))


def segment(df: DataFrame, keys: list[str], i: int, n: int, exact: bool = False) -> DataFrame:
    """The i-th of n disjoint parts.  ``exact`` deals by the 64-bit FNV hash of
    the encoded key; otherwise by Spark's own hash, which stays in compiled code."""
    if not (1 <= n <= 1_000_000 and 0 <= i < n):
        raise ValidationError("not a segment")
    if exact:
        return df.where(F.pmod(segment_hash(df, keys), F.lit(n).cast("decimal(20,0)")) == i)
    return df.where(F.pmod(F.xxhash64(*[key_column(df, k) for k in keys]), F.lit(n)) == i)


def page(df: DataFrame, keys: list[str], request: Request | None = None, most: int = PAGE_BYTES) -> DataFrame:
    """The first page: at most PAGE_ITEMS rows and ``most`` bytes, one row at
    least.  The window runs over a limited set, so one task for it is enough."""
    r = request or Request()
    rows = df.where(after(df, keys, r.start, r.forward)) if r.start else df
    rows = ordered(rows, keys, r.forward).limit(min(r.limit or PAGE_ITEMS, PAGE_ITEMS))
    order = [key_column(df, k).asc() if r.forward else key_column(df, k).desc() for k in keys]
    sized = rows.withColumn("__size", C.item_size(df, r.sets))
    over = Window.orderBy(*order)
    sized = sized.withColumn("__sum", F.sum("__size").over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__row", F.row_number().over(over))
    return sized.where((F.col("__sum") <= most) | (F.col("__row") == 1)).drop("__size", "__sum", "__row")


def top_of_partitions(df: DataFrame, keys: list[str], n: int, forward: bool = True) -> DataFrame:
    """The first n rows of every partition at once.  Spark turns the rank
    filter into a limit before the shuffle, so a hot partition sends few rows."""
    order = [key_column(df, k).asc() if forward else key_column(df, k).desc() for k in keys[1:]]
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order))).where(F.col("rn") <= n)


#: More keys than this are no request but a table, and are joined as one.
BROADCAST_KEYS = 10_000


def batch_get(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The items of a table of keys; missing ones give no row.  The keys of a
    request, counted up to a bound, go to the scan of the table."""
    wanted = wanted.select(*keys).distinct()
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(wanted) if few else wanted, keys, "left_semi")


def pages(df: DataFrame, keys: list[str], request: Request | None = None, most: int = PAGE_BYTES) -> Iterator[tuple[DataFrame, dict[str, Any] | None]]:
    """Pages and their LastEvaluatedKey, each page from the key of the one
    before it, until one comes out empty.  Only that key reaches the driver."""
    r = request or Request()
    while True:
        rows = page(df, keys, r, most)
        last = ordered(rows.select(*keys), keys, not r.forward).limit(1).collect()
        if not last:
            return
        key = last[0].asDict()
        yield rows, key
        r = replace(r, start=key)


def positional_get(df: DataFrame, wanted: DataFrame, keys: list[str], place: str) -> DataFrame:
    """A row for each wanted key, in its place; nulls where there is none."""
    rest = [c for c in df.columns if c not in keys]
    return wanted.join(df, keys, "left").select(place, *keys, *rest).orderBy(place)


def project(df: DataFrame, r: Request) -> DataFrame:
    if not r.projection:
        return df
    paths = [p for p in parse_projection(r.projection, r.names) if NOWHERE not in p.steps and p.name in df.columns]
    names = list(dict.fromkeys(p.name for p in paths))
    return df.select(*[_picked(F.col(f"`{n}`"), df.schema[n].dataType, [p.steps[1:] for p in paths if p.name == n]).alias(n) for n in names])


def _picked(column: Column, kind: T.DataType, tails: list[tuple]) -> Column:
    """What the paths below a value pick from it, in its shape; the picks from
    a list stand side by side, one for each path."""
    if any(not t for t in tails):
        return column
    if isinstance(kind, T.ArrayType):
        picks = [_picked(F.get(column, F.lit(t[0])), kind.elementType, [t[1:]]) for t in tails if isinstance(t[0], int)]
        return F.array_compact(F.array(*picks)) if picks else F.lit(None)
    if isinstance(kind, T.StructType):
        names = [n for n in dict.fromkeys(t[0] for t in tails) if n in kind.fieldNames()]
        parts = [_picked(column.getField(n), kind[n].dataType, [t[1:] for t in tails if t[0] == n]).alias(n) for n in names]
        return F.when(column.isNotNull(), F.struct(*parts)) if parts else F.lit(None)
    if isinstance(kind, T.MapType):
        names = list(dict.fromkeys(t[0] for t in tails if isinstance(t[0], str)))
        return F.map_filter(column, lambda k, _: k.isin(names))
    return F.lit(None)


