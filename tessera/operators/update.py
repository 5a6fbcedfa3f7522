"""Update expressions on native columns.

The steps of an expression run from left to right and each sees what the ones
before it made, so they fold over a map of columns; the table is only touched by
the last ``select``.  An item on which a step fails (a place past the end of a
list, a container that isn't there) stays as it was, with the reason in the
``error`` column if one is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.ast import Call, Path, Sum, Update, Value
from ..plans.compiler import literal
from ..plans.parser import parse_update
from ..values import ValidationError, plain, tagged


@dataclass
class _Fold:
    kinds: dict[str, T.DataType]
    columns: dict[str, Column]
    values: dict[str, Any]
    sets: frozenset[str]
    df: DataFrame
    touched: list[str] = field(default_factory=list)
    failed: list[Column] = field(default_factory=list)

    def has(self, path: Path) -> bool:
        try:
            self.read(path)
        except ValidationError:
            return False
        return True

    def read(self, path: Path) -> tuple[Column, T.DataType]:
        if path.name not in self.columns:
            raise ValidationError(f"no attribute {path.name!r}")
        column, kind = self.columns[path.name], self.kinds[path.name]
        for step in path.steps[1:]:
            if isinstance(kind, T.StructType) and step in kind.fieldNames():
                column, kind = column.getField(step), kind[step].dataType
            elif isinstance(kind, T.MapType) and isinstance(step, str):
                column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
            elif isinstance(kind, T.ArrayType) and isinstance(step, int):
                column, kind = F.get(column, F.lit(step)), kind.elementType
            else:
                raise ValidationError(f"no path {path.steps}")
        return column, kind

    def operand(self, node: object, like: T.DataType | None = None) -> Column:
        if isinstance(node, Value):
            if node.name not in self.values:
                raise ValidationError(f"no value {node.name}")
            value = self.values[node.name]
            if isinstance(like, T.ArrayType):
                x = plain(tagged(value)) if not isinstance(value, (list, set, tuple)) else value
                return F.array(*[F.lit(v) for v in x]).cast(like)
            return next(iter(literal(value, like).columns.values()))
        if isinstance(node, Path):
            return self.read(node)[0]
        if isinstance(node, Sum):
            out = self.operand(node.first, like)
            for sign, x in node.rest:
                out = out + self.operand(x, like) if sign == "+" else out - self.operand(x, like)
            return out
        if isinstance(node, Call) and node.name == "if_not_exists" and len(node.args) == 2:
            other = self.operand(node.args[1], like)
            return F.coalesce(self.operand(node.args[0], like), other) if self.has(node.args[0]) else other
        if isinstance(node, Call) and node.name == "list_append" and len(node.args) == 2:
            return F.concat(self.operand(node.args[0], like), self.operand(node.args[1], like))
        raise ValidationError("not an operand of SET")

    def write(self, path: Path, value: Column | None) -> None:
        self.touched.append(path.name)
        self.columns[path.name] = _put(self.columns[path.name], self.kinds[path.name], path.steps[1:], value, self.failed)

    def make(self, name: str, value: Column) -> None:
        """A new attribute, or one of a new type."""
        self.touched.append(name)
        self.columns[name], self.kinds[name] = value, self.df.select(value).schema[0].dataType

    def apply(self, step: Update) -> None:
        name, whole = step.path.name, len(step.path.steps) == 1
        if step.kind == "REMOVE":
            if self.has(step.path):
                self.write(step.path, None)
            return
        if name not in self.columns and whole and step.kind in ("SET", "ADD"):
            given = self.values.get(step.operand.name) if isinstance(step.operand, Value) else None
            if isinstance(given, dict) and next(iter(given)) in ("SS", "NS", "BS"):
                self.sets |= {name}
                self.make(name, F.array(*[F.lit(v) for v in plain(given)]))
            else:
                self.make(name, self.operand(step.operand))
            return
        if name not in self.columns and step.kind == "DELETE":
            return
        if step.kind == "SET" and isinstance(step.path.steps[-1], int) and not self.has(step.path):
            raise ValidationError(f"no path {step.path.steps}")
        column, kind = self.read(step.path)
        is_set = name in self.sets and whole
        if step.kind == "SET":
            self.write(step.path, self.operand(step.operand, kind).cast(kind))
        elif step.kind == "ADD" and is_set:
            extra = self.operand(step.operand, kind)
            self.write(step.path, F.array_union(F.coalesce(column, F.array().cast(kind)), extra))
        elif step.kind == "ADD" and isinstance(kind, T.NumericType):
            self.write(step.path, (F.coalesce(column, F.lit(0)) + self.operand(step.operand, kind)).cast(kind))
        elif step.kind == "DELETE" and is_set:
            left = F.array_except(column, self.operand(step.operand, kind))
            self.write(step.path, F.when(F.size(left) > 0, left))
        elif step.kind == "ADD" and whole:
            self.make(name, self.operand(step.operand))  # a number onto something else takes its place
        elif step.kind == "ADD":
            raise ValidationError("ADD is for numbers and sets")


def _put(column: Column, kind: T.DataType, steps: tuple, value: Column | None, failed: list[Column]) -> Column:
    """The value with one place in it replaced, or removed if value is None.

    A place at the end of a list appends; one past it fails, as does a container
    that isn't there.  What isn't there can be removed without harm.
    """
    if not steps:
        return F.lit(None).cast(kind) if value is None else value
    step, rest = steps[0], steps[1:]
    if value is not None:
        failed.append(column.isNull())
    if isinstance(kind, T.StructType):
        inner = kind[step].dataType
        return F.when(column.isNotNull(), column.withField(step, _put(column.getField(step), inner, rest, value, failed)))
    if isinstance(kind, T.MapType):
        if value is None and not rest:
            return F.map_filter(column, lambda k, _: k != step)
        new = _put(F.try_element_at(column, F.lit(step)), kind.valueType, rest, value, failed)
        return F.map_concat(F.map_filter(column, lambda k, _: k != step), F.create_map(F.lit(step), new))
    if isinstance(kind, T.ArrayType):
        if value is None and not rest:
            return F.filter(column, lambda _, i: i != step)
        if value is not None and not rest:
            failed.append(F.size(column) < step)
        new = _put(F.get(column, F.lit(step)), kind.elementType, rest, value, failed)
        placed = F.transform(column, lambda x, i: F.when(i == step, new).otherwise(x))
        return F.when((F.size(column) != step) | F.lit(value is None or bool(rest)), placed).otherwise(F.concat(column, F.array(new)))
    raise ValidationError("not a container")


def updated(df: DataFrame, expression: str, values: dict[str, Any] | None = None, names: dict[str, str] | None = None, *, keys: tuple[str, ...] = (), sets: frozenset[str] = frozenset(), error: str | None = None) -> tuple[list[Column], list[str]]:
    """The columns after the update, and the names it touches; with ``error``
    also a column of that name, null where the update was made."""
    fold = _Fold({f.name: f.dataType for f in df.schema}, {c: F.col(f"`{c}`") for c in df.columns}, values or {}, sets, df)
    for step in parse_update(expression, names):
        if step.path.name in keys:
            raise ValidationError("key attributes can't be updated")
        fold.apply(step)
    bad = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in fold.failed]) if fold.failed else None

    def final(c: str) -> Column:
        if bad is None or c not in fold.touched:
            return fold.columns[c].alias(c)
        old = F.col(f"`{c}`").cast(fold.kinds[c]) if c in df.columns else F.lit(None)
        return F.when(bad, old).otherwise(fold.columns[c]).alias(c)

    out = [final(c) for c in fold.columns]
    if error:
        out.append((F.lit(None).cast("string") if bad is None else F.when(bad, "ValidationException")).alias(error))
    return out, list(dict.fromkeys(fold.touched))


def update(df: DataFrame, expression: str, values: dict[str, Any] | None = None, names: dict[str, str] | None = None, **options: Any) -> DataFrame:
    return df.select(*updated(df, expression, values, names, **options)[0])


def returned(df: DataFrame, expression: str, which: str, keys: list[str], values: dict[str, Any] | None = None, names: dict[str, str] | None = None, **options: Any) -> DataFrame:
    """Keys and what ReturnValues shows: ALL_OLD, ALL_NEW, or with UPDATED_OLD
    and UPDATED_NEW only attributes that changed."""
    columns, touched = updated(df, expression, values, names, keys=tuple(keys), **options)
    if which == "ALL_OLD":
        return df
    if which == "ALL_NEW":
        return df.select(*columns)
    if which == "NONE":
        return df.select(*keys).limit(0)
    both = df.select(F.struct(*df.columns).alias("__old"), *columns)
    old = {c: F.col(f"__old.`{c}`") if c in df.columns else F.lit(None) for c in touched}
    shown = [F.when(~F.col(f"`{c}`").eqNullSafe(old[c]), F.col(f"`{c}`") if which == "UPDATED_NEW" else old[c]).alias(c) for c in touched]
    return both.select(*keys, *shown)
