"""Condition trees to Spark columns.

The language has two truth values: a comparison with a missing operand, or of
two types, is false, and NOT of it true.  SQL has three.  Filters therefore
depend on where a comparison stands: as it is under no NOT, where WHERE drops
null, and under NOT in the form that keeps null and still reaches the file scan.
Two kinds of table are read through one interface: typed columns, where null is
"missing", and a VARIANT of tagged JSON, where ``{"NULL": true}`` is a value.
"""

from __future__ import annotations

import base64
import datetime
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..values import Tagged, ValidationError, tag_of, tagged
from .ast import And, Bare, Between, Call, Compare, In, Not, Or, Path, Value
from .parser import NOWHERE

OPPOSITE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
ORDERED = ("S", "N", "B", "T")
_APPLY = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@dataclass
class Operand:
    """What a path, value or function gives: a column for each tag it can have.
    ``exists`` tells whether it is there; ``constant`` marks request values."""

    columns: dict[str, Column]
    exists: Column
    constant: bool = False
    raw: Any = None


ABSENT = None


def literal(value: Any, kind: T.DataType | None = None) -> Operand:
    """A request value: Python or tagged; for a number, of a type that leaves
    the column it is compared with as it is."""
    if isinstance(value, (datetime.datetime, datetime.date)):
        return Operand({"T": F.lit(value)}, F.lit(True), True, value)
    value = tagged(value)
    tag = tag_of(value)
    x = value[tag]
    if tag == "N":
        d = Decimal(x)
        whole = d == d.to_integral_value() and abs(d) < 1 << 63
        column = F.lit(int(d)) if whole else F.lit(d) if isinstance(kind, T.DecimalType) else F.lit(float(d))
    elif tag == "B":
        column = F.lit(base64.b64decode(x))
    elif tag in ("SS", "BS", "NS"):
        column = F.array(*[F.lit(v) for v in x])
    elif tag in ("M", "L", "NULL"):
        column = F.lit(None)
    else:
        column = F.lit(x)
    return Operand({tag: column}, F.lit(True), True, value)


class Typed:
    """Operands of a table with native columns.  ``sets`` names array columns
    that are sets, not lists."""

    def __init__(self, schema: T.StructType, sets: frozenset[str] = frozenset()):
        self.schema, self.sets = schema, sets

    def tag(self, kind: T.DataType, name: str = "") -> str:
        if isinstance(kind, T.NumericType):
            return "N"
        if isinstance(kind, T.ArrayType):
            return ("NS" if isinstance(kind.elementType, T.NumericType) else "SS") if name in self.sets else "L"
        plain = {T.StringType: "S", T.BinaryType: "B", T.BooleanType: "BOOL", T.StructType: "M", T.MapType: "M", T.NullType: "NULL"}
        return plain.get(type(kind), "T")

    def path(self, path: Path) -> Operand | None:
        name = path.steps[0]
        if name not in self.schema.fieldNames():
            return ABSENT
        column, kind = F.col(f"`{name}`"), self.schema[name].dataType
        for step in path.steps[1:]:
            if isinstance(kind, T.StructType) and isinstance(step, str) and step in kind.fieldNames():
                column, kind = column.getField(step), kind[step].dataType
            elif isinstance(kind, T.MapType) and isinstance(step, str):
                column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
            elif isinstance(kind, T.ArrayType) and isinstance(step, int) and path.name not in self.sets:
                column, kind = F.get(column, F.lit(step)), kind.elementType
            else:
                return ABSENT
        return Operand({self.tag(kind, str(name) if len(path.steps) == 1 else ""): column}, column.isNotNull(), raw=kind)


class Document:
    """Operands of a VARIANT column of tagged JSON."""

    def __init__(self, column: str = "item"):
        self.column = column

    def path(self, path: Path) -> Operand | None:
        if NOWHERE in path.steps:
            return ABSENT
        where = f"$['{path.name}']"
        for step in path.steps[1:]:
            where += f".M['{step}']" if isinstance(step, str) else f".L[{step}]"
        item = F.col(self.column)

        def get(tail: str, kind: str) -> Column:
            return F.try_variant_get(item, where + tail, kind)

        columns = {"S": get(".S", "string"), "N": get(".N", "double"), "B": F.unbase64(get(".B", "string")), "BOOL": get(".BOOL", "boolean"), "NULL": get(".NULL", "boolean"), "M": get(".M", "map<string,variant>"), "L": get(".L", "array<variant>"), "SS": get(".SS", "array<string>"), "NS": get(".NS", "array<string>"), "BS": get(".BS", "array<string>")}
        return Operand(columns, get("", "variant").isNotNull(), raw=get(".N", "string"))


@dataclass
class Compiler:
    source: Typed | Document
    values: dict[str, Any] = field(default_factory=dict)

    def operand(self, node: object, like: Operand | None = None) -> Operand | None:
        if isinstance(node, Value):
            if node.name not in self.values:
                return ABSENT
            return literal(self.values[node.name], like.raw if like and isinstance(like.raw, T.DataType) else None)
        if isinstance(node, Path):
            return ABSENT if NOWHERE in node.steps else self.source.path(node)
        if isinstance(node, Call) and node.name == "size" and len(node.args) == 1 and isinstance(node.args[0], Path):
            return self._size(self.operand(node.args[0]))
        return ABSENT

    @staticmethod
    def _size(of: Operand | None) -> Operand | None:
        if of is None:
            return ABSENT
        found = [F.octet_length(c) if t in ("S", "B") else F.cardinality(c) for t, c in of.columns.items() if t in ("S", "B", "M", "L", "SS", "NS", "BS")]
        if not found:
            return ABSENT
        # cardinality of null is -1 or null by setting; a size is never below 0.
        found = [F.when(c >= 0, c.cast("long")) for c in found]
        column = F.coalesce(*found) if len(found) > 1 else found[0]
        return Operand({"N": column}, column.isNotNull())

    def _pairs(self, left: object, right: object) -> tuple[list[tuple[str, Column, Column]], bool]:
        """The columns to compare, by common tag, and whether one side is a
        constant."""
        a = self.operand(left)
        b = self.operand(right, a)
        a = self.operand(left, b) if isinstance(left, Value) else a
        if a is None or b is None:
            return [], False
        return [(t, c, b.columns[t]) for t, c in a.columns.items() if t in b.columns], a.constant or b.constant

    def _compare(self, op: str, left: object, right: object, negated: bool) -> Column:
        pairs, constant = self._pairs(left, right)
        found = []
        for tag, a, b in pairs:
            if tag in ORDERED or tag == "BOOL" and op in ("=", "<>"):
                found.append((a, b, op))
            elif tag == "NULL" and op == "=":  # two of them are equal, never unequal
                there = [c.isNotNull() for c, node in ((a, left), (b, right)) if not isinstance(node, Value)]
                found.append((_all(there) if there else F.lit(True), F.lit(True), "="))
        if not found:
            return F.lit(negated)
        if not negated:
            out = [_APPLY[o](a, b) for a, b, o in found]
            return _any([c if len(found) == 1 else F.coalesce(c, F.lit(False)) for c in out])
        if len(found) == 1 and constant:
            a, b, o = found[0]
            if isinstance(left, Value) and not isinstance(right, Value):
                a, b, o = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(o, o)
            return ~a.eqNullSafe(b) if o == "=" else a.isNull() | _APPLY[OPPOSITE[o]](a, b)
        return ~_any([F.coalesce(_APPLY[o](a, b), F.lit(False)) for a, b, o in found])

    def where(self, node: object, negated: bool = False) -> Column:
        """For a filter; true exactly where the condition (or its negation)
        holds, null allowed elsewhere."""
        if isinstance(node, Not):
            return self.where(node.part, not negated)
        if isinstance(node, (And, Or)):
            parts = [self.where(p, negated) for p in node.parts]
            return _all(parts) if isinstance(node, And) != negated else _any(parts)
        if isinstance(node, Compare):
            return self._compare(node.op, node.left, node.right, negated)
        if isinstance(node, Between):
            low, high = Compare(">=", node.operand, node.low), Compare("<=", node.operand, node.high)
            return self.where(And((low, high)), negated)
        if isinstance(node, In):
            return self._in(node, negated)
        if isinstance(node, Bare) and isinstance(node.operand, Call):
            return self._call(node.operand, negated)
        return F.lit(negated)

    def value(self, node: object) -> Column:
        """For a projection: true or false, never null."""
        return F.coalesce(self.where(node), F.lit(False))

    def _in(self, node: In, negated: bool) -> Column:
        of = self.operand(node.operand)
        choices = [self.operand(c, of) for c in node.choices]
        if of is not None and len(of.columns) == 1 and choices and all(c is not None and c.constant for c in choices):
            (tag, column), *_ = of.columns.items()
            same = [c.columns[tag] for c in choices if tag in c.columns] if tag in (*ORDERED, "BOOL") else []
            if not same:
                return F.lit(negated)
            return column.isNull() | ~column.isin(same) if negated else column.isin(same)
        parts = [self._compare("=", node.operand, c, negated) for c in node.choices]
        return (_all(parts) if negated else _any(parts)) if parts else F.lit(negated)

    def _call(self, call: Call, negated: bool) -> Column:
        name, args = call.name, call.args
        if name in ("attribute_exists", "attribute_not_exists") and len(args) == 1:
            of = self.operand(args[0])
            if of is None:
                return F.lit((name == "attribute_not_exists") != negated)
            return of.exists if (name == "attribute_exists") != negated else ~of.exists
        if len(args) != 2:
            return F.lit(negated)
        a, b = self.operand(args[0]), self.operand(args[1])
        if a is None or b is None:
            return F.lit(negated)
        found: list[Column] = []
        if name == "begins_with":
            found = [F.startswith(a.columns[t], b.columns[t]) for t in ("S", "B") if t in a.columns and t in b.columns]
        elif name == "contains":
            for outer, inner in (("S", "S"), ("SS", "S"), ("NS", "N")):
                if outer in a.columns and inner in b.columns:
                    whole, part = a.columns[outer], b.columns[inner]
                    if outer == "NS" and isinstance(self.source, Document):
                        part = F.lit(b.raw["N"]) if b.constant else b.raw
                    found.append(F.contains(whole, part) if outer == "S" else F.array_contains(whole, part))
        elif name == "attribute_type" and b.constant and "S" in b.columns:
            tag = b.raw["S"]
            if tag not in ("S", "N", "B", "BOOL", "NULL", "M", "L", "SS", "NS", "BS"):
                raise ValidationError(f"no type {tag!r}")
            found = [a.columns[tag].isNotNull()] if tag in a.columns else []
        if not found:
            return F.lit(negated)
        one = _any(found if len(found) == 1 else [F.coalesce(c, F.lit(False)) for c in found])
        return ~F.coalesce(one, F.lit(False)) if negated else one


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def source_of(df: DataFrame, sets: frozenset[str] = frozenset()) -> Typed | Document:
    """Typed columns, unless the table has a VARIANT column ``item``."""
    document = "item" in df.columns and isinstance(df.schema["item"].dataType, T.VariantType)
    return Document() if document else Typed(df.schema, sets)
