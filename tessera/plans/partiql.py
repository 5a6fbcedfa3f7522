"""A small PartiQL: SELECT, INSERT, UPDATE and DELETE on one table.

``SELECT *|a, b FROM t [WHERE a op v AND ...]``, ``INSERT INTO t VALUE {...}``,
``UPDATE t SET a = v, ... WHERE ...``, ``DELETE FROM t WHERE ...``.  Conditions
are joined by AND; an attribute that is missing fails every condition, and one
of another type meets only ``<>``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..values import ValidationError
from .compiler import Typed, literal, source_of
from .ast import Path

_TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*')|(?P<name>"[^"]*"|[A-Za-z_][A-Za-z0-9_.-]*)|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<sign><=|>=|<>|[<>=?,{}\[\]:*]))""")


@dataclass
class Statement:
    kind: str
    table: str
    columns: list[str] = field(default_factory=list)
    where: list[tuple[str, str, Any]] = field(default_factory=list)
    item: dict[str, Any] = field(default_factory=dict)
    assign: dict[str, Any] = field(default_factory=dict)


class _Reader:
    def __init__(self, text: str, params: list[Any]):
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise ValidationError(f"unexpected character at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.params = 0, list(params)

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *words: str) -> bool:
        kind, word = self.peek()
        if kind in ("sign", "name") and word.upper() in words:
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                raise ValidationError(f"expected {w}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, word = self.peek()
        if kind != "name":
            raise ValidationError(f"expected a name, found {word!r}")
        self.at += 1
        return word.strip('"')

    def value(self) -> Any:
        kind, word = self.peek()
        self.at += 1
        if kind == "text":
            return word[1:-1]
        if kind == "number":
            return Decimal(word)
        if kind == "name" and word.upper() in ("TRUE", "FALSE"):
            return word.upper() == "TRUE"
        if kind == "name" and word.upper() == "NULL":
            return None
        if word == "?":
            if not self.params:
                raise ValidationError("too few parameters")
            return self.params.pop(0)
        if word == "{":
            out = {}
            while not self.take("}"):
                kind, key = self.peek()
                if kind not in ("text", "name"):
                    raise ValidationError("expected a name")
                self.at += 1
                self.need(":")
                out[key.strip("'\"")] = self.value()
                self.take(",")
            return out
        if word == "[":
            out = []
            while not self.take("]"):
                out.append(self.value())
                self.take(",")
            return out
        raise ValidationError(f"expected a value, found {word!r}")

    def where(self) -> list[tuple[str, str, Any]]:
        out = []
        if self.take("WHERE"):
            while True:
                name, (_, op) = self.name(), self.peek()
                if op not in ("=", "<>", "<", "<=", ">", ">="):
                    raise ValidationError(f"no comparison {op!r}")
                self.at += 1
                out.append((name, op, self.value()))
                if not self.take("AND"):
                    break
        return out


def parse(text: str, params: list[Any] | None = None) -> Statement:
    r = _Reader(text, params or [])
    if r.take("SELECT"):
        columns = [] if r.take("*") else [r.name()]
        while columns and r.take(","):
            columns.append(r.name())
        r.need("FROM")
        out = Statement("SELECT", r.name(), columns)
        out.where = r.where()
    elif r.take("INSERT"):
        r.need("INTO")
        out = Statement("INSERT", r.name())
        r.need("VALUE")
        out.item = r.value()
        if not isinstance(out.item, dict):
            raise ValidationError("INSERT takes an item")
    elif r.take("UPDATE"):
        out = Statement("UPDATE", r.name())
        r.need("SET")
        while True:
            name = r.name()
            r.need("=")
            out.assign[name] = r.value()
            if not r.take(","):
                break
        out.where = r.where()
    elif r.take("DELETE"):
        r.need("FROM")
        out = Statement("DELETE", r.name())
        out.where = r.where()
    else:
        raise ValidationError("not a statement")
    if r.peek()[0] != "end":
        raise ValidationError(f"unexpected {r.peek()[1]!r}")
    return out


def condition(df: DataFrame, terms: list[tuple[str, str, Any]]) -> Column:
    source = source_of(df)
    parts = [_term(source, *t) for t in terms]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _term(source, name: str, op: str, value: Any) -> Column:
    of = source.path(Path((name,)))
    if of is None:
        return F.lit(False)
    like = of.raw if isinstance(source, Typed) else None
    (tag, constant), *_ = literal(value, like).columns.items()
    if tag == "NULL":
        null = of.columns["NULL"].isNotNull() if "NULL" in of.columns else F.lit(False)
        return null if op == "=" else of.exists & ~null if op == "<>" else F.lit(False)
    if tag not in of.columns:
        return of.exists if op == "<>" else F.lit(False)
    column = of.columns[tag]
    apply = {"=": column == constant, "<>": column != constant, "<": column < constant, "<=": column <= constant, ">": column > constant, ">=": column >= constant}
    if tag not in ("S", "N", "B", "T") and op not in ("=", "<>"):
        return F.lit(False)
    if op == "<>" and len(of.columns) > 1:
        return of.exists & F.coalesce(apply[op], F.lit(True))
    return apply[op]


def select(df: DataFrame, statement: Statement) -> DataFrame:
    """Key conditions are ordinary ones: Spark pushes them into the scan."""
    rows = df.where(condition(df, statement.where))
    return rows.select(*[F.col(f"`{c}`") for c in statement.columns if c in df.columns]) if statement.columns else rows


def _key(statement: Statement, keys: list[str]) -> None:
    equal = {n for n, op, _ in statement.where if op == "="}
    if not all(k in equal for k in keys):
        raise ValidationError("WHERE must name the whole key")


def written(df: DataFrame, statement: Statement, keys: list[str]) -> DataFrame:
    """The table after INSERT, UPDATE or DELETE of one item.  INSERT takes the
    place of an item that is there; UPDATE makes one if WHERE is but the key;
    terms beside the key are conditions that an item must meet."""
    if statement.kind == "INSERT":
        if any(statement.item.get(k) is None for k in keys):
            raise ValidationError("an item has its key")
        same = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.lit(statement.item[k]) for k in keys])
        kinds = {f.name: f.dataType for f in df.schema}
        one = df.sparkSession.range(1).select(*[F.lit(v).cast(kinds[n]).alias(n) if n in kinds else F.lit(v).alias(n) for n, v in statement.item.items()])
        return df.where(~same).unionByName(one, allowMissingColumns=True)
    _key(statement, keys)
    met = F.coalesce(condition(df, statement.where), F.lit(False))
    if statement.kind == "DELETE":
        return df.where(~met)
    if any(k in statement.assign for k in keys):
        raise ValidationError("key attributes can't be updated")
    kinds = {f.name: f.dataType for f in df.schema}
    new = {n: F.lit(v).cast(kinds[n]) if n in kinds else F.lit(v) for n, v in statement.assign.items()}
    rows = df
    if {n for n, _, _ in statement.where} == set(keys):
        made = {n: v for n, _, v in statement.where}
        same = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.lit(made[k]) for k in keys])
        absent = df.where(same).limit(1).agg(F.count("*").alias("n")).where("n = 0")
        rows = df.unionByName(absent.select(*[F.lit(made[k]).cast(kinds[k]).alias(k) for k in keys]), allowMissingColumns=True)
        met = same
    return rows.select(*[F.when(met, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns], *[F.when(met, v).alias(n) for n, v in new.items() if n not in kinds])
