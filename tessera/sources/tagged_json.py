"""Tagged JSON items in and out, and the rules they must keep."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import number_text
from ..plans.evaluate import apply_update
from ..plans.parser import parse_update
from ..values import ValidationError, normalized, validate

TYPES = {"S": "string", "N": "double", "B": "binary"}


def read_items(lines: DataFrame, keys: dict[str, str], column: str = "value") -> DataFrame:
    """Typed key columns and the item as VARIANT, from lines of tagged JSON;
    a line that isn't JSON gives nulls."""
    item = F.try_parse_json(column)
    cols = []
    for name, tag in keys.items():
        found = F.try_variant_get(item, f"$['{name}'].{tag}", "string" if tag == "B" else TYPES[tag])
        cols.append((F.unbase64(found) if tag == "B" else found).alias(name))
    return lines.select(*cols, item.alias("item"))


def tagged_column(column: Column, kind: T.DataType, is_set: bool = False) -> Column:
    """A native value as tagged JSON text; null where it is missing."""
    if isinstance(kind, T.BooleanType):
        body = F.concat(F.lit('{"BOOL":'), column.cast("string"), F.lit("}"))
    elif isinstance(kind, T.NumericType):
        body = F.concat(F.lit('{"N":"'), number_text(column, kind), F.lit('"}'))
    elif isinstance(kind, T.BinaryType):
        body = F.concat(F.lit('{"B":"'), F.base64(column), F.lit('"}'))
    elif isinstance(kind, T.ArrayType):
        if is_set:
            tag = "NS" if isinstance(kind.elementType, T.NumericType) else "SS"
            body = F.concat(F.lit(f'{{"{tag}":'), F.to_json(F.transform(column, lambda x: x.cast("string"))), F.lit("}"))
        else:
            parts = F.transform(column, lambda x: F.coalesce(tagged_column(x, kind.elementType), F.lit('{"NULL":true}')))
            body = F.concat(F.lit('{"L":['), F.array_join(parts, ","), F.lit("]}"))
    elif isinstance(kind, T.StructType):
        body = F.concat(F.lit('{"M":{'), _members([(f.name, column.getField(f.name), f.dataType, False) for f in kind]), F.lit("}}"))
    elif isinstance(kind, T.MapType):
        parts = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(_quoted(e.key), F.lit(":"), tagged_column(e.value, kind.valueType)))
        body = F.concat(F.lit('{"M":{'), F.array_join(parts, ","), F.lit("}}"))
    else:
        body = F.concat(F.lit('{"S":'), _quoted(column.cast("string")), F.lit("}"))
    return F.when(column.isNotNull(), body)


def _quoted(text: Column) -> Column:
    """A JSON string: that of a one-element list without its brackets."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _members(fields: list[tuple[str, Column, T.DataType, bool]]) -> Column:
    parts = [F.concat(F.lit(json.dumps(name) + ":"), tagged_column(c, kind, s)) for name, c, kind, s in sorted(fields, key=lambda f: f[0])]
    return F.array_join(F.array_compact(F.array(*parts)), ",")


def write_items(df: DataFrame, sets: frozenset[str] = frozenset()) -> DataFrame:
    """A column ``value`` of tagged JSON, names in order, missing left out."""
    fields = [(f.name, F.col(f"`{f.name}`"), f.dataType, f.name in sets) for f in df.schema]
    return df.select(F.concat(F.lit("{"), _members(fields), F.lit("}")).alias("value"))


def checked(lines: DataFrame, keys: dict[str, str], column: str = "value") -> DataFrame:
    """The lines with ``error``: null if valid, else what is wrong; valid ones
    come back with canonical numbers.  Rules of nesting and number grammar have
    no column form, so this runs in Arrow batches."""
    at = lines.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for text in batch.column(at).to_pylist():
                try:
                    item = {k: normalized(v) for k, v in json.loads(text).items()}
                    validate(item, keys)
                    texts.append(json.dumps(item, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
                    errors.append(None)
                except (ValidationError, ValueError, TypeError, AttributeError) as e:
                    texts.append(text)
                    errors.append(str(e)[:200] or type(e).__name__)
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], [*batch.schema.names, "error"])

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("error", T.StringType())]))


def update_items(lines: DataFrame, expression: str, values: dict[str, Any] | None = None, names: dict[str, str] | None = None, keys: tuple[str, ...] = (), column: str = "value") -> DataFrame:
    """Documents after an update expression, with ``error`` where it failed."""
    steps, at = parse_update(expression, names), lines.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for text in batch.column(at).to_pylist():
                try:
                    texts.append(json.dumps(apply_update(json.loads(text), steps, values, keys), sort_keys=True, ensure_ascii=False, separators=(",", ":")))
                    errors.append(None)
                except (ValidationError, ValueError, TypeError, AttributeError) as e:
                    texts.append(text)
                    errors.append(str(e)[:200] or type(e).__name__)
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], [*batch.schema.names, "error"])

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("error", T.StringType())]))
