"""Secondary indexes as derived tables: always those of the current view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..catalog import Index, Table


def index_view(df: DataFrame, table: Table, index: Index) -> DataFrame:
    """Items that have all keys of the index, with what it projects; the keys
    of index and table always stay."""
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in index.keys))
    if index.projection == "ALL":
        return rows
    kept = [*index.keys, *table.keys, *(index.include if index.projection == "INCLUDE" else ())]
    return rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys(kept) if c in df.columns])


def index_order(table: Table, index: Index) -> list[str]:
    return list(dict.fromkeys([*index.keys, *table.keys]))
