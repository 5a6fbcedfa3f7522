"""The change log: writes as rows, and the views that follow from them.

A log has the columns of the items, a sequence column and an operation, ``P``
for a put or ``D`` for a delete.  The newest row of a key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SEQ, OP = "seq", "op"


def newest(log: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The newest row of each key.  Spark turns the rank filter into a limit
    before the shuffle, so a hot key is one row a task."""
    latest = [(F.col(o) if isinstance(o, str) else o).desc() for o in order]
    ranked = log.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest)))
    return ranked.where("__place = 1").drop("__place")


def current(log: DataFrame, keys: list[str], order: list[Column | str], deleted: Column) -> DataFrame:
    """Items as they stand: newest rows that aren't deletes."""
    return newest(log.withColumn("__gone", deleted), keys, order).where("NOT __gone").drop("__gone")


def as_of(log: DataFrame, until: Column) -> DataFrame:
    """The log up to a point; its current view is the table at that time."""
    return log.where(until)


def compact(log: DataFrame, keys: list[str], order: list[Column | str], deleted: Column) -> DataFrame:
    """A log of one put for each live key: same current view, no history."""
    return current(log, keys, order, deleted)


def changes(log: DataFrame, keys: list[str], order: list[Column | str], deleted: Column) -> DataFrame:
    """The change feed: INSERT, MODIFY or REMOVE with the image before; a
    delete of what isn't there gives nothing."""
    rest = [c for c in log.columns if c not in keys]
    over = Window.partitionBy(*keys).orderBy(*order)
    rows = log.withColumn("__gone", deleted).withColumn("__image", F.when(~deleted, F.struct(*rest)))
    rows = rows.withColumn("old_image", F.lag("__image").over(over))
    name = F.when(F.col("__gone"), "REMOVE").when(F.col("old_image").isNull(), "INSERT").otherwise("MODIFY")
    rows = rows.withColumn("event_name", name).where("NOT (__gone AND old_image IS NULL)")
    return rows.withColumnRenamed("__image", "new_image").drop("__gone")


def viewed(feed: DataFrame, view: str) -> DataFrame:
    """The images that a view type shows."""
    out = feed
    if view not in ("NEW_IMAGE", "NEW_AND_OLD_IMAGES"):
        out = out.withColumn("new_image", F.lit(None).cast(feed.schema["new_image"].dataType))
    if view not in ("OLD_IMAGE", "NEW_AND_OLD_IMAGES"):
        out = out.withColumn("old_image", F.lit(None).cast(feed.schema["old_image"].dataType))
    return out


def records(feed: DataFrame, kind: str, seq: int | None = None, limit: int = 1000) -> DataFrame:
    """Records from an iterator: TRIM_HORIZON, LATEST, AT_SEQUENCE_NUMBER or
    AFTER_SEQUENCE_NUMBER."""
    if kind == "LATEST":
        return feed.limit(0)
    if kind == "AT_SEQUENCE_NUMBER":
        feed = feed.where(F.col(SEQ) >= seq)
    elif kind == "AFTER_SEQUENCE_NUMBER":
        feed = feed.where(F.col(SEQ) > seq)
    return feed.orderBy(SEQ).limit(limit)


def retained(feed: DataFrame, time: str, now: int, seconds: int = 86_400) -> DataFrame:
    return feed.where(F.col(time) >= now - seconds)
