"""Batches of writes: each row is a request and gets an outcome as data."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.compiler import Compiler, source_of
from ..plans.evaluate import Evaluator
from ..plans.parser import parse_condition
from . import log
from .update import updated

OK, FAILED, CANCELLED = "OK", "ConditionalCheckFailed", "TransactionCanceled"


def first_wins(requests: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Puts under attribute_not_exists(key), in order: the first of each key is
    made, the others fail."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return requests.withColumn("status", F.when(place == 1, OK).otherwise(FAILED))


def _met(current: DataFrame, condition: str, values: dict[str, Any] | None, names: dict[str, str] | None) -> tuple[Column, bool]:
    """The condition on an item that is there, and what it says of none."""
    tree = parse_condition(condition, names)
    return Compiler(source_of(current), values or {}).value(tree), Evaluator({}, values).true(tree)


def conditional(current: DataFrame, requests: DataFrame, keys: list[str], condition: str, values: dict[str, Any] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Requests with a status: the condition sees the item as it stands, or
    nothing where there is none.  One request a key."""
    met, absent = _met(current, condition, values, names)
    joined = requests.join(current.select(*keys, met.alias("__met")), keys, "left")
    return joined.withColumn("status", F.when(F.coalesce("__met", F.lit(absent)), OK).otherwise(FAILED)).drop("__met")


def upsert(current: DataFrame, wanted: DataFrame, keys: list[str], expression: str, values: dict[str, Any] | None = None, names: dict[str, str] | None = None, **options: Any) -> DataFrame:
    """The table after an update of the wanted keys: items that aren't there
    are made from their key, others than the wanted stay as they are."""
    asked = wanted.select(*keys).distinct().withColumn("__asked", F.lit(True))
    rows = current.join(asked, keys, "full")
    columns, _ = updated(rows, expression, values, names, keys=tuple(keys), **options)
    after = rows.select(F.col("__asked").alias("__was"), F.struct(*[F.col(f"`{c}`") for c in current.columns]).alias("__old"), *columns)
    made = [c for c in after.columns if c not in ("__was", "__old", "__asked")]
    return after.select(*[F.when(F.col("__was"), F.col(f"`{c}`")).otherwise(F.col(f"__old.`{c}`") if c in current.columns else F.lit(None)).alias(c) for c in made])


def transact_write(current: DataFrame, actions: DataFrame, transaction: str, keys: list[str], condition: str, values: dict[str, Any] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """The table after transactions of actions (transaction, kind, keys, rest).

    A kind is Put, Update, Delete or ConditionCheck.  The condition is that of
    all actions on the item as it stands; a transaction with one that isn't met,
    or with two actions on one key, does nothing.  Put replaces the item, Update
    sets the attributes that aren't null.  Transactions run in their order.
    """
    rest = [c for c in current.columns if c not in keys]
    met, absent = _met(current, condition, values, names)
    checked = actions.join(current.select(*keys, met.alias("__met")), keys, "left").withColumn("__ok", F.coalesce("__met", F.lit(absent)))
    # Two actions on one key are more rows than keys; both counts merge before the shuffle.
    twice = checked.groupBy(transaction, *keys).agg(F.count("*").alias("n"), F.bool_and("__ok").alias("ok"))
    good = twice.groupBy(transaction).agg(F.bool_and("ok").alias("ok"), F.max("n").alias("n")).where("ok AND n = 1").select(transaction)
    made = actions.join(good, transaction, "left_semi").where("kind <> 'ConditionCheck'")
    before = current.select(*keys, F.lit(None).cast(actions.schema[transaction].dataType).alias(transaction), F.lit("Put").alias("kind"), *rest)
    log = before.union(made.select(*keys, transaction, "kind", *rest))
    # All writes of a key in order: what stands is made of those since the last Put or Delete.
    over = Window.partitionBy(*keys).orderBy(F.col(transaction).asc_nulls_first())
    log = log.withColumn("__since", F.sum(F.when(F.col("kind") != "Update", 1).otherwise(0)).over(over)).withColumn("__n", F.row_number().over(over))
    newest = Window.partitionBy(*keys)
    log = log.where(F.col("kind").isNotNull()).withColumn("__last", F.max("__since").over(newest)).where(F.col("__since") == F.col("__last"))
    folded = log.groupBy(*keys).agg(F.max_by("kind", "__n").alias("__kind"), F.min_by("kind", "__n").alias("__first"), *[F.max_by(c, F.when(F.col(c).isNotNull() & (F.col("kind") != "Delete"), F.col("__n"))).alias(c) for c in rest])
    return folded.where("NOT (__first = 'Delete' AND __kind = 'Delete')").select(*current.columns)


def batch_write(current: DataFrame, requests: DataFrame, batch: str, keys: list[str], order: list[Column | str], valid: Column) -> DataFrame:
    """The table after batches of requests (batch, op P or D, keys, rest): a
    batch with an invalid request does nothing; of several requests for a key
    the last one stands."""
    rest = [c for c in current.columns if c not in keys]
    marked = requests.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    good = marked.groupBy(batch).agg(F.bool_and("__valid").alias("ok")).where("ok").select(batch)
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    made = marked.join(good, batch, "left_semi").select(*keys, *rest, "op", place.alias("__at"))
    before = current.select(*keys, *rest, F.lit("P").alias("op"), F.lit(None).cast(made.schema["__at"].dataType).alias("__at"))
    return log.current(before.union(made), keys, ["__at"], F.col("op") == "D").select(*current.columns)


def transact(actions: DataFrame, transaction: str, check: Column) -> DataFrame:
    """All or nothing: the actions of a transaction are made only if the checks
    of all of them hold.  The verdict is one partial aggregate a transaction."""
    checked = actions.withColumn("__ok", F.coalesce(check, F.lit(False)))
    verdict = checked.groupBy(transaction).agg(F.bool_and("__ok").alias("committed"))
    return checked.drop("__ok").join(verdict, transaction)


def once(requests: DataFrame, token: str, body: str, order: list[Column | str]) -> DataFrame:
    """Requests with a token: the first runs, a repeat with the same body is
    answered again, one with another body is a mismatch."""
    over = Window.partitionBy(token).orderBy(*order)
    first = F.first(F.sha2(F.col(body), 256)).over(over)
    place = F.row_number().over(over)
    return requests.withColumn("status", F.when(place == 1, OK).when(F.sha2(F.col(body), 256) == first, "Replayed").otherwise("IdempotentParameterMismatch"))
