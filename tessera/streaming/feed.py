"""The write path and its change feed as Structured Streaming.

Write requests are folded for each key in order of their sequence numbers; the
state of a key is its item as it stands.  A finite input gives the rows that the
batch form gives.  Lateness never drops a write: order is that of sequence
numbers, and a watermark bounds the table of request tokens only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.evaluate import Evaluator
from ..plans.parser import parse_condition
from ..values import tagged

FEED = "key string, seq long, event_name string, old_image string, new_image string, status string"


def fold(requests: DataFrame, condition: str | None = None, values: dict | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """The feed of requests (key string, seq long, op string, image string).

    op is ``P`` or ``D``, image the item as tagged JSON.  With a condition a
    request whose condition fails on the item as it stands gives a row with the
    status ConditionalCheckFailed and no event, and changes nothing.
    """
    tree = parse_condition(condition, names) if condition else None
    given = {k: tagged(v) for k, v in (values or {}).items()}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (image,) = state.get if state.exists else (None,)
        out = []
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for seq, op, new in zip(rows.seq.tolist(), rows.op.tolist(), rows.image.tolist(), strict=True):
            if tree is not None and not Evaluator(json.loads(image) if image else {}, given).true(tree):
                out.append((key[0], seq, None, None, None, "ConditionalCheckFailed"))
            elif op == "D":
                if image is not None:
                    out.append((key[0], seq, "REMOVE", image, None, "OK"))
                image = None
            else:
                out.append((key[0], seq, "INSERT" if image is None else "MODIFY", image, new, "OK"))
                image = new
        state.update((image,))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in FEED.split(", ")])

    state = T.StructType([T.StructField("image", T.StringType())])
    return requests.groupBy("key").applyInPandasWithState(step, FEED, state, "append", GroupStateTimeout.NoTimeout)


def once(requests: DataFrame, token: str, time: str, within: str = "10 minutes") -> DataFrame:
    """Each token's first request; the watermark bounds what is remembered."""
    return requests.withWatermark(time, within).dropDuplicatesWithinWatermark([token])


def run_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all input that is there and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
