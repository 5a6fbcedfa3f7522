"""Token buckets, replayed over ordered requests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BURST_SECONDS, ON_DEMAND_RATE = 300.0, 40_000.0


class Bucket:
    """Fills at ``rate`` up to rate * 300 s; a request passes while something
    is left and may take the level below nothing once."""

    def __init__(self, rate: float):
        self.rate, self.level, self.at = rate, rate * BURST_SECONDS, None

    def take(self, now: float, units: float) -> bool:
        if self.at is not None and now > self.at:
            self.level = min(self.rate * BURST_SECONDS, self.level + (now - self.at) * self.rate)
        self.at = now if self.at is None else max(now, self.at)
        if self.level <= 0:
            return False
        self.level -= units
        return True


def replay(requests: DataFrame, table: str, time: str, units: str, rate: float = ON_DEMAND_RATE) -> DataFrame:
    """(table, time, units, admitted) of each request.  What a bucket admits
    depends on all before it, so the requests of one table run in one task; they
    stream through it in order and only one level is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket = None, Bucket(rate)
        for batch in batches:
            out = []
            for name, now, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != key:
                    key, bucket = name, Bucket(rate)
                out.append(bucket.take(now, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "admitted"])

    rows = requests.select(F.col(table).cast("string").alias("table_name"), F.col(time).cast("double").alias("at"), F.col(units).cast("double").alias("units"))
    dealt = rows.repartition("table_name").sortWithinPartitions("table_name", "at", "units")
    return dealt.mapInArrow(run, "table_name string, at double, units double, admitted boolean")
