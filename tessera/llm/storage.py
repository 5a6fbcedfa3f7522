"""Tables in the folder that every executor shares.

``spark.checkpoint.dir`` names it on a cluster.  Only where the setting is
missing, as in tests on one machine, a temporary folder stands in.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import shared_folder


_scopes: list[list[str]] = []


class _Kept:
    def __init__(self, paths: list[str]):
        self.paths = paths

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out = persist(df, name)
        self.paths.pop()
        return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[_Kept]:
    """Tables that ``persist`` writes within are deleted at the end, but for
    those written by what this gives.  What is returned must read only these."""
    _scopes.append([])
    try:
        yield _Kept(_scopes[-1])
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def persist(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors; the schema travels
    along, so an empty table reads back as an empty table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the JVM has collected what refers to
    them; after a large step this asks for that, so disk isn't held until the
    driver happens to run short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
