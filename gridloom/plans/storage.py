"""Written tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Tables written inside each open scratch block of this thread, the innermost last.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder on a local master where it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="gridloom-")
    return _LOCAL[context.applicationId]


def cut(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if blocks := _OPEN.get():
        blocks[-1].append(out)
    return out


def release(df: DataFrame) -> None:
    """Deletes a written table that no later plan reads."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those given to the function that it yields.

    Kept tables belong to the block around this one, if there is any.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for df in made:
            if not any(df is k for k in kept):
                release(df)
        if blocks := _OPEN.get():
            blocks[-1].extend(kept)
