"""Tables written in the shared folder to cut a plan's lineage, and their removal."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without it (tests) writes below its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return folder


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path below the shared folder, removed with the written tables."""
    if not _written:
        import atexit

        atexit.register(_remove, 0)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
    _written.append((spark, folder))
    return folder


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: Parquet in a folder of its own below ``spark.checkpoint.dir``, read again.

    The folder goes at the end of the ``freed`` block that it was written in, else when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = scratch(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def freed(*, last: bool = False) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose written tables are removed at its end, but for those that the yielded function writes.

    With ``last`` the table written last before the block goes too.
    """
    mark, kept = max(0, len(_written) - last), []

    def keep(df: DataFrame) -> DataFrame:
        out = written(df)
        kept.append(_written.pop())
        return out

    try:
        yield keep
    finally:
        _remove(mark)
        _written.extend(kept)


def _remove(mark: int) -> None:
    while len(_written) > mark:
        spark, folder = _written.pop()
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session is gone; its folder is the cluster's to clean
            continue
