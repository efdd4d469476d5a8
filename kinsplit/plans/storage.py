"""Intermediate tables in the shared folder of the cluster.

An iterative plan is cut by writing a Parquet table below ``spark.checkpoint.dir``; every executor and the driver
reach that folder, so losing an executor loses nothing. Only where the setting is absent and the master is local (tests, runs on
one machine) is a folder of our own chosen; a cluster without the setting is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a folder of this machine where Spark runs on it alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="kinsplit-")
    return _OWN[app]


ROWS_PER_FILE = 250_000


def materialize(df: DataFrame, name: str = "table", at_most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back; its lineage ends there.

    ``at_most``: a bound of its rows, where one is known; then it is written in files of ROWS_PER_FILE rows or more,
    eight at least, rather than in one for each shuffle partition.
    """
    spark = df.sparkSession
    if at_most is not None:
        df = df.coalesce(max(8, -(-at_most // ROWS_PER_FILE)))
    path = f"{shared_dir(spark)}/kinsplit/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._kinsplit_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that no plan will read any more."""
    for t in tables:
        path = getattr(t, "_kinsplit_path", None)
        if path:
            delete(t.sparkSession, path)


def mark() -> int:
    """A point in the sequence of written tables, for :func:`release_since`."""
    return len(_WRITTEN)


def release_since(point: int) -> None:
    """Delete the tables written since ``point``; what was made of them has been written elsewhere."""
    while len(_WRITTEN) > point:
        delete(*_WRITTEN.pop())


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a path when the driver ends."""
    _WRITTEN.append((spark, path))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _WRITTEN:
        try:
            delete(spark, path)
        except Exception:  # the session has ended; the cluster's own cleaning of the folder remains
            return
