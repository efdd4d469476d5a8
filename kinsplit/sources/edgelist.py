"""Edge files: text lists, binary records, and tables."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsplit.operators.edges import EdgeStore
from kinsplit.plans.storage import forget_at_exit, shared_dir

FORMAT_VERSION = (1, 0, 0)
_HEAD = struct.Struct("<3HQQ")
_RECORD = np.dtype([("src", "<u4"), ("dst", "<u4"), ("weight", "<f4")])
PIECE = _RECORD.itemsize * (8 << 20)  # bytes of a file that a task reads
PART_RECORDS = 1 << 20  # about as many are written by a task


def _bad(message: str):
    raise OSError(message)


def write(store: EdgeStore, path: str) -> None:
    if path.endswith(".edgelist"):
        write_text(store, path)
    elif path.endswith(".edgestr"):
        write_records(store, path)
    elif path.endswith(".parquet"):
        write_table(store, path)
    else:
        _bad(f"unknown extension of {path}: .edgelist, .edgestr or .parquet")


def read(spark: SparkSession, path: str) -> EdgeStore:
    if path.endswith(".edgelist"):
        return read_text(spark, path)
    if path.endswith(".edgestr"):
        return read_records(spark, path)
    if path.endswith(".parquet"):
        return read_table(spark, path)
    return _bad(f"unknown extension of {path}: .edgelist, .edgestr or .parquet")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _parts(rows: DataFrame, path: str, trim: int = 0):
    """Write ``rows`` (one text column) to part files by the executors; their streams in order, as (stream, bytes) without the last ``trim`` of each."""
    spark = rows.sparkSession
    folder, fs = _hadoop(spark, path)
    rows.write.mode("overwrite").option("compression", "none").text(path)
    found = sorted((s.getPath().getName(), s) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    for _, s in found:
        if s.getLen() > trim:
            stream = fs.open(s.getPath())
            try:
                yield stream, s.getLen() - trim
            finally:
                stream.close()
    fs.delete(folder, True)


def _joined(spark: SparkSession, path: str, head: bytes, parts) -> None:
    """One file of a head and parts, copied from stream to stream; no rows come to the driver's Python or as results."""
    target, fs = _hadoop(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(head))
        for stream, size in parts:
            spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size)
    finally:
        out.close()


def write_text(store: EdgeStore, path: str) -> None:
    """One file: ``# n = <count>``, then ``u v w`` a line, in order. Executors sort and write parts by range, which are joined."""
    spark = store.edges.sparkSession
    rows = store.edges.orderBy("src", "dst").select(F.concat_ws(" ", "src", "dst", "weight").alias("line"))
    _joined(spark, path, f"# n = {store.node_count}\n".encode(), _parts(rows, path + ".parts"))


def read_text(spark: SparkSession, path: str) -> EdgeStore:
    """A text list, parsed by the executors; a missing header or a bad line is an OSError that names it."""
    try:
        lines = spark.read.text(path)
        head = lines.first()
    except Exception as e:
        raise OSError(f"cannot read {path}: {str(e).splitlines()[0]}") from e
    words = head["value"].split() if head else []
    if len(words) != 4 or words[:3] != ["#", "n", "="] or not words[3].isdigit():
        _bad(f"{path}, line 1: expected '# n = <count>'")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("p", F.split(F.trim("value"), r"\s+"))
    parsed = rows.select("value", F.get("p", F.lit(0)).try_cast("long").alias("src"), F.get("p", F.lit(1)).try_cast("long").alias("dst"), F.get("p", F.lit(2)).try_cast("double").alias("weight"))
    wrong = parsed.where("src is null or dst is null or weight is null").first()
    if wrong:
        _bad(f"{path}: not 'u v w': {wrong['value']!r}")
    return EdgeStore(int(words[3]), parsed.select("src", "dst", "weight"))


def write_records(store: EdgeStore, path: str) -> None:
    """Header (version, nodes, edges) and 12 bytes an edge, in order.

    Executors sort by range and write the records of each part as one line of bytes; the parts are joined without the
    lines' ends.
    """
    spark, n = store.edges.sparkSession, len(store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            a = np.empty(b.num_rows, _RECORD)
            for c in a.dtype.names:
                a[c] = b.column(c).to_numpy()
            held.append(a.tobytes())
        if any(held):
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["r"])

    sorted_ = store.edges.repartitionByRange(max(1, -(-n // PART_RECORDS)), "src", "dst").sortWithinPartitions("src", "dst")
    rows = sorted_.select("src", "dst", "weight").mapInArrow(run, "r binary").select(F.col("r").cast("string"))
    _joined(spark, path, _HEAD.pack(*FORMAT_VERSION, store.node_count, n), _parts(rows, path + ".parts", 1))


def read_records(spark: SparkSession, path: str) -> EdgeStore:
    """Records of a file of any size, read as pieces of PIECE bytes.

    A record does not start at a multiple of its size, so no reader of Spark splits such a file. Its pieces are copied
    to the shared folder, from stream to stream, and executors read those.
    """
    try:
        source, fs = _hadoop(spark, path)
        size = fs.getFileStatus(source).getLen()
        stream = fs.open(source)
    except Exception as e:
        raise OSError(f"cannot read {path}: {str(e).splitlines()[0]}") from e
    try:
        head = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, _HEAD.size)))
        if len(head) < _HEAD.size:
            _bad(f"{path} has no header")
        *version, nodes, edges = _HEAD.unpack(head)
        if tuple(version) != FORMAT_VERSION:
            _bad(f"{path} has format {tuple(version)}; this version reads {FORMAT_VERSION}")
        if size != _HEAD.size + edges * _RECORD.itemsize:
            _bad(f"{path} is cut short")
        folder = f"{shared_dir(spark)}/kinsplit/records-{uuid.uuid4().hex}"
        forget_at_exit(spark, folder)
        left = edges * _RECORD.itemsize
        for k in range(max(1, -(-left // PIECE))):
            target, shared = _hadoop(spark, f"{folder}/{k}")
            out = shared.create(target, True)
            spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, min(PIECE, left))
            out.close()
            left -= min(PIECE, left)
    finally:
        stream.close()

    def run(batches):
        for pdf in batches:
            for c in pdf["content"]:
                a = np.frombuffer(c, _RECORD)
                for i in range(0, max(1, len(a)), 100_000):
                    p = a[i : i + 100_000]
                    yield pd.DataFrame({"src": p["src"].astype(np.int64), "dst": p["dst"].astype(np.int64), "weight": p["weight"].astype(float)})

    raw = spark.read.format("binaryFile").load(folder).select("content")
    return EdgeStore(int(nodes), raw.mapInPandas(run, "src long, dst long, weight double"))


def write_table(store: EdgeStore, path: str) -> None:
    """Edges and vertices as Parquet tables below ``path``; the format to use at scale."""
    version = ".".join(map(str, FORMAT_VERSION))
    store.edges.withColumn("format_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/edges")
    store.vertices.write.mode("overwrite").parquet(f"{path}/vertices")


def read_table(spark: SparkSession, path: str) -> EdgeStore:
    try:
        edges: DataFrame = spark.read.parquet(f"{path}/edges")
        other = edges.where(F.col("format_version") != ".".join(map(str, FORMAT_VERSION))).first()
    except Exception as e:
        raise OSError(f"cannot read {path}: {str(e).splitlines()[0]}") from e
    if other:
        _bad(f"{path} has format {other['format_version']}")
    return EdgeStore(spark.read.parquet(f"{path}/vertices"), edges)
