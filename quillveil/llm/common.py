"""Shared helpers: scratch tables in the cluster's shared folder and Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word and line contracts: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session may go without one and gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


#: Paths of the scratch tables of this driver that no one has removed.
written: list[str] = []


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns as a scratch table; those that it wrote on the way are removed."""
    mark = len(written)
    out = scratch(make(), name)
    removed(out.sparkSession, mark, -1)
    return out


def removed(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Remove scratch tables by their places in ``written``."""
    for path in written[since:until]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del written[since:until]


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """``df`` with a column of its own that tells all rows apart, in a written table, and its name."""
    while name in df.columns:
        name += "_"
    return scratch(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def only(df: DataFrame, keys: DataFrame, key: str, kind: str = "left_semi", most: int = 2_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the written table ``keys``, or with left_anti is not. Up to
    ``most`` keys are broadcast; more shuffle with the rows."""
    keys = keys.select(key)
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, key, kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


class RowKeys:
    """Keys for the rows of one task, unique over all tasks; valid once the rows are written."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 36

    def take(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next, dtype=np.int64)


def text_pieces(col: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of consecutive texts of about ``limit`` bytes: first row, end row, bytes, offsets.

    A null text counts as empty; a text above the limit forms a piece of its own.
    """
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, len(col))
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Arrow lists from flat values and their offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


#: What a Python worker keeps for one operator from task to task.
_kept: dict[str, dict] = {}


def kept_by_worker(name: str) -> dict:
    """A dictionary that lives as long as the worker works for ``name``; those of other names go."""
    for other in [k for k in _kept if k != name]:
        del _kept[other]
    return _kept.setdefault(name, {})
