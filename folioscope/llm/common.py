"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Span = tuple[str, int, int]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


#: Rows, and bytes, that go to a Python worker at a time.  A text can be long, so the defaults of 10,000 and 64 MB would hold too much.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering its session's rows and bytes in an Arrow batch to ``BATCH_ROWS`` and ``BATCH_BYTES`` where they are more."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        held = conf.get(name).lower().removesuffix("b")
        if not (held.lstrip("-").isdigit() and 0 < int(held) <= most):
            conf.set(name, str(most))
    return df


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return a worker's free memory to the system: workers outlive their task, and the next stage's tables need the room."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The function of batches ``run``, which gives memory back when it begins and when it ends."""

    def tidied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on one machine (tests) a temporary folder is chosen, once,
    and set in the session.  On a cluster executors would not see such a folder, so there the setting must be made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="folioscope-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, compact: bool = False, folder: str = "") -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back.

    The copy cuts the lineage, survives a lost executor and lets later plans read only the columns
    they need; unlike ``checkpoint()`` it is columnar and compressed.  ``compact`` deals small results out anew,
    so that they take few files, and splits large partitions.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Stored tables that a computation needs until it is done; ``drop`` deletes them from the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, True, self.folder)

    def drop(self) -> None:
        delete_folder(self.spark, self.folder)


def span_text(spans: Iterable[Span], order: Sequence[str]) -> str:
    """``kind:start:end`` by start, then by the kind's place in ``order``, comma-joined."""
    rank = {k: i for i, k in enumerate(order)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def span_text_by_kind(spans: Iterable[Span], order: Sequence[str]) -> str:
    """``kind:start:end`` by the kind's place in ``order``, then by start, comma-joined."""
    rank = {k: i for i, k in enumerate(order)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (rank[x[0]], x[1], x[2])))


def sha256_hex(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()
