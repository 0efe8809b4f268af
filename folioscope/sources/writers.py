"""Sinks: tables of the store, event logs, replaced partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, root: str, name: str, version: str) -> str:
    """A table under a new path; readers switch to it once it is complete."""
    path = f"{root}/{name}/{version}"
    df.write.mode("error").parquet(path)
    return path


def replace_signals(signals: DataFrame, path: str, buckets: int = 64) -> None:
    """Signals by bucket of session, only the buckets present in ``signals`` being written anew.

    The caller passes all sessions of a bucket: those replaced and those kept.
    """
    keyed = signals.withColumn("bucket", F.pmod(F.hash("session_id"), F.lit(buckets)))
    writer = keyed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def event_lines(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events as JSON lines, the moment first; absent fields are left out."""
    rest = [c for c in events.columns if c != ts]
    return events.select(F.to_json(F.struct(ts, *rest), {"ignoreNullFields": "true"}).alias("value"))


def append_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("append").text(path)
