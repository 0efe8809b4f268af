"""Readers of what a conversion leaves behind: tables, logs, page images, link files, lesson banks, prompt files.

Missing or unreadable JSON counts as empty, as a run must not fail on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.runlog import parse_lines
from ..schemas import LINK, RUN_SIGNALS, SESSIONS, USERS, refuse_legacy_users

STORE = {"users": USERS, "sessions": SESSIONS, "run_signals": RUN_SIGNALS}

LESSON = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("instruction", T.StringType()),
            T.StructField("before", T.StringType()),
            T.StructField("after", T.StringType()),
            T.StructField("count", T.LongType()),
            T.StructField("sessions", T.ArrayType(T.StringType())),
            T.StructField("updated_at", T.StringType()),
        ]
    )
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the store; columns that older files lack are null, a legacy users table is refused."""
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(f"{root}/{name}")
    if name == "users":
        refuse_legacy_users(df.columns)
    for f in STORE[name].fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*STORE[name].names)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Events of all logs under ``path`` in order; the session is the name of the log's folder."""
    raw = spark.read.text(path, wholetext=True).withColumn("session_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return parse_lines(raw)


def stream_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """The same as an unbounded table of raw lines (session_id, value), for the streaming operators."""
    lines = spark.readStream.text(path)
    return lines.withColumn("session_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """(session, order, name, content) of files called ``<order>__<name>``."""
    files = spark.read.format("binaryFile").load(path)
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    own = files.withColumn("file", file).where(F.contains("file", F.lit("__")))
    order = F.split("file", "__", 2)[0].try_cast("int")
    return own.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("session"), order.alias("order"), F.split("file", "__", 2)[1].alias("name"), "content")


def links_by_page(text: Column) -> Column:
    """A links file (page to list of links) as map<int, array<struct<text, href>>>; unreadable is empty."""
    kind = T.MapType(T.StringType(), T.ArrayType(LINK))
    empty = F.create_map().cast(kind)
    return F.coalesce(F.from_json(text, kind), empty)


def page_links(files: DataFrame, text: str = "value") -> DataFrame:
    """(session, page, pos, text, href) of links files (session, value)."""
    pages = files.select("session", F.explode(links_by_page(F.col(text))).alias("page", "links"))
    each = pages.select("session", F.col("page").try_cast("int").alias("page"), F.posexplode("links").alias("pos", "l"))
    return each.select("session", "page", "pos", "l.text", "l.href")


def lessons(text: Column) -> Column:
    """A lesson bank as an array; anything but a JSON array is empty."""
    return F.coalesce(F.from_json(text, LESSON), F.array().cast(LESSON))


def read_prompts(spark: SparkSession, session_dir: str, library_dir: str) -> DataFrame:
    """(name, priority, text) of prompt files; a session's own copy has the smaller priority."""
    parts = []
    for priority, path in enumerate((session_dir, library_dir)):
        files = spark.read.text(f"{path}/*.md", wholetext=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1))
        parts.append(files.select("name", F.lit(priority).alias("priority"), F.col("value").alias("text")))
    return parts[0].unionByName(parts[1])
