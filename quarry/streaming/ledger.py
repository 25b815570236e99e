"""Streams: per-file indexing as files arrive, and a windowed roll-up of the ledger."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import keep
from ..sources.crawl import MAX_BYTES, NAMES, below, contents, language_of, listing, looks_binary, root_of, skipped
from ..sources.extract import SCHEMA, _run
from ..sources.index import LEDGER_SCHEMA

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ledger_windows(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, verb, runs, spent_tokens) of a ledger stream or table, in tumbling windows; rows later than `late`
    behind the newest are dropped by the stream."""
    timed = rows.select(F.timestamp_seconds("ts").alias("at"), "verb", "spent_tokens").withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", width), "verb").agg(F.count(F.lit(1)).alias("runs"), F.sum("spent_tokens").alias("spent_tokens"))
    return grouped.select(F.col("window.start").alias("start"), "verb", "runs", "spent_tokens")


def read_ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LEDGER_SCHEMA).json(folder).where("verb is not null and repo is not null")


VERSIONS = "path string, version bigint, modified timestamp, len bigint, present boolean"


def index_stream(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Extract definitions and references of source files as they appear below root.

    Each batch writes a manifest row for every file version that it saw, whether it has definitions or not, and the
    version's rows; readers take the newest version of every path (see latest). A file that stops being text is a
    version without rows. Directories that are never entered are left out. A stream takes each path once; what is
    rewritten or deleted under its name is found by index_changes().
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).load(root)

    def absorb(batch: DataFrame, number: int) -> None:
        _absorb(batch, root_of(spark, root), out, f"batch={number:020d}")

    return files.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _absorb(files: DataFrame, base: str, out: str, name: str) -> None:
    """Write the versions and rows of files(path, modificationTime, length, content) under a folder of their own."""
    path = below(F.col("path"), base)
    known = files.where(language_of(F.col("path")).isNotNull()).select(
        path.alias("path"), F.lit(time.time_ns()).alias("version"), F.col("modificationTime").alias("modified"), F.col("length").alias("len"), "content")
    known = known.where(~skipped(F.col("path")))
    fits = (F.col("len") <= MAX_BYTES) & ~looks_binary(F.col("content"))
    known.select("path", "version", "modified", "len", F.lit(True).alias("present")).write.mode("overwrite").parquet(f"{out}/versions/{name}")
    # Rows carry their file by a number within the task, which is tied to the path before anything else moves.
    numbered = known.where(fits).select(F.struct("path", "version").alias("of"), language_of(F.col("path")).alias("lang"), "content")
    numbered.mapInArrow(_run_named, f"path string, version bigint, {SCHEMA}").drop("file_id").write.mode("overwrite").parquet(f"{out}/rows/{name}")


def _run_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As the extractor, with each file's path and version on its rows."""
    for b in batches:
        of = b.column("of")
        ids = pa.array(range(b.num_rows), pa.int32())
        for rows in _run(iter([pa.RecordBatch.from_arrays([ids, b.column("lang"), b.column("content")], ["file_id", "lang", "content"])])):
            mine = of.take(rows.column("file_id"))
            yield pa.RecordBatch.from_arrays([mine.field(0), mine.field(1), *rows.columns], ["path", "version", *rows.schema.names])


def index_changes(spark: SparkSession, root: str, out: str) -> int:
    """Bring the index up to date with what a file stream does not see: files rewritten under their names, and files
    that are gone. Returns the number of changes; each call that finds some adds one folder."""
    now = listing(spark, root).select("path", F.timestamp_micros(F.expr("mtime_nanos div 1000")).alias("v"), F.col("len").alias("l"), "uri")
    old = versions(spark, out).where("present").select("path", "modified", "len")
    both = keep(now.join(old, "path", "full").where("v is null or modified is null or v <> modified or l <> len"), "changes")
    n = both.count()
    if n:
        name = f"sweep={time.time_ns():020d}"
        both.where("v is null").select("path", F.lit(time.time_ns()).alias("version"), "modified", "len", F.lit(False).alias("present")).write.parquet(f"{out}/versions/{name}-gone")
        fresh = both.where("v is not null").select("uri", F.col("v").alias("modificationTime"), F.col("l").alias("length"))
        if not fresh.isEmpty():
            read = fresh.join(contents(spark, fresh), "uri").withColumnRenamed("uri", "path")
            _absorb(read, root_of(spark, root), out, name)
    return n


def versions(spark: SparkSession, out: str) -> DataFrame:
    """(path, version, modified, len, present): the newest version of every path, by the time it was read."""
    found = spark.read.schema(VERSIONS).option("recursiveFileLookup", "true").parquet(f"{out}/versions")
    return found.groupBy("path").agg(F.max(F.struct("version", "modified", "len", "present")).alias("m")).select("path", "m.*")


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Rows of the newest version of every path; none of paths that are gone."""
    rows = spark.read.schema(f"path string, version bigint, {SCHEMA}".replace("file_id int, ", "")).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    return rows.join(versions(spark, out).where("present").select("path", "version"), ["path", "version"], "left_semi")
