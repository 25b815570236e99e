"""The saved index and the usage ledger."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

VERSION = 1

LEDGER_SCHEMA = "ts bigint, repo string, verb string, spent_tokens bigint, spent_ms bigint, naive_tokens bigint, naive_ms bigint, model string"


@dataclass
class Index:
    files: DataFrame  # file_id, path, n_bytes, content, lang
    symbols: DataFrame  # sym_id, name, kind, file_id, line, end_line, start_byte, end_byte, cx, body_start, body_end
    refs: DataFrame  # ref_id, name, file_id, start_byte, end_byte
    edges: DataFrame  # src, dst, weight

    TABLES = ("files", "symbols", "refs", "edges")


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_index(spark: SparkSession, path: str, index: Index, manifest: DataFrame) -> None:
    """Write all tables under another name, then put the folder in place."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    for name in Index.TABLES:
        getattr(index, name).write.parquet(f"{tmp}/v{VERSION}/{name}")
    manifest.write.parquet(f"{tmp}/v{VERSION}/manifest")
    there, store = _store(spark, path)
    store.delete(there, True)
    store.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tmp), there)


def load_index(spark: SparkSession, path: str) -> tuple[Index, DataFrame] | None:
    """(index, manifest), or None if there is none of this version that can be read."""
    try:
        tables = {name: spark.read.parquet(f"{path}/v{VERSION}/{name}") for name in (*Index.TABLES, "manifest")}
        for name, key in (("files", "path"), ("symbols", "sym_id"), ("refs", "ref_id"), ("edges", "src"), ("manifest", "hash")):
            tables[name].select(key).count()
    except Exception:  # noqa: BLE001  whatever is wrong with the files, the index is rebuilt
        return None
    return Index(*[tables[n] for n in Index.TABLES]), tables["manifest"]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows of a JSON-lines file; lines that are no row are left out."""
    raw = spark.read.schema(LEDGER_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return raw.where("verb is not null and repo is not null")


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
