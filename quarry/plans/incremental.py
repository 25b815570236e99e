"""Building, saving and reusing an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import keep, shared_dir
from ..functions.text import fnv1a64
from ..operators.relations import manifest_diff, really_changed, resolve_edges
from ..sources.crawl import contents, crawl, listing, looks_binary, stats
from ..sources.extract import extract
from ..sources.index import Index, load_index, save_index


@dataclass
class Opened:
    index: Index
    state: str  # hit or rebuilt


def build_index(spark: SparkSession, root: str, tier2: str = "basename") -> Index:
    files = keep(crawl(spark, root), "files")
    return index_of(files, tier2)


def index_of(files: DataFrame, tier2: str = "basename") -> Index:
    """An index of any files(file_id, path, n_bytes, content, lang)."""
    symbols, refs = extract(files)
    symbols, refs = keep(symbols, "symbols"), keep(refs, "refs")
    return Index(files, symbols, refs, keep(resolve_edges(refs, symbols, files, tier2), "edges"))


def index_path(spark: SparkSession, root: str, folder: str | None = None) -> str:
    """Where the index of a root is kept: a folder named by the hash of the root's canonical path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    canonical = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    name = spark.range(1).select(fnv1a64(F.lit(canonical).cast("binary")).alias("h")).first()["h"]
    return f"{folder or shared_dir(spark) + '/index'}/{name}"


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """manifest(path, len, mtime_nanos, hash) of every listed file, binary ones included."""
    listed = listing(spark, root)
    both = listed.join(contents(spark, listed), "uri")
    # A binary file is listed but never indexed; its entry keeps it from looking new in every run.
    return both.select("path", "len", "mtime_nanos", F.when(looks_binary(F.col("content")), F.lit("binary")).otherwise(fnv1a64(F.col("content"))).alias("hash"))


def open_index(spark: SparkSession, root: str, use_saved: bool = True, folder: str | None = None, tier2: str = "basename") -> Opened:
    """The saved index if nothing has changed, else a new one.

    No saved index, one that can't be read, or a file missing: rebuilt. Files whose time or length changed but whose
    content did not: hit, and the manifest takes the new times. Anything else: rebuilt as a whole.
    """
    path = index_path(spark, root, folder)
    saved = load_index(spark, path) if use_saved else None
    if saved is not None:
        index, manifest = saved
        now = stats(spark, root)
        diff = keep(manifest_diff(manifest, now), "diff")
        counts = {r["state"]: r["count"] for r in diff.groupBy("state").count().collect()}
        if not set(counts) - {"same"}:
            return Opened(index, "hit")
        if not counts.get("missing"):
            fresh = keep(hashes(spark, root), "manifest")
            if really_changed(diff, manifest, fresh).isEmpty():
                # Read from a copy: the folder that is written now is the one these tables come from.
                copy = Index(*[keep(getattr(index, n), n) for n in Index.TABLES])
                save_index(spark, path, copy, fresh)
                return Opened(copy, "hit")
    index = build_index(spark, root, tier2)
    if use_saved:
        save_index(spark, path, index, hashes(spark, root))
    return Opened(index, "rebuilt")
