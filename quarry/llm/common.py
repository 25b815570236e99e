"""Shared storage, input readers and connected components for the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

SLICE_ROWS = 2_000
# Rows of a side that may be broadcast, counted before each use; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000
# Words of 64 bits of a Bloom filter that is broadcast, whatever the number of its keys.
SLOTS = 1 << 20
# At most so many hot keys are broadcast: a key is hot from the (rows / HOT_KEYS)th row on.
HOT_KEYS = 100_000
COLD_ROWS = 64


def free_name(columns: Iterable[str], name: str) -> str:
    """`name`, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, n: int) -> DataFrame:
    """df, to be broadcast if its n rows may be."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def hot_from(n: int) -> int:
    """The number of rows from which one of n rows' keys counts as hot; at most HOT_KEYS keys have more."""
    return max(COLD_ROWS, n // HOT_KEYS)


def join_sized(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """rows joined to groups, which has one row a key and the number `size` of its n rows in all.

    Hot keys' groups are broadcast, so that their rows stay where they are; the others are shuffled, and none of
    them has more than hot_from(n) rows. Both sides are read twice and should be written tables.
    """
    most = hot_from(n)
    hot = groups.where(F.col(size) > most)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= most), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def _bits(h: str) -> str:
    return " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(`{h}`, {20 + 6 * i}) & 63 as int))" for i in range(4))


def perhaps_in(rows: DataFrame, key: str, keys: DataFrame, n: int, flag: str) -> DataFrame:
    """rows with the boolean `flag`: false where `keys` (n rows, column `key`) surely lacks the row's key.

    A Bloom filter of at most SLOTS words, joined by its word's place, so that rows of other keys need no shuffle.
    """
    slots = min(SLOTS, 1 << max(10, (n // 4).bit_length()))
    hashed = keys.select(F.xxhash64(key, F.lit(77)).alias("h"))
    words = hashed.select(F.expr(f"h & {slots - 1}L").alias("slot"), F.expr(_bits("h")).alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    h, at, held = (free_name(rows.columns, x) for x in ("bloom_hash", "bloom_slot", "bloom_bits"))
    own = rows.withColumn(h, F.xxhash64(key, F.lit(77)))
    met = own.join(F.broadcast(words.select(F.col("slot").alias(at), F.col("bits").alias(held))), F.expr(f"`{h}` & {slots - 1}L") == F.col(at), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.expr(f"coalesce(`{held}` & ({_bits(h)}), 0) = ({_bits(h)})").alias(flag))


def semi_rows(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """rows to be joined to keys (n rows): all of them where keys will be broadcast, else those that may meet one."""
    if n <= BROADCAST_ROWS:
        return rows
    flag = free_name(rows.columns, "perhaps")
    return perhaps_in(rows, key, keys, n, flag).where(F.col(flag)).drop(flag)


def without_keys(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """rows whose key is not among the n keys. Only rows that a Bloom filter does not clear are shuffled."""
    keys = keys.select(key)
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key, "left_anti").select(rows.columns)
    flag = free_name(rows.columns, "perhaps")
    marked = perhaps_in(rows, key, keys, n, flag)
    doubted = marked.where(F.col(flag)).drop(flag).join(keys, key, "left_anti")
    return marked.where(~F.col(flag)).drop(flag).unionByName(doubted).select(rows.columns)


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for later tasks, and idle ones should hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Let the session send documents to Python in batches of at most SLICE_ROWS rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= SLICE_ROWS:
        spark.conf.set(name, SLICE_ROWS)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = SLICE_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` over slices of at most `rows` rows, with its memory given back at the end of the task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    yield b.slice(at, rows)

        try:
            yield from run(slices())
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Folders that Scratches take inside are deleted at the end: results must have been written elsewhere."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            delete_folder(spark, path)


class Scratch:
    """Written tables that cut lineage; they outlive any executor. `lasting` ones outlive passing() too."""

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        if _passing and not lasting:
            _passing[-1].append(self.base)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{label}"

    def keep(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        """Write df as Parquet, with the writer's options, and return a reader of it."""
        path = self.path(label)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quarry_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete what keep() wrote; for tables that no later plan reads."""
        delete_folder(self.spark, df._quarry_path)


def _plain_read(df: DataFrame) -> bool:
    """Whether df's rows are those of one set of files, with columns and rows left out at most."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.children().size() == 1:
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation"


def number_rows(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df with `name`, a bigint of its own for each row, the same in every read.

    Rows of Parquet files are numbered by their file and their place in it, so nothing is written; the files are no
    more than their reader holds on the driver anyway. Other tables are written with their numbers.
    """
    path, place, file = (free_name([*df.columns, name], x) for x in ("file_path", "file_place", "file_no"))
    if _plain_read(df):
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
        except AnalysisException:  # a format that does not count its rows
            placed = None
        if placed is not None:
            files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
            if not files:
                return df.withColumn(name, F.lit(0).cast("bigint"))
            numbers = spark.createDataFrame(list(enumerate(files)), f"`{file}` bigint, `{path}` string")
            met = placed.join(F.broadcast(numbers), path)
            return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.shiftleft(F.col(file), 40) + F.col(place)).alias(name))
    return Scratch(spark, "rows").keep(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, component): the smallest vertex reachable over edges (a, b), for every vertex of an edge.

    Contraction: every vertex points to the smallest vertex next to it or itself, pointers are followed to their
    roots by doubling, and edges are rewritten to roots; edges inside one root go. At least half of the vertices
    disappear in a round, so rounds and the doubling steps of each grow with the logarithm of the graph. Labels and
    edges stay distributed; each step is written to the shared folder. A hub's neighbours are reduced to a
    minimum before any shuffle; where labels are followed to a hub, rows are two numbers, and a partition that grows
    beyond the skew threshold of adaptive execution is split by it.
    """
    left = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    label = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("r")), "cc-up")
        while True:
            step = scratch.keep(up.join(up.select(F.col("v").alias("r"), F.col("r").alias("rr")), "r").select("v", F.col("rr").alias("r"), (F.col("r") != F.col("rr")).alias("moved")), "cc-up")
            moved = not step.where("moved").isEmpty()
            scratch.drop(up)
            up = step
            if not moved:
                break
        roots = up.select("v", "r")
        # Roots of earlier rounds are vertices of this one, unless they have no edges left.
        new = roots.withColumnRenamed("r", "component") if label is None else (
            label.join(roots.select(F.col("v").alias("component"), "r"), "component", "left").select("v", F.coalesce("r", "component").alias("component")))
        old, label = label, scratch.keep(new, "cc-label")
        a, b = roots.select(F.col("v").alias("a"), F.col("r").alias("ra")), roots.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        fewer = scratch.keep(left.join(a, "a").join(b, "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        for x in (left, up, *([old] if old is not None else [])):
            scratch.drop(x)
        left = fewer
        if left.isEmpty():
            return label
