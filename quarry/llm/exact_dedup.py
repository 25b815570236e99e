"""Exact dedup by two-pass Bloom filtering.

Pass 1 hashes every normalised text and builds, partition by partition, a Bloom filter of what was seen and one of
what was seen again; merging partitions ORs both and adds to the second what both sides had seen. Pass 2 tests
every hash against the second filter: a hash that it lacks occurs once, so its row passes straight through. Only
the rest shuffles, and is grouped by the whole hash, so false positives cost a shuffle and never a result.

A filter has BITS_A_ROW bits a row at any size. Where that is more than `range_bits`, hashes are dealt to ranges by
their first bits, and each range is built and tested by itself, where its rows lie: hashes are written in order of
their ranges, so a range reads its own row groups only, and one filter of at most range_bits is broadcast at a time.
Of the rows that shuffle, those of texts with very many copies stay in place: their few groups are broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, Scratch, join_sized

HASHES = 4
BITS_A_ROW = 16
RANGE_BITS = 1 << 29  # 64 MB: the filter of one range, which is broadcast; more rows have more ranges
CHUNK_BITS = 1 << 20
LANE_BITS = 30  # of a hash, to deal it to ranges


def strip_white(text: Column) -> Column:
    """Delete every character of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _positions(digests: pa.Array, bits: int) -> np.ndarray:
    """(rows, HASHES) bit positions from the digests' first 16 bytes; all lie in one chunk."""
    width = 32
    raw = np.frombuffer(digests.buffers()[1], np.uint8)[digests.offset * width:(digests.offset + len(digests)) * width]
    lanes = raw.reshape(-1, width)[:, :16].copy().view(np.uint64)
    chunk_bits = min(bits, CHUNK_BITS)
    chunk = lanes[:, 0] % np.uint64(bits // chunk_bits)
    a, b = lanes[:, 1] & np.uint64(0xFFFFFFFF), (lanes[:, 1] >> np.uint64(32)) | np.uint64(1)
    i = np.arange(HASHES, dtype=np.uint64)
    within = (a[:, None] + i[None, :] * b[:, None]) % np.uint64(chunk_bits)
    return (chunk[:, None] * np.uint64(chunk_bits) + within).astype(np.int64)


def _fixed(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.cast(pa.binary(32))


def build_repeat_filter(hashed: DataFrame, bits: int) -> np.ndarray:
    """Bytes of the filter of hashes seen again. Tasks send compressed chunks of their two filters, one row for
    each chunk that they touch; each chunk is merged by itself and at most bits / 8 bytes reach the driver."""
    chunk_bits = min(bits, CHUNK_BITS)
    size = chunk_bits // 8

    def partial(batches):
        seen, again = {}, {}
        for batch in batches:
            pos = _positions(_fixed(batch.column("digest")), bits)
            order = np.argsort(pos[:, 0] // chunk_bits, kind="stable")
            chunks, starts = np.unique(pos[order, 0] // chunk_bits, return_index=True)
            for c, rows in zip(chunks.tolist(), np.split(order, starts[1:]), strict=True):
                if c not in seen:
                    seen[c], again[c] = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                s, g = seen[c], again[c]
                at, n = np.unique(pos[rows] - c * chunk_bits, return_counts=True)
                byte, mask = at >> 3, (128 >> (at & 7)).astype(np.uint8)
                twice = (n > 1) | ((s[byte] & mask) > 0)
                np.bitwise_or.at(g, byte[twice], mask[twice])
                np.bitwise_or.at(s, byte, mask)
        for c in seen:
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([c], pa.int64()),
                "seen": pa.array([zlib.compress(seen[c].tobytes(), 1)], pa.binary()),
                "again": pa.array([zlib.compress(again[c].tobytes(), 1)], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, g = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            for x, y in zip(batch.column("seen"), batch.column("again"), strict=True):
                a, b = (np.frombuffer(zlib.decompress(z.as_py()), np.uint8) for z in (x, y))
                g |= b | (s & a)
                s |= a
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int64()), "again": pa.array([g.tobytes()], pa.binary())})

    parts = hashed.select("digest").mapInArrow(partial, "chunk bigint, seen binary, again binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("chunk").applyInArrow(merge, "chunk bigint, again binary").collect():
        out[row["chunk"] * size:(row["chunk"] + 1) * size] = np.frombuffer(row["again"], np.uint8)
    return out


def dedup_exact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bits: int = RANGE_BITS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of docs, dropped ones too.

    Texts are equal when they are the same without white space [\\x20\\x09-\\x0D]; null counts as empty, and empty
    texts are equal to each other. The row with the most code points in its original text stays, then the smallest
    id. Rows that repeat an id all stay as rows of the result; of those that tie for the place of the kept row all
    count as kept. A null id is the smallest. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(spark, "exact-dedup")
    text = F.col(text_col)
    digest = F.sha2(strip_white(text), 256)
    hashed = scratch.keep(docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"), digest.alias("hex")).select(
            "id", "chars", F.unhex("hex").alias("digest"),
            # The last bits: positions in a filter come from the first ones.
            F.shiftright(F.conv(F.substring("hex", -8, 8), 16, 10).cast("bigint"), 32 - LANE_BITS).alias("lane")).sortWithinPartitions("lane"), "hashes")
    n = hashed.count()
    wanted = 1 << max(16, math.ceil(math.log2(max(1, n) * BITS_A_ROW)))
    ranges = max(1, min(1 << LANE_BITS, wanted // range_bits))
    bits, width = wanted // ranges, (1 << LANE_BITS) // ranges
    flagged = None
    for i in range(ranges):
        own = hashed if ranges == 1 else hashed.where((F.col("lane") >= i * width) & (F.col("lane") < (i + 1) * width))
        again = spark.sparkContext.broadcast(build_repeat_filter(own, bits))
        part = scratch.keep(own.select("id", "chars", "digest").mapInArrow(_flag(again, bits), f"id {dict(hashed.dtypes)['id']}, chars bigint, digest binary, maybe boolean"), "flagged")
        again.unpersist()
        flagged = part if flagged is None else flagged.unionByName(part)
    scratch.drop(hashed)
    once = flagged.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "digest")
    maybe = flagged.where("maybe").select("id", "chars", "digest")
    groups = scratch.keep(maybe.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").alias("keep_id"))).alias("best")), "groups")
    many = join_sized(maybe, groups, "digest", "group_size", n).select("id", F.col("best.keep_id").alias("keep_id"), "group_size", "digest")
    return once.unionByName(many).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def _flag(again, bits: int):
    """Batches with `maybe`: whether the filter `again` has the row's hash."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = again.value
        for batch in batches:
            pos = _positions(_fixed(batch.column("digest")), bits)
            hit = ((filled[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "maybe"])

    return flag
