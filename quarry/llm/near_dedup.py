"""Near-duplicate components by HyperMinHash.

A document's set is its distinct word shingles, hashed to 64 bits. The top bits of a hash choose one of REGISTERS
buckets; the bucket keeps the smallest rest, compressed to its leading-zero count and MANTISSA bits after the first
one. Empty buckets borrow from a filled one by a fixed probe sequence, so small sets compare like large ones.
Bands of registers are the candidate keys; `banding` takes as many rows a band as keep a pair at the threshold
from being missed with more than MISS probability.

Documents with the same set form a class first, and only one of each class goes on, so copies cost nothing. Classes
that share a band key hang together in candidate groups (each is tied to the key's smallest class, never to all of
them). Groups are cut into blocks of about BLOCK classes; each block also gets a few of the group's classes, PIVOTS.
In a block, pairs of which the collision-corrected estimate is far below the threshold are set aside, the others
are confirmed on full sets, and only links that join two components are kept. Groups of several blocks are then
compared across blocks, but only where blocks still lie in different components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, join_sized, lean, semi_rows, small, small_batches

BUCKET_BITS = 8
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
# Chance that two different minima compress to the same register, from the sketch's analysis: 0.1699 / 2**MANTISSA.
COLLISION = 0.169919487159739 / (1 << MANTISSA)
MISS = 1e-6
BLOCK = 128
ACROSS = 512  # sets of two blocks that are compared across
PIVOTS = 8
SURE = 48  # smaller sets are compared without an estimate
MARGIN = 6  # standard deviations of the estimate
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PROBES = _rng.integers(0, REGISTERS, (REGISTERS, 1024))
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out = np.multiply.accumulate(steps)
        if size > CHUNK_BYTES * 4:
            return out[:n]
        _powers[name] = out
    return _powers[name][:n]


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, of none has none."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK_BYTES):
            size += len(texts[end]) + 1
            end += 1
        yield from _chunk_sets(texts[at:end], words)
        at = end


def _chunk_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = b" ".join(texts).lower() + b" "
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    summed = np.empty(len(buf) + 1, np.uint64)
    summed[0] = 0
    np.cumsum(_BYTE[buf] * _power(_P, len(buf)), out=summed[1:])
    word = _mix((summed[ends] - summed[starts]) * _power(_P_INV, len(buf))[starts] + (ends - starts).astype(np.uint64))
    # Shingles of the whole chunk; those over the end of a text are left out below.
    n = max(0, len(word) - words + 1)
    run = np.zeros(n, np.uint64)
    for i in range(words):
        run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + word[i:i + n])
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, bounds)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(run[a:b - words + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
            yield h
        else:
            yield np.empty(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The REGISTERS compressed registers (uint16) of a non-empty sorted set."""
    shift = np.uint64(64 - BUCKET_BITS)
    bucket = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    filled, rest = bucket[first], hashes[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)
    # Leading zeros and mantissa straight from the float's exponent and fraction; rounding up is cut off first.
    cut = rest & ~np.uint64(0xFF)
    _, exponent = np.frexp(cut.astype(np.float64))
    zeros = (64 - BUCKET_BITS) - np.minimum(exponent, 64 - BUCKET_BITS)
    top = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (cut >> top) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    if len(filled) < REGISTERS:
        has = np.zeros(REGISTERS, bool)
        has[filled] = True
        empty = np.flatnonzero(~has)
        for width in (16, 1024):
            probe = _PROBES[empty, :width]
            hit = has[probe]
            found = hit.any(axis=1)
            out[empty[found]] = out[probe[found, hit[found].argmax(axis=1)]]
            empty = empty[~found]
            if not len(empty):
                break
        out[empty] = out[filled[0]]
    return out


def banding(threshold: float) -> tuple[int, int]:
    """(rows a band, bands): the most selective bands that miss a pair at the threshold with at most MISS."""
    best = (1, REGISTERS)
    for rows in range(2, 17):
        bands = REGISTERS // rows
        if (1 - threshold**rows) ** bands <= MISS:
            best = (rows, bands)
    return best


def band_keys(regs: np.ndarray, rows: int, bands: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(1)
    cut = regs[:rows * bands].reshape(bands, rows).astype(np.uint64)
    for i in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, i] + np.uint64(1))
    return key.view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of registers `one` against rows `many`."""
    return ((many == one).mean(axis=1) - COLLISION) / (1 - COLLISION)


class _Union:
    def __init__(self, labels: list):
        self.up = list(range(len(labels)))
        seen: dict = {}
        for i, c in enumerate(labels):
            if c is not None:
                self.up[i] = seen.setdefault(c, i)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def block_links(ids: list, comps: list, sets: list[np.ndarray], percent: int) -> Iterator[tuple]:
    """Confirmed links between the members of a block, as few as join what hangs together."""
    joined = _Union(comps)
    sizes = np.array([len(s) for s in sets])
    regs = np.stack([registers(s) for s in sets])
    t = percent / 100
    floor = t - MARGIN * math.sqrt(t * (1 - t) / REGISTERS)
    waiting: list[tuple[float, int, int]] = []
    roots = np.array([joined.root(i) for i in range(len(ids))])
    for i in range(len(ids) - 1):
        small, large = np.minimum(sizes[i + 1:], sizes[i]), np.maximum(sizes[i + 1:], sizes[i])
        may = np.flatnonzero((100 * small >= percent * large) & (roots[i + 1:] != roots[i])) + i + 1
        if not len(may):
            continue
        near = estimate(regs[i], regs[may])
        keep = (near >= floor) | (np.minimum(sizes[may], sizes[i]) < SURE)
        waiting += zip(near[keep].tolist(), [i] * int(keep.sum()), may[keep].tolist(), strict=True)
    waiting.sort(key=lambda x: -x[0])
    for _, i, j in waiting:
        a, b = joined.root(i), joined.root(j)
        if a == b:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            joined.up[b] = a
            yield ids[i], ids[j]


def _verify(spark: SparkSession, texts: DataFrame, members: DataFrame, n: int, percent: int, words: int) -> DataFrame:
    """Links (a, b) of members (rep, grp, blk, comp): every block's members are brought together once."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(_bytes(b.column("text")), words)
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("grp"), b.column("blk"), b.column("comp"), pa.array((s.tobytes() for s in sets), pa.binary())],
                ["rep", "grp", "blk", "comp", "hashes"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, [], [], [])
        out: list[tuple] = []

        def end():
            if len(held[1]) > 1:
                out.extend(block_links(held[1], held[2], held[3], percent))

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field("rep").type
            for rep, grp, blk, comp, hashes in zip(*(b.column(c).to_pylist() for c in ("rep", "grp", "blk", "comp")), b.column("hashes"), strict=True):
                if (grp, blk) != held[0]:
                    end()
                    held = ((grp, blk), [], [], [])
                held[1].append(rep)
                held[2].append(comp)
                held[3].append(np.frombuffer(hashes.as_buffer(), np.uint64))
        end()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k in (0, 1)], ["a", "b"])

    kind = dict(members.dtypes)["rep"]
    own = semi_rows(texts, "id", members.select(F.col("rep").alias("id")).distinct(), n).withColumnRenamed("id", "rep").join(small(members, n), "rep").select("rep", "grp", "blk", "comp", "text")
    sets = own.mapInArrow(lean(to_sets), f"rep {kind}, grp {kind}, blk string, comp {kind}, hashes binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(parts, "grp", "blk").sortWithinPartitions("grp", "blk", "rep")
    return dealt.mapInArrow(lean(links), f"a {kind}, b {kind}")


def _bytes(column: pa.Array) -> list[bytes]:
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased; a set holds the distinct shingles of `words` words, or
    the whole sequence if it is shorter. Sets with 100 * intersection >= percent * union are linked. component_id
    is the smallest id reachable over links, itself included; kept: it is the row's own id. Null and empty texts
    have no shingles and are linked with nothing. Ids should be unique and not null: rows that repeat an id are
    taken as that many copies of its component, and a null id stays in a component of its own. An empty table gives
    no rows. Texts of any length are compared whole; a set takes eight bytes a shingle in the task that confirms it, with
    those of the block around it. Other columns are ignored.
    """
    small_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    rows, bands = banding(percent / 100)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["id"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints, keys = [], [], []
            for s in shingle_sets(_bytes(b.column("text")), words):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(registers(s), rows, bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n", "print", "keys"])

    sketches = scratch.keep(texts.mapInArrow(lean(sketch), f"id {kind}, n bigint, print binary, keys array<bigint>"), "sketches")
    whole = sketches.where(F.col("print").isNotNull() & F.col("id").isNotNull())
    # One of each class of equal sets; copies are reduced before the shuffle.
    classes = scratch.keep(whole.groupBy("print").agg(F.min("id").alias("rep"), F.any_value("keys").alias("keys"), F.count(F.lit(1)).alias("copies")), "classes")
    # A key's classes are tied to its smallest one: a map-side minimum, then a join with one row a key.
    keyed = classes.select("rep", F.explode("keys").alias("key"))
    hubs = scratch.keep(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1"), "hubs")
    # With the number of classes that share the keys; a hub is tied to itself here, for its own number.
    ties = scratch.keep(join_sized(keyed, hubs, "key", "m", bands * classes.count()).groupBy("rep", "hub").agg(F.sum("m").alias("shared")), "ties")
    groups = connected_components(spark, ties.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")), scratch)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    member = scratch.keep(groups.join(sizes, "component").select(
        F.col("v").alias("rep"), F.col("component").alias("grp"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "groups")
    n = member.count()
    block = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")
    large = member.where("blocks > 1")
    # Some classes of a group go to all its blocks: the first ones by PIVOTS hashes, and in each of PIVOTS parts the one
    # that shares keys with the most classes, which is where a group of copies of one text has its middle.
    shared = ties.groupBy("rep").agg(F.sum("shared").alias("shared"))
    part = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(PIVOTS))
    picks = F.array_compact(F.array_distinct(F.array(
        *[F.min_by("rep", F.xxhash64("rep", F.lit(i))) for i in range(PIVOTS)],
        *[F.max_by("rep", F.when(part == i, F.struct("shared", "rep"))) for i in range(PIVOTS)])))
    pivots = large.join(shared, "rep").groupBy("grp").agg(F.first("blocks").alias("blocks"), picks.alias("reps")).select("grp", "blocks", F.explode("reps").alias("rep"))
    everywhere = pivots.select("rep", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    placed = member.select("rep", "grp", block.alias("blk")).union(everywhere).distinct().select(
        "rep", "grp", F.col("blk").cast("string").alias("blk"), F.lit(None).cast(kind).alias("comp"))
    links = scratch.keep(_verify(spark, texts, placed, n, percent, words), "links")
    comps = connected_components(spark, links, scratch)
    if not large.isEmpty():
        links = links.unionByName(_across(spark, texts, large, comps, percent, words, scratch))
        comps = connected_components(spark, links, scratch)
    label = scratch.keep(classes.select("print", "rep", "copies").join(comps, F.col("rep") == F.col("v"), "left").select(
        "print", "copies", F.coalesce("component", "rep").alias("component")), "labels")
    of_class = join_sized(whole.select("id", "n", "print"), label, "print", "copies", sketches.count()).select("id", "n", "component")
    alone = sketches.where(F.col("print").isNull() | F.col("id").isNull()).select("id", "n", F.col("id").alias("component"))
    return of_class.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("id")).alias("kept"))


def _across(spark: SparkSession, texts: DataFrame, large: DataFrame, comps: DataFrame, percent: int, words: int, scratch: Scratch) -> DataFrame:
    """Links across the blocks of large groups, where components still differ.

    A block now holds members of one component, or several small components together; two blocks of the same
    component are never compared, so a group that has become one component costs nothing here.
    """
    now = large.join(comps, large["rep"] == comps["v"], "left").select("rep", "grp", F.coalesce("component", "rep").alias("comp"))
    half = ACROSS // 2
    pure = F.col("m") > half / 4
    count = now.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("m"))
    per_group = count.groupBy("grp").agg(F.count(F.lit(1)).alias("comps"), F.sum(F.when(~pure, F.col("m"))).alias("loose")).where("comps > 1")
    sized = count.join(per_group, "grp")
    # Large components are cut into slices of their own; small ones are dealt by hash into as many mixed blocks as they fill.
    mixed = F.concat(F.lit("m"), F.pmod(F.xxhash64("comp"), F.ceil(F.col("loose") / (half / 2))).cast("string"))
    plan = sized.select("grp", "comp", pure.alias("pure"), F.ceil(F.col("m") / half).alias("slices"), mixed.alias("mixed"))
    name = F.when(F.col("pure"), F.concat(
        F.lit("p"), F.col("comp").cast("string"), F.lit(":"), F.pmod(F.xxhash64("rep", F.lit(3)), F.col("slices")).cast("string"))).otherwise(F.col("mixed"))
    blocks = scratch.keep(now.join(plan, ["grp", "comp"]).select("rep", "grp", "comp", name.alias("name"), F.when(F.col("pure"), F.col("comp")).alias("only")), "blocks")
    names = blocks.groupBy("grp", "name").agg(F.first("only").alias("only"))
    other = names.select("grp", F.col("name").alias("name2"), F.col("only").alias("only2"))
    pairs = names.join(other, "grp").where("name <= name2 and not (only is not null and only2 is not null and only = only2)")
    sides = pairs.select("grp", "name", F.concat_ws("|", "name", "name2").alias("blk")).union(pairs.select("grp", "name2", F.concat_ws("|", "name", "name2"))).distinct()
    members = scratch.keep(blocks.join(sides, ["grp", "name"]).select("rep", "grp", "blk", "comp"), "across")
    n = members.count()
    return scratch.keep(_verify(spark, texts, members, n, percent, words), "links")
