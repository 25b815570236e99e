"""Training-order materialisation: token ids in a keyed random order, in fixed-stride binary shards.

Each task encodes its documents, ends each with the end mark and cuts the stream into sequences of `seq_len` ids.
Counts by task give every sequence a number 0..N-1; a keyed Feistel network over the next even power of two,
walked along its cycle until it lands below N, turns the number into its global slot. It is a bijection, so no
slot needs a look at any other. Slots are dealt to tasks by range and each task writes its shards: slot s is row
s % rows_per_shard of shard s // rows_per_shard, and row r begins at byte r * seq_len * 2. A reader can start at
any slot and read on.

Encoded sequences are kept compressed in the shared folder, against a dictionary of the ids of at most DICT_DOCS
documents' beginnings (compression is lossless whatever the dictionary), and shards are written under another name and then
renamed, so a lost executor costs only its tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, small_batches
from .tokens import ByteCodec

ROUNDS = 6
DICT_DOCS, DICT_CHARS, DICT_BYTES = 64, 4096, 1 << 16
SPAN = "array<struct<doc_id:{kind},doc_from:bigint,seq_from:int,n:int>>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _network(x: np.ndarray, h: int, key: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << h) - 1)
    left, right = x >> np.uint64(h), x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        k = _mix(np.array([(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)], np.uint64))
        if back:
            left, right = right ^ (_mix(left + k) & mask), left
        else:
            left, right = right, left ^ (_mix(right + k) & mask)
    return (left << np.uint64(h)) | right


def permute(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Slots of indexes in [0, n), or with back=True indexes of slots: a bijection of [0, n) for each key."""
    h, out = _half_bits(n), np.asarray(index, np.uint64)
    with np.errstate(over="ignore"):
        out = _network(out, h, key, back)
        while (far := out >= np.uint64(n)).any():
            out[far] = _network(out[far], h, key, back)
    return out.astype(np.int64)


def sample_dictionary(docs: DataFrame, codec_args: tuple[str, str], text_col: str) -> bytes:
    some = docs.where(F.col(text_col).isNotNull()).select(F.substring(F.col(text_col), 1, DICT_CHARS).alias("t")).limit(DICT_DOCS).collect()
    codec = ByteCodec(*codec_args)
    return b"".join(codec.ids(r["t"]) for r in some)[:DICT_BYTES]


def _raw_dict(dictionary: bytes):
    import zstandard

    # The format wants eight bytes at least.
    return zstandard.ZstdCompressionDict(dictionary.ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def encode_sequences(docs: DataFrame, codec_args: tuple[str, str], dictionary: bytes, seq_len: int, id_col: str, text_col: str) -> DataFrame:
    """(part, idx, n_tokens, payload, spans): sequences of each task, payload being zstandard-compressed uint16 ids."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec, press = ByteCodec(*codec_args), zstandard.ZstdCompressor(level=5, dict_data=_raw_dict(dictionary))
        part, width = TaskContext.get().partitionId(), 2 * seq_len
        eot = codec.eot.to_bytes(2, "little")
        held, spans, idx = bytearray(), [], 0
        rows: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(
                [{"part": part, "idx": i, "n_tokens": len(p) // 2, "payload": press.compress(p), "spans": s} for i, p, s in rows], schema=shape)

        shape = None
        for batch in batches:
            if shape is None:
                of = batch.schema.field("id").type
                shape = pa.schema([("part", pa.int32()), ("idx", pa.int64()), ("n_tokens", pa.int32()), ("payload", pa.binary()), (
                    "spans", pa.list_(pa.struct([("doc_id", of), ("doc_from", pa.int64()), ("seq_from", pa.int32()), ("n", pa.int32())])))])
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = codec.ids(text.as_py() or "") + eot
                at = 0
                while at < len(ids):
                    n = min(width - len(held), len(ids) - at)
                    spans.append({"doc_id": key, "doc_from": at // 2, "seq_from": len(held) // 2, "n": n // 2})
                    held += ids[at:at + n]
                    at += n
                    if len(held) == width:
                        rows.append((idx, bytes(held), spans))
                        held, spans, idx = bytearray(), [], idx + 1
                if len(rows) >= 512:
                    yield batch_of(rows)
                    rows = []
        if held:
            rows.append((idx, bytes(held), spans))
        if rows:
            yield batch_of(rows)

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(lean(run), f"part int, idx bigint, n_tokens int, payload binary, spans {SPAN.format(kind=kind)}")


def materialise(spark: SparkSession, docs: DataFrame, out_dir: str, codec_args: tuple[str, str], seq_len: int = 2048, rows_per_shard: int = 4096,
                key: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to out_dir; return their index: slot, shard, row, byte_offset, n_tokens, n_docs, spans, ids_sha256.

    codec_args: path of a tiktoken rank file and its pattern. Every row of docs is written, ended by the end mark;
    null and empty texts are an end mark alone. The last sequence of a task may be short: its row is filled up
    with end marks that n_tokens does not count. ids_sha256 is of the row's counted bytes. Repeated rows are
    written each; null ids stay null in spans. An empty table writes no shard. Other columns are ignored.
    """
    small_batches(spark)
    scratch = Scratch(spark, "training-order")
    dictionary = sample_dictionary(docs, codec_args, text_col)
    seqs = scratch.keep(encode_sequences(docs, codec_args, dictionary, seq_len, id_col, text_col), "sequences")
    # As many rows as tasks, whatever the number of documents.
    sizes = {r["part"]: r["n"] for r in seqs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    base = np.zeros(max(sizes, default=0) + 1, np.int64)
    base[1:] = np.cumsum([sizes.get(p, 0) for p in range(len(base) - 1)])
    kind = dict(docs.dtypes)[id_col]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = base[b.column("part").to_numpy()] + b.column("idx").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(permute(at, n, key)), b.column("n_tokens"), b.column("payload"), b.column("spans")], ["slot", "n_tokens", "payload", "spans"])

    spans = SPAN.format(kind=kind)
    shards = max(1, -(-n // rows_per_shard))
    tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = -(-shards // tasks)
    placed = seqs.mapInArrow(lean(place), f"slot bigint, n_tokens int, payload binary, spans {spans}")
    dealt = placed.repartitionById(tasks, (F.col("slot") / (rows_per_shard * each)).cast("int")).sortWithinPartitions("slot")
    out_dir = out_dir.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, top = open_store(out_dir)
        store.create_dir(top, recursive=True)
        unpress, width = zstandard.ZstdDecompressor(dict_data=_raw_dict(dictionary)), 2 * seq_len
        eot = codec_eot.to_bytes(2, "little")
        shard, out, tmp = -1, None, ""
        attempt = TaskContext.get().taskAttemptId()

        def close():
            if out is not None:
                out.close()
                put_in_place(store, tmp, f"{top}/{shard_name(shard)}")

        for b in batches:
            slots = b.column("slot").to_numpy()
            digests = []
            for slot, payload in zip(slots.tolist(), b.column("payload"), strict=True):
                if slot // rows_per_shard != shard:
                    close()
                    shard = slot // rows_per_shard
                    tmp = f"{top}/.{shard_name(shard)}.{attempt}"
                    out = store.open_output_stream(tmp)
                row = unpress.decompress(payload.as_py(), max_output_size=width)
                out.write(row + eot * ((width - len(row)) // 2))
                digests.append(hashlib.sha256(row).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), b.column("n_tokens"), b.column("spans"), pa.array(digests, pa.string())], ["slot", "n_tokens", "spans", "ids_sha256"])
        close()

    codec_eot = ByteCodec(*codec_args).eot
    index = scratch.keep(dealt.mapInArrow(lean(write), f"slot bigint, n_tokens int, spans {spans}, ids_sha256 string"), "index")
    scratch.drop(seqs)
    row = (F.col("slot") % rows_per_shard).cast("bigint")
    return index.select(
        "slot", F.floor(F.col("slot") / rows_per_shard).cast("bigint").alias("shard"), row.alias("row"), (row * 2 * seq_len).alias("byte_offset"),
        "n_tokens", F.size(F.array_distinct(F.transform("spans", lambda s: s["doc_id"]))).alias("n_docs"), "spans", "ids_sha256")


def open_store(out_dir: str):
    """(file system, path) of a folder; Spark's names of an object store are those of its own protocol."""
    from pyarrow import fs

    scheme, sep, rest = out_dir.rstrip("/").partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else out_dir.rstrip("/"))


def put_in_place(store, tmp: str, name: str) -> None:
    """Rename a finished shard. An earlier attempt's shard, which is the same, may be there and may not give way."""
    from pyarrow import fs

    try:
        store.move(tmp, name)
    except OSError:
        if store.get_file_info(name).type == fs.FileType.NotFound:
            raise
        store.delete_file(tmp)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(out_dir: str, first: int, count: int, seq_len: int = 2048, rows_per_shard: int = 4096) -> Iterator[np.ndarray]:
    """Rows of `count` slots from `first` on, in order: what a trainer that resumes reads."""
    store, top = open_store(out_dir)
    slot, width = first, 2 * seq_len
    while slot < first + count:
        shard, row = divmod(slot, rows_per_shard)
        with store.open_input_file(f"{top}/{shard_name(shard)}") as f:
            f.seek(row * width)
            while slot < first + count and slot // rows_per_shard == shard and (got := f.read(width)):
                yield np.frombuffer(got, "<u2")
                slot += 1
