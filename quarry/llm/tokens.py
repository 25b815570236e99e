"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of more than CHUNK characters is encoded as overlapping chunks, with offsets; a shorter one is a single chunk.
Two neighbours are spliced at a common boundary inside their overlap: an ASCII white-space character that follows a
non-space. A pre-tokeniser that never lets a piece reach over such a place makes it a boundary: what lies left of it
is encoded alike whatever follows, and what lies right of it whatever precedes. A splice also needs the tokens since
another such boundary of the overlap to be the same in both chunks. Where an overlap has no such pair, the left chunk
is widened, twice as far each time, to the end of the text if need be.

Whether the pre-tokeniser parts text there is tried out when the file is loaded; where it does not, texts are encoded
whole. Either way the counts are the library's own of the whole text (tests compare them).
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

CHUNK = 8_192
OVERLAP = 256
BATCH_CHARS = 1 << 20
# ASCII characters that the tokenisers' patterns, Python's and Rust's rules all call white space.
CUT = re.compile(r"(?<=[^\s])[ \t\n\r]")


def parts_at_white(pieces_of: Callable[[str], list[tuple[int, int]]]) -> bool:
    """Whether no piece of some text reaches over a boundary: tried between characters of many kinds."""
    kinds = ["a", "Z", "é", "語", "7", "!", "'", "'s", "_", "-", "\u0301", "\u00a0", "😀", "<|endoftext|>"]
    for left in kinds:
        for right in [*kinds, " ", "\n"]:
            text = "".join(f"x{left}{w}{right}" for w in (" ", "\t", "\n", "\r"))
            cuts = [m.start() for m in CUT.finditer(text)]
            if any(a < p < b for a, b in pieces_of(text) for p in cuts):
                return False
    return True


# The normalisation that plain texts are spared, and the first step of a pre-tokeniser that drops all white space.
SPARED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
DROPS_WHITE = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
# Latin, Cyrillic and general punctuation: no character of these composes with another one of them.
PLAIN = [*range(0x300), *range(0x400, 0x482), *range(0x48A, 0x530), *range(0x2010, 0x2028)]


def spared(path: str, library):
    """(a tokeniser without its normaliser, a pattern of characters that it must not be given), or None.

    NFC leaves texts of PLAIN characters alone, Python lower-cases them like the library, and white space is dropped
    later. Each character is tried out; those that the library makes something else of are not given.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = said.get("pre_tokenizer") or {}
    if (said.get("normalizer") or {}).get("normalizers") != SPARED or (steps.get("pretokenizers") or [None])[0] != DROPS_WHITE:
        return None
    from tokenizers import Tokenizer

    alike = [c for c in map(chr, PLAIN) if library.normalizer.normalize_str(c) == c.lower() and len(c.lower()) == 1 or c in " \t\n\r"]
    bare = Tokenizer.from_str(json.dumps(said | {"normalizer": None}))
    bare.no_truncation()
    bare.no_padding()
    return bare, re.compile("[^" + "".join(map(re.escape, alike)) + "]")


class JsonPart:
    """The tokens of a chunk, asked for only where they are needed."""

    def __init__(self, encoding, text: str):
        self.e, self.text = encoding, text

    def __len__(self) -> int:
        return len(self.e)

    def first_from(self, at: int) -> int:
        """The first token from the boundary `at` on."""
        for q in range(at, len(self.text)):
            k = self.e.char_to_token(q)
            if k is not None:
                return k
        return len(self.e)

    def starts(self, i: int, j: int) -> list[int]:
        return [self.e.token_to_chars(k)[0] for k in range(i, j)]

    def ids(self, i: int, j: int) -> np.ndarray:
        return np.array(self.e.ids[i:j], np.int64)


class ArrayPart:
    """Tokens as arrays of ids and of starts in code points."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        self.all, self.at = ids, at

    def __len__(self) -> int:
        return len(self.all)

    def first_from(self, at: int) -> int:
        return int(np.searchsorted(self.at, at))

    def starts(self, i: int, j: int) -> list[int]:
        return self.at[i:j].tolist()

    def ids(self, i: int, j: int) -> np.ndarray:
        return self.all[i:j]


class JsonCodec:
    """A tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cuttable = self.library.pre_tokenizer is not None and parts_at_white(self._pieces)
        self.spared = spared(path, self.library)
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]

    def _encoded(self, texts: list[str], fast: bool) -> list:
        """The library's encodings, by the tokeniser without a normaliser where that gives the same."""
        encode = lambda library: library.encode_batch_fast if fast else library.encode_batch
        out, plain, rest = [None] * len(texts), [], range(len(texts))
        if self.spared is not None:
            bare, strange = self.spared
            low = [t.lower() for t in texts]
            # Added tokens are looked for before texts are lower-cased.
            plain = [i for i, t in enumerate(texts) if not strange.search(t) and not any(a in low[i] for a in self.added)]
            rest = sorted(set(rest) - set(plain))
            for i, e in zip(plain, encode(bare)([low[i] for i in plain], add_special_tokens=False), strict=True):
                out[i] = e
        for i, e in zip(rest, encode(self.library)([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e
        return out

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[JsonPart]:
        return [JsonPart(e, t) for e, t in zip(self._encoded(texts, False), texts, strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self._encoded(texts, True)]


def _splice(text: str, a, a_at: int, b, b_at: int, since: int, until: int) -> int | None:
    """A proven common boundary p, since < p < until, of chunk a (begins at a_at) and chunk b (at b_at), or None."""
    last = None
    for m in CUT.finditer(text, since + 1, until):
        p = m.start()
        here = a.first_from(p - a_at), b.first_from(p - b_at)
        if last is not None:
            (at, i, k), (j, n) = last, here
            if j - i == n - k and np.array_equal(a.ids(i, j), b.ids(k, n)) and [x + a_at for x in a.starts(i, j)] == [x + b_at for x in b.starts(k, n)]:
                return p
        last = (p, *here)
    return None


def spliced(codec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple]:
    """(part, i, j): the tokens of a text of any length are the tokens i to j of each part, in order."""
    if len(text) <= chunk or not codec.cuttable:
        part = codec.encode([text])[0]
        yield part, 0, len(part)
        return
    begins = list(range(0, len(text), chunk))
    parts = codec.encode([text[s:s + chunk + overlap] for s in begins])
    i, since = 0, 0  # chunk i's tokens from `since` on are wanted
    while True:
        at, part, wide = begins[i], parts[i], overlap
        end = min(len(text), at + chunk + overlap)
        while end < len(text):
            after = (end - 1) // chunk  # the last chunk that begins before end
            p = _splice(text, part, at, parts[after], begins[after], max(since, begins[after]), end)
            if p is not None:
                break
            wide *= 2
            end = min(len(text), end + wide)
            part = codec.encode([text[at:end]])[0]
        first = part.first_from(since - at) if since > at else 0
        if end == len(text):
            yield part, first, len(part)
            return
        yield part, first, part.first_from(p - at)
        i, since = after, p


def encode_long(codec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of a text of any length."""
    return np.concatenate([part.ids(i, j) for part, i, j in spliced(codec, text, chunk, overlap)])


_codecs: dict[str, JsonCodec] = {}


def codec_for(path: str) -> JsonCodec:
    """One codec a worker."""
    if path not in _codecs:
        _codecs[path] = JsonCodec(path)
    return _codecs[path]


def count_texts(codec, texts: list[str | None]) -> list[int]:
    out = [0] * len(texts)
    single: list[int] = []
    held = 0

    def flush():
        for i, n in zip(single, codec.counts([texts[i] for i in single]), strict=True):
            out[i] = n
        single.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > CHUNK:
            out[i] = sum(j - k for _, k, j in spliced(codec, text))
            continue
        single.append(i)
        held += len(text)
        if held > BATCH_CHARS:
            flush()
            held = 0
    flush()
    return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    `tokenizer` is the path, on every executor, of a tokenizers .json file. No special tokens are added, and their
    strings inside texts are handled as the file says. Null texts count as empty: no bytes, no tokens. Texts of any
    length are counted whole. Repeated rows and null ids stay; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(tokenizer)
        for batch in batches:
            n = count_texts(codec, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    kind = dict(read.dtypes)["id"]
    return read.mapInArrow(lean(run), f"id {kind}, n_bytes bigint, n_tokens bigint").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


class ByteCodec:
    """A tiktoken rank file; ids of a text as little-endian uint16 bytes, end of text as one more id."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.eot = len(ranks)
        if self.eot >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(self.eot, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        import regex

        self.cuttable = parts_at_white(lambda text: [m.span() for m in regex.finditer(pattern, text)])

    def encode(self, texts: list[str]) -> list[ArrayPart]:
        out = []
        for t in texts:
            ids = np.array(self.library.encode_ordinary(t), np.int64)
            ends = np.cumsum(self.sizes[ids])
            # Byte offsets to code points: a token that starts inside a character belongs to that character.
            heads = np.cumsum((np.frombuffer(t.encode(), np.uint8) & 0xC0) != 0x80)
            starts = ends - self.sizes[ids]
            out.append(ArrayPart(ids, heads[starts] - 1 if len(ids) else starts))
        return out

    def ids(self, text: str) -> bytes:
        """Ids of one text without the end mark."""
        if len(text) > CHUNK:
            return encode_long(self, text).astype("<u2").tobytes()
        return np.array(self.library.encode_ordinary(text), "<u2").tobytes()
