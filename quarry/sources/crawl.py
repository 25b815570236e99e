"""A source tree as the files relation: recursive listing, filters and stable ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..operators.ordering import number_rows

MAX_BYTES = 4 << 20
SNIFF_BYTES = 4096

# Directories that are never entered.
SKIPPED_DIRS = (
    ".git", ".claude", ".hg", ".svn", "node_modules", "vendor", "third_party", ".cache", "build", "dist", "out", "target", ".venv", "venv",
    "__pycache__", ".idea", ".vscode", "asan", "build_prof", "CMakeFiles", "captures")

# Languages and their case-sensitive extensions.
EXTENSIONS = {
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hpp", "hh", "hxx", "c++", "h++"],
    "csharp": ["cs"],
    "cuda": ["cu", "cuh"],
    "dart": ["dart"],
    "elixir": ["ex", "exs"],
    "bash": ["sh", "bash"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "json": ["json"],
    "kotlin": ["kt", "kts"],
    "lua": ["lua"],
    "objc": ["m", "mm"],
    "php": ["php"],
    "python": ["py"],
    "ruby": ["rb"],
    "rust": ["rs"],
    "swift": ["swift"],
    "toml": ["toml"],
    "yaml": ["yml", "yaml"],
    "typescript": ["ts"],
    "tsx": ["tsx"],
    "html": ["html", "htm"],
}
LANG_OF = {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts}
NAMES = f"*.{{{','.join(LANG_OF)}}}"
# Lines of a step and of a block, for offsets that are summed without a window.
STEP_LINES, BLOCK_LINES = 4096, 64


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANG_OF.items() for x in pair])
    return F.try_element_at(table, extension(path))


def skipped(path: Column) -> Column:
    """Whether a root-relative path lies below a directory that is never entered."""
    parts = F.split(path, "/")
    dirs = F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))
    return F.exists(dirs, lambda d: d.isin(*SKIPPED_DIRS) | (d.startswith("cmake-build-") & (F.length(d) > 12))
                    | F.contains(d, F.lit("plugins-tmp")) | (d.endswith(".dSYM") & (F.length(d) > 5)))


def looks_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00"))


def root_of(spark: SparkSession, root: str) -> str:
    """The root as files below it name it, with a slash at its end."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    return unquote(top.replace("file:///", "file:/"))


def below(uri: Column, base: str) -> Column:
    """The part of a file's name below the root; the scheme may be spelled in two ways."""
    return F.substr(F.regexp_replace(uri, "^file:///", "file:/"), F.lit(len(base) + 1))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(uri, path, len, mtime_nanos) of source files below root; no content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).load(root)
    out = raw.where(F.col("length") <= MAX_BYTES).select(
        F.regexp_replace("path", "^file:///", "file:/").alias("uri"), below(F.col("path"), root_of(spark, root)).alias("path"), F.col("length").alias("len"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_nanos"))
    return out.where(language_of(F.col("path")).isNotNull() & ~skipped(F.col("path")))


def contents(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """(uri, content) of listed files. Only their folders are read: those that are never entered stay shut. The list of
    folders is shorter than the list of files that the reader holds on the driver anyway."""
    folders = [r["d"] for r in listed.select(F.regexp_extract("uri", "^(.*)/[^/]*$", 1).alias("d")).distinct().collect()]
    reader = spark.read.format("binaryFile").option("pathGlobFilter", NAMES)
    if not folders:
        return listed.select("uri", F.lit(b"").alias("content")).limit(0)
    raw = reader.load([re.sub(r"([\\*?\[\]{}])", r"\\\1", d) for d in folders]).where(F.col("length") <= MAX_BYTES)
    return raw.select(F.regexp_replace("path", "^file:///", "file:/").alias("uri"), "content")


def stats(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).select("path", "len", "mtime_nanos")


def number_files(files: DataFrame) -> DataFrame:
    """file_id: rank of the path in byte order, from 0."""
    ids = number_rows(files.select("path"), ["path"], "file_id").withColumn("file_id", F.col("file_id").cast("int"))
    return files.join(ids, "path")


def crawl(spark: SparkSession, root: str) -> DataFrame:
    """files(file_id, path, n_bytes, content, lang): text files of known languages below root."""
    listed = listing(spark, root)
    files = listed.join(contents(spark, listed), "uri").where(~looks_binary(F.col("content")))
    numbered = number_files(files.select("path", F.col("len").alias("n_bytes"), "content"))
    return numbered.select("file_id", "path", "n_bytes", "content", language_of(F.col("path")).alias("lang"))


def _bytes(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0).cast("bigint"), lambda s, t: s + F.octet_length(t) + 1)


def _cut(texts: Column, base: Column, size: int) -> Column:
    """Slices of `size` lines: array<struct<first, base, texts>>, base being the bytes before the slice."""
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.size(texts) - 1, F.lit(0)), F.lit(size)), lambda i: F.struct(
        i.alias("first"), F.slice(texts, i + 1, F.lit(size)).alias("texts")))
    sums = F.transform(slices, lambda s: _bytes(s["texts"]))
    return F.transform(slices, lambda s, k: F.struct(
        s["first"].alias("first"), (base + F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("base"), s["texts"].alias("texts")))


def lines(content: DataFrame, id_col: str = "file_id", text_col: str = "content", having: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, line, start_byte, text): lines from 1, without \\n and one \\r before it; no empty line at the end.

    having(text) drops lines before their offsets are summed. Offsets are summed inside the row, over steps, blocks and
    lines: no window and no shuffle.
    """
    parts = F.split(F.col(text_col).cast("string"), "\n")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    steps = content.select(id_col, kept.alias("parts")).where(F.size("parts") > 0).select(
        id_col, F.explode(_cut(F.col("parts"), F.lit(0).cast("bigint"), STEP_LINES)).alias("s"))
    blocks = steps.select(id_col, F.col("s.first").alias("first"), F.explode(_cut(F.col("s.texts"), F.col("s.base"), BLOCK_LINES)).alias("b"))
    each = F.transform("b.texts", lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    if having is not None:
        each = F.filter(each, lambda x: having(F.regexp_replace(x["t"], "\r$", "")))
    placed = F.transform(each, lambda x: F.struct(
        (F.col("first") + F.col("b.first") + x["i"] + 1).alias("line"), (F.col("b.base") + _bytes(F.slice("b.texts", F.lit(1), x["i"]))).alias("start_byte"),
        F.regexp_replace(x["t"], "\r$", "").alias("text")))
    return blocks.select(id_col, F.explode(placed).alias("x")).select(id_col, "x.line", "x.start_byte", "x.text")


def span_text(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) as text, invalid UTF-8 replaced; null outside the content."""
    ok = (start >= 0) & (start <= end) & (end <= F.octet_length(content))
    return F.when(ok, F.make_valid_utf8(F.substring(content, (start + 1).cast("int"), (end - start).cast("int")).cast("string")))


FRAME = r"^[^ ]*:[+]?[0-9]+$"


def parse_frames(trace: DataFrame, text_col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """frames(*keep, frame_no, path, line) of whole trace texts: lines `path:line`, in order; others are left out."""
    each = trace.select(*keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("frame_no", "raw")).select(
        *keep, "frame_no", F.trim(F.regexp_replace("raw", "\r$", "")).alias("t"))
    number = F.regexp_replace(F.substring_index("t", ":", -1), "^[+]", "").try_cast("bigint")
    path = F.expr("substring(t, 1, length(t) - length(substring_index(t, ':', -1)) - 1)")
    out = each.where(F.col("t").rlike(FRAME)).select(*keep, "frame_no", path.alias("path"), number.alias("line"))
    return out.where(F.col("line").isNotNull() & (F.col("line") < (1 << 32)))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse_frames(spark.read.option("wholetext", "true").text(path))
