"""Scalar functions over text and paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Directory names and the layer that each stands for.
LAYERS = {
    "game": "game", "gameplay": "game",
    "infra": "infra", "infrastructure": "infra", "infrastucture": "infra",
    "metal": "render", "render": "render", "renderer": "render",
    "math": "math", "numerics": "math",
    "sound": "audio", "audio": "audio",
    "steer": "ai", "ai": "ai", "behavior": "ai",
    "test": "test", "tests": "test", "bench": "test",
}

# Words that the router leaves out.
STOPWORDS = ("the", "a", "an", "is", "are", "to", "of", "in", "for", "how", "does", "do", "where", "what", "which", "on", "with")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def subtokens(c: Column) -> Column:
    """Lower-case parts of identifiers: runs of ASCII letters and digits, cut at case changes, of 2 or more bytes."""
    cut = F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.filter(F.split(cut, "[^A-Za-z0-9]+"), lambda x: F.length(x) >= 2), F.lower)


def query_words(c: Column) -> Column:
    return F.filter(F.split(c, "[ \t\n\r]"), lambda x: x != "")


def query_terms(c: Column) -> Column:
    """Distinct subtokens of the lower-cased words, in order of first sight."""
    return F.array_distinct(F.flatten(F.transform(query_words(c), lambda w: subtokens(lower_ascii(w)))))


def is_camel(c: Column) -> Column:
    return c.rlike("[a-z][A-Z]")


def is_snake(c: Column) -> Column:
    return c.rlike("(?s)^.+_.")


def escape_xml(c: Column, quotes: bool = False) -> Column:
    """& < > " as entities, and ' as well with quotes."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")] + ([("'", "&apos;")] if quotes else [])
    for raw, entity in pairs:
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


# Characters of a field and their codes in a saved line; an empty field is \e.
FIELD_CODES = (("\\", "\\\\"), (" ", "\\s"), ("\n", "\\n"), ("\t", "\\t"), ("|", "\\p"))


def escape_field(c: Column) -> Column:
    out = c
    for raw, code in FIELD_CODES:
        out = F.replace(out, F.lit(raw), F.lit(code))
    return F.when(c == "", F.lit("\\e")).otherwise(out)


def unescape_field(c: Column) -> Column:
    """The inverse of escape_field. Escaped backslashes are set aside first, so `\\\\s` stays a backslash and an s."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for raw, code in FIELD_CODES[1:]:
        out = F.replace(out, F.lit(code), F.lit(raw))
    return F.when(c == "\\e", F.lit("")).otherwise(F.replace(out, F.lit("\x00"), F.lit("\\")))


def escape_json(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def fnv1a64(c: Column) -> Column:
    """FNV-1a over a binary column, as 16 hex digits. The state is two 32-bit halves, so nothing overflows."""
    low32, prime = F.lit(0xFFFFFFFF), F.lit(0x1B3)

    def step(s, i):
        byte = F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("bigint")
        lo = s["lo"].bitwiseXOR(byte)
        wide = lo * prime
        hi = (s["hi"] * prime + F.shiftleft(lo, 8) + F.shiftright(wide, 32)).bitwiseAND(low32)
        return F.struct(hi.alias("hi"), wide.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    size = F.octet_length(c)
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the last path part; empty without one."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def layer(path: Column) -> Column:
    """The layer of the first directory that has one, by lower-cased name; else empty."""
    table = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])
    parts = F.split(path, "/")
    dirs = F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    found = F.filter(F.transform(dirs, lambda p: F.try_element_at(table, F.lower(p))), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def row_tier(path: Column) -> Column:
    """1 for the test layer, 2 below docs/, else 0."""
    return F.when(layer(path) == "test", 1).when(path.startswith("docs/") | F.contains(path, F.lit("/docs/")), 2).otherwise(0)


def price(n_bytes: Column, rate: float = 3.8) -> Column:
    """Estimated tokens of a document: bytes over the rate, rounded half up."""
    return F.floor(n_bytes / F.lit(float(rate)) + F.lit(0.5)).cast("bigint")


def line_of_byte(content: Column, at: Column) -> Column:
    """1-based line of the 0-based byte offset `at` in a binary column."""
    before = F.hex(F.substring(content, F.lit(1), at))
    # Hex pairs are aligned only if every byte is spelled apart.
    spelled = F.regexp_replace(before, "(..)", "$1 ")
    return (F.length(spelled) - F.length(F.replace(spelled, F.lit("0A "), F.lit("0A")))).cast("bigint") + 1


def signature(text: Column) -> Column:
    """First line of a definition without trailing space and opening braces."""
    line = F.regexp_replace(F.substring_index(text, "\n", 1), r"\s+$", "")
    return F.regexp_replace(F.regexp_replace(line, r"\{+$", ""), r"\s+$", "")


def short_number(n: Column) -> Column:
    """1234 as 1.2K, 1234567 as 1.2M; halves by the exact binary value, to even."""
    one = lambda x: F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))
    return (F.when(F.abs(n) >= 1_000_000, F.concat(one(n / F.lit(1e6)), F.lit("M"))).when(F.abs(n) >= 1_000, F.concat(one(n / F.lit(1e3)), F.lit("K")))
            .otherwise(n.cast("string")))


def duration(ms: Column) -> Column:
    """Milliseconds as 1h2m3s; leading units that are zero are left out."""
    sign = F.when(ms < 0, F.lit("-")).otherwise(F.lit(""))
    s = F.floor(F.abs(ms) / 1000).cast("bigint")
    h, m, rest = F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint"), s % 60
    said = F.when(h > 0, F.format_string("%dh%dm%ds", h, m, rest)).when(m > 0, F.format_string("%dm%ds", m, rest)).otherwise(F.format_string("%ds", rest))
    return F.concat(sign, said)


def shorten_path(path: Column, most: int = 40) -> Column:
    return F.when(F.length(path) > most, F.concat(F.lit("..."), F.right(path, F.lit(most - 3)))).otherwise(path)


def go_imports(text: Column) -> Column:
    """Quoted paths of single-line imports, with their quotes."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\s*import ([^\n]*)"), F.lit(1))
    return F.regexp_extract_all(F.array_join(lines, " "), F.lit(r'(?:^|[\s(])("[^\s]*?")(?=[\s)]|$)'), F.lit(1))


def is_test(path: Column, name: Column) -> Column:
    return path.endswith("_test.go") | path.endswith("Test.java") | (name.startswith("Test") & (F.length(name) > 4))
