import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def many(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def plain_subtokens(s):
    out = []
    for run in re.findall(r"[A-Za-z0-9]+", s):
        cur = ""
        for i, c in enumerate(run):
            if i and c.isupper() and (not run[i - 1].isupper() or (i + 1 < len(run) and run[i + 1].islower())):
                out.append(cur)
                cur = ""
            cur += c
        out.append(cur)
    return [t.lower() for t in out if len(t) >= 2]


def test_subtokens(spark):
    rng = random.Random(0)
    texts = ["parseHTTPRequest", "snake_case_9x", "ABc", "aB", "x", "", "É HTMLParser2Go", "A1B2c3"] + [
        "".join(rng.choice("aBcD1_ éZ") for _ in range(rng.randrange(12))) for _ in range(500)]
    assert many(spark, texts, T.subtokens) == [plain_subtokens(t) for t in texts]


def test_query_terms(spark):
    assert one(spark, T.query_terms(F.lit("Find the  parseFile\tparse-file x"))) == ["find", "the", "parsefile", "parse", "file"]


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def test_fnv(spark):
    data = [b"", b"a", b"foobar", bytes(range(256))]
    assert many(spark, data, T.fnv1a64, "binary") == [fnv(d) for d in data]
    assert fnv(b"a") == "af63dc4c8601ec8c"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\ sntpe|\n\té", max_size=12), min_size=1, max_size=30))
def test_field_escape_round_trip(spark, texts):
    codes = many(spark, texts, T.escape_field)
    assert all(" " not in c and "\n" not in c and c for c in codes)
    assert many(spark, codes, T.unescape_field) == texts


def test_paths(spark):
    paths = ["Game/x.go", "src/Tests/a.go", "docs/a.md", "a/docs/b", "x.go", "test", "src/lib/a.b/c", "infrastructure/q/Test.java"]
    assert many(spark, paths, T.layer) == ["game", "test", "", "", "", "test", "", "infra"]
    assert many(spark, paths, T.row_tier) == [0, 1, 2, 2, 0, 1, 0, 0]
    assert many(spark, ["a/b.tar.gz", "a.b/c", "x", ".go"], T.extension) == ["gz", "", "", "go"]
    assert many(spark, ["a" * 40, "b" * 41], T.shorten_path) == ["a" * 40, "..." + "b" * 37]


def test_numbers(spark):
    assert many(spark, [0, 999, 1000, 43_251, 952_150, 1_200_000, -2500], T.short_number, "bigint") == ["0", "999", "1.0K", "43.3K", "952.1K", "1.2M", "-2.5K"]
    assert many(spark, [0, 999, 61_000, 3_600_000, 3_725_000, -61_000], T.duration, "bigint") == ["0s", "0s", "1m1s", "1h0m0s", "1h2m5s", "-1m1s"]
    assert many(spark, [0, 1, 2, 38], lambda c: T.price(c), "bigint") == [0, 0, 1, 10]


def test_lines_and_signatures(spark):
    data = b"ab\n\nc\xc3\xa9\n"
    got = [one(spark, T.line_of_byte(F.lit(data), F.lit(i))) for i in range(len(data) + 1)]
    assert got == [1 + data[:i].count(b"\n") for i in range(len(data) + 1)]
    assert many(spark, ["func A() {{ \nx", "def f():", "{", "a  "], T.signature) == ["func A()", "def f():", "", "a"]


def test_escapes(spark):
    assert one(spark, T.escape_xml(F.lit("<a & \"b\" 'c'>"))) == "&lt;a &amp; &quot;b&quot; 'c'&gt;"
    assert one(spark, T.escape_xml(F.lit("'"), quotes=True)) == "&apos;"
    assert one(spark, T.escape_json(F.lit('a"\\'))) == 'a\\"\\\\'
    assert one(spark, T.go_imports(F.lit('import "fmt"\n  import f "x/y"\nimport (\n"no"\n)'))) == ['"fmt"', '"x/y"']


@pytest.mark.parametrize("word,camel,snake", [("aB", True, False), ("AB", False, False), ("a_b", False, True), ("_b", False, False), ("a_", False, False)])
def test_shapes(spark, word, camel, snake):
    assert one(spark, T.is_camel(F.lit(word))) is camel and one(spark, T.is_snake(F.lit(word))) is snake
