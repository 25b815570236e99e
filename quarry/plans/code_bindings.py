"""The extractor and the verbs over a code tree that is made of the tables, as named queries with equivalent SQL.

The tree has a Go file for each nation: a function N<nation>, and a function S<supplier> for each of its suppliers
that calls N<nation>, S<supplier + 1> wherever that is, and Missing, which no file defines. So its symbols, edges and
answers follow from the keys of the tables alone. A second tree has a file for each nation in every language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import keep
from ..sources.crawl import number_files
from ..sources.extract import extract
from ..sources.index import Index
from . import render, verbs
from .bindings import _table, query
from .incremental import index_of

_trees: dict[tuple[str, str], Index] = {}


def code_tree(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the tree, built once a session and folder; it lies in the shared folder."""
    known = spark.sparkContext.applicationId, sf_dir
    if known not in _trees:
        n = F.col("n_nationkey").cast("string")
        own = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
        nations = _table(spark, sf_dir, "nation").select("n_nationkey").join(own, "n_nationkey", "left")
        fn = lambda k: F.concat(F.lit("func S"), k.cast("string"), F.lit("() {\n\tN"), n, F.lit("()\n\tS"), (k + 1).cast("string"), F.lit("()\n\tMissing()\n}\n\n"))
        text = F.concat(F.lit("package main\n\nfunc N"), n, F.lit("() int {\n\treturn "), n, F.lit("\n}\n\n"), F.coalesce(F.array_join(F.transform("keys", fn), ""), F.lit("")))
        files = nations.select(F.concat(F.lit("src/nation"), n, F.lit(".go")).alias("path"), text.cast("binary").alias("content"))
        files = number_files(files.select("path", F.octet_length("content").cast("bigint").alias("n_bytes"), "content"))
        _trees[known] = index_of(keep(files.select("file_id", "path", "n_bytes", "content", F.lit("go").alias("lang")), "tree"))
    return _trees[known]


# Symbols in the order of their lines; a supplier's function takes five lines and a blank one.
TREE_SQL = """
f AS (SELECT n_nationkey AS nat, 'src/nation' || n_nationkey || '.go' AS path FROM nation),
o AS (SELECT s_suppkey AS k, s_nationkey AS nat, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier JOIN nation ON n_nationkey = s_nationkey),
s AS (SELECT path, f.nat, 'N' || f.nat AS name, CAST(3 AS BIGINT) AS line, CAST(5 AS BIGINT) AS end_line, CAST(NULL AS BIGINT) AS k FROM f
  UNION ALL SELECT path, f.nat, 'S' || k, 7 + 6 * i, 11 + 6 * i, k FROM o JOIN f ON f.nat = o.nat),
e AS (SELECT s.name AS src, 'N' || s.nat AS dst FROM s WHERE k IS NOT NULL
  UNION ALL SELECT a.name, b.name FROM s a JOIN s b ON b.k = a.k + 1)"""


@query(f"WITH {TREE_SQL} SELECT path, name, 'fn' AS kind, CAST(line AS INT) AS line, CAST(end_line AS INT) AS end_line, 1 AS cx FROM s")
def code_symbols(spark, sf_dir):
    index = code_tree(spark, sf_dir)
    return index.symbols.join(index.files.select("file_id", "path"), "file_id").select("path", "name", "kind", "line", "end_line", "cx")


@query(f"WITH {TREE_SQL} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM e")
def code_edges(spark, sf_dir):
    index = code_tree(spark, sf_dir)
    named = lambda c: index.symbols.select(F.col("sym_id").alias(c), F.col("name").alias(f"{c}_name"))
    both = index.edges.join(named("src"), "src").join(named("dst"), "dst")
    return both.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), F.col("weight").cast("double").alias("weight"))


@query(f"WITH {TREE_SQL} SELECT 'fn' AS t, s.name AS n, s.path, CAST(s.line AS INT) AS line FROM e JOIN s ON s.name = e.src WHERE e.dst = 'N3'")
def verb_callers(spark, sf_dir):
    return verbs.callers(code_tree(spark, sf_dir), "N3")[0].select("t", "n", "path", "line")


@query(f"WITH {TREE_SQL} SELECT 'fn' AS t, s.name AS n, s.path, CAST(s.line AS INT) AS line FROM e JOIN s ON s.name = e.dst WHERE e.src = 'S5'")
def verb_callees(spark, sf_dir):
    return verbs.callees(code_tree(spark, sf_dir), "S5")[0].select("t", "n", "path", "line")


@query(f"""WITH {TREE_SQL}, m AS (SELECT max(k) AS top FROM s)
SELECT (SELECT count(*) FROM s WHERE name = 'N3') AS defs, (SELECT count(*) FROM e WHERE dst = 'N3') AS "count", (SELECT count(*) FROM e WHERE dst = 'N3') AS hop_untested,
  CAST(0 AS BIGINT) AS graph_ambiguous, (SELECT count(*) FROM s a WHERE a.k IS NOT NULL) + (SELECT count(*) FROM s a WHERE a.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k + 1)) AS graph_unresolved,
  '--uses=N3' AS next FROM m""")
def verb_callers_summary(spark, sf_dir):
    return verbs.callers(code_tree(spark, sf_dir), "N3")[1].select("defs", "count", "hop_untested", "graph_ambiguous", "graph_unresolved", "next")


@query(f"""WITH {TREE_SQL} SELECT path, CAST(3 AS INT) AS l, name AS "in", 'func N3() int {{' AS text, (SELECT count(*) FROM e WHERE dst = 'N3') AS callers FROM s WHERE name = 'N3'
UNION ALL SELECT path, CAST(line + 1 AS INT), name, chr(9) || 'N3()', (SELECT count(*) FROM e WHERE e.dst = s.name) FROM s WHERE nat = 3 AND k IS NOT NULL""")
def verb_grep(spark, sf_dir):
    return verbs.grep(code_tree(spark, sf_dir), "N3()")[0].select("path", F.col("l").cast("int").alias("l"), "in", "text", "callers")


@query(f"""WITH {TREE_SQL}, h AS (SELECT name, CASE WHEN k IS NULL THEN 0 ELSE line END AS pos FROM s WHERE nat = 3)
SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM h) AS hits, '--at=src/nation3.go:3' AS next, (SELECT string_agg(name, ',' ORDER BY pos) FROM h) AS enc""")
def verb_grep_summary(spark, sf_dir):
    return verbs.grep(code_tree(spark, sf_dir), "N3()")[1].select("files", "hits", "next", F.array_join(F.transform("enc", lambda x: x["n"]), ",").alias("enc"))


@query(f"""WITH {TREE_SQL} SELECT 'call' AS role, path, line + 3 AS line, name AS "in" FROM s WHERE k IS NOT NULL""")
def verb_uses(spark, sf_dir):
    return verbs.uses(code_tree(spark, sf_dir), "Missing")[0].select("role", "path", "line", "in")


@query(f"WITH {TREE_SQL} SELECT name AS n, 'fn' AS t, CAST(line AS INT) AS l, CAST(end_line AS INT) AS el, path FROM s WHERE path = 'src/nation3.go' AND line <= 8 AND end_line >= 8")
def verb_at(spark, sf_dir):
    return verbs.at(code_tree(spark, sf_dir), "nation3.go:8")[0].select("n", "t", "l", "el", "path")


@query(f"""WITH RECURSIVE {TREE_SQL}, r AS (SELECT 'S6' AS v, 0 AS lev UNION SELECT e.src, r.lev + 1 FROM r JOIN e ON e.dst = r.v)
SELECT v AS n, CAST(min(lev) AS INT) AS level FROM r WHERE v <> 'S6' GROUP BY v""")
def verb_impact(spark, sf_dir):
    return verbs.impact(code_tree(spark, sf_dir), "S6")[0].select("n", "level")


@query(f"""WITH {TREE_SQL}
SELECT a.name, a.path, 'func S5() {{' || chr(10) || chr(9) || 'N' || a.nat || '()' || chr(10) || chr(9) || 'S6()' || chr(10) || chr(9) || 'Missing()' || chr(10) || '}}' AS body,
  (SELECT count(*) FROM s b WHERE b.path = a.path AND b.name <> a.name) AS sibs_total,
  (SELECT string_agg('func ' || e.dst || CASE WHEN e.dst LIKE 'N%' THEN '() int' ELSE '()' END, ';' ORDER BY e.dst) FROM e WHERE e.src = 'S5') AS sigs FROM s a WHERE name = 'S5'""")
def verb_expand(spark, sf_dir):
    rows = verbs.expand(code_tree(spark, sf_dir), "S5")[0]
    return rows.select("name", "path", "body", "sibs_total", F.array_join(F.array_sort("callee_sigs"), ";").alias("sigs"))


TRACE = "/root/src/nation3.go:4\n  src/nation3.go:8\nnot a frame\n/root/src/nowhere.go:3\nlib/src/nation4.go:2"


@query(f"""WITH {TREE_SQL}, t(frame_no, file, line) AS (VALUES (0, 'src/nation3.go', 4), (1, 'src/nation3.go', 8), (3, 'src/nowhere.go', 3), (4, 'src/nation4.go', 2))
SELECT t.frame_no, CAST(t.line AS BIGINT) AS line, s.name AS n, CASE WHEN s.name LIKE 'N%' THEN 'func ' || s.name || '() int' WHEN s.name IS NOT NULL THEN 'func ' || s.name || '()' END AS sig
FROM t LEFT JOIN s ON s.path = t.file AND s.line <= t.line AND s.end_line >= t.line""")
def verb_trace(spark, sf_dir):
    return verbs.from_trace(code_tree(spark, sf_dir), TRACE)[0].select("frame_no", "line", "n", "sig")


@query(f"""WITH {TREE_SQL}, c AS (SELECT sum(length(path) + 3) AS b, count(*) * 12 AS m FROM f UNION ALL SELECT sum(length(name)), count(*) * 30 FROM s UNION ALL SELECT sum(length(dst)), count(*) * 9 FROM e)
SELECT CAST(floor(sum(b) / 2.53 + sum(m) / 2.5 + 320 / 2.5 + 0.5) AS BIGINT) AS tokens, CAST(sum(b) + sum(m) + 320 AS BIGINT) AS bytes FROM c""")
def map_price(spark, sf_dir):
    return render.map_model(code_tree(spark, sf_dir), "/r")


# Languages ----------------------------------------------------------------------------------------------------

#: For each language a source and what it defines and refers to; `#` stands for a nation's key.
SOURCES: dict[str, tuple[str, str]] = {
    "go": ("package a\n\ntype T# struct {\n\tx int\n}\n\ntype I# interface {\n\tm#(a int) int\n}\n\nfunc f#() {\n\tg#(1)\n}\n\nfunc (t *T#) p#() {\n}\n", "T:struct I:iface m:method f:fn p:method g:ref"),
    "java": ("class A# {\n  static final int MAX_# = 1;\n  int f#() {\n    return new B#().go#();\n  }\n}\n\ninterface J# {\n  void m#();\n}\n", "A:cls MAX_:var f:method J:iface m:method B:ref go:ref"),
    "c": ("#define N# 3\nstruct S# {\n  int x#;\n};\nstatic int v# = 1;\nint f#(int a) {\n  return g#(a);\n}\n", "N:macro S:cls x:var v:var f:fn g:ref"),
    "cpp": ("class A# {\n public:\n  int m#(int q) {\n    return 1;\n  }\n};\nvoid f#() {\n  x.k#();\n}\n", "A:cls m:method f:fn k:ref"),
    "csharp": ("class A# {\n  int P# { get; set; }\n  public int M#(int a) {\n    return B#(a);\n  }\n}\n", "A:cls P:var M:method B:ref"),
    "cuda": ("int f#(int a) {\n  return g#(a);\n}\n", "f:fn g:ref"),
    "dart": ("class A# {\n  int m#() {\n    return f#(1);\n  }\n}\n", "A:cls m:method f:ref"),
    "elixir": ("defmodule M# do\n  def f#(x) do\n    g#(x)\n  end\nend\n", "M:cls f:fn g:ref"),
    "bash": ("f#() {\n  g# 1\n}\n", "f:fn g:ref"),
    "javascript": ("class A# {\n  m#(x) {\n    return g#(x);\n  }\n}\nfunction f#() {}\nconst h# = (x) => x;\nconst o = { r#: function () {} };\n", "A:cls m:method f:fn h:fn r:fn g:ref"),
    "typescript": ("interface I# { a: int }\nclass A# {\n  m#(x: number): number {\n    return g#(x);\n  }\n}\n", "I:iface A:cls m:method g:ref"),
    "tsx": ("function f#(x) {\n  return g#(x);\n}\n", "f:fn g:ref"),
    "json": ('{"a#": {"b#": 1}, "c#": [{"d": 2}]}\n', "a:sec b:sec c:sec"),
    "toml": ("k# = 1\n[t#]\nu# = 2\n", "k:sec t:sec u:sec"),
    "yaml": ("a#:\n  b#: 1\n", "a:sec b:sec"),
    "kotlin": ("class A# {\n  fun m#(x: Int): Int {\n    return g#(x)\n  }\n}\n", "A:cls m:fn g:ref"),
    "lua": ("local function f#(a)\n  return g#(a)\nend\n", "f:fn g:ref"),
    "objc": ("@implementation A#\n- (int)m#:(int)x {\n  return [self g#:x];\n}\n@end\n", "A:cls m:method g:ref"),
    "php": ("<?php\nclass A# {\n  function m#() {\n    return $this->g#();\n  }\n}\n", "A:cls m:method g:ref"),
    "python": ("X# = 1\nclass A#:\n    def m#(self):\n        self.w# = 1\n        return g#(2)\n", "X:var A:cls m:fn w:var g:ref"),
    "ruby": ("class A#\n  def m#(x)\n    g#(x)\n  end\nend\n", "A:cls m:method g:ref"),
    "rust": ("struct S# {}\ntrait T# {\n    fn q#(&self);\n}\nfn f#() {\n    g#(1);\n}\n", "S:cls T:iface q:method f:fn g:ref"),
    "swift": ("class A# {\n  func m#() {\n    g#(1)\n  }\n}\n", "A:cls m:fn g:ref"),
}
SHAPES = ", ".join(f"('{lang}', '{name}', '{kind}')" for lang, (_, said) in SOURCES.items() for name, kind in (x.split(":") for x in said.split()))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, nation, content): every source for every nation."""
    rows = F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(src).alias("src")) for lang, (src, _) in SOURCES.items()])
    each = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("nation"), F.explode(rows).alias("s"))
    # In C a # of its own begins a directive.
    text: Column = F.regexp_replace("s.src", "#(?!define)", F.col("nation").cast("string"))
    return each.select("s.lang", "nation", text.cast("binary").alias("content"))


@query(f"WITH p(lang, prefix, kind) AS (VALUES {SHAPES}) SELECT lang, CAST(n_nationkey AS BIGINT) AS nation, prefix || n_nationkey AS name, kind FROM p, nation")
def language_packs(spark, sf_dir):
    langs = F.array(*[F.lit(lang) for lang in SOURCES])
    files = _sources(spark, sf_dir).withColumn("file_id", (F.col("nation") * len(SOURCES) + F.array_position(langs, F.col("lang")) - 1).cast("int"))
    symbols, refs = extract(keep(files.select("file_id", "lang", "content"), "sources"))
    found = symbols.select("file_id", "name", "kind").union(refs.select("file_id", "name", F.lit("ref"))).join(files.select("file_id", "lang", "nation"), "file_id")
    # What has no nation's key in its name is scaffolding of the sources.
    return found.where(F.col("name").rlike("[0-9]$")).select("lang", "nation", "name", "kind").distinct()
