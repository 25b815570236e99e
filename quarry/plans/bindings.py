"""The kernels over ordinary tables, as named queries with equivalent SQL.

Each query reads its whole tables. Names, files and spans are derived from the tables' columns, so that the same
operators that serve code trees are exercised at any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.storage import keep, spread
from ..operators import graph, lexical, relations
from ..sources import crawl
from ..sources.extract import extract_file, html_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TASK = "the stedio of reading worthless heention thlyou"
TASKS = {"broad": TASK, "rare": "heention eatiin thnterhe"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


# Text ---------------------------------------------------------------------------------------------------------

SUBTOKENS_SQL = (
    "list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), "
    "'([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x))")


@query(f"""
WITH t AS (SELECT doc_id, unnest({SUBTOKENS_SQL.format('text')}) AS tok FROM documents)
SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY tok""")
def subtoken_freq(spark, sf_dir):
    t = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.subtokens(F.col("text")).alias("toks"))
    # Documents are counted by a token's first place in each, so one aggregation by token does, combined map-side.
    both = F.concat("toks", F.transform(F.array_distinct("toks"), lambda t: F.concat(F.lit(" "), t)))
    n = t.select(F.explode(both).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    first = F.col("tok").startswith(" ")
    return n.groupBy(F.ltrim("tok").alias("tok")).agg(
        F.sum(F.when(~first, F.col("c")).otherwise(0)).alias("n"), F.sum(F.when(first, F.col("c")).otherwise(0)).alias("df"))


@query(f"""
WITH p AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' '),
    lambda w: upper(w[1]) || lower(w[2:])), '') AS ident FROM part),
t AS (SELECT p_partkey, unnest({SUBTOKENS_SQL.format('ident')}) AS tok FROM p)
SELECT tok, count(*) AS n FROM t GROUP BY tok""")
def subtoken_camel(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    ident = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    t = _table(spark, sf_dir, "part").select(F.explode(T.subtokens(ident)).alias("tok"))
    return t.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


def _doc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.explode(F.array(
        F.struct(F.substring_index("text", "\n", 1).alias("text"), F.lit(lexical.W_NAME).alias("w")),
        F.struct(F.col("text"), F.lit(lexical.W_BODY).alias("w")))).alias("f")).select("doc_id", "f.text", "f.w")


def _bm25_sql(task: str, suffix: str = "") -> str:
    words = task.lower().split()
    values = ", ".join(f"('{w}')" for w in dict.fromkeys(words) if len(w) >= 2)
    return f"""
q{suffix}(tok) AS (VALUES {values}),
tok{suffix} AS (
  SELECT doc_id, w, unnest({SUBTOKENS_SQL.format('t')}) AS tok FROM (
    SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS t, 3 AS w FROM documents UNION ALL SELECT doc_id, coalesce(text, ''), 1 FROM documents)),
dl{suffix} AS (SELECT d.doc_id, coalesce(sum(w), 0) AS dl FROM documents d LEFT JOIN tok{suffix} t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
tf{suffix} AS (SELECT doc_id, tok, sum(w) AS tf FROM tok{suffix} WHERE tok IN (SELECT tok FROM q{suffix}) GROUP BY doc_id, tok),
df{suffix} AS (SELECT tok, count(*) AS n FROM tf{suffix} GROUP BY tok),
st{suffix} AS (SELECT count(*) AS s, avg(dl) AS av FROM dl{suffix}),
sc{suffix} AS (
  SELECT tf.doc_id, sum(ln((s - n + 0.5) / (n + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score
  FROM tf{suffix} tf JOIN df{suffix} df ON tf.tok = df.tok JOIN dl{suffix} dl ON dl.doc_id = tf.doc_id, st{suffix} GROUP BY tf.doc_id)"""


@query(f"""WITH {_bm25_sql(TASK)}
SELECT doc_id, round(round(score, 6), 4) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM sc WHERE score > 0""")
def bm25_documents(spark, sf_dir):
    scores = lexical.bm25(_doc_fields(spark, sf_dir), lexical.terms_of(spark, TASK), "doc_id").withColumn("score", F.round("score", 6))
    return lexical.ranked(scores, "doc_id").select("doc_id", F.round("score", 4).alias("score"), F.col("r").cast("bigint").alias("r"))


def _cliff_sql() -> str:
    parts, unions = [], []
    for i, (name, task) in enumerate(TASKS.items()):
        parts.append(_bm25_sql(task, str(i)))
        unions.append(f"SELECT '{name}' AS query, doc_id, round(score, 6) AS score FROM sc{i} WHERE score > 0")
    return f"""WITH {','.join(parts)}, allsc AS ({' UNION ALL '.join(unions)}),
o AS (SELECT query, score, row_number() OVER w - 1 AS i, lag(score) OVER w AS prev FROM allsc WINDOW w AS (PARTITION BY query ORDER BY score DESC, doc_id)),
d AS (SELECT query, i, (prev - score) / prev AS d FROM o),
a AS (SELECT query, count(*) AS avail, max(d) AS best FROM d GROUP BY query),
c AS (SELECT query, i, d, row_number() OVER (PARTITION BY query ORDER BY d DESC, i) AS rn FROM d WHERE i >= 1 AND i < 40),
names(query) AS (VALUES {', '.join(f"('{n}')" for n in TASKS)}),
s AS (SELECT names.query, coalesce(avail, 0) AS avail, coalesce(best, 0) AS best, coalesce(c.d, 0) AS d, c.i
  FROM names LEFT JOIN a ON a.query = names.query LEFT JOIN c ON a.query = c.query AND rn = 1)
SELECT query, avail AS positives,
  CASE WHEN avail = 0 THEN 5 WHEN d >= 0.2 THEN greatest(i, least(5, avail)) ELSE greatest(least(40, avail), least(5, avail)) END AS kept,
  NOT d >= 0.2 AS hit_ceiling, CAST(CASE WHEN d >= 0.2 THEN floor(100 * d + 0.5) WHEN best >= 0.2 THEN floor(100 * best + 0.5) ELSE 0 END AS INT) AS margin_pct,
  CASE WHEN d >= 0.2 OR (avail > 0 AND avail <= greatest(least(40, avail), least(5, avail))) THEN 'high' ELSE 'low' END AS confidence FROM s"""


@query(_cliff_sql())
def cliff_cut(spark, sf_dir):
    scores = lexical.bm25_many(_doc_fields(spark, sf_dir), {name: lexical.terms_of(spark, task) for name, task in TASKS.items()}, "doc_id")
    names = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in TASKS])).alias("query"))
    return lexical.cut_summaries(scores.withColumn("score", F.round("score", 6)), names, "doc_id")


ROUTES = ("where is goldenrod", "parseFile now please", "snake_case", "how does the cold antique part work", "parseFile", "the of", "plum Puff")


@query(f"""
WITH q(query) AS (VALUES {', '.join(f"('{q}')" for q in ROUTES)}),
w AS (SELECT query, unnest(list_filter(regexp_split_to_array(query, '[ \t\n\r]'), lambda x: x <> '' AND NOT list_contains(
  ['the','a','an','is','are','to','of','in','for','how','does','do','where','what','which','on','with'], lower(x)))) AS word FROM q),
k AS (SELECT DISTINCT lower(n) AS low FROM (SELECT unnest(string_split(p_name, ' ')) AS n FROM part)),
m AS (SELECT query, regexp_matches(word, '[a-z][A-Z]') OR regexp_matches(word, '.+_.') AS shaped, lower(word) IN (SELECT low FROM k) AS known FROM w),
a AS (SELECT q.query, count(m.query) AS n, coalesce(bool_or(shaped), false) AS shaped, count(*) FILTER (WHERE shaped OR known) AS hits
  FROM q LEFT JOIN m ON q.query = m.query GROUP BY q.query)
SELECT query, (shaped AND n <= 2) OR (n > 0 AND hits = n) AS name_exact, n, hits,
  CASE WHEN (shaped AND n <= 2) OR (n > 0 AND hits = n) THEN 'name-exact' WHEN n >= 3 THEN 'conceptual' ELSE 'broad' END AS reason FROM a""")
def query_router(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    queries = spark.range(1).select(F.explode(F.array(*[F.lit(q) for q in ROUTES])).alias("query"))
    return lexical.route(names, queries).select("query", "name_exact", "n", "hits", "reason")


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS line, unnest(p) AS t, len(p) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
SELECT doc_id, CAST(line AS INT) AS line, CAST(strpos(t, 'icens') AS INT) AS at FROM l WHERE strpos(t, 'icens') > 0 AND NOT (line = n AND t = '')""")
def grep_lines(spark, sf_dir):
    found = crawl.lines(_table(spark, sf_dir, "documents"), "doc_id", "text").where(F.instr("text", "icens") > 0)
    return found.select("doc_id", F.col("line").cast("int").alias("line"), F.instr("text", "icens").alias("at"))


@query("""
WITH d AS (SELECT doc_id, hex(encode(text)) AS h, CAST(doc_id % 977 AS INT) AS upto FROM documents)
SELECT doc_id, CAST(upto AS BIGINT) AS upto, CAST(1 + len(list_filter(range(0, upto), lambda i: substr(h, CAST(2 * i + 1 AS BIGINT), 2) = '0A')) AS BIGINT) AS line FROM d""")
def line_of_byte(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"), (F.col("doc_id") % 977).alias("upto"))
    return d.select("doc_id", "upto", T.line_of_byte(F.col("b"), F.col("upto").cast("int")).alias("line"))


@query()
def line_of_byte_whole(spark, sf_dir):
    """line_of_byte at offsets over the whole length of a text, its end included."""
    upto = (F.col("doc_id") * 7919) % (F.octet_length("text") + 1)
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"), upto.alias("upto"))
    return d.select("doc_id", "upto", T.line_of_byte(F.col("b"), F.col("upto").cast("int")).alias("line"))


@query(r"""
SELECT doc_id, rtrim(regexp_replace(rtrim(string_split(text, chr(10))[1], E' \t\r\x0b\x0c'), '\{+$', ''), E' \t\r\x0b\x0c') AS sig FROM documents""")
def signature_line(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.signature(F.col("text")).alias("sig"))


@query("""
SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM documents""")
def xml_escape(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.escape_xml(F.col("text"), quotes=True).alias("escaped"))


@query("""
SELECT doc_id, CASE WHEN text = '' THEN chr(92) || 'e' ELSE replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), ' ', chr(92) || 's'),
  chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), '|', chr(92) || 'p') END AS field, true AS same FROM documents""")
def field_escape(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "text", T.escape_field(F.col("text")).alias("field"))
    return d.select("doc_id", "field", (T.unescape_field(F.col("field")) == F.col("text")).alias("same"))


@query("SELECT doc_id, CAST(floor(octet_length(encode(text)) / 3.8 + 0.5) AS BIGINT) AS est_tokens FROM documents")
def price_flat(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.price(F.octet_length("text")).alias("est_tokens"))


@query("""
SELECT o_orderkey, CASE WHEN v >= 1000000 THEN printf('%.1fM', v / 1000000.0) WHEN v >= 1000 THEN printf('%.1fK', v / 1000.0) ELSE CAST(v AS VARCHAR) END AS short,
  CASE WHEN s >= 3600 THEN concat(s // 3600, 'h', s % 3600 // 60, 'm', s % 60, 's') WHEN s >= 60 THEN concat(s // 60, 'm', s % 60, 's') ELSE concat(s, 's') END AS took
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 7 + 3 AS v, CAST(floor(o_totalprice) AS BIGINT) * 37 // 1000 AS s FROM orders)""")
def fmt_numbers(spark, sf_dir):
    v = F.floor("o_totalprice").cast("bigint")
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.short_number(v * 7 + 3).alias("short"), T.duration(v * 37).alias("took"))


@query("""
SELECT page_id, CASE WHEN length(url) > 40 THEN '...' || right(url, 37) ELSE url END AS short, replace(replace(url, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') AS json,
  regexp_extract(string_split(url, '/')[-1], '\\.([^.]+)$', 1) AS ext, string_split(url, '/')[-1] AS base FROM pages""")
def path_scalars(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", T.shorten_path(url).alias("short"), T.escape_json(url).alias("json"), T.extension(url).alias("ext"), T.basename(url).alias("base"))


FNV_SQL = """list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, length(n_name) + 1), lambda i: CAST(ascii(n_name[i]) AS HUGEINT))),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"""


@query(f"SELECT n_nationkey, lower(lpad(to_hex({FNV_SQL}), 16, '0')) AS hash FROM nation")
def fnv_hash(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", T.fnv1a64(F.col("n_name").cast("binary")).alias("hash"))


DIRS = ["src", "Game", "gameplay", "INFRA", "infrastructure", "metal", "Render", "renderer", "math", "numerics", "sound", "Audio", "steer", "ai", "behavior", "test",
        "Tests", "bench", "docs", "lib"]


@query(f"""
WITH p AS (SELECT doc_id, list_value({', '.join(f"'{d}'" for d in DIRS)})[doc_id % 20 + 1] || '/' || source || '/' || lang || doc_id || '.go' AS path FROM documents),
l AS (SELECT doc_id, path, coalesce(list_filter(list_transform(string_split(path, '/')[1:-2], lambda c: CASE lower(c) WHEN 'game' THEN 'game' WHEN 'gameplay' THEN 'game'
  WHEN 'infra' THEN 'infra' WHEN 'infrastructure' THEN 'infra' WHEN 'metal' THEN 'render' WHEN 'render' THEN 'render' WHEN 'renderer' THEN 'render' WHEN 'math' THEN 'math'
  WHEN 'numerics' THEN 'math' WHEN 'sound' THEN 'audio' WHEN 'audio' THEN 'audio' WHEN 'steer' THEN 'ai' WHEN 'ai' THEN 'ai' WHEN 'behavior' THEN 'ai' WHEN 'test' THEN 'test'
  WHEN 'tests' THEN 'test' WHEN 'bench' THEN 'test' END), lambda x: x IS NOT NULL)[1], '') AS layer FROM p)
SELECT doc_id, path, layer, CASE WHEN layer = 'test' THEN 1 WHEN starts_with(path, 'docs/') OR contains(path, '/docs/') THEN 2 ELSE 0 END AS tier FROM l""")
def layer_tier(spark, sf_dir):
    d = F.get(F.array(*[F.lit(x) for x in DIRS]), (F.col("doc_id") % 20).cast("int"))
    path = F.concat(d, F.lit("/"), "source", F.lit("/"), "lang", F.col("doc_id").cast("string"), F.lit(".go"))
    out = _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return out.select("doc_id", "path", T.layer(F.col("path")).alias("layer"), T.row_tier(F.col("path")).alias("tier"))


@query("""
WITH p AS (SELECT doc_id, list_value('src', 'node_modules', 'cmake-build-x', 'cmake-build-', 'a-plugins-tmp-b', 'x.dSYM', '.dSYM', 'build')[doc_id % 8 + 1] || '/f' || doc_id || '.' ||
  list_value('go', 'GO', 'rs', 'txt', 'py')[doc_id % 5 + 1] AS path, octet_length(encode(text)) AS n FROM documents)
SELECT path, CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' END AS lang FROM p
WHERE regexp_extract(path, '\\.([^./]+)$', 1) IN ('go', 'rs', 'py') AND n <= 4194304 AND doc_id_dir(path)""".replace(
    "doc_id_dir(path)", "string_split(path, '/')[1] IN ('src', 'cmake-build-', '.dSYM')").replace("AS n FROM", "AS n FROM"))
def crawl_filters(spark, sf_dir):
    dirs = ["src", "node_modules", "cmake-build-x", "cmake-build-", "a-plugins-tmp-b", "x.dSYM", ".dSYM", "build"]
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs)).cast("int"))
    path = F.concat(pick(dirs), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), pick(["go", "GO", "rs", "txt", "py"]))
    files = _table(spark, sf_dir, "documents").select(path.alias("path"), F.octet_length("text").alias("n"), F.col("text").cast("binary").alias("content"))
    ok = (F.col("n") <= crawl.MAX_BYTES) & ~crawl.skipped(F.col("path")) & ~crawl.looks_binary(F.col("content"))
    return files.where(ok & crawl.language_of(F.col("path")).isNotNull()).select("path", crawl.language_of(F.col("path")).alias("lang"))


# Joins --------------------------------------------------------------------------------------------------------

@query("""
WITH v AS (SELECT event_id, user_id, ts AS s, lead(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events WHERE event_type = 'view'),
r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT r.event_id, (SELECT v.event_id FROM v WHERE v.user_id = r.user_id AND v.s <= r.ts AND v.e >= r.ts ORDER BY v.s DESC, v.event_id DESC LIMIT 1) AS span FROM r""")
def enclosing_span(spark, sf_dir):
    ev = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    nxt = F.lead("ts", 3).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    spans = ev.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("s"), nxt.alias("e")).where("e is not null")
    refs = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return relations.enclosing(refs, spans, "event_id", "user_id", ("ts", "ts"), ("s", "e"), "event_id").select("event_id", F.col("enclosing").alias("span"))


@query("""
WITH l AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi, l_partkey FROM lineitem GROUP BY l_orderkey, l_partkey),
p AS (SELECT o_orderkey, 1 + o_orderkey % 5 AS line FROM orders)
SELECT o_orderkey, (SELECT l_partkey FROM l WHERE l.l_orderkey = o_orderkey AND lo <= line AND hi >= line ORDER BY lo DESC, l_partkey DESC LIMIT 1) AS part FROM p""")
def at_span(spark, sf_dir):
    spans = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    points = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_orderkey") % 5).alias("line"))
    return relations.enclosing(points, spans, "o_orderkey", "l_orderkey", ("line", "line"), ("lo", "hi"), "l_partkey").select("o_orderkey", F.col("enclosing").alias("part"))


LADDER_SQL = """
WITH s AS (SELECT p_partkey AS sym_id, p_name || ' ' || p_size AS name, p_brand || '/' || p_type AS path, p_type AS base FROM part),
n AS (SELECT max(p_partkey) AS m FROM part),
r AS (SELECT DISTINCT l_orderkey * 1000000 + l_partkey AS ref_id, s.path, s.base, t.name FROM lineitem JOIN s ON s.sym_id = l_partkey, n, s t WHERE t.sym_id = (7 * l_partkey + 3) % m),
c AS (SELECT ref_id, s.sym_id, CASE WHEN s.path = r.path THEN 1 WHEN s.base = r.base THEN 2 ELSE 3 END AS tier FROM r JOIN s ON s.name = r.name),
b AS (SELECT *, min(tier) OVER (PARTITION BY ref_id) AS best FROM c),
k AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS k FROM b WHERE tier = best)
SELECT ref_id, sym_id, tier, k FROM k WHERE tier < 3 OR k = 1"""


@query(LADDER_SQL)
def candidate_ladder(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    s = part.select(F.col("p_partkey").alias("sym_id"), F.concat_ws(" ", "p_name", "p_size").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("path"))
    top = part.agg(F.max("p_partkey")).first()[0]
    called = s.select(F.col("sym_id").alias("target"), "name")
    refs = (_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().join(s.select(F.col("sym_id").alias("l_partkey"), "path"), "l_partkey")
            .withColumn("target", (7 * F.col("l_partkey") + 3) % top).join(called, "target")
            .select((F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("ref_id"), "name", "path"))
    return relations.candidates(refs, s)


EDGES_SQL = """
e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, least(sqrt(count(*)), 8) AS weight FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    a = li.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("src"))
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    return relations.weighted_edges(a.join(b, ["l_orderkey", "n"]).select("src", "dst", F.lit(1.0).alias("conf")))


@query(f"WITH {EDGES_SQL} SELECT src, dst, round(weight, 4) AS weight FROM e")
def weighted_edges(spark, sf_dir):
    return part_edges(spark, sf_dir).select("src", "dst", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query(f"WITH {EDGES_SQL} SELECT dst AS part, count(DISTINCT src) AS fan_in FROM e GROUP BY dst")
def fan_in(spark, sf_dir):
    return relations.fan_in(part_edges(spark, sf_dir)).select(F.col("dst").alias("part"), "fan_in")


@query(f"WITH {EDGES_SQL} SELECT src AS part, round(sum(weight), 3) AS w_out FROM e GROUP BY src")
def out_degree(spark, sf_dir):
    return relations.out_degree(part_edges(spark, sf_dir)).select(F.col("src").alias("part"), F.round("w_out", 3).alias("w_out"))


BRAND_DEFS = "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'"


@query(f"WITH {EDGES_SQL} SELECT DISTINCT src AS part FROM e WHERE dst IN ({BRAND_DEFS})")
def callers_1hop(spark, sf_dir):
    defs = _table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("sym_id"))
    return relations.neighbours(part_edges(spark, sf_dir), defs, "callers").select(F.col("sym_id").alias("part"))


@query(f"WITH {EDGES_SQL} SELECT dst AS part, min(src) AS first_src FROM e WHERE src IN ({BRAND_DEFS}) GROUP BY dst")
def callees_1hop(spark, sf_dir):
    defs = _table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("sym_id"))
    return relations.neighbours(part_edges(spark, sf_dir), defs, "callees").select(F.col("sym_id").alias("part"), F.col("disc.src").alias("first_src"))


@query(f"""WITH {EDGES_SQL}, t AS (SELECT p_partkey AS part FROM part WHERE p_type LIKE 'ECONOMY%' UNION SELECT dst FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_type LIKE 'ECONOMY%'))
SELECT p_partkey AS part, p_partkey IN (SELECT part FROM t) AS tested FROM part""")
def tested_partition(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sym_id"), F.col("p_type").startswith("ECONOMY").alias("is_test"))
    yes = relations.tested(part, part_edges(spark, sf_dir)).withColumn("tested", F.lit(True))
    return part.join(yes, "sym_id", "left").select(F.col("sym_id").alias("part"), F.coalesce("tested", F.lit(False)).alias("tested"))


@query("""
WITH f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.go' AS path FROM documents),
r AS (SELECT doc_id AS frame_no, CASE doc_id % 3 WHEN 0 THEN '/root/' || path WHEN 1 THEN path ELSE '/x' || path END AS path FROM f)
SELECT frame_no, (SELECT min(doc_id) FROM f WHERE r.path = f.path OR suffix(r.path, '/' || f.path)) AS file_id FROM r""")
def frame_suffix_join(spark, sf_dir):
    f = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.concat_ws("/", "source", "lang", "doc_id"), F.lit(".go")).alias("path"))
    kind = F.col("doc_id") % 3
    frames = f.select(F.col("doc_id").alias("frame_no"), F.when(kind == 0, F.concat(F.lit("/root/"), "path")).when(kind == 1, F.col("path")).otherwise(
        F.concat(F.lit("/x"), "path")).alias("path"))
    return relations.suffix_join(frames, f.withColumnRenamed("doc_id", "file_id")).select("frame_no", "file_id")


@query(r"""
WITH t AS (SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN ' ' || source || '/' || doc_id || ':' || doc_id || ' ' WHEN 1 THEN source || ' x:' || doc_id WHEN 2 THEN source || ':+' || doc_id ELSE source || ':' END) AS t FROM documents)
SELECT doc_id, regexp_extract(t, '^(.*):[^:]*$', 1) AS path, CAST(regexp_extract(t, ':\+?([0-9]+)$', 1) AS BIGINT) AS line FROM t WHERE regexp_full_match(t, '[^ ]*:\+?[0-9]+')""")
def frame_parse(spark, sf_dir):
    k, doc, src = F.col("doc_id") % 4, F.col("doc_id").cast("string"), F.col("source")
    raw = (F.when(k == 0, F.concat(F.lit(" "), src, F.lit("/"), doc, F.lit(":"), doc, F.lit(" "))).when(k == 1, F.concat(src, F.lit(" x:"), doc))
           .when(k == 2, F.concat(src, F.lit(":+"), doc)).otherwise(F.concat(src, F.lit(":"))))
    t = _table(spark, sf_dir, "documents").select("doc_id", raw.alias("value"))
    # Here each document is a trace of one line.
    return crawl.parse_frames(t, keep=["doc_id"]).select("doc_id", "path", "line")


@query("""
WITH m AS (SELECT 'f' || doc_id AS path, n_chars AS len, doc_id * 10 AS t, lang AS h FROM documents WHERE doc_id % 7 <> 3),
s AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS len, doc_id * 10 + (doc_id % 11 = 0)::INT AS t, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE lang END AS h
  FROM documents WHERE doc_id % 13 <> 5),
d AS (SELECT coalesce(m.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'new' WHEN m.len <> s.len OR m.t <> s.t THEN 'changed' ELSE 'same' END AS state,
  s.h IS DISTINCT FROM m.h AS other FROM m FULL JOIN s ON m.path = s.path)
SELECT path, state, state IN ('changed', 'new') AND other AS rebuilt FROM d""")
def manifest_diff(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    path, five = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id") % 5 == 0
    m = d.where("doc_id % 7 <> 3").select(path, F.col("n_chars").alias("len"), (F.col("doc_id") * 10).alias("mtime_nanos"), F.col("lang").alias("hash"))
    s = d.where("doc_id % 13 <> 5").select(
        path, F.when(five, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("len"),
        (F.col("doc_id") * 10 + (F.col("doc_id") % 11 == 0).cast("int")).alias("mtime_nanos"), F.when(five, "new").otherwise(F.col("lang")).alias("hash"))
    diff = relations.manifest_diff(m, s)
    real = relations.really_changed(diff, m, s).withColumn("rebuilt", F.lit(True))
    return diff.join(real, "path", "left").select("path", "state", F.coalesce("rebuilt", F.lit(False)).alias("rebuilt"))


@query("""
WITH d AS (SELECT doc_id AS seq, doc_id % 50 AS file_id, CAST(n_chars % 20 AS INT) AS line, lang AS name,
  list_value('fn', 'method', 'cls', 'var', 'struct', 'macro')[doc_id % 6 + 1] AS kind, CAST(list_value(4, 5, 3, 1, 4, 2)[doc_id % 6 + 1] AS BIGINT) AS spec, n_chars AS e FROM documents)
SELECT file_id, line, name, arg_max(kind, spec * 1000000000 - seq) AS kind, arg_max(e, spec * 1000000000 - seq) AS end_byte, arg_min(e, seq) AS end_line FROM d GROUP BY file_id, line, name""")
def dedup_specific(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("fn", "method", "cls", "var", "struct", "macro")])
    d = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), (F.col("doc_id") % 50).alias("file_id"), (F.col("n_chars") % 20).cast("int").alias("line"), F.col("lang").alias("name"),
        F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("kind"), F.col("n_chars").alias("end_line"), F.lit(0).alias("start_byte"), F.col("n_chars").alias("end_byte"),
        F.lit(0).alias("cx"), F.lit(0).alias("body_start"), F.lit(0).alias("body_end"))
    return relations.dedup_definitions(d).select("file_id", "line", "name", "kind", "end_byte", "end_line")


@query("""
WITH d AS (SELECT doc_id AS file_id, n_chars % 9 AS line, lang || n_chars AS name FROM documents UNION ALL SELECT doc_id, n_chars % 7, source FROM documents)
SELECT file_id, line, name, CAST(row_number() OVER (ORDER BY file_id, line, name) - 1 AS INT) AS sym_id FROM d""")
def symbol_ids(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    defs = d.select(F.col("doc_id").alias("file_id"), (F.col("n_chars") % 9).alias("line"), F.concat("lang", F.col("n_chars").cast("string")).alias("name")).unionByName(
        d.select(F.col("doc_id").alias("file_id"), (F.col("n_chars") % 7).alias("line"), F.col("source").alias("name")))
    return relations.number_symbols(defs).select("file_id", "line", "name", "sym_id")


@query("""
SELECT l_orderkey, CAST(floor(sum(n) / 4.0 + 0.5) AS BIGINT) AS naive_tokens FROM (SELECT DISTINCT l_orderkey, l_partkey, p_size * 100 AS n FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY l_orderkey""")
def naive_cost(spark, sf_dir):
    # An order is an answer, its parts are the files that it names.
    paths = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("path"))
    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") * 100).alias("n_bytes"))
    return relations.naive_cost(paths, files, ["l_orderkey"])


# Graph --------------------------------------------------------------------------------------------------------

@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()},
w AS (SELECT src, sum(weight) AS w FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM part),
r AS (
  SELECT 0 AS it, p_partkey AS v, 1.0 / n AS k FROM part, n
  UNION ALL
  SELECT it, v, 0.85 * coalesce(sum(f), 0) + (0.85 * any_value(dang) + 0.15) / any_value(n) FROM (
    SELECT r.it + 1 AS it, p.v AS v, 0 AS f, d.dang, n.n FROM (SELECT p_partkey AS v FROM part) p, (SELECT max(it) AS it FROM r) r,
      (SELECT coalesce(sum(k), 0) AS dang FROM r WHERE v NOT IN (SELECT src FROM w)) d, n WHERE r.it < 20
    UNION ALL
    SELECT r.it + 1, e.dst, r.k * e.weight / w.w, d.dang, n.n FROM r JOIN e ON e.src = r.v JOIN w ON w.src = r.v,
      (SELECT coalesce(sum(k), 0) AS dang FROM r WHERE v NOT IN (SELECT src FROM w)) d, n WHERE r.it < 20) GROUP BY it, v)
SELECT v AS part, round(k * 1000, 5) AS k FROM r WHERE it = 20""")
def rank_parts(spark, sf_dir):
    nodes = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sym_id"))
    run = graph.pagerank(nodes, part_edges(spark, sf_dir), tolerance=0.0, rounds=20)
    return run.ranks.select(F.col("sym_id").alias("part"), F.round(F.col("k") * 1000, 5).alias("k"))


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()},
w AS (SELECT src, sum(weight) AS w FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM part),
r AS (
  SELECT 0 AS it, p_partkey AS v, 1.0 / n AS k, CAST(1 AS DOUBLE) AS d FROM part, n
  UNION ALL
  SELECT it, v, 0.85 * coalesce(sum(f), 0) + (0.85 * any_value(dang) + 0.15) / any_value(n), abs(0.85 * coalesce(sum(f), 0) + (0.85 * any_value(dang) + 0.15) / any_value(n) - sum(old)) FROM (
    SELECT r.it + 1 AS it, r.v, 0 AS f, r.k AS old, d.dang, n.n FROM r,
      (SELECT coalesce(sum(k), 0) AS dang FROM r WHERE v NOT IN (SELECT src FROM w)) d, n, (SELECT sum(d) AS moved FROM r) m WHERE r.it < 100 AND moved >= 1e-6
    UNION ALL
    SELECT r.it + 1, e.dst, r.k * e.weight / w.w, 0, d.dang, n.n FROM r JOIN e ON e.src = r.v JOIN w ON w.src = r.v,
      (SELECT coalesce(sum(k), 0) AS dang FROM r WHERE v NOT IN (SELECT src FROM w)) d, n, (SELECT sum(d) AS moved FROM r) m WHERE r.it < 100 AND moved >= 1e-6) GROUP BY it, v),
t AS (SELECT max(it) AS it FROM r)
SELECT v AS part, round(k, 8) AS k, CAST(t.it AS INT) AS iterations, (SELECT sum(d) FROM r WHERE r.it = t.it) < 1e-6 AS converged FROM r, t WHERE r.it = t.it""")
def rank_converged(spark, sf_dir):
    nodes = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sym_id"))
    run = graph.pagerank(nodes, part_edges(spark, sf_dir))
    return run.ranks.select(F.col("sym_id").alias("part"), F.round("k", 8).alias("k"), F.lit(run.iterations).alias("iterations"), F.lit(run.converged).alias("converged"))


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()}, r AS (SELECT CAST(1 AS BIGINT) AS v, 0 AS lev UNION SELECT e.src, r.lev + 1 FROM r JOIN e ON e.dst = r.v WHERE r.lev < 3)
SELECT v AS part, min(lev) AS level FROM r WHERE v <> 1 GROUP BY v""")
def impact_depth3(spark, sf_dir):
    edges = keep(part_edges(spark, sf_dir), "edges")
    start = spark.range(1).select(F.lit(1).cast("bigint").alias("sym_id"))
    return graph.reach(edges, start, 3)[0].select(F.col("sym_id").alias("part"), "level")


@query()
def impact_whole(spark, sf_dir):
    """Everything that reaches part 1, without a depth."""
    edges = keep(part_edges(spark, sf_dir), "edges")
    start = spark.range(1).select(F.lit(1).cast("bigint").alias("sym_id"))
    return graph.reach(edges, start)[0].select(F.col("sym_id").alias("part"), "level")


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()}, o AS (SELECT p_partkey AS o FROM part WHERE p_brand = 'Brand#11'),
r AS (SELECT o, o AS v, 0 AS lev FROM o UNION SELECT r.o, e.src, r.lev + 1 FROM r JOIN e ON e.dst = r.v WHERE r.lev < 2)
SELECT o.o AS part, count(DISTINCT r.v) FILTER (WHERE r.lev > 0) AS amp FROM o LEFT JOIN r ON r.o = o.o GROUP BY o.o""")
def amp_depth2(spark, sf_dir):
    edges = keep(part_edges(spark, sf_dir), "edges")
    origins = _table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("sym_id"))
    return graph.reach_sizes(edges, origins, 2).select(F.col("origin").alias("part"), "amp")


@query()
def amp_whole(spark, sf_dir):
    """amp_depth2's parts without a depth: all that reaches each of them."""
    edges = keep(part_edges(spark, sf_dir).select("src", "dst"), "edges")
    origins = _table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("sym_id"))
    return graph.reach_sizes(edges, origins).select(F.col("origin").alias("part"), "amp")


# Extraction ---------------------------------------------------------------------------------------------------

@query("""
SELECT event_id, 'a' AS name FROM events UNION ALL SELECT event_id, 'b' FROM events UNION ALL SELECT event_id, 'k' FROM events WHERE contains(props, '"k"')""")
def json_keys(spark, sf_dir):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, names = [], []
            for key, doc in zip(b.column("event_id").to_pylist(), b.column("doc").to_pylist(), strict=True):
                got = [d[0] for d in extract_file("json", doc.encode()).defs]
                ids += [key] * len(got)
                names += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], ["event_id", "name"])

    # Depth 1: a and b; depth 2: the keys of props; depth 3 is not looked at.
    doc = F.concat(F.lit('{"a": {'), F.expr("substring(props, 2, length(props) - 2)"), F.lit('}, "b": [{"x": '), F.col("props"), F.lit("}]}"))
    return _table(spark, sf_dir, "events").select("event_id", doc.alias("doc")).mapInArrow(run, "event_id bigint, name string")


@query(r"""SELECT page_id, count(*) AS n, min(v) AS first_value FROM (SELECT page_id, unnest(regexp_extract_all(decode(html), '<[A-Za-z][^<>]*?\s(href)\s*=\s*"([^"]*)"', 2)) AS v FROM pages) GROUP BY page_id""".replace("decode(html)", "html"))
def html_attrs(spark, sf_dir):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, values = [], []
            for key, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                src = (html or "").encode()
                # A definition's span runs from the attribute's name to the end of its value.
                got = [src[d[4]:d[5]].split(b"=", 1)[1].strip() for d in html_file(src, "href").defs]
                ids += [key] * len(got)
                values += [(v[1:-1] if v[:1] in (b'"', b"'") else v).decode() for v in got]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], ["page_id", "v"])

    pages = _table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id bigint, v string")
    return pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first_value"))


# Ledger -------------------------------------------------------------------------------------------------------

@query("""
WITH l AS (SELECT CAST(user_id AS VARCHAR) AS repo, event_type AS verb, CAST(floor(value) AS BIGINT) AS spent, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 1000 END AS naive FROM events)
SELECT CASE WHEN grouping(repo) = 0 THEN 'repo' WHEN grouping(verb) = 0 THEN 'verb' ELSE 'total' END AS level, coalesce(repo, verb, '') AS name, count(*) AS runs,
  CAST(sum(spent) AS BIGINT) AS spent_tokens, CAST(coalesce(sum(naive), 0) AS BIGINT) AS naive_tokens, count(*) FILTER (WHERE naive IS NULL) AS unmodelled,
  CAST(CASE WHEN coalesce(sum(naive), 0) > 0 AND sum(naive) > sum(spent) THEN least((sum(naive) - sum(spent)) * 100 // sum(naive), 100) ELSE 0 END AS BIGINT) AS saved_tokens_pct
FROM l GROUP BY GROUPING SETS ((), (repo), (verb))""")
def ledger_rollup(spark, sf_dir):
    from . import ledger

    return ledger.savings(ledger.rollup(_ledger_rows(spark, sf_dir))).select("level", "name", "runs", "spent_tokens", "naive_tokens", "unmodelled", "saved_tokens_pct")


def _ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = F.col("event_id") % 3 == 0
    return _table(spark, sf_dir, "events").select(
        F.lit(0).cast("bigint").alias("ts"), F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("verb"), F.floor("value").cast("bigint").alias("spent_tokens"),
        F.lit(0).cast("bigint").alias("spent_ms"), F.when(~three, F.col("event_id") % 1000).alias("naive_tokens"), F.lit(None).cast("bigint").alias("naive_ms"),
        F.when(three, "none").otherwise("file-set").alias("model"))


@query("""
WITH l AS (SELECT user_id, CAST(sum(floor(value)) AS BIGINT) AS spent FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS repo, spent FROM l ORDER BY spent DESC, CAST(user_id AS VARCHAR) LIMIT 10""")
def ledger_top10(spark, sf_dir):
    from . import ledger

    rows = _ledger_rows(spark, sf_dir)
    return ledger.top_repos(ledger.rollup(rows).where("level = 'repo'")).select(F.col("name").alias("repo"), F.col("spent_tokens").alias("spent"))
