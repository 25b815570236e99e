"""The query verbs. Each takes an index and returns (rows, summary), two DataFrames.

Rows hold what an answer lists, summary one row of what it says about itself. render.py turns both into XML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.storage import keep
from ..operators import graph, lexical, relations
from ..sources.crawl import lines, parse_frames, span_text
from ..sources.index import Index

Answer = tuple[DataFrame, DataFrame]
SIBLINGS = 8
TAIL = 20


def _symbols(index: Index) -> DataFrame:
    return index.symbols.join(index.files.select("file_id", "path", "lang"), "file_id")


def _one(index: Index, **columns) -> DataFrame:
    return index.files.sparkSession.range(1).select(*[(c if not isinstance(c, (str, int, bool, float, type(None))) else F.lit(c)).alias(k) for k, c in columns.items()])


def resolve(index: Index, selector: str) -> DataFrame:
    """Symbols that a selector means: FILE:NAME with the file's path or its end, else a bare name."""
    s = _symbols(index)
    file, sep, name = selector.rpartition(":")
    if sep and file:
        exact = s.where((F.col("name") == name) & ((F.col("path") == file) | F.col("path").endswith("/" + file)))
        if not exact.isEmpty():
            return exact
    return s.where(F.col("name") == selector)


def ranked_map(index: Index) -> Answer:
    """Every symbol by rank, with its callees."""
    run = graph.pagerank(index.symbols.select("sym_id"), index.edges)
    callee = index.symbols.select(F.col("sym_id").alias("dst"), F.col("name").alias("callee"))
    calls = index.edges.join(callee, "dst").groupBy(F.col("src").alias("sym_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dst", "callee"))), lambda x: x["callee"]).alias("callees"))
    rows = (_symbols(index).join(run.ranks, "sym_id").join(calls, "sym_id", "left").select(
        "sym_id", "path", F.col("kind").alias("t"), F.col("name").alias("n"), F.round("k", 4).alias("k"), "line", "cx",
        T.layer(F.col("path")).alias("layer"), F.coalesce("callees", F.array().cast("array<string>")).alias("callees"), F.col("k").alias("rank"))
        .orderBy(F.desc("rank"), "sym_id"))
    summary = _one(index, pr_iters=run.iterations, converged=run.converged).crossJoin(
        index.files.agg(F.count(F.lit(1)).alias("files"))).crossJoin(index.symbols.agg(F.count(F.lit(1)).alias("symbols"))).crossJoin(
        index.edges.agg(F.count(F.lit(1)).alias("edges")))
    return rows, summary


def _unsettled(index: Index) -> DataFrame:
    """One row: graph_ambiguous and graph_unresolved, references inside definitions that the graph has no edge for."""
    paths = index.files.select("file_id", "path")
    inside = relations.enclosing(index.refs, _spans(index), "ref_id", "file_id", ("start_byte", "end_byte"), ("start_byte", "end_byte"), "sym_id").where("enclosing is not null")
    counts = relations.unsettled(inside.join(paths, "file_id"), index.symbols.join(paths, "file_id"))
    return counts.select(F.col("ambiguous").alias("graph_ambiguous"), F.col("unresolved").alias("graph_unresolved"))


def _spans(index: Index) -> DataFrame:
    return index.symbols.select("file_id", "start_byte", "end_byte", "sym_id")


def per_file(index: Index, rows: DataFrame, value) -> DataFrame:
    """rows(file_id, ...) with `value`(content, row) added: a file's rows are gathered first, so its content is read
    once and never copied to them. A file has at most as many rows as it has places."""
    names = [c for c in rows.columns if c != "file_id"]
    gathered = rows.groupBy("file_id").agg(F.collect_list(F.struct(*names)).alias("rows"))
    met = gathered.join(index.files.select("file_id", "content"), "file_id")
    out = met.select("file_id", F.explode(F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in names], value(F.col("content"), r).alias("value")))).alias("r"))
    return out.select("file_id", "r.*")


def line_of(index: Index, places: DataFrame, key: str, at: str) -> DataFrame:
    """places(file_id, ...), one row a `key`, with the line of the byte `at`: files that hold places are cut into lines
    once, and places meet the lines' spans, so no place reads its file's content again."""
    held = index.files.join(places.select("file_id").distinct(), "file_id", "left_semi")
    # A character a byte, so that offsets are right whatever the bytes are.
    plain = F.regexp_replace(F.decode("content", "ISO-8859-1"), "[\r\u0080-\u00ff]", ".")
    cut = lines(held.select("file_id", plain.alias("content")))
    spans = cut.select("file_id", "start_byte", (F.col("start_byte") + F.length("text")).alias("end_byte"), F.col("line").cast("bigint").alias("line"))
    return relations.enclosing(places, spans, key, "file_id", (at, at), ("start_byte", "end_byte"), "line").withColumnRenamed("enclosing", "line")


def grep(index: Index, term: str) -> Answer:
    """Lines that hold a literal text, with the innermost definition around the first place in each. The summary lists
    the enclosing names in the order of their first hits, with the callers of the first definition of the name."""
    hits = lines(index.files, having=lambda t: F.instr(t, term) > 0)
    at = F.col("start_byte") + F.octet_length(F.substring(F.col("text"), F.lit(1), F.instr("text", term) - 1))
    hits = keep(hits.select("file_id", "line", "text", at.alias("at"), F.struct("file_id", "line").alias("hit")), "hits")
    placed = relations.enclosing(hits, _spans(index), "hit", "file_id", ("at", "at"), ("start_byte", "end_byte"), "sym_id")
    inside = index.symbols.select(F.col("sym_id").alias("enclosing"), F.col("name").alias("in"), "cx")
    callers = relations.fan_in(index.edges).withColumnRenamed("dst", "enclosing")
    rows = keep(placed.drop("hit").join(inside, "enclosing", "left").join(callers, "enclosing", "left").join(index.files.select("file_id", "path"), "file_id").select(
        "path", F.col("line").alias("l"), "in", F.col("enclosing").alias("in_id"), F.col("text"), F.coalesce("fan_in", F.lit(0)).alias("callers"), "cx"), "grep")
    first = rows.where("in is not null").groupBy("in").agg(F.min(F.struct("path", "l")).alias("seen"))
    named = index.symbols.groupBy(F.col("name").alias("in")).agg(F.min(F.struct(F.col("sym_id").alias("enclosing"), "kind", "cx")).alias("d"))
    enc = first.join(named, "in").select("seen", "in", "d.*").join(callers, "enclosing", "left").agg(F.array_sort(F.collect_list(F.struct(
        "seen", F.col("in").alias("n"), F.coalesce("fan_in", F.lit(0)).alias("callers"), F.when(F.col("kind").isin("fn", "method"), F.col("cx")).alias("cx")))).alias("enc"))
    enc = enc.select(F.transform("enc", lambda x: F.struct(x["n"].alias("n"), x["callers"].alias("callers"), x["cx"].alias("cx"))).alias("enc"))
    top = rows.agg(F.min(F.struct("path", "l")).alias("t"), F.count(F.lit(1)).alias("hits")).select(
        "hits", F.when(F.col("t").isNotNull(), F.concat(F.lit("--at="), F.col("t.path"), F.lit(":"), F.col("t.l").cast("string"))).alias("next"))
    summary = index.files.agg(F.count(F.lit(1)).alias("files")).crossJoin(top).crossJoin(enc)
    return rows.orderBy("path", "l"), summary


def hierarchy(index: Index, selector: str, which: str, transitive_tests: bool = False) -> Answer:
    """Callers or callees of a symbol, one hop; tests and docs come last. The summary also counts the graph's references
    that no edge was made for."""
    defs = resolve(index, selector).select("sym_id")
    near = relations.neighbours(index.edges, defs, which)
    s = _symbols(index)
    marked = s.select("sym_id", T.is_test(F.col("path"), F.col("name")).alias("is_test"))
    tested = relations.tested(marked, index.edges, transitive_tests).withColumn("tested", F.lit(True))
    rows = keep(near.join(s, "sym_id").join(tested, "sym_id", "left").select(
        F.col("kind").alias("t"), F.col("name").alias("n"), "path", "line", "sym_id", T.row_tier(F.col("path")).alias("tier"), "disc",
        F.coalesce("tested", F.lit(False)).alias("tested")), which)
    summary = defs.agg(F.count(F.lit(1)).alias("defs")).crossJoin(rows.agg(
        F.count(F.lit(1)).alias("count"), F.count_if("tested").alias("hop_tested"), F.count_if(~F.col("tested")).alias("hop_untested"))).crossJoin(
        _unsettled(index)).withColumn("next", F.lit(f"--{'uses' if which == 'callers' else 'expand'}={selector}"))
    return rows.orderBy("tier", "path", "disc").select("t", "n", "path", "line", "sym_id", "tier", "tested"), summary


def callers(index: Index, selector: str) -> Answer:
    return hierarchy(index, selector, "callers")


def callees(index: Index, selector: str) -> Answer:
    return hierarchy(index, selector, "callees")


def uses(index: Index, selector: str) -> Answer:
    """Places that refer to a name, each with the definition around it."""
    name = selector
    defs = resolve(index, selector)
    if ":" in selector and not defs.isEmpty():
        name = selector.rpartition(":")[2]
    sites = index.refs.where(F.col("name") == name)
    placed = relations.enclosing(sites, _spans(index), "ref_id", "file_id", ("start_byte", "end_byte"), ("start_byte", "end_byte"), "sym_id")
    inside = index.symbols.select(F.col("sym_id").alias("enclosing"), F.col("name").alias("in"))
    lined = line_of(index, placed.select("file_id", "ref_id", "start_byte", F.col("enclosing").alias("sym")), "ref_id", "start_byte").withColumnRenamed("sym", "enclosing")
    rows = (lined.join(index.files.select("file_id", "path"), "file_id").join(inside, "enclosing", "left").select(
        F.lit("call").alias("role"), "path", "line", "in",
        F.col("enclosing").alias("in_id"), T.row_tier(F.col("path")).alias("tier"), "start_byte").orderBy("tier", "path", "start_byte"))
    n = F.count(F.lit(1))
    summary = defs.agg(n.alias("defs"), F.when(n == 0, 1).otherwise(0).alias("external")).crossJoin(sites.agg(n.alias("count"))).crossJoin(_unsettled(index))
    return rows, summary


def at(index: Index, place: str, strict_parity: bool = False) -> Answer:
    """Definitions around FILE:LINE, innermost first; none for an unknown file. With strict_parity the innermost
    alone, and an unknown file is the first one."""
    file, _, line = place.rpartition(":")
    number = int(line) if line.isdigit() else 0
    own = index.files.where((F.col("path") == file) | F.col("path").endswith("/" + file)).agg(F.min("file_id").alias("file_id"))
    if strict_parity:
        own = own.select(F.coalesce("file_id", F.lit(0)).alias("file_id"))
    s = _symbols(index).join(own, "file_id").where(F.lit(number).between(F.col("line"), F.col("end_line")))
    order = Window.partitionBy("file_id").orderBy(F.desc("line"), F.desc("sym_id"))
    rows = s.select(F.col("name").alias("n"), F.col("kind").alias("t"), F.col("line").alias("l"), F.col("end_line").alias("el"), "path", "sym_id",
                    F.row_number().over(order).alias("up")).orderBy("up")
    rows = rows.where("up = 1") if strict_parity else rows
    summary = rows.agg(F.count(F.lit(1)).alias("chain"), F.min_by("n", "up").alias("sym")).withColumn("p", F.lit(file)).withColumn("l", F.lit(number))
    return rows, summary


def impact(index: Index, selector: str, depth: int | None = None) -> Answer:
    """Everything that reaches a symbol over calls."""
    defs = keep(resolve(index, selector).select("sym_id"), "defs")
    met, levels, capped = graph.reach(index.edges, defs, depth)
    rows = met.join(_symbols(index), "sym_id").select("sym_id", "level", F.col("kind").alias("t"), F.col("name").alias("n"), "path", "line").orderBy("level", "sym_id")
    summary = defs.agg(F.count(F.lit(1)).alias("defs")).crossJoin(met.agg(F.count(F.lit(1)).alias("reaches"))).withColumn(
        "depth", F.lit(levels)).withColumn("depth_capped", F.lit(int(capped)))
    return rows, summary


def bundle(index: Index, ids: DataFrame) -> DataFrame:
    """Bodies of ids(sym_id): body, siblings of other names in the file (at most 8, with their total), imports of Go
    files and signatures of callees."""
    s = index.symbols.join(ids.select("sym_id"), "sym_id", "left_semi").join(index.files, "file_id")
    body = span_text(F.col("content"), F.col("start_byte"), F.col("end_byte"))
    whole = F.make_valid_utf8(F.col("content").cast("string"))
    incs = F.when(F.col("path").endswith(".go"), T.go_imports(whole)).otherwise(F.array().cast("array<string>"))
    out = s.select("sym_id", "name", "kind", "file_id", "path", "line", "end_line", "n_bytes", body.alias("body"), incs.alias("inc"), F.size(incs).alias("inc_total"))
    sib = index.symbols.select("file_id", F.col("sym_id").alias("sib"), F.col("name").alias("sib_name"))
    sibs = out.select("sym_id", "name", "file_id").join(sib, "file_id").where("sib_name <> name").groupBy("sym_id").agg(
        F.count(F.lit(1)).alias("sibs_total"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("sib", "sib_name"))), 1, SIBLINGS), lambda x: x["sib_name"]).alias("sibs"))
    calls = index.edges.join(ids.select(F.col("sym_id").alias("src")), "src", "left_semi").join(signatures(index).withColumnRenamed("sym_id", "dst"), "dst")
    calls = calls.groupBy(F.col("src").alias("sym_id")).agg(F.array_sort(F.collect_list(F.struct("dst", "sig"))).alias("calls"))
    return out.join(sibs, "sym_id", "left").join(calls, "sym_id", "left").select(
        *out.columns, F.coalesce("sibs", F.array().cast("array<string>")).alias("sibs"), F.coalesce("sibs_total", F.lit(0)).alias("sibs_total"),
        F.transform(F.coalesce("calls", F.array().cast("array<struct<dst:int,sig:string>>")), lambda x: x["sig"]).alias("callee_sigs"))


def signatures(index: Index, ids: DataFrame | None = None) -> DataFrame:
    s = index.symbols if ids is None else index.symbols.join(ids.select("sym_id"), "sym_id", "left_semi")
    return per_file(index, s.select("file_id", "sym_id", "start_byte"), lambda content, r: T.signature(
        span_text(content, r["start_byte"], F.octet_length(content).cast("bigint")))).select("sym_id", F.col("value").alias("sig"))


def expand(index: Index, selector: str, root: str = ".") -> Answer:
    """The first definition that a selector means: its body with context, or its whole file where that is smaller than
    the bundle as it would be written, markup and legend included (see render.bundle_bytes)."""
    from .render import bundle_bytes, expand_price

    first = resolve(index, selector).agg(F.min("sym_id").alias("sym_id")).where("sym_id is not null")
    rows = bundle(index, first)
    size = bundle_bytes()
    whole = F.col("n_bytes") < size
    text = F.when(whole, F.make_valid_utf8(F.col("content").cast("string"))).otherwise(F.col("body"))
    reason = F.when(whole, F.concat(F.lit("file "), F.col("n_bytes").cast("string"), F.lit("B < bundle "), size.cast("string"), F.lit("B"))).otherwise(
        F.concat(F.lit("bundle "), size.cast("string"), F.lit("B <= file "), F.col("n_bytes").cast("string"), F.lit("B")))
    rows = rows.join(index.files.select("file_id", "content"), "file_id").withColumn("mode", F.when(whole, "whole-file").otherwise("bundle")).withColumn(
        "reason", reason).withColumn("text", text).drop("content")
    summary = rows.select("mode", "reason", F.col("n_bytes").alias("file_bytes"), size.alias("bundle_bytes"), expand_price(root).alias("est_tokens"))
    return rows, summary


def for_task(index: Index, task: str) -> Answer:
    """Symbols by how well they fit a task in words, cut where the scores fall off."""
    spark = index.files.sparkSession
    terms = lexical.terms_of(spark, task)
    body = per_file(index, index.symbols.select("file_id", "sym_id", "start_byte", "end_byte"), lambda content, r: F.coalesce(
        span_text(content, r["start_byte"], r["end_byte"]), F.lit(""))).select("sym_id", F.col("value").alias("text"))
    scores = keep(lexical.bm25(lexical.symbol_fields(index.symbols, index.edges, body), terms).withColumn("score", F.col("score").cast("float")), "scores")
    exact = scores.withColumn("score", F.col("score").cast("double"))
    cut = keep(lexical.cut_summary(exact), "cut")
    kept = cut.first()["kept"]
    top = keep(scores.orderBy(F.desc("score"), "sym_id").where("score > 0").limit(kept), "top")
    order = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "sym_id")))
    fan = relations.fan_in(index.edges).withColumnRenamed("dst", "sym_id")
    amp = graph.reach_sizes(index.edges, top).withColumnRenamed("origin", "sym_id")
    callee = index.symbols.select(F.col("sym_id").alias("dst"), F.col("name").alias("callee"))
    hops = index.edges.join(top.select(F.col("sym_id").alias("src")), "src", "left_semi").join(callee, "dst").groupBy(F.col("src").alias("sym_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dst", "callee"))), lambda x: x["callee"]).alias("hops"))
    rows = (order.join(_symbols(index), "sym_id").join(fan, "sym_id", "left").join(amp, "sym_id", "left").join(hops, "sym_id", "left")
            .join(signatures(index, top), "sym_id", "left").select(
        F.col("line").alias("l"), F.col("name").alias("n"), F.concat_ws(":", "path", "line").alias("p"), "cx", F.lit(0).alias("ccx"),
        F.coalesce("fan_in", F.lit(0)).alias("in"), F.coalesce("amp", F.lit(0)).alias("amp"), "r", "score", "sig", "sym_id",
        F.coalesce("hops", F.array().cast("array<string>")).alias("hops"),
        F.when(F.col("r") == 1, F.concat(F.lit("--expand="), "path", F.lit(":"), "name")).alias("next")).orderBy("r"))
    # The tail: files of positive rows that the cut left out, and that no kept row lies in.
    left = exact.where("score > 0").select("sym_id").join(top.select("sym_id"), "sym_id", "left_anti")
    in_files = lambda ids: index.symbols.join(ids, "sym_id", "left_semi").select("file_id").distinct()
    tail = in_files(left).join(in_files(top.select("sym_id")), "file_id", "left_anti").join(index.files.select("file_id", "path"), "file_id")
    tail = tail.agg(F.count(F.lit(1)).alias("tail_total"), F.slice(F.array_sort(F.collect_list("path")), 1, TAIL).alias("tail"))
    named = lexical.route(index.symbols, spark.range(1).select(F.lit(task).alias("query")))
    summary = cut.crossJoin(named.select("name_exact", "reason", "named")).crossJoin(
        rows.agg(F.count_if(F.size("hops") == 0).alias("noedge"))).crossJoin(tail).withColumn("window", F.lit(lexical.CEILING))
    return rows, summary


def from_trace(index: Index, trace: str, strict_parity: bool = False) -> Answer:
    """Frames of a stack trace, in order, with the definitions they lie in; the first one that is in the corpus comes
    with its body. With strict_parity a file may match from the middle of a path part."""
    spark = index.files.sparkSession
    frames = keep(parse_frames(spark.range(1).select(F.lit(trace).alias("value"))), "frames")
    placed = relations.suffix_join(frames, index.files, boundary=not strict_parity)
    spans = index.symbols.select("file_id", "line", "end_line", "sym_id")
    found = relations.enclosing(placed.withColumnRenamed("line", "at_line"), spans, "frame_no", "file_id", ("at_line", "at_line"), ("line", "end_line"), "sym_id")
    s = index.symbols.select(F.col("sym_id").alias("enclosing"), F.col("name").alias("n"), F.col("kind").alias("t"))
    rows = keep(found.join(s, "enclosing", "left").select("frame_no", "path", F.col("at_line").alias("line"), "file_id", F.col("enclosing").alias("sym_id"), "n", "t"), "trace")
    first = rows.where("sym_id is not null").agg(F.min_by("sym_id", "frame_no").alias("sym_id")).where("sym_id is not null")
    body = bundle(index, first).select("sym_id", "body")
    sigs = signatures(index, rows.where("sym_id is not null").select("sym_id").distinct())
    out = rows.join(sigs, "sym_id", "left").join(body, "sym_id", "left").orderBy("frame_no").select("frame_no", "path", "line", "sym_id", "n", "t", "sig", "body")
    summary = rows.agg(F.count(F.lit(1)).alias("frames"), F.count("file_id").alias("in_corpus"), F.count_if(F.col("sym_id").isNull()).alias("unresolved"))
    return out, summary


VERBS = ("grep", "callers", "callees", "for", "uses", "at", "expand", "impact", "from-trace", "gain", "map")


def choose_verb(flags: dict[str, str | None]) -> str:
    """The verb that wins when several are asked for; gain only if no other is."""
    for verb in VERBS:
        if verb in ("gain", "map"):
            continue
        if flags.get(verb) is not None:
            return verb
    return "gain" if flags.get("gain") is not None else "map"


def run_verb(index: Index, flags: dict[str, str | None]) -> tuple[str, Answer]:
    """The winning verb of the flags and its answer; `depth` belongs to impact."""
    verb = choose_verb(flags)
    arg = flags.get(verb)
    if verb == "map":
        return verb, ranked_map(index)
    if verb == "impact":
        depth = flags.get("depth")
        return verb, impact(index, arg, int(depth) if depth is not None else None)
    if verb == "gain":
        raise ValueError("gain reads the ledger, not an index: see quarry.plans.ledger")
    return verb, {"grep": grep, "callers": callers, "callees": callees, "for": for_task, "uses": uses, "at": at, "expand": expand, "from-trace": from_trace}[verb](index, arg)
