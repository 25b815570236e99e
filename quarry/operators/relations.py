"""Joins and aggregations that turn files, symbols and references into a weighted graph.

All take any DataFrames with the named columns, so they run on code trees and on ordinary tables alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import number_rows

# Kinds by how much they say about a definition.
SPECIFICITY = {"method": 5, "fn": 4, "struct": 4, "iface": 4, "cls": 3, "macro": 2, "var": 1, "sec": 1}


def specificity(kind: Column) -> Column:
    out = F.lit(0)
    for name, n in SPECIFICITY.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def dedup_definitions(defs: DataFrame) -> DataFrame:
    """One definition for each (file_id, line, name), `seq` being the order of arrival.

    The most specific kind wins, the first of equals, with its byte and body spans; end_line and cx stay those of
    the first arrival.
    """
    best = F.struct(specificity(F.col("kind")), -F.col("seq"))
    spans = F.struct("kind", "start_byte", "end_byte", "body_start", "body_end")
    out = defs.groupBy("file_id", "line", "name").agg(
        F.max_by(spans, best).alias("w"), F.min_by(F.struct("end_line", "cx"), F.col("seq")).alias("f"))
    return out.select("file_id", "line", "name", "w.kind", "f.end_line", "w.start_byte", "w.end_byte", "f.cx", "w.body_start", "w.body_end")


def number_symbols(defs: DataFrame) -> DataFrame:
    """sym_id: rank by (file_id, line, name) from 0."""
    return number_rows(defs, ["file_id", "line", "name"], "sym_id").withColumn("sym_id", F.col("sym_id").cast("int"))


# Spans of a group from which on places and spans meet by buckets instead of all with all.
CROWDED = 1_000


def _axis(df: DataFrame, name: str) -> Column:
    """A column as whole numbers in the same order: microseconds of times, days of dates."""
    c, kind = F.col(name), dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        seconds = F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(c)
    return F.unix_date(c).cast("bigint") if kind == "date" else F.floor(c).cast("bigint")


def enclosing(points: DataFrame, spans: DataFrame, point_id: str, group: str, at: tuple[str, str], span: tuple[str, str], span_id: str, slack: int = 0,
              crowded: int = CROWDED) -> DataFrame:
    """points with `enclosing`, the innermost span of the same group that holds [at[0], at[1]]; null without one.

    Innermost: the latest start; of equal starts the largest span id. slack widens spans at their end. Spans of a group
    with more than `crowded` spans are dealt to buckets as wide as their mean length, and a span goes to every bucket
    that it touches: an equi join whose rows grow with what really overlaps.
    """
    end = F.col(span[1]) + F.lit(slack) if slack else F.col(span[1])
    last = F.col("_ne") + F.lit(slack) if slack else F.col("_ne")
    s = spans.select(F.col(group).alias("_g"), F.col(span[0]).alias("_s"), end.alias("_e"), _axis(spans, span[0]).alias("_ns"), _axis(spans, span[1]).alias("_ne"),
                     F.col(span_id).alias("_id")).withColumn("_ne", last).where("_e >= _s")
    width = F.greatest(F.lit(1), F.avg(F.col("_ne") - F.col("_ns")) + 1).cast("bigint")
    # One row a group: only crowded ones are told apart.
    wide = s.groupBy("_g").agg(F.count(F.lit(1)).alias("m"), width.alias("_w")).where(F.col("m") > crowded).select("_g", "_w")
    p = points.select(point_id, F.col(group).alias("_pg"), F.col(at[0]).alias("_p0"), F.col(at[1]).alias("_p1"), _axis(points, at[0]).alias("_n"))
    inside = (F.col("_s") <= F.col("_p0")) & (F.col("_e") >= F.col("_p1"))
    few = p.join(s.join(wide, "_g", "left_anti"), (F.col("_pg") == F.col("_g")) & inside)
    dealt = s.join(wide, "_g").withColumn("_b", F.explode(F.sequence(F.floor(F.col("_ns") / F.col("_w")), F.floor(F.col("_ne") / F.col("_w")))))
    own = p.join(wide.select(F.col("_g").alias("_pg"), F.col("_w").alias("_pw")), "_pg").withColumn("_pb", F.floor(F.col("_n") / F.col("_pw")))
    many = own.join(dealt, (F.col("_pg") == F.col("_g")) & (F.col("_pb") == F.col("_b")) & inside)
    hit = few.select(point_id, "_s", "_id").unionByName(many.select(point_id, "_s", "_id"))
    best = hit.groupBy(point_id).agg(F.max_by("_id", F.struct("_s", "_id")).alias("enclosing"))
    return points.join(best, point_id, "left")


def candidates(refs: DataFrame, symbols: DataFrame, tier2: str = "basename") -> DataFrame:
    """(ref_id, sym_id, tier, k): the definitions that a reference's name may mean.

    refs: ref_id, name, path. symbols: sym_id, name, path. Tier 1: definitions in the same file; else tier 2: in other
    files of the same basename (tier2="dir": the same directory); else tier 3: the definition elsewhere if it is
    the only one. k is the number of candidates.
    """
    part = (lambda c: F.substring_index(c, "/", -1)) if tier2 == "basename" else (lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1))
    s = symbols.select("sym_id", "name", F.col("path").alias("at"), part(F.col("path")).alias("base"))
    r = refs.select("ref_id", "name", F.col("path").alias("at"), part(F.col("path")).alias("base"))
    # Counts of each tier decide first, one row a key; then a reference meets the definitions of its tier alone.
    n = F.count(F.lit(1))
    same = s.groupBy("name", "at").agg(n.alias("k1"))
    near = s.groupBy("name", "base").agg(n.alias("k2"))
    only = s.groupBy("name").agg(n.alias("k3"), F.min("sym_id").alias("only"))
    sized = r.join(same, ["name", "at"], "left").join(near, ["name", "base"], "left").join(only, "name")
    tier = F.when(F.col("k1").isNotNull(), 1).when(F.col("k2").isNotNull(), 2).when(F.col("k3") == 1, 3)
    chosen = sized.select("ref_id", "name", "at", "base", "only", "k1", "k2", tier.alias("tier"))
    one = lambda t, key, k: chosen.where(F.col("tier") == t).join(s.select("sym_id", "name", key), ["name", key]).select(
        "ref_id", "sym_id", "tier", F.col(k).alias("k"))
    alone = chosen.where("tier = 3").select("ref_id", F.col("only").alias("sym_id"), "tier", F.lit(1).cast("bigint").alias("k"))
    return one(1, "at", "k1").unionByName(one(2, "base", "k2")).unionByName(alone)


def unsettled(refs: DataFrame, symbols: DataFrame, tier2: str = "basename") -> DataFrame:
    """One row: ambiguous, the references that several definitions elsewhere could be meant by and that get none, and
    unresolved, those whose name no definition has."""
    settled = candidates(refs, symbols, tier2).select("ref_id").distinct()
    known = symbols.select("name").distinct().withColumn("known", F.lit(True))
    rest = refs.select("ref_id", "name").join(settled, "ref_id", "left_anti").join(known, "name", "left")
    return rest.agg(F.count_if(F.col("known").isNotNull()).alias("ambiguous"), F.count_if(F.col("known").isNull()).alias("unresolved"))


def weighted_edges(calls: DataFrame, cap: float = 8.0) -> DataFrame:
    """edges(src, dst, weight) from calls(src, dst, conf): the mean confidence times the root of the number of
    references, at most cap. Self calls are left out."""
    n = F.count(F.lit(1))
    w = F.least(F.sum(F.col("conf").cast("double")) / n * F.sqrt(n), F.lit(cap))
    return calls.where("src <> dst").groupBy("src", "dst").agg(w.cast("float").alias("weight"))


def resolve_edges(refs: DataFrame, symbols: DataFrame, files: DataFrame, tier2: str = "basename") -> DataFrame:
    """edges(src, dst, weight) of an index: the caller is the innermost definition around a reference."""
    paths = files.select("file_id", "path")
    spans = symbols.select("file_id", "start_byte", "end_byte", "sym_id")
    placed = enclosing(refs, spans, "ref_id", "file_id", ("start_byte", "end_byte"), ("start_byte", "end_byte"), "sym_id").where("enclosing is not null")
    met = candidates(placed.join(paths, "file_id"), symbols.join(paths, "file_id"), tier2)
    calls = placed.select("ref_id", F.col("enclosing").alias("src")).join(met, "ref_id").select(
        "src", F.col("sym_id").alias("dst"), (F.lit(1.0) / F.col("k")).cast("float").alias("conf"))
    return weighted_edges(calls)


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum(F.col("weight").cast("double")).alias("w_out"))


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("fan_in"))


def neighbours(edges: DataFrame, defs: DataFrame, which: str) -> DataFrame:
    """(sym_id, disc): distinct callers or callees of defs(sym_id), with the first edge that shows each."""
    own, other = ("dst", "src") if which == "callers" else ("src", "dst")
    met = edges.join(defs.select(F.col("sym_id").alias(own)).distinct(), own, "left_semi")
    return met.groupBy(F.col(other).alias("sym_id")).agg(F.min(F.struct("src", "dst")).alias("disc"))


def tested(symbols: DataFrame, edges: DataFrame, transitive: bool = False) -> DataFrame:
    """sym_ids that are tests (column is_test of symbols) or called by one; with transitive, reached by one."""
    tests = symbols.where("is_test").select("sym_id")
    if transitive:
        from .graph import reach_forward

        return tests.union(reach_forward(edges, tests).select("sym_id")).distinct()
    called = edges.join(tests.withColumnRenamed("sym_id", "src"), "src", "left_semi").select(F.col("dst").alias("sym_id"))
    return tests.union(called).distinct()


def manifest_diff(manifest: DataFrame, stats: DataFrame) -> DataFrame:
    """(path, state): new, changed, same or missing; a file is changed if its length or time differ."""
    m = manifest.select("path", F.col("len").alias("_l"), F.col("mtime_nanos").alias("_t"), F.lit(True).alias("_m"))
    s = stats.select("path", "len", "mtime_nanos", F.lit(True).alias("_s"))
    state = (F.when(F.col("_s").isNull(), "missing").when(F.col("_m").isNull(), "new")
             .when(~F.col("len").eqNullSafe(F.col("_l")) | ~F.col("mtime_nanos").eqNullSafe(F.col("_t")), "changed").otherwise("same"))
    return s.join(m, "path", "full").select("path", state.alias("state"))


def really_changed(diff: DataFrame, manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """Changed or new paths whose content hash is not the manifest's."""
    old = manifest.select("path", F.col("hash").alias("_h"))
    return (diff.where("state in ('changed', 'new')").join(hashes.select("path", "hash"), "path").join(old, "path", "left")
            .where(~F.col("hash").eqNullSafe(F.col("_h"))).select("path"))


def suffix_join(frames: DataFrame, files: DataFrame, boundary: bool = True) -> DataFrame:
    """frames(frame_no, path, ...) with file_id of the first file whose path the frame's path is or ends with; null
    without one.

    With boundary a match must begin at a path part; without it, anywhere. Either way a frame's path is joined on its
    own suffixes: an equi join, as many rows a frame as it has parts or characters, and no size matters.
    """
    if not boundary:
        ends = F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda i: F.substr(F.col("path"), i))
        hit = frames.select("frame_no", F.explode(ends).alias("_x")).join(files.select("file_id", F.col("path").alias("_x")), "_x")
        best = hit.groupBy("frame_no").agg(F.min("file_id").alias("file_id"))
        return frames.join(best, "frame_no", "left")

    def suffixes(c: Column) -> Column:
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    f = frames.select("frame_no", F.explode(suffixes(F.col("path"))).alias("_x"))
    best = f.join(files.select("file_id", F.col("path").alias("_x")), "_x").groupBy("frame_no").agg(F.min("file_id").alias("file_id"))
    return frames.join(best, "frame_no", "left")


def naive_cost(paths: DataFrame, files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """naive_tokens, what reading every file named in paths(path) would cost, each file once: one row, or one for each
    combination of the columns `by` of paths; null if none is a file."""
    keys = by or []
    total = paths.select(*keys, "path").distinct().join(files.select("path", "n_bytes"), "path", "left" if keys else "inner").groupBy(*keys).agg(F.sum("n_bytes").alias("b"))
    return total.select(*keys, F.floor(F.col("b") / F.lit(4.0) + F.lit(0.5)).cast("bigint").alias("naive_tokens"))
