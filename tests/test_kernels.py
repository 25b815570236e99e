"""Relations, graph loops and the adaptive cut on small made-up inputs."""

import random

import pytest

from quarry.operators import graph, lexical, ordering, relations
from quarry.sources import crawl


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, *rest in rows for w in (rest or [1.0])], "src int, dst int, weight float")


def nodes_of(spark, n):
    return spark.range(n).selectExpr("cast(id as int) as sym_id")


def plain_rank(n, edges, rounds=100):
    out = {}
    for a, _, w in edges:
        out[a] = out.get(a, 0) + w
    k = [1 / n] * n
    for i in range(1, rounds + 1):
        dang = sum(k[v] for v in range(n) if v not in out)
        nxt = [(0.85 * dang + 0.15) / n] * n
        for a, b, w in edges:
            nxt[b] += 0.85 * k[a] * w / out[a]
        d = sum(abs(x - y) for x, y in zip(k, nxt, strict=True))
        k = nxt
        if d < 1e-6:
            return k, i, True
    return k, rounds, False


@pytest.mark.parametrize("edges", [[], [(0, 1, 1.0), (1, 0, 2.0), (2, 0, 1.0)], [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 0.5), (3, 1, 2.0), (0, 3, 8.0)]])
def test_rank(spark, edges):
    run = graph.pagerank(nodes_of(spark, 5), edges_of(spark, edges))
    want, n, ok = plain_rank(5, edges)
    got = {r.sym_id: r.k for r in run.ranks.collect()}
    assert (run.iterations, run.converged) == (n, ok) and all(abs(got[v] - want[v]) < 1e-9 for v in range(5))


def test_rank_of_nothing(spark):
    run = graph.pagerank(nodes_of(spark, 0), edges_of(spark, []))
    assert (run.ranks.count(), run.iterations, run.converged) == (0, 0, True)


def test_reach_and_amp(spark):
    e = edges_of(spark, [(1, 0), (2, 1), (3, 2), (0, 3), (4, 2), (5, 5)])
    start = nodes_of(spark, 1)
    rows, depth, capped = graph.reach(e, start)
    assert {(r.sym_id, r.level) for r in rows.collect()} == {(1, 1), (2, 2), (3, 3), (4, 3)} and not capped and depth == 4
    rows, depth, capped = graph.reach(e, start, 2)
    assert {r.sym_id for r in rows.collect()} == {1, 2} and depth == 2 and capped
    assert graph.reach(e, start, 0)[0].count() == 0 and graph.reach(e, start, 0)[2]
    amp = {r.origin: r.amp for r in graph.reach_sizes(e, nodes_of(spark, 6)).collect()}
    assert amp == {0: 5, 1: 5, 2: 5, 3: 5, 4: 0, 5: 1}


def test_candidate_tiers(spark):
    symbols = spark.createDataFrame([
        (0, "f", "a/x.go"), (1, "f", "a/x.go"), (2, "f", "b/x.go"), (3, "g", "b/x.go"), (4, "g", "c/x.go"), (5, "h", "q/z.go"), (6, "i", "q/z.go"), (7, "i", "r/w.go"),
        (8, "j", "a/y.go")], "sym_id int, name string, path string")
    refs = spark.createDataFrame([(i, n, "a/x.go") for i, n in enumerate("fghijk")], "ref_id bigint, name string, path string")
    got = {(r.ref_id, r.sym_id, r.tier, r.k) for r in relations.candidates(refs, symbols).collect()}
    assert got == {(0, 0, 1, 2), (0, 1, 1, 2), (1, 3, 2, 2), (1, 4, 2, 2), (2, 5, 3, 1), (4, 8, 3, 1)}
    by_dir = {(r.ref_id, r.sym_id, r.tier) for r in relations.candidates(refs, symbols, tier2="dir").collect()}
    assert (4, 8, 2) in by_dir and not any(r == 1 for r, *_ in by_dir)


def test_edge_weights(spark):
    calls = spark.createDataFrame([(1, 2, 0.5), (1, 2, 1.0), (1, 1, 1.0), (3, 2, 1.0)] + [(4, 2, 1.0)] * 100, "src int, dst int, conf float")
    got = {(r.src, r.dst): r.weight for r in relations.weighted_edges(calls).collect()}
    assert got.keys() == {(1, 2), (3, 2), (4, 2)} and abs(got[1, 2] - 0.75 * 2**0.5) < 1e-6 and got[4, 2] == 8.0


def test_enclosing(spark):
    rng = random.Random(0)
    spans = [(i, rng.randrange(3), s, s + rng.randrange(30)) for i, s in enumerate(rng.choices(range(100), k=80))]
    points = [(i, rng.randrange(4), rng.randrange(120)) for i in range(200)]
    s = spark.createDataFrame(spans, "sid int, grp int, s int, e int")
    p = spark.createDataFrame(points, "pid int, grp int, at int")
    want = {}
    for i, g, a in points:
        hits = [(st, sid) for sid, sg, st, e in spans if sg == g and st <= a <= e]
        want[i] = max(hits)[1] if hits else None
    plain = relations.enclosing(p, s, "pid", "grp", ("at", "at"), ("s", "e"), "sid").collect()
    bucketed = relations.enclosing(p, s, "pid", "grp", ("at", "at"), ("s", "e"), "sid", crowded=0).collect()
    assert {r.pid: r.enclosing for r in plain} == want == {r.pid: r.enclosing for r in bucketed}


def plain_cut(scores):
    pos = sorted((s for s in scores if s > 0), reverse=True)
    n = len(pos)
    if not n:
        return 0, 5, True, 0, "low"
    ceil = max(min(40, n), min(5, n))
    best, cut, cut_drop = 0.0, 0, 0.0
    for i in range(1, n):
        d = (pos[i - 1] - pos[i]) / pos[i - 1]
        best = max(best, d)
        if i < ceil and d > cut_drop:
            cut, cut_drop = i, d
    if cut_drop >= 0.2:
        return n, max(cut, min(5, ceil)), False, int(cut_drop * 100 + 0.5), "high"
    return n, ceil, True, int(best * 100 + 0.5) if best >= 0.2 else 0, "high" if n <= ceil else "low"


@pytest.mark.parametrize("scores", [[], [0.0, -1.0], [3.0], [9.0, 5.0, 4.9, 4.8, 4.7, 4.6, 4.5], [10 - 0.1 * i for i in range(60)], [10 - 0.1 * i for i in range(50)] + [1.0] * 3,
                                    [8.0] * 7 + [4.0] * 7 + [2.0] * 7])
def test_cut(spark, scores):
    df = spark.createDataFrame(list(enumerate(scores)), "sym_id int, score double")
    r = lexical.cut_summary(df).first()
    assert (r.positives, r.kept, r.hit_ceiling, r.margin_pct, r.confidence) == plain_cut(scores)


def test_router(spark):
    names = spark.createDataFrame([("Dist",), ("main",)], "name string")
    queries = spark.createDataFrame([(q,) for q in ("dist", "the DIST of main", "fooBar now", "fooBar now please", "", "find the point distance")], "query string")
    got = {r["query"]: (r.name_exact, r.reason, r.named) for r in lexical.route(names, queries).collect()}
    assert got["dist"] == (True, "name-exact", "dist") and got["the DIST of main"] == (True, "name-exact", "DIST")
    assert got["fooBar now"] == (True, "name-exact", "fooBar") and got["fooBar now please"] == (False, "conceptual", None)
    assert got[""] == (False, "broad", None) and got["find the point distance"][1] == "conceptual"


def test_lines(spark):
    texts = [(1, b"a\r\nb\n\nc"), (2, b""), (3, b"x\n"), (4, "é\nz".encode())]
    df = spark.createDataFrame(texts, "file_id int, content binary")
    got = [tuple(r) for r in crawl.lines(df).orderBy("file_id", "line").collect()]
    assert got == [(1, 1, 0, "a"), (1, 2, 3, "b"), (1, 3, 5, ""), (1, 4, 6, "c"), (3, 1, 0, "x"), (4, 1, 0, "é"), (4, 2, 3, "z")]


def test_frames(spark):
    text = "a.go:3\n  b/c.go:+7  \r\nbad line:3\nx:\nq:99999999999\nc:d.go:4\n"
    got = [(r.frame_no, r.path, r.line) for r in crawl.parse_frames(spark.createDataFrame([(text,)], "value string")).orderBy("frame_no").collect()]
    assert got == [(0, "a.go", 3), (1, "b/c.go", 7), (5, "c:d.go", 4)]


def test_suffix_join(spark):
    files = spark.createDataFrame([(0, "b/main.go"), (1, "main.go"), (2, "c.go")], "file_id int, path string")
    frames = spark.createDataFrame([(0, "/x/b/main.go"), (1, "main.go"), (2, "/x/abc.go"), (3, "/y/c.go")], "frame_no int, path string")
    assert {r.frame_no: r.file_id for r in relations.suffix_join(frames, files).collect()} == {0: 0, 1: 1, 2: None, 3: 2}
    assert {r.frame_no: r.file_id for r in relations.suffix_join(frames, files, boundary=False).collect()} == {0: 0, 1: 1, 2: 2, 3: 2}


def test_dedup_definitions(spark):
    cols = "file_id int, line int, name string, kind string, seq bigint, end_line int, start_byte bigint, end_byte bigint, cx int, body_start bigint, body_end bigint"
    rows = [(0, 1, "a", "cls", 0, 9, 0, 10, 0, 0, 10), (0, 1, "a", "struct", 1, 5, 2, 8, 3, 4, 8), (0, 1, "a", "iface", 2, 6, 3, 7, 1, 1, 1), (0, 2, "a", "var", 3, 2, 9, 9, 0, 0, 0)]
    got = {(r.line, r.kind, r.end_line, r.start_byte, r.cx) for r in relations.dedup_definitions(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(1, "struct", 9, 2, 0), (2, "var", 2, 9, 0)}


def test_places_without_one_sort(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SPAN", 3)
    rng = random.Random(1)
    rows = [(i, rng.randrange(20)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v int")
    placed = ordering.number_rows(df, ["v", "id"], "at")
    want = {i: at for at, (_, i) in enumerate(sorted((v, i) for i, v in rows))}
    assert {r.id: r.at for r in placed.collect()} == want
    order = [v for _, v in sorted((at, v) for (i, v), at in zip(rows, [want[i] for i, _ in rows], strict=True))]
    got = sorted((r.at, r.before) for r in ordering.with_previous(placed, "at", "v", "before").collect())
    assert got == [(i, order[i - 1] if i else None) for i in range(200)]
    assert ordering.number_rows(df.where("false"), ["v", "id"], "at").collect() == []
