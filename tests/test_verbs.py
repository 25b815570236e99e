"""Verbs over the two small trees; expected values follow from the operators' definitions."""

import pytest

from quarry.plans import incremental, verbs
from quarry.sources.extract import extract


@pytest.fixture(scope="module")
def go(spark, go_tree):
    return incremental.build_index(spark, go_tree)


@pytest.fixture(scope="module")
def java(spark, java_tree):
    return incremental.build_index(spark, java_tree)


def rows(answer):
    return answer[0].collect(), answer[1].first()


def test_go_symbols_and_edges(go):
    got = [(r.sym_id, r.name, r.kind, r.line, r.end_line, r.cx) for r in go.symbols.orderBy("sym_id").collect()]
    assert got == [(0, "Ledger", "struct", 5, 8, 0), (1, "Total", "method", 10, 16, 2), (2, "main", "fn", 18, 21, 1)]
    assert [tuple(r) for r in go.edges.collect()] == [(2, 1, 1.0)]


def test_java_symbols_and_edges(java):
    got = [(r.sym_id, r.name, r.kind, r.line, r.end_line) for r in java.symbols.orderBy("sym_id").collect()]
    assert got == [(0, "Kettle", "cls", 1, 8), (1, "heat", "method", 4, 7), (2, "Kitchen", "cls", 10, 15), (3, "main", "method", 11, 14)]
    assert sorted(tuple(r) for r in java.edges.collect()) == [(3, 0, 1.0), (3, 1, 1.0)]


def test_go_map(go):
    r, s = rows(verbs.ranked_map(go))
    assert [(x.n, x.k) for x in r] == [("Total", 0.4805), ("Ledger", 0.2597), ("main", 0.2597)]
    assert (s.pr_iters, s.converged, s.files, s.symbols, s.edges) == (12, True, 1, 3, 1)
    assert {x.n: x.callees for x in r}["main"] == ["Total"]


def test_java_map(java):
    r, s = rows(verbs.ranked_map(java))
    assert [(x.n, x.k) for x in r] == [("Kettle", 0.2938), ("heat", 0.2938), ("Kitchen", 0.2062), ("main", 0.2062)]
    assert s.pr_iters == 9


def test_grep(go):
    r, s = rows(verbs.grep(go, "Total"))
    assert [(x.l, x["in"], x.callers) for x in r] == [(10, "Total", 1), (20, "main", 0)]
    assert (s.files, s.hits, s.next) == (1, 2, "--at=main.go:10")
    assert [tuple(e) for e in s.enc] == [("Total", 1, 2), ("main", 0, 1)]
    s = rows(verbs.grep(go, "nowhere"))[1]
    assert (s.hits, s.next, s.enc) == (0, None, [])


def test_callers_callees_uses(go):
    r, s = rows(verbs.callers(go, "Total"))
    assert [(x.n, x.line) for x in r] == [("main", 18)] and (s.defs, s["count"], s.hop_untested) == (1, 1, 1)
    r, s = rows(verbs.callees(go, "main.go:main"))
    assert [x.n for x in r] == ["Total"] and s.next == "--expand=main.go:main" and (s.graph_ambiguous, s.graph_unresolved) == (0, 1)
    r, s = rows(verbs.uses(go, "Total"))
    assert [(x.line, x["in"]) for x in r] == [(20, "main")] and (s.defs, s.external, s["count"]) == (1, 0, 1)
    r, s = rows(verbs.uses(go, "Exit"))
    assert len(r) == 1 and s.external == 1


def test_at(go):
    r, s = rows(verbs.at(go, "main.go:12"))
    assert [(x.n, x.l, x.el) for x in r] == [("Total", 10, 16)] and s.sym == "Total"
    assert rows(verbs.at(go, "other.go:10"))[0] == []
    assert rows(verbs.at(go, "main.go:9"))[0] == []


def test_at_chain(java):
    r, _ = rows(verbs.at(java, "Kitchen.java:12"))
    assert [x.n for x in r] == ["main", "Kitchen"]


def test_strict_parity(java):
    assert [x.n for x in rows(verbs.at(java, "Kitchen.java:12", strict_parity=True))[0]] == ["main"]
    assert [x.n for x in rows(verbs.at(java, "None.java:12", strict_parity=True))[0]] == ["main"]


def test_documented_gates(spark):
    src = [(0, "a.yml", 0, b"a:\n  b:\n    c: 1\n", "yaml"), (1, "b.js", 0, b"const low = 1\nconst HIGH = 2\n", "javascript")]
    files = spark.createDataFrame(src, "file_id int, path string, n_bytes bigint, content binary, lang string")
    names = lambda **k: {r.name for r in extract(files, **k)[0].collect()}
    assert names() == {"a", "b", "c", "low", "HIGH"} and names(gates="documented") == {"a", "b", "HIGH"}


def test_impact(go):
    r, s = rows(verbs.impact(go, "Ledger"))
    assert r == [] and (s.reaches, s.depth, s.depth_capped) == (0, 1, 0)
    r, s = rows(verbs.impact(go, "Total"))
    assert [x.n for x in r] == ["main"] and s.reaches == 1
    assert rows(verbs.impact(go, "Total", 0))[1].depth_capped == 1


def test_expand(go):
    r, s = rows(verbs.expand(go, "main.go:main"))
    assert r[0].name == "main" and r[0].body.startswith("func main()") and r[0].sibs == ["Ledger", "Total"] and r[0].inc == ['"os"']
    assert s.mode in ("whole-file", "bundle")
    assert rows(verbs.expand(go, "nothing"))[0] == []


def test_for(go):
    r, s = rows(verbs.for_task(go, "find the ledger total"))
    # ledger: a name, and twice in a body; total: a name, a callee's name, and once in a body.
    assert [x.n for x in r] == ["Total", "main", "Ledger"]
    assert (s.kept, s.confidence, s.name_exact, s.tail_total, s.tail) == (3, "high", False, 0, [])
    assert r[0].sig == "func (l *Ledger) Total() int" and r[2].sig == "type Ledger struct" and [x.next for x in r] == ["--expand=main.go:Total", None, None]


def test_from_trace(go):
    r, s = rows(verbs.from_trace(go, "/src/x/main.go:19\n/src/x/main.go:12\nnot a frame\n/src/other.go:3"))
    assert [x.n for x in r] == ["main", "Total", None]
    assert (s.frames, s.in_corpus, s.unresolved) == (3, 2, 1) and r[0].body.startswith("func main") and r[1].body is None


def test_verb_choice():
    assert verbs.choose_verb({"gain": "", "grep": "x", "callers": "y"}) == "grep"
    assert verbs.choose_verb({"gain": "", "at": "x"}) == "at"
    assert verbs.choose_verb({"gain": ""}) == "gain" and verbs.choose_verb({}) == "map"


def test_index_cache(spark, tmp_path):
    tree, folder = tmp_path / "t", f"file://{tmp_path}/index"
    tree.mkdir()
    (tree / "a.go").write_text("package a\n\nfunc A() {\n}\n")
    (tree / "bin.go").write_bytes(b"x\x00y")
    state = lambda: incremental.open_index(spark, str(tree), folder=folder).state
    assert (state(), state()) == ("rebuilt", "hit")
    (tree / "a.go").touch()
    assert (state(), state()) == ("hit", "hit")
    (tree / "a.go").write_text("package a\n\nfunc B() {\n}\n")
    assert state() == "rebuilt"
    (tree / "b.go").write_text("package a\n\nfunc C() {\n}\n")
    assert state() == "rebuilt"
    (tree / "b.go").unlink()
    opened = incremental.open_index(spark, str(tree), folder=folder)
    assert opened.state == "rebuilt" and [r.name for r in opened.index.symbols.collect()] == ["B"]
    assert incremental.open_index(spark, str(tree), use_saved=False, folder=folder).state == "rebuilt"
    index = incremental.index_path(spark, str(tree), folder).removeprefix("file://")
    for f in (tmp_path / "index").rglob("symbols/*.parquet"):
        f.write_bytes(f.read_bytes()[:20])
    assert index and state() == "rebuilt"


def test_uses_of_many_places_in_one_file(spark):
    """3,000 places in a file with bytes that are no UTF-8: it is read once, not once a place, and lines count bytes."""
    import time

    from quarry.plans.incremental import index_of

    text = b"package a\r\n\r\n// \xff\xfe \xc3\xa9\r\n" + b"".join(b"func S%d() {\n\tMissing()\n\tMissing()\n}\n" % i for i in range(1500))
    files = spark.createDataFrame([(0, "src/a.go", len(text), bytearray(text), "go")], "file_id int, path string, n_bytes bigint, content binary, lang string")
    index, began = index_of(files), time.time()
    got = verbs.uses(index, "Missing")[0].select("line", "in", "path").collect()
    assert sorted((r["line"], r["in"]) for r in got) == sorted((5 + 4 * i + j, f"S{i}") for i in range(1500) for j in (0, 1))
    assert time.time() - began < 60
