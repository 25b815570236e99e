"""Rendering, the ledger, the command line's parser and streams."""

import json
import xml.etree.ElementTree as ET

import pytest

from quarry.plans import cli, incremental, ledger, render, verbs
from quarry.streaming import ledger as streams


@pytest.fixture(scope="module")
def go(spark, go_tree):
    return incremental.build_index(spark, go_tree)


def test_documents_are_xml_and_priced(go):
    for flags in ({}, {"grep": "Total"}, {"callers": "Total"}, {"uses": "Total"}, {"at": "main.go:12"}, {"expand": "main.go:main"}, {"impact": "Total"}, {"for": "ledger <total>"},
                  {"from-trace": "/x/main.go:14"}):
        verb, answer = verbs.run_verb(go, flags)
        doc = render.render(verb, go, answer, "root & co")
        tree = ET.fromstring(doc[doc.index("-->") + 3:])
        est = int(tree.get("est_tokens"))
        rate = render.FLAT_RATE if verb not in ("map", "for", "from-trace") else render.COMPOSED_RATE
        assert abs(est - len(doc.encode()) / rate) < (12 if verb != "map" else 60), (verb, est, len(doc))
        assert doc == render.render(verb, go, answer, "root & co")


def test_settle():
    est, doc = render.settle(lambda n: "x" * 95 + str(n), 1.0)
    assert est == len(doc) == 97
    assert render.cdata("a]]>b").count("]]>") == 2
    full, compact = render.LEGENDS["grep"]
    assert render.pick_legend("grep", "x") == compact and render.pick_legend("grep", "x" * 500) == full


def test_ledger(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    assert "nothing has been logged" in ledger.report(spark, path)
    ledger.log_run(spark, path, "a,b", "map", 100, 10, 1000, rate=1000.0)
    ledger.log_run(spark, path, "c", "grep", 50, 5, None)
    with open(f"{path}/extra.json", "w") as f:
        f.write("\nnot json\n{}\n")
    rows, summary = ledger.gain(spark, path)
    s = summary.first()
    assert (s.runs, s.spent_tokens, s.naive_tokens, s.naive_ms, s.unmodelled) == (2, 150, 1000, 1000, 1)
    assert (s.saved_tokens, s.saved_tokens_pct, s.saved_ms_pct) == (850, 85, 98)
    assert {(r.level, r["name"], r.runs) for r in rows.collect()} == {("repo", "a,b", 1), ("repo", "c", 1), ("verb", "map", 1), ("verb", "grep", 1)}
    assert ledger.report(spark, path) == ledger.report(spark, path)


def test_parser():
    assert cli.parse(["--grep=a=b", "--depth=2", "x", "y"]) == ({"grep": "a=b", "depth": "2"}, "y")
    assert cli.parse(["gain"])[0] == {"gain": ""} and cli.main(["x", "--help"]) == cli.HELP


def test_command_line(spark, go_tree, tmp_path):
    doc = cli.main(["--callers=Total", f"--gain-log={tmp_path}/log", "--no-cache", go_tree])
    assert 'n="main"' in doc and "Tokens" in cli.main(["gain", f"--gain-log={tmp_path}/log"])


def test_ledger_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"ts": t, "repo": "r", "verb": v, "spent_tokens": 5, "spent_ms": 1, "model": "none"} for t, v in ((0, "map"), (1800, "map"), (3700, "grep"))]
    (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = (streams.ledger_windows(streams.read_ledger_stream(spark, str(folder))).writeStream.format("memory").queryName("windows").outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination(60)
    got = {(r.start.timestamp() % 86400, r.verb, r.runs, r.spent_tokens) for r in spark.table("windows").collect()}
    assert {x[1:] for x in got} == {("map", 2, 10), ("grep", 1, 5)}


def test_index_stream(spark, tmp_path):
    root, out = tmp_path / "src", str(tmp_path / "out")
    (root / "node_modules").mkdir(parents=True)
    (root / "a.go").write_text("package a\n\nfunc A() {\n\tB()\n}\n")
    (root / "node_modules" / "n.go").write_text("package n\n\nfunc N() {\n}\n")
    (root / "x.txt").write_text("func no()")
    run = lambda: streams.index_stream(spark, str(root), out, str(tmp_path / "cp")).awaitTermination(90)
    got = lambda: {(r["path"], r["name"], r.is_def) for r in streams.latest(spark, out).collect()}
    run()
    (root / "b.go").write_text("package a\n\nfunc B() {\n}\n")
    run()
    assert got() == {("a.go", "A", True), ("a.go", "B", False), ("b.go", "B", True)}
    assert streams.index_changes(spark, str(root), out) == 0
    (root / "a.go").write_text("package a\n\nvar x = 1\n// nothing but a variable\n")
    (root / "b.go").unlink()
    assert streams.index_changes(spark, str(root), out) == 2 and got() == {("a.go", "x", True)}
    (root / "a.go").write_text("package a\n")
    (root / "b.go").write_text("package a\n\nfunc C() {\n}\n")
    assert streams.index_changes(spark, str(root), out) == 2 and got() == {("b.go", "C", True)}
