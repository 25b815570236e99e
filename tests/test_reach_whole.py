"""Reach without a depth against brute force: parts that reach others over many steps are counted."""

import random

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Successor pairs by order: a chain of 12 parts, a cycle, and a sparse random part; 150 parts of two brands."""
    rng, folder = random.Random(4), tmp_path_factory.mktemp("parts")
    pairs = [(i + 1, i) for i in range(1, 12)] + [(20, 21), (21, 22), (22, 20), (23, 20)] + [(rng.randrange(30, 150), rng.randrange(30, 150)) for _ in range(150)]
    items = [(order, at, part) for order, pair in enumerate(pairs) for at, part in enumerate(pair, 1)]
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{folder}/lineitem.parquet")
    brand = {i: "Brand#11" if i < 120 else "Brand#12" for i in range(150)}
    spark.createDataFrame(list(brand.items()), "p_partkey bigint, p_brand string").write.parquet(f"{folder}/part.parquet")
    return str(folder), {p for p in pairs if p[0] != p[1]}, [i for i, b in brand.items() if b == "Brand#11"]


def reaching(pairs, at):
    found, left, level = {}, {at}, 0
    while left:
        level += 1
        left = {a for a, b in pairs if b in left} - set(found)
        found |= dict.fromkeys(left, level)
    return found


def test_amp_whole(spark, parts):
    folder, pairs, origins = parts
    got = {r.part: r.amp for r in entry.queries()["amp_whole"](spark, folder).collect()}
    assert got == {o: len(reaching(pairs, o)) for o in origins}
    assert got[1] == 11 and got[20] == 4 and got[0] == 0
    # The bounded query counts less on the same table.
    assert {r.part: r.amp for r in entry.queries()["amp_depth2"](spark, folder).collect()}[1] == 2


def test_impact_whole(spark, parts):
    folder, pairs, _ = parts
    got = {r.part: r.level for r in entry.queries()["impact_whole"](spark, folder).collect()}
    assert got == {v: n for v, n in reaching(pairs, 1).items() if v != 1} and max(got.values()) == 11


def test_cycles_are_merged_and_chunks_go_in_turns(spark, monkeypatch):
    """Two cycles of 100 in a row with a tail: no edge within a cycle is left, and any turn size counts alike."""
    from quarry.operators import graph

    ring = lambda a: [(a + i, a + (i + 1) % 100) for i in range(100)] + [(a + i, a + (i * 7 + 3) % 100) for i in range(100)]
    pairs = {p for p in ring(0) + ring(100) if p[0] != p[1]} | {(50, 150), (199, 200)} | {(200, i) for i in range(201, 281)}
    edges = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    left, groups = graph.merge_cycles(edges)
    where = {r.sym_id: r.group for r in groups.collect()}
    assert len(where) == 200 and len({where[i] for i in range(100)}) == len({where[i] for i in range(100, 200)}) == 1
    assert left.count() == 82
    monkeypatch.setattr(graph, "ROWS_A_TURN", 1)
    origins = spark.createDataFrame([(i,) for i in range(282)], "sym_id bigint")
    got = {r.origin: r.amp for r in graph.reach_sizes(edges, origins).collect()}
    assert got == {o: len(reaching(pairs, o)) for o in range(282)} and got[5] == 100 and got[150] == 200 and got[280] == 201 and got[281] == 0
