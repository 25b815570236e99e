"""Offsets over whole texts: far lines are found, and the query asks for them."""

import __spark_entry__ as entry


def test_line_of_byte_whole(spark, tmp_path):
    texts = [(7, "a\n" * 5_000), (8, "é\n語 x\n" * 3_000), (9, ""), (10, "\n"), (11, "word " * 40_000 + "\nlast"), (12, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.upto, r.line) for r in entry.queries()["line_of_byte_whole"](spark, str(tmp_path)).collect()}
    want = {12: (None, None)}
    for i, text in texts[:-1]:
        raw = text.encode()
        at = i * 7919 % (len(raw) + 1)
        want[i] = at, 1 + raw[:at].count(b"\n")
    assert got == want and max(at or 0 for at, _ in got.values()) > 976 and got[7][1] > 489
