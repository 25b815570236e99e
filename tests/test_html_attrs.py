"""The html query runs the operator: all spellings of an attribute, none in comments."""

import __spark_entry__ as entry


def test_every_spelling(spark, tmp_path):
    pages = [(1, """<a href='b'><A HREF=a><a class="x" Href = "c"><!-- <a href="0"> --><p>href="1"</p>"""), (2, "<p>none</p>"), (3, None), (4, '<a href="é">')]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in entry.queries()["html_attrs"](spark, str(tmp_path)).select("page_id", "n", "first_value").collect()}
    assert got == {(1, 3, "a"), (4, 1, "é")}
