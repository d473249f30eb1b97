"""Table functions against the DataFrame forms, and what they refuse when a query is analysed."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions.table_functions import register
from quillstone.operators import chunking, sections
from quillstone.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_lateral_query_equals_the_frames(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = catalog.queries()["lateral_chunks"](spark, DATA)
    want = chunking.chunked(sections.parse_text(docs, "doc_id"), ["doc_id", "section_index", "title"], 1500, 150).select("doc_id", "section_index", "title", "piece", F.md5("content").alias("md5"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(got) == rows(want) and got.count() > 200
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_schema_of_a_table_follows_from_its_columns(spark):
    register(spark)
    spark.createDataFrame([(1, "alpha beta gamma delta", 7), (2, None, 8), (3, "", 9)], "id long, body string, piece int").createOrReplaceTempView("chunk_input")
    got = spark.sql("SELECT * FROM table_chunks(TABLE(chunk_input), 'body', 12, 0)")
    assert got.columns == ["id", "body", "piece", "piece_", "chunk"]
    want = chunking.chunk_text("alpha beta gamma delta", 12, 0)
    assert sorted(map(tuple, got.collect())) == [(1, "alpha beta gamma delta", 7, i, c) for i, c in enumerate(want)]
    marks = spark.sql("SELECT s.* FROM (SELECT '# A\\nx\\n## B\\ny' AS t) v, LATERAL text_sections(v.t, 'markdown') s ORDER BY section_index")
    assert [tuple(r) for r in marks.collect()] == [s for s in sections.markdown_sections("# A\nx\n## B\ny")]
    assert [tuple(r)[:4] for r in spark.sql("SELECT * FROM text_sections(CAST(NULL AS STRING))").collect()] == [s[:4] for s in sections.text_sections("")]


@pytest.mark.parametrize("call", [
    "text_chunks(5)", "text_chunks('x', 'y')", "text_chunks('x', 10, 11)", "text_chunks('x', 0, 0)", "text_sections('x', 'pdf')", "table_chunks(TABLE(chunk_other), 'none', 10, 0)", "table_chunks(TABLE(chunk_other), 'n', 10, 0)",
])
def test_wrong_arguments_are_refused_by_the_analyser(spark, call):
    register(spark)
    spark.range(1).selectExpr("id AS n", "'x' AS t").createOrReplaceTempView("chunk_other")
    with pytest.raises(Exception, match="must"):
        spark.sql(f"SELECT * FROM {call}")
