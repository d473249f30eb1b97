"""Queries against their SQL on tables made for edges that the given tables rarely hold."""

from datetime import datetime

import duckdb

from quillstone.operators import sections
from quillstone.plans import catalog


def both(spark, folder, name, table, rows, schema):
    """A query's rows and those of its SQL over one table, sorted."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    got = catalog.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_days_left_count_whole_seconds_to_the_nearest(spark, tmp_path):
    # purged after 15 days: within the first second after 0, 3 and 7 days
    times = [datetime(2024, 1, d, 0, 0, s, us) for d in (16, 19, 23) for s, us in ((0, 0), (0, 499999), (0, 500000), (0, 500001), (0, 999999), (1, 500000))]
    rows = [(i, t, 1, "error") for i, t in enumerate(times)]
    got, want = both(spark, tmp_path, "trash_status", "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    assert got == want == [("amber", 6), ("green", 3), ("red", 6), ("today", 3)]


def test_sections_of_headings_alone_are_empty(spark, tmp_path):
    rows = [(1, "1. Intro\nCAPITALS\n"), (2, None), (3, ""), (4, "before\nCHAPTER ONE\n"), (5, "CAPITALS\n \ninside"), (6, " \n2.1 Last")]
    got, want = both(spark, tmp_path, "text_sections", "documents", rows, "doc_id long, text string")
    assert got == want == [(1, 0, None, 0, 0), (3, 0, None, 0, 0), (4, 0, None, 0, 6), (5, 0, "CAPITALS", 1, 6), (6, 0, None, 0, 0)]
    # the operator keeps the headings, so that chunks lose nothing
    assert sections.parse_text(spark.createDataFrame(rows[:1], "doc_id long, text string"), "doc_id").first()["content"] == "1. Intro\nCAPITALS"
