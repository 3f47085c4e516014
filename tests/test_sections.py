"""Sections of pages whose texts are missing, blank or begin with spaces of other scripts, against the SQL in DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from corpusloom import registry
from corpusloom.operators import ingest

registry.load()
ODD = [None, "", " \n\n ", "　wide \nnext", "\u000bupright tab\nnext", " plain ", " ", "\r\nreturn\r\nnext"]


def test_titles_and_parents_equal_the_sql(spark, tmp_path):
    ids = [*range(-300, 600)]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([ODD[(i // 3) % len(ODD)] for i in ids], pa.string())}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    answer = con.sql(registry.ORACLES["a18_page_sections"])
    found = registry.QUERIES["a18_page_sections"](spark, str(tmp_path)).select(*answer.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(answer.fetchall(), key=str)


def test_pages_without_a_line_are_named_by_number(spark):
    pages = spark.createDataFrame([(1, 1, None), (1, 2, "　"), (1, 3, "a\nb")], "doc_id int, page int, text string")
    assert sorted((r["start"], r["title"]) for r in ingest.page_sections(pages).collect()) == [(1, "page 1"), (2, "page 2"), (3, "a")]
