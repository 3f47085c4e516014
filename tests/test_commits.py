"""Tables that change together: crashes, reruns, replaced documents, compaction, and ingestion in batches."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.operators.commits import Tables
from corpusloom.streaming import jobs


def frame(spark, rows, names="doc_id long, x string"):
    return spark.createDataFrame(rows, names)


def seen(tables, name):
    df = tables.read(name)
    return None if df is None else sorted((tuple(r) for r in df.collect()), key=str)


def test_a_batch_that_fails_between_two_tables_leaves_nothing(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    assert tables.commit("one", {"a": frame(spark, [(1, "p"), (2, "q"), (None, "r")]), "b": frame(spark, [(1, "s")])}, frame(spark, [(1, ""), (2, "")]))
    broken = frame(spark, [(1, "bad")]).withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        tables.commit("two", {"a": frame(spark, [(1, "new")]), "b": broken}, frame(spark, [(1, "")]))
    assert seen(tables, "a") == [(1, "p"), (2, "q"), (None, "r")] and seen(tables, "b") == [(1, "s")]
    assert tables.commit("two", {"a": frame(spark, [(1, "new")])}, frame(spark, [(1, "")]))
    assert not tables.commit("two", {"a": frame(spark, [(1, "newer")])}, frame(spark, [(1, "")]))
    # a batch that replaces a document takes its rows out of the tables that it gives nothing for, too
    assert seen(tables, "a") == [(1, "new"), (2, "q"), (None, "r")] and seen(tables, "b") == []
    assert seen(tables, "c") is None
    before = seen(tables, "a")
    tables.compact()
    assert seen(tables, "a") == before and not tables.commit("one", {"a": frame(spark, [(9, "z")])})
    assert tables.commit("three", {"a": frame(spark, [(2, "last"), (2, "last")])}, frame(spark, [(2, "")]))
    assert seen(tables, "a") == [(1, "new"), (2, "last"), (2, "last"), (None, "r")]


def test_the_later_of_two_writers_of_a_version_fails(spark, tmp_path):
    first, second = Tables(spark, str(tmp_path / "t")), Tables(spark, str(tmp_path / "t"))
    second.manifest = lambda: {"version": 0, "batches": []}
    first.commit("a", {"t": frame(spark, [(1, "a")])})
    with pytest.raises(RuntimeError):
        second.commit("b", {"t": frame(spark, [(2, "b")])})
    assert seen(first, "t") == [(1, "a")]


def test_graphs_of_documents_are_replaced_whole(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame([(d, 0, "s", "unit", t, "rule", k, "e", 0.9, "auto") for d, t, k in x], "doc_id long, chunk_index long, src string, src_type string, dst string, dst_type string, type string, evidence string, confidence double, status string")
    graph.replace_graph(tables, "1", rows((1, "a", "k"), (1, "b", "k"), (2, "c", "k")), frame(spark, [(1, ""), (2, ""), (3, "")]))
    assert not graph.replace_graph(tables, "1", rows((1, "z", "k")), frame(spark, [(1, "")]))
    graph.replace_graph(tables, "2", rows((1, "z", "m")), frame(spark, [(1, ""), (2, ""), (2, "")]))
    assert sorted((r["doc_id"], r["dst"]) for r in tables.read("relations").collect()) == [(1, "z")]
    assert tables.read("entities").count() == 2
    assert sorted((r["doc_id"], r["relations"], r["status"]) for r in tables.read("status").collect()) == [(1, 1, "ready"), (2, 0, "empty"), (3, 0, "empty")]


def test_ingestion_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema, kinds = "doc_id long, title string, text string", [("fees", ["fee"])]
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
    run = lambda: jobs.ingest_all(spark, source, schema, target, check, kinds).awaitTermination()
    put([(1, "t", "word " * 500), (2, "fee", "")])
    run()
    tables = Tables(spark, target)
    counts = lambda name: {r["doc_id"]: r["count"] for r in tables.read(name).groupBy("doc_id").count().collect()}
    assert counts("chunks") == {1: 3} and counts("kinds") == {1: 1, 2: 1}
    assert {r["doc_id"]: r["status"] for r in tables.read("status").collect()} == {1: "done", 2: "failed"}
    real, calls = jobs.ingest_documents, []

    def fails(docs, kinds, least=1):
        found = real(docs, kinds, least)
        calls.append(1)
        return found | {"status": found["status"].withColumn("status", F.raise_error(F.lit("lost")).cast("string"))} if len(calls) < many else found

    monkeypatch.setattr(jobs, "ingest_documents", fails)
    # a failure after chunks and rows are written, then a success
    many = 2
    put([(1, "t", "word " * 10), (3, "t", "word " * 10)])
    run()
    assert counts("chunks") == {1: 1, 3: 1} and len(calls) == 2
    # failures only: the batch's documents have a status and nothing else
    many, calls[:] = 99, []
    put([(3, "t", "word " * 500), (4, "t", "word " * 500)])
    run()
    assert len(calls) == 3 and counts("chunks") == {1: 1}
    assert {r["doc_id"]: r["status"] for r in tables.read("status").collect()} == {1: "done", 2: "failed", 3: "failed", 4: "failed"}
