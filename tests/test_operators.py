"""Hand-written cases for what SQL can't express, and for constants and ties."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.operators import components, documents, graph, ingest, retrieval, tables
from corpusloom.streaming import jobs


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("na me,,x\n1,2,3\n,,\n4,5,6\n")
    found = ingest.read_csv_rows(spark, str(tmp_path / "a.csv"), "a")
    assert rows_of(found.select("row_number", F.concat_ws(",", "row_keys").alias("k")), "row_number", "k") == [(2, "name,列2,x"), (4, "name,列2,x")]


def test_text_source_flags_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grün".encode())
    (tmp_path / "b.txt").write_bytes("操作流程".encode("gb18030"))
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbf" + "操作".encode())
    found = ingest.read_text_docs(spark, str(tmp_path)).select(F.substring_index("path", "/", -1).alias("f"), "text", "valid")
    assert rows_of(found, "f", "text", "valid") == [("a.txt", "grün", True), ("b.txt", "操作流程", False), ("c.txt", "操作", True)]


def test_csv_rows_are_numbered_across_tasks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text("\n".join(f"v{k},{j}" for j in range(50)) + "\n")
    rows = ingest.read_csv_rows(spark, str(tmp_path), "a").select("row_number").collect()
    assert sorted(r[0] for r in rows) == list(range(2, 151))


def test_first_rule_that_a_query_meets(spark):
    rules = spark.createDataFrame([(1, "a", "t", ["x"]), (2, None, "t", ["y"]), (3, "b", None, ["z"]), (4, None, None, ["w"])], "priority int, topic string, route string, kinds array<string>")
    queries = spark.createDataFrame([(1, "a", "t"), (2, "c", "t"), (3, "b", "s"), (4, None, None), (5, "b", "t")], "query_id int, topic string, route string")
    assert rows_of(documents.allowed_kinds(queries, rules), "query_id", "kinds") == [(1, ["x"]), (2, ["y"]), (3, ["z"]), (4, ["w"]), (5, ["y"])]


def test_quotes_go_before_contents_and_contexts(spark):
    df = spark.createDataFrame([(1, 1, "a" * 2000, ["q" * 100]), (1, 2, "b" * 2000, ["r" * 100, "s" * 50])], "question_id long, rank long, content string, quotes array<string>")
    fit = lambda tokens: {r["rank"]: (len(r["content"]), len(r["quotes"])) for r in retrieval.token_budget(df, tokens).collect()}
    assert fit(1070) == {1: (2000, 1), 2: (2000, 2)} and fit(1050) == {1: (2000, 1), 2: (2000, 1)}
    assert fit(1025) == {1: (2000, 1), 2: (2000, 0)} and fit(900) == {1: (2000, 1), 2: (1440, 0)} and fit(300) == {1: (900, 1)}


def test_diversity_passes_over_mismatches(spark):
    rows = [(1, 9, 1, 0.9, False, False), (1, 9, 2, 0.8, True, False), (1, 9, 3, 0.3, True, False), (1, 8, 4, 0.2, False, False), (2, 9, 1, 0.9, True, True), (2, 8, 2, 0.5, False, True), (2, 7, 3, 0.4, False, True), (2, 6, 4, 0.3, False, True)]
    df = spark.createDataFrame(rows, "question_id long, doc_id long, rank int, reranked double, mismatch boolean, strict boolean")
    assert rows_of(retrieval.diversify(df, 6), "question_id", "place", "rank") == [(1, 1, 1), (1, 2, 2), (1, 3, 4), (1, 4, 3), (2, 1, 2), (2, 2, 3), (2, 3, 4)]


def test_terms_are_found_inside_words_of_any_length(spark):
    words = spark.createDataFrame([("abcabc",), ("x",), ("xy",), ("abd",)], "word string")
    terms = spark.createDataFrame([("a",), ("bc",), ("cab",), ("xy",), ("zz",), ("abcabcd",)], "term string")
    assert rows_of(retrieval.held_words(terms, words), "term", "word") == [("a", "abcabc"), ("a", "abd"), ("bc", "abcabc"), ("cab", "abcabc"), ("xy", "xy")]


def test_nfkc_normalisation(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ　Ｗ ﬁ",)], "t string")
    assert df.select(retrieval.normalize_text(F.col("t"))).first()[0] == "fullwfi"
    assert df.select(graph.normalize_entity(F.lit("（甲） A-b."))).first()[0] == "甲ab"


def test_cjk_terms(spark):
    df = spark.createDataFrame([("流程abc的办理",)], "t string")
    terms = set(df.select(retrieval.relevance_terms(F.col("t"))).first()[0])
    assert {"abc", "流", "流程", "的办理", "办理"} <= terms and "的" not in terms


def test_row_lines_of_chunks_repeat_headers(spark):
    text = "表头: a|b\n" + "\n".join(f"row {k} " + "x" * 40 for k in range(6))
    found = ingest.chunk_lines(spark.createDataFrame([(1, 1, text)], "doc_id int, page int, text string"), size=120).collect()
    assert len(found) > 1 and all(r["content"].startswith("表头") for r in found)
    assert [x for r in found for x in r["content"].split("\n") if x.startswith("row")] == text.split("\n")[1:]


def test_semantic_ties_take_the_first_column(spark):
    df = spark.createDataFrame([("d", "s", 1, {"city b": "x", "city a": "y"}, ["city b", "city a"])], "document string, sheet string, row_number int, row map<string,string>, row_keys array<string>")
    assert tables.infer_semantics(df, {"city": ["city"]}).first()["raw_name"] == "city b"


def test_filters_fall_back_to_any_value(spark):
    df = spark.createDataFrame([("d", "s", 1, {"a": "Rome", "b": "1"}, ["a", "b"], {"x": "y"})], "document string, sheet string, row_number int, row map<string,string>, row_keys array<string>, semantic map<string,string>")
    q = tables.TableQuery({"city": ["town"]}).where("city", "eq", "Rome")
    strict = tables.TableQuery({"city": ["town"]}, fallback=False).where("city", "eq", "Rome")
    assert q.rows(df).count() == 1 and strict.rows(df).count() == 0


def test_grades(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id int")
    issues = spark.createDataFrame([(1, "a", "critical"), (2, "a", "warning"), (2, "b", "warning"), (3, "a", "info")] + [(4, str(k), "warning") for k in range(3)], "doc_id int, code string, severity string")
    assert rows_of(documents.grade(docs, issues), "doc_id", "score", "grade") == [(1, 65, "blocked"), (2, 70, "needs_review"), (3, 95, "good"), (4, 55, "poor")]


def test_highlight_prefers_the_longest_at_one_start(spark):
    df = spark.createDataFrame([("abcab", ["ab", "abc"])], "content string, terms array<string>")
    assert [(r["start"], r["end"]) for r in retrieval.highlight(df).first()["ranges"]] == [(0, 3), (3, 5)]


def test_token_budget_shortens_then_drops(spark):
    df = spark.createDataFrame([(1, 1, "a" * 3000), (1, 2, "b" * 3000)], "question_id int, rank int, content string")
    found = {r["rank"]: len(r["content"]) for r in retrieval.token_budget(df, 1100).collect()}
    assert found == {1: 3000, 2: 1119}
    sizes = lambda tokens: {r["rank"]: len(r["content"]) for r in retrieval.token_budget(df, tokens).collect()}
    assert sizes(800) == {1: 2160, 2: 900} and sizes(300) == {1: 900} and sizes(100) == {1: 900}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 50), (50, 70)]
    found = components.connected(spark.createDataFrame(edges, "a long, b long"))
    assert dict(rows_of(found, "node", "component")) == {**{k: 1 for k in range(1, 31)}, 50: 50, 70: 50, 100: 50}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def events(spark):
    start = datetime(2024, 1, 1)
    rows, k = [], 0
    for user, steps in {1: [0, 10, 20, 30, 40, 50, 1000], 2: [0, 10, 20, 30, 400], 3: [0, 10, 20, 25, 30, 40]}.items():
        for n, s in enumerate(steps):
            k += 1
            rows.append((user, k, start + timedelta(seconds=s), not (user == 3 and n == 3)))
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, failed boolean")


def streamed(spark, df, tmp_path, job, name):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    return spark.table(name)


def test_lockouts_stream_equals_batch(spark, tmp_path):
    batch = rows_of(jobs.lockouts_batch(events(spark)), "user_id", "event_id")
    assert batch == [(1, 5)]
    assert rows_of(streamed(spark, events(spark), tmp_path, jobs.lockouts, "locks"), "user_id", "event_id") == batch


def test_paired_turns_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (1, 2, "assistant"), (2, 0, "assistant")], "session_id long, turn long, role string")
    batch = {tuple(r) for r in jobs.pair_turns_batch(df).collect()}
    assert batch == {(1, 1, 0), (1, 2, 0), (2, 0, None)}
    assert {tuple(r) for r in streamed(spark, df, tmp_path, jobs.pair_turns, "pairs").collect()} == batch


def test_task_stream_drops_repeats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (2, "a", datetime(2024, 1, 1)), (3, "b", datetime(2024, 1, 1))], "task_id long, kind string, created_at timestamp")
    found = streamed(spark, df, tmp_path, lambda s: jobs.dedupe_tasks(s, ["kind"], "created_at", "1 hour"), "tasks")
    assert sorted(r["kind"] for r in found.collect()) == ["a", "b"]


def test_rolling_counts_stream_equals_batch(spark, tmp_path):
    df = events(spark)
    batch = {tuple(r) for r in jobs.rolling_counts(df, "ts", "user_id", "1 minute").collect()}
    found = {tuple(r) for r in streamed(spark, df, tmp_path, lambda s: jobs.rolling_counts(s, "ts", "user_id", "1 minute", delay="10 seconds"), "rolling").collect()}
    assert found and found <= batch


def test_ingestion_stream_restarts_without_repeats(spark, tmp_path):
    source, chunks, check = (str(tmp_path / x) for x in ("in", "chunks", "check"))
    schema = "doc_id long, text string"
    for k in range(2):
        spark.createDataFrame([(k, "word " * 500)], schema).write.mode("append").parquet(source)
        jobs.ingest_stream(spark, source, schema, chunks, check).awaitTermination()
    assert rows_of(spark.read.parquet(chunks).groupBy("doc_id").count(), "doc_id", "count") == [(0, 3), (1, 3)]


def test_write_by_document_replaces_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.write_by_document(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string"), path, "doc_id")
    ingest.write_by_document(spark.createDataFrame([(2, "c")], "doc_id int, v string"), path, "doc_id")
    assert rows_of(spark.read.parquet(path), "doc_id", "v") == [(1, "a"), (2, "c")]
