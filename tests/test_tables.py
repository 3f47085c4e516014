"""Table queries, bonuses, first values and section trees against plain Python."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ingest, tables

# sections --------------------------------------------------------------------------------------------------------------


def outline(n, seed):
    r = random.Random(seed)
    return "\n".join(f"{'#' * r.randint(1, 7)} t{k}" if r.random() < 0.6 else f"text {k}" for k in range(n))


def brute_sections(text):
    lines = text.split("\n")
    heads = [(k, len(x) - len(x.lstrip("#")), x.lstrip("#").strip()) for k, x in enumerate(lines) if x.startswith("#") and not x.startswith("#######")]
    out, stack = [], []
    for line, level, title in heads:
        end = next((k - 1 for k, n, _ in heads if k > line and n <= level), len(lines) - 1)
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        out.append((line, level, title, end, " / ".join(t for _, t in stack)))
    return out


def test_sections_and_paths_equal_a_stack(spark):
    docs = [(k, outline(k * 7 % 40, k)) for k in range(30)] + [(None, outline(12, 99)), (100, None), (101, "")]
    found = ingest.heading_sections(spark.createDataFrame(docs, "doc_id long, text string"))
    paths = sorted((str(r["doc_id"]), r["line"], r["path"]) for r in ingest.section_paths(found).collect())
    want = [(str(d), *x) for d, t in docs if t for x in brute_sections(t)]
    assert sorted((str(r["doc_id"]), r["line"], r["level"], r["title"], r["end"]) for r in found.collect()) == sorted(w[:5] for w in want)
    assert paths == sorted((w[0], w[1], w[5]) for w in want)


def test_a_document_of_many_headings_takes_linear_time(spark):
    docs = spark.createDataFrame([(1, outline(170_000, 3))], "doc_id long, text string")
    began = time.time()
    found = ingest.heading_sections(docs)
    assert ingest.section_paths(found).count() == found.count() > 80_000
    assert time.time() - began < 60


# first values ----------------------------------------------------------------------------------------------------------


def test_samples_are_the_first_different_values_of_all_tasks(spark):
    r = random.Random(1)
    rows = [(f"d{k % 3}", r.choice(["s1", "s2", None]), k if k % 5 else None, f"v{r.randint(0, 30)}" if k % 7 else "") for k in range(600)]
    df = spark.createDataFrame(rows, "document string, sheet string, row_number long, v string").select("document", "sheet", "row_number", F.array(F.lit("c"), F.lit("e")).alias("row_keys"), F.create_map(F.lit("c"), "v", F.lit("e"), F.lit("")).alias("row"))
    want = {}
    for d, sheet, n, v in rows:
        if v:
            at = ((sheet is not None, sheet or ""), (n is not None, n or 0))
            want.setdefault(d, {})[v] = min(at, want.get(d, {}).get(v, at))
    got = {(x["document"], x["raw_name"]): x["samples"] for x in tables.column_samples(df.repartition(7), 4).collect()}
    assert got == {(d, "c"): [v for v, _ in sorted(x.items(), key=lambda y: (y[1], y[0]))[:4]] for d, x in want.items()} | {(d, "e"): [] for d in want}
    few = tables.first_values(df.repartition(7).select("document", "sheet", "row_number", F.element_at("row", "c").alias("value")).where("value <> ''"), ["document"], ["sheet", "row_number"], "value", 4)
    assert few.count() <= 7 * 3 * 4
    assert tables.column_samples(df.where("false")).count() == 0


# bonuses and table queries ---------------------------------------------------------------------------------------------

BONUSES = [tables.Bonus(("a",), ("x", "y"), 0.6), tables.Bonus(("a", "b"), ("x", "y"), 0.45, every=True), tables.Bonus(("b",), ("x", "y", "z"), 0.15, each=True, most=0.4)]


def test_bonuses_are_alike_for_columns_and_sets(spark):
    subsets = lambda names: [list(x) for n in range(len(names) + 1) for x in itertools.combinations(names, n)]
    rows = [(a, f) for a in subsets("abc") for f in subsets("xyz")]
    df = spark.createDataFrame(rows, "asks array<string>, fields array<string>")
    found = df.select("asks", "fields", tables.topic_bonus(F.col("asks"), F.col("fields"), BONUSES).alias("p")).collect()
    for r in found:
        asks, fields = {*r["asks"]}, {*r["fields"]}
        want = 0.6 * bool("a" in asks and fields & {"x", "y"}) + 0.45 * bool(asks & {"a", "b"} and fields >= {"x", "y"}) + ("b" in asks) * min(0.4, 0.15 * len(fields))
        assert r["p"] == pytest.approx(want) == pytest.approx(sum(tables._points(b, asks, fields) for b in BONUSES))


def test_header_rows_come_last_and_titles_name_months(spark):
    q = spark.createDataFrame([(1, ["Rome"], None, ["fee"], []), (2, [], "202504", [], [])], "question_id long, places array<string>, month string, tokens array<string>, asks array<string>")
    ranked = spark.createDataFrame([(1, "d", 0, "Fees of 2025-03"), (2, "d", 0, "Fees")], "question_id long, document string, doc_rank int, title string")
    rows = spark.createDataFrame([("d", "202503", 1, {"city": "Rome"}, ["city"], False), ("d", "202504", 2, {"city": "Oslo"}, ["city"], None), ("d", "202503", 3, {"city": "Rome"}, ["city"], True)], "document string, sheet string, row_number long, row map<string,string>, row_keys array<string>, is_header boolean").withColumn("fields", F.col("row_keys"))
    got = {(r["question_id"], r["row_number"]): r["score"] for r in tables.rank_rows(q, ranked, rows, []).collect()}
    assert got == {(1, 1): 1.53, (1, 2): 0.58, (1, 3): -1.0, (2, 1): -0.85, (2, 2): 8.4, (2, 3): -1.0}


def test_soft_steps_are_passed_over_and_counted(spark):
    rows = spark.createDataFrame([("d", k, k % 2 == 0, k % 3 == 0, k > 90, f"v{k % 4}" if k % 5 else "") for k in range(30)] + [("e", 99, True, True, True, None)], "document string, k int, even boolean, third boolean, big boolean, v string")
    q = spark.createDataFrame([(1, True), (2, False), (3, None)], "question_id long, wants boolean")
    ranked = spark.createDataFrame([(1, "d"), (1, "d"), (2, "d"), (2, "e")], "question_id long, document string")
    steps = [tables.Step("even", F.col("even")), tables.Step("big", F.col("big"), F.col("wants"), soft=True), tables.Step("third", F.col("third"), F.col("wants"))]
    left, counters = tables.table_query(q, ranked, rows, steps, F.col("v"))
    got = {r["question_id"]: tuple(r)[1:] for r in counters.select("question_id", "documents", "rows", "even", "big", "third", "matched", "different").collect()}
    sixth = [k for k in range(0, 30, 6)]
    assert got == {1: (1, 30, 15, 0, 5, 5, len({k % 4 for k in sixth if k % 5})), 2: (2, 31, 16, 0, 0, 16, 2), 3: (0, 0, 0, 0, 0, 0, 0)}
    assert sorted(r["k"] for r in left.where("question_id = 1").collect()) == sixth


def test_the_rows_of_one_document_are_dealt_out(spark):
    rows = spark.range(2000).selectExpr("'d' as document", "cast(id % 4 as string) as sheet", "id as row_number", "map('a', cast(id % 3 as string)) as row", "array('a') as row_keys")
    known = spark.createDataFrame([("d", "city", "a")], "document string, semantic string, raw_name string")
    tasks = lambda df: df.groupBy(F.spark_partition_id()).count().count()
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        typed = tables.with_semantics(rows, known)
        assert tasks(typed) > 1
        assert typed.where("semantic['city'] = 'a'").count() == 2000
        assert tasks(tables.dealt_join(rows.drop("row"), known)) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_periods_are_sheets_and_their_first_rows_count(spark):
    rows = spark.createDataFrame([("d", "k", "1", 1, {"a": "x"}, ["a"]), ("d", "k", "1", 2, {"a": "y"}, ["a"]), ("d", "k", "2", 3, {"a": " x ", "b": "1"}, ["a", "b", "b"]), ("d", "k", None, 4, {"b": "2"}, ["b"]), ("d", "one", "1", 5, {"a": "z"}, ["a"])], "document string, key string, sheet string, row_number long, row map<string,string>, row_keys array<string>")
    got = {(r["key"], r["field"]): (r["periods"], r["different"], r["changed"]) for r in tables.compare_periods(rows, "key").collect()}
    assert got == {("k", "a"): (2, 1, False)}
