"""Search of stated questions against brute force, in Latin and CJK scripts, and on odd rows."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, patterns, pipeline, retrieval, vectors, wiki

WORDS = ["退款", "流程", "材料", "审批", "alpha", "beta", "gamma", "de", "x_1", "表格", "需要", "哪些"]


def texts(n, seed, low=0, high=9):
    r = random.Random(seed)
    return [("" if r.random() < 0.2 else " ").join(r.choice(WORDS) for _ in range(r.randint(low, high))) for _ in range(n)]


def terms_of(text):
    """Words and the 2- to 4-grams of CJK runs, and single CJK characters."""
    runs = re.findall("[一-鿿]+", text)
    grams = {r[i : i + n] for r in runs for n in (2, 3, 4) for i in range(len(r) - n + 1)}
    return set(re.findall("[a-z0-9_]{2,}", text.lower())) | grams | {c for r in runs for c in r if c not in "的了和是在有"}


def questions(spark, n=12):
    rows = [(k, t, sorted(terms_of(t))) for k, t in enumerate(["退款流程需要哪些材料", "alpha beta, 退款流程需要", *texts(n, 5, 1)])]
    return rows, spark.createDataFrame(rows, "question_id long, question string, terms array<string>")


def pages_of(n=60):
    titles, summaries, bodies = texts(n, 1, 1, 3), texts(n, 2, 0, 4), texts(n, 3, 0, 30)
    return [(f"p{k:03}", t, (k % 11) / 10 if k % 7 else None, s or None, b) for k, (t, s, b) in enumerate(zip(titles, summaries, bodies, strict=True))]


def test_wiki_pages_in_any_script_equal_brute_force(spark):
    asked, q = questions(spark)
    rows = [*pages_of(), ("refund", "退款流程", 0.5, None, "退款 流程需要 哪些\n材料：先填表。")]
    pages = spark.createDataFrame(rows, "slug string, title string, confidence double, summary string, body string").repartition(3)
    near = lambda *x: re.sub(r"\s+", "", " ".join(t for t in x if t)).lower()
    want = []
    for k, question, terms in asked:
        said = {p.lower() for p in re.split(r"[\s,.;:!?，。；：！？]+", question) if 4 <= len(p) <= 12}
        found = []
        for slug, title, sure, summary, body in rows:
            full = near(title, summary, body)
            n, t, s = (sum(x in where for x in terms) for where in (full, near(title), near(summary)))
            if not (t or n and n / len(terms) >= 0.16):
                continue
            p = sum(x in full for x in said)
            score = 0.68 * n / len(terms) + min(0.2, 0.065 * t) + min(0.16, 0.04 * s) + min(0.14, 0.07 * p) + min(0.06, 0.06 * (sure or 0)) + 0.04 - min(0.08, 0.01 * math.log10(max(1000, len(full))))
            found.append((-math.floor(max(0, min(0.99, score)) * 1e4 + 0.5) / 1e4, slug))
        want += [(k, slug, -s, i + 1) for i, (s, slug) in enumerate(sorted(found)[:4])]
    got = sorted(tuple(r) for r in wiki.wiki_topk(q, pages, 4).select("question_id", "slug", "score", "rank").collect())
    assert got == sorted(want)
    assert any(r[:2] == (0, "refund") for r in got)


def test_sections_in_any_script_equal_brute_force(spark):
    asked, q = questions(spark)
    rows = [(k % 7, k, t or None, s, d) for k, (t, s, d) in enumerate(zip(texts(50, 7, 0, 3), texts(50, 8, 0, 9), texts(50, 9, 0, 2), strict=True))]
    sections = spark.createDataFrame(rows, "doc_id long, line long, title string, summary string, doc_title string")
    want = []
    for k, _, terms in asked:
        found = {}
        for doc, line, title, summary, doc_title in rows:
            long = lambda *x: {t for t in terms_of(" ".join(y for y in x if y is not None)) if len(t) >= 2} & set(terms)
            n, h, d = len(long(title, summary)), len(terms_of(title or "") & set(terms)), len(long(doc_title))
            if n or d:
                found.setdefault(doc, []).append((-round(min(0.92, 0.18 + min(0.56, 0.08 * n) + min(0.22, 0.07 * h) + min(0.12, 0.03 * d)), 6), line))
        want += [(k, doc, line, -s, i + 1) for doc, x in found.items() for i, (s, line) in enumerate(sorted(x)[:2])]
    assert sorted(tuple(r) for r in retrieval.section_topk(q, sections).collect()) == sorted(want)


def test_keywords_anywhere_in_texts_equal_brute_force(spark):
    asked, _ = questions(spark)
    asked = [*asked, (90, "", ["a beta", "退款 流程", "", "de"]), (91, "", []), (92, "", ["nowhere"])]
    q = spark.createDataFrame(asked, "question_id long, question string, terms array<string>")
    rows = [(k // 4, k % 4, t or None, c) for k, (t, c) in enumerate(zip(texts(80, 11, 0, 2), texts(80, 12, 0, 20), strict=True))]
    rows += [(99, 0, None, None), (99, 1, "Title", "退款 流程 ALPHA BETA de"), (99, 1, "Title", "退款 流程 ALPHA BETA de")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index long, title string, content string").withColumn("rank", F.lit("clash"))
    want = []
    for k, _, terms in asked:
        found = []
        for doc, chunk, title, content in rows:
            title, content = (title or "").lower(), (content or "").lower()
            size = lambda t: min(len(t), 12) / 12
            held = {t for t in terms if t and (t in title or t in content)}
            if held:
                score = sum((0.12 + 0.1 * size(t)) * (t in content) + (0.18 + 0.12 * size(t)) * (t in title) for t in held) + min(0.22, 0.35 * len(held) / len(terms))
                found.append((-math.floor(min(0.96, score) * 1e6 + 0.5) / 1e6, -len(held), doc, chunk))
        want += [(k, doc, chunk, round(-s, 6), -m, i + 1) for i, (s, m, doc, chunk) in enumerate(sorted(found)[:5])]
    got = retrieval.keyword_topk(q, chunks.repartition(4), 5).select("question_id", "doc_id", "chunk_index", F.round("score", 6), "matched", "rank")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert retrieval.keyword_topk(q.where("false"), chunks, 5).count() == 0
    assert retrieval.keyword_topk(q, chunks.where("false"), 5).count() == 0


def test_questions_in_blocks_are_found_alike(spark):
    _, q = questions(spark)
    chunks = spark.createDataFrame([(k, 0, "t", t) for k, t in enumerate(texts(40, 13))], "doc_id long, chunk_index long, title string, content string")
    found = [sorted(tuple(r) for r in retrieval.keyword_topk(q, chunks, 3).collect())]
    sizes = patterns.blocks.__defaults__
    try:
        patterns.blocks.__defaults__ = (5, 2)
        found.append(sorted(tuple(r) for r in retrieval.keyword_topk(q, chunks, 3).collect()))
    finally:
        patterns.blocks.__defaults__ = sizes
    assert found[0] == found[1]


def test_newest_documents_need_no_term(spark):
    docs = spark.createDataFrame([(1, "Refund guide", "guide.pdf", "admin_upload", 5), (2, "Other", "other.md", "chat_upload", 9), (3, None, None, None, 1)], "doc_id long, title string, filename string, source_type string, created_at long")
    q = spark.createDataFrame([(1, ["nothing"], None, True), (2, ["nothing"], None, False), (3, ["refundguide", "chat"], ".md", False), (4, [], None, None), (5, ["nothing"], ".pdf", False)], "question_id long, terms array<string>, wants string, newest boolean")
    got = sorted((r["question_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in retrieval.metadata_topk(q, docs, 3).collect())
    assert got == [(1, 1, 2, 0.36), (1, 2, 1, 0.36), (1, 3, 3, 0.36), (3, 1, 2, 0.54), (3, 2, 1, 0.42), (4, 1, 2, 0.18), (4, 2, 1, 0.18), (4, 3, 3, 0.18), (5, 1, 1, 0.38)]


@pytest.mark.parametrize("size", [1 << 20, 100])
def test_vectors_equal_brute_force(spark, size):
    r = random.Random(4)
    rows = [(k, [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)]) for k in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(40)] + [(400, [0.0] * 6), (401, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = [*rows[:9], (400, [0.0] * 6)]
    norm = lambda x: math.sqrt(sum(v * v for v in x))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)) if norm(a) * norm(b) else 0.0
    want = []
    for q, x in asked:
        best = sorted((-round(cosine(x, y), 9), v) for v, y in rows if y)[:7]
        want += [(q, v, -s, i + 1) for i, (s, v) in enumerate(best)]
    found = vectors.vector_topk(spark.createDataFrame(asked, "question_id long, embedding array<double>"), df, 7, block_bytes=size, digits=9)
    assert sorted(tuple(r) for r in found.select("question_id", "vec_id", "score", "rank").collect()) == sorted(want)


def test_sparse_vectors_equal_dense_ones(spark):
    r = random.Random(8)
    rows = [(k, [(s, r.choice([-1.0, 0.5, 2.0])) for s in sorted(r.sample(range(9), r.randint(0, 5)))]) for k in range(80)]
    dense = lambda x: [dict(x).get(s, 0.0) for s in range(9)]
    sparse = lambda rows, name: spark.createDataFrame(rows, f"{name} long, embedding array<struct<slot: long, weight: double>>").repartition(3)
    full = lambda rows, name: spark.createDataFrame([(k, dense(x)) for k, x in rows], f"{name} long, embedding array<double>")
    one = vectors.vector_topk(sparse(rows[:9], "question_id"), sparse(rows, "vec_id"), 4, digits=6, dim=9)
    two = vectors.vector_topk(full(rows[:9], "question_id"), full(rows, "vec_id"), 4, digits=6)
    get = lambda df: sorted((r["question_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    assert get(one) == get(two) and len(get(one)) == 36


def test_relations_must_be_believed(spark):
    rel = [("Office", "Form", k, 1, 0, "the form", c, s) for k, c, s in (("requires", 0.9, "auto"), ("names", 0.95, "confirmed"), ("holds", 0.99, "pending"), ("owns", 0.99, "rejected"))]
    relations = spark.createDataFrame(rel, "src string, dst string, type string, doc_id long, chunk_index long, evidence string, confidence double, status string")
    q = spark.createDataFrame([(1, "which form do rules ask for", 7, ["office", "form"], []), (2, "office", 8, ["office"], []), (3, "desk", 7, ["office"], ["desk"])], "question_id long, question string, user_id long, terms array<string>, named array<string>")
    access = spark.createDataFrame([(7, 1), (7, 1), (8, 2)], "user_id long, doc_id long")
    got = [tuple(r) for r in graph.graph_topk(q, relations, access, 5, "off", (("rules", "requires", "form"),)).orderBy("rank").select("question_id", "type", "score").collect()]
    assert got == [(1, "requires", 7.9), (1, "names", 4.9)]


def test_evidence_is_counted_by_terms(spark):
    c = spark.createDataFrame([(1, 1, 0.5, 9, "title", "outage report", ["out", "report", "退款"]), (1, 2, 0.3, 9, None, "退款", ["out", "report", "退款"])], "question_id long, rank int, score double, doc_id long, title string, content string, terms array<string>")
    plans = spark.createDataFrame([(1, "deep", 12), (2, "precise", None)], "question_id long, bucket string, min_contexts int")
    got = {r["question_id"]: (r["quality"], r["contexts"], r["enough"]) for r in retrieval.evidence_quality(c, plans).collect()}
    assert got[1] == (round(0.45 * 0.5 + 0.25 * 0.4 + 0.45 * 0.45 + 0.12 / 3, 6), 2, False) and got[2] == (0.0, 0, False)


# whole retrieval -------------------------------------------------------------------------------------------------------

CTX = "question_id long, channel string, doc_id long, key string, title string, content string, score double, rank int"


def test_every_branch_of_whole_retrieval(spark):
    """1 is answered by pages, 2 mixes weak pages with text, 3 is led by relations, 4 names a document, 5 asks for a table, 6 for metadata, 7 finds nothing."""
    q = spark.createDataFrame(
        [(k, f"question {k}", ["refund"], r, False, g, p) for k, r, g, p in ((1, "text", False, False), (2, "text", True, False), (3, "text", True, True), (4, "text", True, True), (5, "table", True, False), (6, "metadata", False, False), (7, "summary", False, False))],
        "question_id long, question string, terms array<string>, route string, strict boolean, graph_check boolean, graph_primary boolean",
    )
    table = lambda rows, more="": spark.createDataFrame(rows, CTX + more)
    wiki_rows = table([(1, "wiki", 1, "w1", "t", "refund 1", 0.9, 1, ["refund", "x"], ["q"]), (2, "wiki", 2, "w2", "t", "refund", 0.3, 1, ["refund"], [])], ", matched array<string>, quotes array<string>")
    text = table([(k, "text", d, f"c{d}", "t", "refund text", 0.5, d - 9) for k in (1, 2, 3, 4) for d in (10, 11, 12)])
    of = {"text": text, "table": table([(5, "table", 20, "r", "t", "row", 0.8, 1), (1, "table", 21, "r", "t", "row", 0.8, 1)]), "metadata": table([(6, "metadata", 30, "m", "t", "f", 0.4, 1)])}
    graph_rows = table([(k, "graph", 40, f"g{k}", "", "a b", 2.5, 1) for k in (2, 3, 4, 5)])
    named = table([(4, "title", 50, "c0", "t", "x", 0.9, 1), (4, "title", 10, "c10", "t", "x", 0.88, 2)])
    seen = {}

    def channel(name, df):
        def run(asked):
            seen[name] = {r["question_id"] for r in asked.collect()}
            return df.join(asked.select("question_id"), "question_id", "left_semi")

        return run

    kinds = spark.createDataFrame([(11, "bad"), (10, "good"), (12, "good"), (40, "good"), (50, "good"), (2, "bad"), (20, "bad")], "doc_id long, kind string")
    score = lambda c: c.withColumns({"reranked": F.col("score") + F.when(F.col("channel") == "wiki", 0.5).otherwise(0.0) - F.col("rank") / 100, "mismatch": F.lit(False)})
    found = pipeline.retrieve(q, channel("wiki", wiki_rows), {k: channel(k, v) for k, v in of.items()}, channel("graph", graph_rows), channel("title", named), score, kinds, ["good"])
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["question_id"], r["place"] or 0)):
        got.setdefault((r["question_id"], r["backend"], r["sufficient"]), []).append(r["key"])
    assert got == {
        (1, "wiki", True): ["w1"],
        (2, "hybrid", True): ["g2", "c10", "c12"],
        (3, "graph", True): ["g3"],
        (4, "hybrid", True): ["c0", "c10", "c12", "g4"],
        (5, "table", True): ["r"],
        (6, "metadata", True): ["m"],
        (7, "hybrid", False): [None],
    }
    assert seen == {"wiki": {1, 2, 3, 4, 6, 7}, "text": {2, 3, 4, 7}, "table": {5}, "metadata": {6}, "graph": {2, 3, 4}, "title": {2, 3, 4, 6, 7}}
    assert list(itertools.chain(*got.values())).count("c11") == 0


def test_graph_counts_a_relation_once_and_reads_only_askers(spark):
    row = ("Office", "form", "requires", 1, 0, "the office", 0.9, "auto")
    relations = spark.createDataFrame([row, row, ("desk", "form", "requires", 2, 0, "x", 0.9, "auto"), ("form", "form", "requires", 3, 0, "x", 0.9, "auto")], "src string, dst string, type string, doc_id long, chunk_index int, evidence string, confidence double, status string")
    access = spark.createDataFrame([(5, 1), (5, 1), (5, 3), (6, 2)], "user_id long, doc_id long")
    q = spark.createDataFrame([(1, 5, ["office", "form", "form"], []), (2, 6, ["form"], []), (3, 7, ["form"], [])], "question_id long, user_id long, terms array<string>, named array<string>")
    got = sorted(tuple(r) for r in graph.graph_topk(q, relations, access, 5).select("question_id", "doc_id", "score", "rank").collect())
    assert got == [(1, 1, 4.5, 1), (1, 3, 2.25, 2), (2, 2, 2.25, 1)]


def test_equal_questions_are_asked_once(spark, monkeypatch):
    asked = []
    blocks = patterns.blocks
    monkeypatch.setattr(patterns, "blocks", lambda questions, lists: [asked.append(len(b)) or b for b in blocks(questions, lists)])
    q = spark.range(300).selectExpr("id as question_id", "array(concat('n', id % 2)) as terms", "'.md' as wants", "id % 2 = 0 as newest")
    docs = spark.createDataFrame([(1, "n0", "a.md", "x"), (2, "n1", "b.txt", "x"), (3, "other", "c.txt", "x")], "doc_id long, title string, filename string, source_type string")
    got = {(r["question_id"], r["rank"]): (r["doc_id"], round(r["score"], 2)) for r in retrieval.metadata_topk(q, docs, 2).collect()}
    want = {0: [(1, 0.72), (2, 0.36)], 1: [(1, 0.38), (2, 0.34)]}
    assert got == {(i, k + 1): want[i % 2][k] for i in range(300) for k in range(2)} and asked == [2]


def test_parts_of_words_are_found_without_comparing_candidates(spark):
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("ab1", k=draw.randrange(1, 40))) for _ in range(60)})
    short = sorted({w[i : i + n] for w in words for i, n in [(draw.randrange(20), draw.randrange(1, 19)), (0, 3)] if w[i : i + n]})
    long = sorted({w[1:30] for w in words if len(w) > 25} | {"a" * 30})
    column = lambda x, name: spark.createDataFrame([(v,) for v in x], f"{name} string")
    found = retrieval.held_words(column(short + long, "term"), column(words, "word"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((t, w) for t in short + long for w in words if t in w)
    plan = retrieval.held_words(column(short, "term"), column(words, "word"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "contains(" not in plan


def test_vectors_are_asked_for_in_blocks_of_few_queries(spark):
    from corpusloom.operators import vectors

    queries = spark.range(2 * vectors.BLOCK_QUERIES + 1).selectExpr("id as question_id", "array(1.0f, cast(id as float)) as embedding")
    assert [len(ids) for ids, _ in vectors._blocks(queries, vectors.BLOCK_BYTES, None)] == [vectors.BLOCK_QUERIES, vectors.BLOCK_QUERIES, 1]


def test_vectors_of_one_key_and_without_a_key_are_kept(spark):
    from corpusloom.operators.vectors import vector_topk

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (2, [-1.0, 0.0])]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "question_id long, embedding array<float>")
    got = [(r["vec_id"], round(r["score"], 3)) for r in vector_topk(asked, own, 4).orderBy("rank").collect()]
    assert got == [(1, 1.0), (None, 0.707), (1, 0.0), (2, -1.0)]


def test_a_step_of_a_search_counts_few_pairs(spark, monkeypatch):
    block = patterns.Block([{"question_id": q, "terms": ["a", "b"]} for q in range(1000)], {"terms"})
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "question_id long, terms array<string>")
    texts = spark.range(300).selectExpr("id as doc_id", "1 as chunk_index", "'' as title", "'a b c' as content").coalesce(1)
    want = [tuple(r) for r in retrieval.keyword_topk(q, texts, 3).orderBy("question_id", "rank").collect()]
    monkeypatch.setattr(patterns, "PAIRS", 40)
    assert [tuple(r) for r in retrieval.keyword_topk(q, texts, 3).orderBy("question_id", "rank").collect()] == want
    assert patterns.step_of(block, {"n": patterns.Count("terms", ("content",))}) == 1
    monkeypatch.setattr(patterns, "PAIRS", 1 << 14)
    assert patterns.step_of(block, {"n": patterns.Count("terms", ("content",))}) == 8


def test_texts_are_normalized_as_by_python(spark):
    import unicodedata

    odd = ["ﬁne Ｔｅｘｔ ①", "e\u0301 ½ ㍿", "", None, "İ x", "한글"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, text string")
    got = [r["t"] for r in df.select("k", retrieval._nfkc("text").alias("t")).orderBy("k").collect()]
    assert got == [x and unicodedata.normalize("NFKC", x) if x is not None else None for x in odd]


def test_two_lists_of_one_search_search_once(spark):
    from corpusloom.plans.retrieval_queries import two_lists

    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in two_lists(spark, "/root/testdata/sf0.001")]
    assert sum(p.count("MapInArrow") for p in plans) <= 1


def test_short_and_common_terms_are_found_as_by_python(spark, monkeypatch):
    import numpy as np

    r = random.Random(7)
    asked = [{"question_id": k, "terms": sorted({"".join(r.choice("ab1_") for _ in range(r.randint(1, 5))) for _ in range(6)} | {"é", "ab.", "退款"})} for k in range(9)]
    block = patterns.Block(asked, {"terms"})
    found_in = ["", "ab", "a\nb", "é退款", "ab.退", *["".join(r.choice("ab1_é退款\n.") for _ in range(r.randint(0, 40))) for _ in range(60)]]
    want = sorted((k, t) for k, x in enumerate(found_in) for t, term in enumerate(block.terms) if term in x)
    for cells in (patterns.CELLS, 64):  # also in groups of one text
        monkeypatch.setattr(patterns, "CELLS", cells)
        pairs = np.sort(block.finder()(found_in))
        assert [divmod(int(p), len(block.terms)) for p in pairs] == want
    rows, terms = pairs // len(block.terms), pairs % len(block.terms)
    assert (block.common["terms"][0] >= 0).any()
    counts = block.counted("terms", rows, terms, len(found_in), np.ones(len(block.terms)))
    assert counts.tolist() == [[sum(t in x for t in q["terms"]) for q in asked] for x in found_in]
    assert patterns.Block([{"question_id": 1, "terms": []}], {"terms"}).finder()(["x"]).tolist() == []


def test_vectors_of_whole_texts_equal_hashed_tokens(spark):
    from corpusloom.operators import ingest

    rows = [(1, "a b, B c_1 退款 a"), (2, ""), (3, None), (4, ", ."), (5, "x"), (5, "y x"), (None, "z")]
    df = spark.createDataFrame(rows, "k int, text string")
    want = {(r["k"], r["slot"]): r["weight"] for r in ingest.hash_embed(df, "k", "text").collect()}
    got = {(r["k"], x["slot"]): x["weight"] for r in ingest.hash_vectors(df, ["k"], "text").collect() for x in r["embedding"]}
    assert got == pytest.approx(want) and len(got) > 5


def test_whole_retrieval_cuts_chunks_without_grouping_tokens(spark):
    from corpusloom.plans import pipeline_queries

    asked = pipeline_queries.questions(spark, "/root/testdata/sf0.001")
    plan = pipeline_queries.by_vectors(spark, "/root/testdata/sf0.001", asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "token" not in plan


def test_best_sections_are_settled_in_one_pass(spark, monkeypatch):
    r = random.Random(3)
    q = spark.createDataFrame([(k, [r.choice("abcdef") * 2 for _ in range(3)]) for k in range(5)] + [(9, ["none"])], "question_id long, terms array<string>").withColumn("terms", F.array_distinct("terms"))
    rows = [(k // 13 if k < 60 else None, k, None, " ".join(r.choice("abcdefgh") * 2 for _ in range(3)), "aa" if k % 13 == 4 else None) for k in range(70)]
    sections = spark.createDataFrame(rows, "doc_id int, line int, title string, summary string, doc_title string").repartition(4)
    want = []
    for k, terms in q.collect():
        found = {}
        for doc, line, _, summary, doc_title in rows:
            n, d = len({*summary.split()} & {*terms}), int(bool(doc_title) and "aa" in terms)
            if n or d:
                found.setdefault(doc, []).append((-min(92, 18 + 8 * n + 3 * d), line))
        want += [(k, doc, line, -s / 100, i + 1) for doc, x in found.items() for i, (s, line) in enumerate(sorted(x)[:3])]
    for cells in (1 << 20, 1):  # the latter: sections come one by one
        monkeypatch.setattr(retrieval, "CELLS", cells)
        found = retrieval.section_topk(q, sections, 3)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
