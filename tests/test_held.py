"""Parts held by texts against plain Python, mentions of pages, and common neighbours."""

import math
import random

from corpusloom.operators import held, wiki


def test_parts_of_any_script_and_length(spark):
    draw = random.Random(5)
    letters = "ab1é中𝒳 -\n"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    texts = [(k, word(draw.randrange(60))) for k in range(300)] + [(300, None), (301, ""), (302, "x" * held.STEP + "中1é")]
    stretch = lambda n: (lambda t: t[(a := draw.randrange(len(t))) : a + n])(draw.choice([t for _, t in texts[:300] if t]))
    parts = sorted({word(n) for n in (1, 2, 3) for _ in range(20)} | {stretch(n) for n in (2, 5, 9, 33, 50) for _ in range(20)} | {"中1é", "x" * 40, "", "é" * 30, "absent"})
    found = held.held_parts(spark.createDataFrame(texts, "key long, text string").repartition(3), spark.createDataFrame([(p,) for p in parts * 2], "part string"))
    assert sorted(map(tuple, found.collect())) == sorted((k, p) for k, t in texts for p in parts if t and p and p in t)


def test_no_parts(spark):
    assert held.held_parts(spark.createDataFrame([(1, "a")], "key long, text string"), spark.createDataFrame([], "part string")).count() == 0


def test_mentions_without_words(spark):
    pages = spark.createDataFrame([("p1", "Alpha 2041", "", "see beta"), ("p2", "Beta  gamma", "", "alp ha2041 and 2041"), ("p3", "Delta", "", "betagamma x")], "slug string, title string, summary string, body string")
    edges = wiki.mention_edges(pages)
    # p1 names beta; p2 has the number and, without white space, the whole title; p3 has the two words and the whole title
    assert sorted(map(tuple, edges.collect())) == [("p1", "p2", 1 + 2), ("p2", "p3", 3)]
    # texts aren't split into words that meet in a shuffle
    assert "word" not in edges._jdf.queryExecution().executedPlan().toString()


def test_common_neighbors_of_hubs_and_others(spark):
    draw = random.Random(2)
    edges = {tuple(sorted(draw.sample(range(40), 2))) for _ in range(150)} | {(k, 99) for k in range(0, 40, 2)} | {(k, 98) for k in range(1, 30)} | {(98, 99)}
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for e in edges for n in e}
    want = {(a, b): sum(1 / math.log(max(2, len(near[m]))) for m in near[a] & near[b]) for a, b in edges if near[a] & near[b]}
    found = wiki.common_neighbors(spark.createDataFrame([(f"p{a}", f"p{b}") for a, b in edges], "a string, b string")).collect()
    assert {(int(r["a"][1:]), int(r["b"][1:])): round(r["near"], 9) for r in found} == {k: round(v, 9) for k, v in want.items()}
    assert len(found) == len(want)
