"""The best blocks of pages whose words stand far behind their beginning."""

from corpusloom.operators import wiki


def test_words_far_behind_the_beginning_of_a_block_count(spark):
    far = "x " * 2000 + "needle needle [S1]"
    pages = spark.createDataFrame([("p", f"# Head {far}\n\n{far}\n\nno such word")], "slug string, body string")
    questions = spark.createDataFrame([(1, ["needle"])], "question_id long, terms array<string>")
    hits = spark.createDataFrame([(1, "p")], "question_id long, slug string")
    found = {r["block"]: r for r in wiki.best_blocks(hits, pages, questions).collect()}
    assert found[0]["text"] == f"# Head {far}" and found[0]["score"] == 3.95
    # the heading is carried in front of the two blocks under it, so its words count there too
    assert found[1]["text"] == f"# Head {far}\n{far}" and found[1]["score"] == 5.3
    assert found[2]["text"] == f"# Head {far}\nno such word" and found[2]["score"] == 3.7
