"""The pipeline on a small corpus, stage by stage, against what the stages say they do."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sentencepiece import SentencePieceProcessor  # noqa: E402

from .test_operators import good_and_bad, public_tokenizers  # noqa: E402


def test_pipeline_keeps_clean_documents_only(spark, tmp_path):
    good, bad = good_and_bad()
    item = " ".join(f"bench{k}" for k in range(30))
    texts = good + bad + [good[0], good[1] + " end", good[2] + "\n" + item, good[3].replace(".", " a@b.co.", 1) + "\nmore words of another kind that differ from all the others in this small corpus of ours today so that it stays " * 2]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    n, m = len(good), len(good + bad)
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert m not in found and m + 1 not in found and m + 2 not in found and m + 3 in found
    assert sum(k in found for k in range(n)) >= 0.98 * n and sum(k in found for k in range(n, m)) <= 0.1 * len(bad)
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(list(found[k]["piece_ids"]) == library.encode(texts[k]) for k in found if k < n)
    assert "[EMAIL]" in library.decode(list(found[m + 3]["piece_ids"]))


def test_stages_keep_the_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, texts without words, repeated rows, ties, a long text and columns with clashing names."""
    good, _ = good_and_bad()
    long = "\n".join(good[40:60])
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "s", None, "own", "own") for k, t in enumerate(good[:30])]
    rows += [(100, None, "en", "s", 1, None, None), (101, "", "en", "s", 0, None, None), (102, " \n ", None, None, 0, None, None), (103, long, "en", "s", len(long), "x", "y")]
    rows += [rows[3], rows[3], (3, good[31], "en", "s", 5, None, None), (None, good[32], "en", "s", 5, None, None), (200, good[4], "en", "s", 5, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in found]
    assert not {100, 101, 102, 200} & set(ids) and {103, None} <= set(ids) and len(ids) == len(set(ids))
    assert len(set(range(30)) & set(ids)) >= 29
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert next(list(r["piece_ids"]) for r in found if r["doc_id"] == 103) == library.encode(long)


def test_stages_keep_clashing_columns_and_empty_tables(spark, tmp_path):
    good, _ = good_and_bad()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), "own", "own") for k, t in enumerate(good[:20])], SCHEMA)
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        assert {(r["score"], r["spans"]) for r in kept.collect()} == {("own", "own")}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
