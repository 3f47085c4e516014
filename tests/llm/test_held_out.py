"""Queries on the given tables against what these know: languages of held-out texts, quality labels, and digests."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pii, sharding
from corpusloom.llm.queries import QUERIES

from ..test_oracles import TABLES

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the tables aren't here")
LARGER = TABLES.parent / "sf0.01"


def documents(spark, folder=TABLES):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_languages_of_held_out_texts(spark):
    found = QUERIES["op5_language_id"](spark, str(LARGER)).where("held_out and lang_pred <> 'und'")
    both = found.join(documents(spark, LARGER).select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(both) > 200 and sum(r["lang"] == r["lang_pred"] for r in both) >= 0.95 * len(both)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in both)


def test_scores_agree_with_quality_labels(spark):
    found = QUERIES["op2_quality_classifier"](spark, str(LARGER))
    both = found.join(spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r["kept"] for r in both if r["quality"] == q] for q in (1, 0))
    assert len(bad) > 20 and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_personal_data_digests(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    for r in QUERIES["op6_pii"](spark, str(TABLES)).collect():
        base = sorted(pii.plain(texts[r["doc_id"]]), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r["spans"].split(","))


def test_token_limits(spark):
    for r in QUERIES["op8_token_counts"](spark, str(TABLES)).collect():
        assert r["over_limit"] == (r["n_tokens"] > 2048)


def slow_place(key, shards):
    """The tree's descent in plain Python."""
    nodes, path = sharding.tree(shards), ""
    while path in nodes:
        draws = []
        for child, weight in nodes[path]:
            u = (int(hashlib.md5(f"{key}|{child}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            draws.append((-math.log(u) / weight, child))
        path = min(draws)[1]
    return int(path.rsplit("/", 1)[1])


@pytest.mark.parametrize("shards", [sharding.topology(40), sharding.topology(41), [sharding.Shard("a", "k", 0, 0.5), sharding.Shard("a", "l", 1, 3.0), sharding.Shard("b", "k", 2, 0.0)]])
def test_placement_equals_the_descent(spark, shards):
    found = sharding.with_shard(spark.range(300).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("own")), shards)
    assert found.columns == ["doc_id", "shard", "shard_"]
    assert all(r["shard_"] == slow_place(r["doc_id"], shards) for r in found.collect())


def test_lowered_weights_move_rows_out_of_their_subtree_alone(spark):
    old = [sharding.Shard("a", "k", 0, 4.0), sharding.Shard("a", "l", 1, 4.0), sharding.Shard("b", "k", 2, 4.0), sharding.Shard("b", "k", 3, 4.0)]
    new = [sharding.Shard("a", "k", 0, 1.0), *old[1:]]
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    both = sharding.with_shard(sharding.with_shard(docs, old), new).toDF("doc_id", "before", "after").where("before <> after").collect()
    assert both and {r["before"] for r in both} <= {0, 1} and not any(r["after"] == 0 for r in both)
    # within the other region nothing moves
    assert all((r["before"], r["after"]) not in {(2, 3), (3, 2)} for r in both)
