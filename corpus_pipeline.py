"""A corpus from raw documents to token ids, in five stages; each is written as Parquet and read again by the next.

Null and empty texts, and texts without words, are rejected by the first stage. Rows of one doc_id count as one document
from the second stage on, which keeps the one of the least text; rows without a doc_id are kept apart, all of them. Further
columns pass through all stages but the last, whatever their names. Ties are broken by doc_id, then text. An empty table
stays empty, and so does each of its results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, jaccard, pieces, pii, quality
from corpusloom.llm.common import Shared, read

PIECES = "piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from docs, rejects go."""
    return quality.accept(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a word 5-gram Jaccard similarity of 0.8 or more, the one of the least doc_id stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data, disguised or plain, becomes its kind in brackets, and n_chars follows the text."""
    return pii.find(docs, redact=True).select(*[F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and piece_ids of every document."""
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(PIECES))
    return encoded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("SentencePiece encoding and decoding", encode),
]

#: A classifier that is trained here, and ids of a tokenizer file, can't be told in SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, on the documents of sf_dir; a stage's table is deleted once the next one is written."""
    shared, docs = Shared(spark), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, shared.keep(stage(spark, docs, sf_dir))
        if k:
            shared.drop(before)
    return docs
