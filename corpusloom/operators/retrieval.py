"""Batch retrieval: terms, candidates by vectors and keywords, features, re-ranking, selection, budgets and checks.

Everything works on whole tables of questions. contexts have question_id, doc_id, chunk_index, content, title and score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .documents import first_of
from .patterns import CELLS, Block, Count, blocks, topk
from .tables import any_of

CJK = "[一-鿿]"


# terms -----------------------------------------------------------------------------------------------------------------


def cjk_grams(text: Column, low: int, high: int, longest: int = 1 << 30) -> Column:
    """All low- to high-grams of each run of CJK characters; runs of up to longest characters also as a whole."""
    runs = F.regexp_extract_all(text, F.lit(f"{CJK}+"), F.lit(0))
    grams = lambda r: F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, n)), lambda g: F.length(g) == n)))
    return F.concat(F.filter(runs, lambda r: F.length(r) <= longest) if longest < 1 << 30 else F.array().cast("array<string>"), F.flatten(F.transform(runs, grams)))


def ascii_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def relevance_terms(text: Column, stop: str = "的了和是在有") -> Column:
    """Words of two characters or more, single CJK characters except stop ones, and CJK 2- to 4-grams."""
    single = F.regexp_extract_all(text, F.lit(f"{CJK}"), F.lit(0))
    return F.array_distinct(F.concat(ascii_terms(text), F.array_except(single, F.array(*map(F.lit, stop))), cjk_grams(text, 2, 4)))


def longest_first(terms: Column, n: int) -> Column:
    return F.slice(F.transform(F.array_sort(F.transform(F.array_distinct(terms), lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), lambda x: x["t"]), 1, n)


def keyword_terms(text: Column, n: int = 80) -> Column:
    """Words, whole CJK runs of up to ten characters and 2- to 6-grams; the n longest, equal ones in order of text."""
    return longest_first(F.concat(ascii_terms(text), cjk_grams(text, 2, 6, 10)), n)


def table_terms(text: Column, n: int = 120) -> Column:
    """Words, numbers and CJK 2- to 5-grams, the n longest."""
    return longest_first(F.concat(ascii_terms(text), F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), cjk_grams(text, 2, 5)), n)


def wiki_terms(text: Column, stop: list[str]) -> Column:
    return F.array_except(F.array_distinct(F.concat(ascii_terms(text), cjk_grams(text, 2, 4))), F.array(*map(F.lit, stop)))


def topic_tokens(text: Column, stop: list[str], least: int = 4) -> Column:
    """Words of least characters or more that aren't numbers or stop words, and CJK 2- to 4-grams."""
    return F.array_except(F.filter(F.array_distinct(F.concat(F.filter(ascii_terms(text), lambda t: F.length(t) >= least), cjk_grams(text, 2, 4))), lambda t: ~t.rlike("^[0-9_]+$")), F.array(*map(F.lit, stop)))


def phrases(text: Column, low: int = 4, high: int = 12) -> Column:
    """Parts of a question between marks, of 4 to 12 characters."""
    return F.filter(F.transform(F.split(text, r"[\s,.;:!?，。；：！？]+"), F.lower), lambda p: F.length(p).between(low, high))


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # a few texts at a time become objects; Arrow's own normalization leaves marks apart, so it is not NFKC
    plain = lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x)
    parts = [pa.array(map(plain, texts.slice(a, 256).to_pylist()), texts.type) for a in range(0, len(texts), 256)]
    return pa.concat_arrays(parts) if parts else texts


def normalize_text(text: Column) -> Column:
    """Unicode NFKC (there is no SQL function for it), lower case, without white space."""
    return F.regexp_replace(F.lower(_nfkc(text)), r"\s+", "")


def expand_terms(questions: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """terms with those that the lexicon gives for words in the question."""
    added = [F.when(F.contains(F.lower("question"), F.lit(word)), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")) for word, more in lexicon.items()]
    return questions.withColumn("terms", F.array_union("terms", F.concat(*added)))


def rewrite(questions: DataFrame, lexicon: dict[str, list[str]], most: int = 18, chars: int = 360) -> DataFrame:
    """question with up to most lexicon terms that it lacks appended, clipped to chars."""
    terms = expand_terms(questions.withColumn("terms", F.array().cast("array<string>")), lexicon)
    missing = F.slice(F.filter("terms", lambda t: ~F.contains(F.lower("question"), t)), 1, most)
    return terms.withColumn("rewritten", F.left(F.concat_ws(" ", "question", F.array_join(missing, " ")), F.lit(chars))).drop("terms")


# candidates ------------------------------------------------------------------------------------------------------------


def ranked(contexts: DataFrame, n: int, *ties: str, by: str = "score", name: str = "rank") -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc(by), *ties)
    return contexts.withColumn(name, F.row_number().over(order)).where(F.col(name) <= n)


def words_of(text: Column) -> Column:
    """The different parts of a text between white space, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[^\\s]+"), F.lit(0)))


#: Terms of up to so many characters are found by equal parts of words, longer ones by their rarest part of this length.
LONGEST_PART = 18


def held_words(terms: DataFrame, words: DataFrame) -> DataFrame:
    """term and word of every pair of terms (term) and words (word) in which the word holds the term.

    Words are split into all their parts of the lengths that terms have, LONGEST_PART at most, and joined by these; so
    candidates are the pairs themselves, however alike the terms are. Only terms beyond that length are compared again."""
    gram = lambda c, n: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.substring(c, i, n)), lambda g: F.length(g) == n)
    asked = terms.select("term").distinct().where("term <> ''").withColumn("n", F.least(F.length("term"), F.lit(LONGEST_PART + 1)))
    stated = {r["n"] for r in asked.select("n").distinct().collect()}  # LONGEST_PART + 1 at most
    lengths = sorted({min(n, LONGEST_PART) for n in stated})
    different = words.select("word").distinct()
    parts = different.select("word", F.explode(F.array_distinct(F.flatten(F.array(*[gram(F.col("word"), n) for n in lengths])) if lengths else F.array().cast("array<string>"))).alias("part"))
    found = asked.where(F.length("term") <= LONGEST_PART).join(parts, F.col("term") == F.col("part")).select("term", "word")
    if LONGEST_PART + 1 not in stated:
        return found
    long = asked.where(F.length("term") > LONGEST_PART).select("term", F.explode(F.array_distinct(gram(F.col("term"), LONGEST_PART))).alias("part"))
    counts = parts.where(F.length("part") == LONGEST_PART).groupBy("part").agg(F.count("*").alias("n"))
    rarest = long.join(counts, "part").groupBy("term").agg(F.min_by("part", F.struct("n", "part")).alias("part"))
    return found.unionByName(rarest.join(parts, "part").where(F.contains("word", F.col("term"))).select("term", "word"))


def keyword_topk(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k chunks of the best keyword score for each question (question_id, terms); chunks: doc_id, chunk_index, title, content.

    A term anywhere in the content gives 0.12 + 0.10 * length / 12, in the title 0.18 + 0.12 * length / 12 (12 characters
    at most), coverage adds 0.35 of itself up to 0.22, and 0.96 is the most; of equal scores the one with more matched
    terms is first."""
    size = lambda t: min(len(t), 12) / 12
    counts = {"inside": Count("terms", ("content",), lambda t: 0.12 + 0.10 * size(t)), "titled": Count("terms", ("title",), lambda t: 0.18 + 0.12 * size(t)), "matched": Count("terms", ("content", "title"))}

    def score(n: dict, q: dict, _: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(0.96, n["inside"] + n["titled"] + np.minimum(0.22, 0.35 * n["matched"] / np.maximum(q["n_terms"], 1))), n["matched"] > 0

    texts = chunks.select("doc_id", "chunk_index", F.lower("title").alias("title"), F.lower("content").alias("content"))
    found = topk(questions.select("question_id", "terms"), texts, k, counts, score, ["doc_id", "chunk_index"], ties=("matched",))
    return found.withColumn("matched", F.col("matched").cast("long"))


def merge_unique(first: DataFrame, second: DataFrame, n: int) -> DataFrame:
    """Contexts of both lists, the first one's before the second's, each (doc_id, chunk_index) once, at most n."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    once = both.withColumn("k", F.row_number().over(Window.partitionBy("question_id", "doc_id", "chunk_index").orderBy("source", "rank"))).where("k = 1")
    return once.withColumn("merged", F.row_number().over(Window.partitionBy("question_id").orderBy("source", "rank", "doc_id", "chunk_index"))).where(F.col("merged") <= n).select("question_id", "doc_id", "chunk_index", "score", "source", "merged")


def dedupe_contexts(contexts: DataFrame) -> DataFrame:
    """Each (doc_id, chunk_index) of a question once, the best score first."""
    return contexts.withColumn("k", F.row_number().over(Window.partitionBy("question_id", "doc_id", "chunk_index").orderBy(F.desc("score")))).where("k = 1").drop("k")


def metadata_topk(questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Documents by title, file name and source type for each question (question_id, terms, wants, newest): 0.18, 0.16 a
    term of up to four characters and 0.24 a longer one, 0.2 for the extension that is asked for, 0.18 if new ones are; 1
    at most. White space counts nowhere. Documents without a term or the extension are found if new ones are asked for,
    or if there are no terms. Of equal scores the newest (created_at, where docs have it) is first."""
    near = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    asked = questions.select("question_id", F.transform("terms", near).alias("terms"), F.coalesce("wants", F.lit("")).alias("wants"), F.coalesce("newest", F.lit(False)).alias("newest"))
    texts = docs.select("doc_id", *[c for c in ("created_at",) if c in docs.columns], near(F.concat_ws(" ", "title", "filename", "source_type")).alias("body"), F.coalesce(F.lower("filename"), F.lit("")).alias("filename"))
    counts = {"hits": Count("terms", ("body",), lambda t: 0.16 if len(t) <= 4 else 0.24)}

    def score(n: dict, q: dict, texts: dict) -> tuple[np.ndarray, np.ndarray]:
        wants, of = np.unique(q["wants"].astype(str), return_inverse=True)
        kind = np.array([[bool(w) and f.endswith(w) for w in wants.tolist()] for f in texts["filename"]], bool).reshape(-1, len(wants))[:, of]
        return np.minimum(1.0, 0.18 + n["hits"] + 0.2 * kind + 0.18 * q["newest"]), (n["hits"] > 0) | kind | q["newest"] | (q["n_terms"] == 0)

    found = topk(asked, texts, k, counts, score, ["doc_id"], columns=("filename",), newest="created_at" if "created_at" in docs.columns else None)
    return found.select("question_id", "doc_id", "score", "rank")


def title_matches(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose whole title occurs in a question; score 0.86, and 0.01 a character beyond four, at most 0.99."""
    tokens = questions.select("question_id", "question", F.explode(F.array_distinct(F.split(F.lower("question"), "[^a-z0-9-]+"))).alias("token"))
    titled = docs.select("doc_id", F.lower("title").alias("title"), F.split_part(F.lower("title"), F.lit(" "), F.lit(1)).alias("token"))
    found = tokens.join(titled, "token").where(F.contains(F.lower("question"), F.col("title")))
    return found.select("question_id", "doc_id", F.least(F.lit(0.99), 0.86 + 0.01 * F.greatest(F.lit(0), F.length("title") - 4)).alias("score")).distinct()


def title_contexts(matches: DataFrame, questions: DataFrame, chunks: DataFrame, n: int = 8) -> DataFrame:
    """The n best chunks (doc_id, chunk_index, title, content) of the documents that a question names: 0.86, 0.015 a term
    up to 0.12, 0.02 a term in the title up to 0.08, at most 0.99. They stay ahead of what other channels find."""
    both = matches.select("question_id", "doc_id").join(chunks.select("doc_id", "chunk_index", "title", "content"), "doc_id").join(questions.select("question_id", "terms"), "question_id")
    held = lambda c: F.size(F.filter("terms", lambda t: F.contains(F.lower(c), t)))
    score = F.least(F.lit(0.99), 0.86 + F.least(F.lit(0.12), 0.015 * held(F.concat_ws(" ", "title", "content"))) + F.least(F.lit(0.08), 0.02 * held(F.col("title"))))
    return ranked(both.withColumn("score", F.round(score, 6)), n, "doc_id", "chunk_index").select("question_id", "doc_id", "chunk_index", "score", "rank")


# features and scores ---------------------------------------------------------------------------------------------------


def penalize(contexts: DataFrame, signal: DataFrame) -> DataFrame:
    both = contexts.join(signal.select("doc_id", "grade", "penalty"), "doc_id", "left")
    return both.withColumn("score", F.greatest(F.lit(0.0), F.col("score") - F.coalesce("penalty", F.lit(0.0)))).drop("penalty")


def matched_terms(contexts: DataFrame, n: int = 12) -> Column:
    return F.slice(F.filter("terms", lambda t: F.contains(F.lower("content"), t)), 1, n)


def relevance_gate(contexts: DataFrame, least: float) -> DataFrame:
    """Contexts (with terms) that share a term with the question or score least or more; matched holds up to 12 terms."""
    return contexts.withColumn("matched", matched_terms(contexts)).where((F.size("matched") > 0) | (F.col("score") >= least))


def plan_bucket(questions: DataFrame, deep: list[str], broad: list[str], precise: list[str]) -> DataFrame:
    """bucket (deep, broad, precise, balanced, by the first list with a marker in the question), its limit and least score."""
    has = lambda words: any_of([F.contains(F.lower("question"), F.lit(w)) for w in words])
    bucket = first_of([(has(deep), "deep"), (has(broad), "broad"), (has(precise), "precise")], "balanced")
    b = F.col("bucket")
    return questions.withColumn("bucket", bucket).withColumn("limit", first_of([(b == "deep", 12), (b == "broad", 10), (b == "precise", 5)], 8)).withColumn("least", first_of([(b == "deep", 0.28), (b == "broad", 0.25), (b == "precise", 0.4)], 0.32))


def complexity(questions: DataFrame, markers: dict[str, float]) -> DataFrame:
    """complexity (markers' weights, and 0.01 a word beyond ten) and the reasons for it."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower("question"), F.lit(m)), F.struct(F.lit(m).alias("m"), F.lit(w).alias("w"))) for m, w in markers.items()]))
    words = F.size(F.split("question", " "))
    total = F.aggregate(hits, F.lit(0.0), lambda s, h: s + h["w"]) + 0.01 * F.greatest(F.lit(0), words - 10)
    return questions.withColumn("complexity", F.round(total, 4)).withColumn("reasons", F.array_join(F.transform(hits, lambda h: h["m"]), ","))


def label_by_markers(texts: DataFrame, column: str, labels: list[tuple[str, list[str]]], otherwise: str, name: str = "label") -> DataFrame:
    """The first label of which a marker is in the text."""
    return texts.withColumn(name, first_of([(any_of([F.contains(F.lower(column), F.lit(m)) for m in markers]), label) for label, markers in labels], otherwise))


#: The least evidence quality for a kind of retrieval plan.
ENOUGH = {"precise": 0.42, "deep": 0.52}
#: The contexts that a kind of plan asks for at least, 5 for others.
MIN_CONTEXTS = {"deep": 12, "broad": 8, "precise": 3}


def query_profile(questions: DataFrame, aspects: dict[str, list[tuple[str, list[str]]]]) -> DataFrame:
    """A column for each aspect (domain, task, actor, topic): its first label of which a marker is in the question, or general."""
    for name, labels in aspects.items():
        questions = label_by_markers(questions, "question", labels, "general", name)
    return questions


def evidence_quality(contexts: DataFrame, plans: DataFrame) -> DataFrame:
    """quality of each question's first six contexts (rank, score, title, content, terms), and whether it is enough.

    0.45 of the best score, 0.25 of the mean of the first three, 0.45 of the share of terms that are among the contexts'
    own terms, up to 0.45, and 0.12 of the different documents, three at most; 1 at most. plans (question_id, bucket)
    set the threshold, 0.46 but for precise and deep ones, and the least number of contexts: half of min_contexts (3
    without that column), from 1 to 3. A question without contexts has the quality 0, which is never enough."""
    first = contexts.where("rank <= 6").groupBy("question_id").agg(F.max("score").alias("best"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("mean3"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("contexts"), F.first("terms").alias("terms"), F.array_distinct(F.flatten(F.collect_list(relevance_terms(F.concat_ws(" ", "title", "content"))))).alias("held"))
    coverage = F.size(F.array_intersect("terms", "held")) / F.greatest(F.size("terms"), F.lit(1))
    quality = 0.45 * F.col("best") + 0.25 * F.col("mean3") + 0.45 * F.least(coverage, F.lit(0.45)) + 0.12 * F.least("documents", F.lit(3)) / 3
    few = F.least(F.lit(3), F.greatest(F.lit(1), F.floor((F.coalesce("min_contexts", F.lit(3)) if "min_contexts" in plans.columns else F.lit(3)) / 2)))
    found = plans.select("question_id", "bucket", few.alias("few")).join(first.withColumn("quality", F.round(F.least(F.lit(1.0), quality), 6)), "question_id", "left").fillna({"quality": 0.0, "contexts": 0, "documents": 0})
    found = found.withColumn("threshold", first_of([(F.col("bucket") == b, t) for b, t in ENOUGH.items()], 0.46))
    return found.withColumn("enough", (F.col("quality") >= F.col("threshold")) & (F.col("contexts") >= F.col("few"))).drop("terms", "held", "few")


def rerank_score(contexts: DataFrame, evidence: list[str]) -> DataFrame:
    """reranked: 0.35 of the score, 0.30 of term coverage, 0.08 an evidence word up to 0.24, 0.07 a term in the title up to
    0.22, 0.16 for a section, and the profile, less the penalty and 0.004 a rank before it, up to 0.08.

    contexts: score, rank, terms, title, content, section, profile and penalty; coverage is the share of the question's
    terms in title and content."""
    body = F.lower(F.concat_ws(" ", "title", "content"))
    coverage = F.size(F.filter("terms", lambda t: F.contains(body, t))) / F.greatest(F.size("terms"), F.lit(1))
    titled = F.least(F.lit(0.22), 0.07 * F.size(F.filter("terms", lambda t: F.contains(F.lower("title"), t))))
    proof = F.least(F.lit(0.24), 0.08 * sum((F.when(F.contains(body, F.lit(w)), 1).otherwise(0) for w in evidence), F.lit(0)))
    score = 0.35 * F.least(F.col("score"), F.lit(1.0)) + 0.30 * coverage + proof + titled + F.when(F.col("section"), 0.16).otherwise(0.0) + F.col("profile") - F.col("penalty") - F.least(F.lit(0.08), 0.004 * (F.col("rank") - 1))
    return contexts.withColumn("coverage", coverage).withColumn("reranked", F.round(score, 6))


def profile_features(contexts: DataFrame, classes: dict[str, tuple[list[str], float, float]]) -> DataFrame:
    """A feature for each class of markers: its weight a marker in the content, up to a cap in size; profile is their sum."""
    columns = {}
    for name, (markers, weight, cap) in classes.items():
        total = weight * sum((F.when(F.contains(F.lower("content"), F.lit(m)), 1).otherwise(0) for m in markers), F.lit(0))
        columns[name] = F.round(F.least(F.lit(cap), total) if weight > 0 else F.greatest(F.lit(cap), total), 6)
    return contexts.withColumns(columns).withColumn("profile", F.round(sum((F.col(c) for c in columns), F.lit(0.0)), 6))


def diversify(contexts: DataFrame, n: int, per_document: int = 3, fill: int = 4) -> DataFrame:
    """At most n contexts of a question in order of rank, as place.

    First come those of its topic, up to per_document of each document; mismatch marks the others, which are passed over
    if they score under 0.45 or the question is strict. If these are fewer than fill, the next best follow up to fill,
    but no mismatches where a strict question has three already. contexts: rank, reranked, mismatch and strict."""
    fits = ~(F.col("mismatch") & ((F.col("reranked") < 0.45) | F.col("strict")))
    own = Window.partitionBy("question_id", "doc_id", "fits").orderBy("rank")
    marked = contexts.withColumn("fits", fits).withColumn("early", F.col("fits") & (F.row_number().over(own) <= per_document))
    # ranks are places of a short candidate list, so a question's rows are few
    ahead = F.sum(F.col("early").cast("int")).over(Window.partitionBy("question_id"))
    marked = marked.withColumn("ahead", F.least(ahead, F.lit(n))).where(F.col("early") | ~(F.col("strict") & F.col("mismatch") & (F.col("ahead") >= 3)))
    placed = marked.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("early"), "rank")))
    return placed.where((F.col("place") <= n) & (F.col("early") | (F.col("place") <= min(fill, n)))).drop("fits", "early", "ahead")


def expand_neighbors(contexts: DataFrame, chunks: DataFrame, width: int, budget: int) -> DataFrame:
    """Chunks up to width before and after a context that aren't contexts, 0.03 less a step (0.1 at least), the best
    budget of each question."""
    steps = F.array(*[F.lit(s) for s in range(-width, width + 1) if s])
    near = contexts.select("question_id", "doc_id", "chunk_index", "score", F.explode(steps).alias("step")).select("question_id", "doc_id", (F.col("chunk_index") + F.col("step")).alias("chunk_index"), F.greatest(F.lit(0.1), F.col("score") - 0.03 * F.abs("step")).alias("score"))
    best = near.groupBy("question_id", "doc_id", "chunk_index").agg(F.max("score").alias("score")).join(contexts, ["question_id", "doc_id", "chunk_index"], "left_anti").join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_semi")
    return ranked(best, budget, "doc_id", "chunk_index")


def section_topk(questions: DataFrame, sections: DataFrame, k: int = 2) -> DataFrame:
    """The k best sections (doc_id, line, title, summary, doc_title) of each document for a question: 0.18, 0.08 a term of
    the section up to 0.56, 0.07 a term of its title up to 0.22, 0.03 a term of the document's title up to 0.12; 0.92 at most.

    Terms are those of relevance_terms, words and CJK grams; single characters count in the section's title alone."""
    long = lambda c: F.filter(relevance_terms(c), lambda t: F.length(t) >= 2)
    parts = {"node": long(F.concat_ws(" ", "title", "summary")), "head": relevance_terms(F.coalesce("title", F.lit(""))), "doc": long(F.coalesce("doc_title", F.lit("")))}
    # a window brings a document's sections together in order (Spark may leave out a plain repartition), so that its best
    # rows are settled in one pass and no hit is shuffled
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    along = sections.select("doc_id", "line", "title", "summary", "doc_title", place.alias("place"))
    words = along.select("doc_id", "line", "place", *[c.alias(name) for name, c in parts.items()])
    names, kinds = [*parts], {c: sections.schema[c].dataType.simpleString() for c in ("doc_id", "line")}
    schema = f"question_id {questions.schema['question_id'].dataType.simpleString()}, doc_id {kinds['doc_id']}, line {kinds['line']}, score double, rank int"
    id_type = to_arrow_type(questions.schema["question_id"].dataType)

    def passed(block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Block = block.value
            ids, terms, ones = pa.array(own.columns["question_id"]).cast(id_type), pa.array(own.terms, pa.string()), np.ones(len(own.terms))
            best = SectionsOf(len(own), k)
            for whole in batches:
                for batch in (whole.slice(a, best.step) for a in range(0, whole.num_rows, best.step)):
                    n = {}
                    for name in names:
                        held = batch.column(name)
                        at = pc.fill_null(pc.index_in(held.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                        row = np.repeat(np.arange(len(held)), pc.fill_null(held.value_lengths(), 0).to_numpy(zero_copy_only=False))
                        n[name] = own.counted("terms", row[at >= 0], at[at >= 0].astype(np.int64), len(held), ones)
                    # in hundredths, so that equal scores are equal
                    score = np.minimum(92, 18 + np.minimum(56, 8 * n["node"]) + np.minimum(22, 7 * n["head"]) + np.minimum(12, 3 * n["doc"])).astype(np.int64)
                    yield from best.add(batch.column("doc_id"), batch.column("line"), batch.column("place").to_numpy(), np.where((n["node"] > 0) | (n["doc"] > 0), score, 0), ids)
            yield from best.end(ids)

        return run

    context = sections.sparkSession.sparkContext
    found = [words.mapInArrow(passed(context.broadcast(b)), schema) for b in blocks(questions.select("question_id", "terms"), {"terms"})]
    return reduce(DataFrame.unionByName, found) if found else sections.sparkSession.createDataFrame([], schema)


class SectionsOf:
    """The k best sections of each document for each of n questions, from sections in order of document and line.

    Only the best rows of the last document are carried on, however many sections it has."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.step = n, k, max(1, CELLS // (4 * n))
        self.doc = self.scores = self.lines = None

    def add(self, docs: pa.Array, lines: pa.Array, place: np.ndarray, scores: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """Rows of the documents that end before the last one of these sections, whose place is 1 where one begins; a score of 0 is no hit."""
        carried, first = 0, np.flatnonzero(place == 1)
        if self.doc is not None and place[0] > 1:
            carried = len(self.scores)
            first = np.concatenate([[0], first + carried])
            scores, docs, lines = np.vstack([self.scores, scores]), pa.concat_arrays([*[self.doc] * carried, docs]), pa.concat_arrays([self.lines, lines])
        else:
            yield from self.end(ids)
        left = np.where(scores > 0, (scores << 32) + len(scores) - np.arange(len(scores))[:, None], 0)  # the earlier of equal scores is larger
        tops = []
        for _ in range(self.k):
            tops.append(np.maximum.reduceat(left, first, axis=0))
            left[left == np.repeat(tops[-1], np.diff(first, append=len(scores)), axis=0)] = 0
        q = np.arange(self.n)
        spot = lambda top: len(scores) - (top & 0xFFFFFFFF)
        line = lambda at, q: np.where(at < carried, at * self.n + q, at + carried * (self.n - 1))
        for rank, top in enumerate(tops):
            doc, asked = np.nonzero(top[:-1])
            if len(doc):
                yield from self._rows(docs.take(pa.array(first[doc])), lines.take(pa.array(line(spot(top[doc, asked]), asked))), top[doc, asked] >> 32, asked, rank, ids)
        last = np.array([top[-1] for top in tops])
        at = np.where(last > 0, line(np.where(last > 0, spot(last), 0), q), 0)
        self.doc, self.scores, self.lines = docs.slice(len(docs) - 1), last >> 32, lines.take(pa.array(at.ravel()))

    def end(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """Rows of the document that is carried on."""
        for rank in range(self.k if self.doc is not None else 0):
            asked = np.flatnonzero(self.scores[rank])
            if len(asked):
                yield from self._rows(pa.concat_arrays([self.doc] * len(asked)), self.lines.take(pa.array(rank * self.n + asked)), self.scores[rank, asked], asked, rank, ids)
        self.doc = None

    def _rows(self, docs: pa.Array, lines: pa.Array, scores: np.ndarray, asked: np.ndarray, rank: int, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        out = [ids.take(pa.array(asked)), docs, lines, pa.array(scores / 100), pa.array(np.full(len(asked), rank + 1, np.int32))]
        yield from pa.table(out, ["question_id", "doc_id", "line", "score", "rank"]).to_batches(max_chunksize=50_000)


def section_content(sections: DataFrame, pages: DataFrame, chars: int = 1800) -> DataFrame:
    """Text of a section's pages and one on either side, clipped; sections: doc_id, start, end."""
    spots = sections.select("doc_id", "start", "end", F.explode(F.sequence(F.col("start") - 1, F.col("end") + 1)).alias("page"))
    held = spots.join(pages, ["doc_id", "page"]).groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return held.select("doc_id", "start", "end", F.left(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), F.lit(chars)).alias("content"))


# sets of contexts ------------------------------------------------------------------------------------------------------


def check_evidence(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """For every question (question_id, route): contexts, documents, best score, whether that suffices for the route, and why.

    A table question needs a row that is no header (is_header), any other a context."""
    found = contexts.groupBy("question_id").agg(F.count("*").alias("contexts"), F.countDistinct("doc_id").alias("documents"), F.max("score").alias("best"), F.count_if(~F.col("is_header")).alias("rows"))
    both = questions.select("question_id", "route").join(found, "question_id", "left").fillna({"contexts": 0, "documents": 0, "best": 0.0, "rows": 0})
    r, none = F.col("route"), F.col("contexts") == 0
    reason = first_of(
        [
            ((r == "table") & (F.col("rows") == 0), "table_route_no_data_rows"), (r == "table", "table_rows_found"),
            ((r == "metadata") & none, "metadata_route_no_sources"), (r == "metadata", "metadata_sources_found"),
            ((r == "summary") & none, "summary_route_no_accessible_documents"), (r == "summary", "summary_sources_found"),
            (none, "text_route_no_contexts"),
        ],
        "text_contexts_found",
    )
    return both.withColumn("reason", reason).withColumn("sufficient", ~F.col("reason").rlike("_no_")).drop("rows")


def check_wiki_evidence(contexts: DataFrame, questions: DataFrame, least: float = 0.6, strong: float = 0.6, several: tuple[str, ...] = ("compare", "several")) -> DataFrame:
    """For every question (question_id, question) the first reason why its wiki contexts can't answer it, or that they can.

    contexts: doc_id, score, matched, quotes (an array) and content. Needed are a score of least, two matched terms, a
    quote, a score of strong for each document where there are several, two documents if the question names several,
    and every number of the question in the evidence."""
    by_document = contexts.groupBy("question_id", "doc_id").agg(F.max("score").alias("own")).groupBy("question_id").agg(F.count("doc_id").alias("documents"), F.min("own").alias("weakest"))
    compact = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    found = contexts.groupBy("question_id").agg(F.count("*").alias("contexts"), F.max("score").alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("terms"), F.sum(F.size("quotes")).alias("quoted"), compact(F.array_join(F.collect_list(F.concat_ws(" ", "content", F.array_join("quotes", " "))), " ")).alias("evidence"))
    both = questions.select("question_id", "question").join(found, "question_id", "left").join(by_document, "question_id", "left")
    numbers = F.regexp_extract_all("question", F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0))
    many = any_of([F.contains(F.lower("question"), F.lit(w)) for w in several])
    reasons = [
        (F.col("contexts").isNull(), "wiki_no_contexts"),
        (F.col("best") < least, "wiki_score_below_direct_threshold"),
        (F.col("terms") < 2, "wiki_match_terms_too_weak"),
        (F.col("quoted") == 0, "wiki_sources_missing"),
        ((F.col("documents") > 1) & (F.col("weakest") < strong), "wiki_mixed_document_confidence"),
        ((F.col("documents") < 2) & many, "wiki_multi_document_evidence_missing"),
        (~F.forall(numbers, lambda x: F.contains("evidence", x)), "wiki_critical_terms_missing"),
    ]
    return both.select("question_id", first_of(reasons, "wiki_evidence_sufficient").alias("reason")).withColumn("sufficient", F.col("reason") == "wiki_evidence_sufficient")


def answer_gate(contexts: DataFrame, generic: list[str], strong: float = 0.58) -> DataFrame:
    """Contexts that may go into an answer: no blocked document, no table header, and no weak match of generic words.

    contexts: grade, channel, is_header, matched, coverage and score. Rows of tables and the graph stay; others need a
    matched term that isn't generic and a coverage of 0.12, or a score of strong."""
    specific = F.size(F.filter(F.array_except("matched", F.array(*map(F.lit, generic))), lambda t: F.length(t) >= 2)) > 0
    fit = (F.col("score") >= strong) | (specific & (F.col("coverage") >= 0.12) & (F.col("score") > 0))
    structured = F.col("channel").isin("table", "graph") & ~F.col("is_header")
    return contexts.where((F.coalesce("grade", F.lit("good")) != "blocked") & (structured | ((F.col("channel") != "table") & fit)))


def char_budget(contexts: DataFrame, n: int, chars: int) -> DataFrame:
    """The first n contexts by rank within chars characters for a question; the one that crosses is clipped."""
    order = Window.partitionBy("question_id").orderBy("rank")
    before = F.coalesce(F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = contexts.withColumn("before", before).where((F.col("rank") <= n) & (F.col("before") < chars))
    return kept.withColumn("content", F.left("content", F.lit(chars) - F.col("before"))).drop("before")


def token_budget(contexts: DataFrame, tokens: int, most: int = 24, floor: int = 900, quote: int = 360) -> DataFrame:
    """question_id, rank, content and quotes within a budget of tokens (four characters each) for a question.

    Quotes (an array; a table without has none) go first, from the last context's last one on, but for the first one of
    the first context, which is clipped to quote characters. Then contents, from the last context on, are shortened by
    steps of 0.72 down to floor characters; then contexts are dropped from the last on, but for the first. A window keeps
    most contexts of a question at most before they meet in one group."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        texts, quotes = group["content"].tolist(), [list(q) for q in group["quotes"]]
        over = lambda: sum(map(len, texts)) + sum(len(x) for q in quotes for x in q) > 4 * tokens
        for k in range(len(quotes) - 1, -1, -1):
            while len(quotes[k]) > (k == 0) and over():
                quotes[k].pop()
        if over() and quotes[0]:
            quotes[0][0] = quotes[0][0][:quote]
        for k in range(len(texts) - 1, -1, -1):
            while over() and len(texts[k]) > floor:
                texts[k] = texts[k][: max(floor, int(len(texts[k]) * 0.72))]
        while len(texts) > 1 and over():
            texts.pop()
            quotes.pop()
        return group.head(len(texts)).assign(content=texts, quotes=quotes)[["question_id", "rank", "content", "quotes"]]

    kind = contexts.schema["question_id"].dataType.simpleString()
    quoted = F.col("quotes") if "quotes" in contexts.columns else F.array().cast("array<string>")
    near = contexts.where(F.col("rank") <= most).select("question_id", F.col("rank").cast("long").alias("rank"), "content", quoted.alias("quotes"))
    return near.groupBy("question_id").applyInPandas(fit, f"question_id {kind}, rank long, content string, quotes array<string>")


def cap_sources(contexts: DataFrame, per_document: int = 4, total: int = 8) -> DataFrame:
    """The best per_document contexts of each document, and of these the best total of a question."""
    own = contexts.withColumn("k", F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy("rank"))).where(F.col("k") <= per_document)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("place") <= total).drop("k")


def highlight(contexts: DataFrame) -> DataFrame:
    """ranges: places (start, end) of the terms in the content, without overlaps; at one start the longest counts.

    A term's places follow from the lengths of what lies between its occurrences, so a text is read once a term."""
    body = F.lower("content")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def spots(t: Column) -> Column:
        parts = F.split(body, F.concat(F.lit("\\Q"), t, F.lit("\\E")), -1)
        after = lambda s, p: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1) + F.length(t), F.lit(0)) + F.length(p)))
        starts = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.expr("cast(array() as array<int>)"), after)
        return F.transform(starts, lambda i: F.struct(i.alias("start"), (-(i + F.length(t))).alias("end")))

    keep = lambda s, r: F.when((F.size(s) == 0) | (F.element_at(s, -1)["end"] <= r["start"]), F.concat(s, F.array(F.struct(r["start"].alias("start"), (-r["end"]).alias("end"))))).otherwise(s)
    return contexts.withColumn("ranges", F.aggregate(F.array_sort(F.flatten(F.transform("terms", spots))), none, keep))


def citations(contexts: DataFrame, chars: int = 300) -> DataFrame:
    """label, place, snippet and score (0 to 1) of each context."""
    return contexts.select("question_id", F.concat(F.lit("["), "rank", F.lit("]")).alias("label"), "doc_id", F.concat_ws(" / ", "title", F.concat(F.lit("chunk "), F.col("chunk_index") + 1)).alias("place"), F.left(F.trim(F.regexp_replace("content", r"\s+", " ")), F.lit(chars)).alias("snippet"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))


def confidence(contexts: DataFrame, low: float = 0.35) -> DataFrame:
    """The best score of a question, 0.12 more if a context matches a term, 0.08 if one is a section, at most 1; and a reason."""
    found = contexts.groupBy("question_id").agg(F.max("score").alias("best"), F.max(F.size("matched") > 0).alias("lexical"), F.max("section").alias("sectioned"))
    total = F.col("best") + F.when(F.col("lexical"), 0.12).otherwise(0.0) + F.when(F.col("sectioned"), 0.08).otherwise(0.0)
    return found.select("question_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("confidence")).withColumn("reason", F.when(F.col("confidence") < low, "weak").otherwise("grounded"))


def quality_notice(contexts: DataFrame, n: int = 6) -> DataFrame:
    """Questions with contexts from documents that aren't good: how many, their grades and up to n documents."""
    poor = contexts.where("grade in ('poor', 'blocked')")
    return poor.groupBy("question_id").agg(F.count("*").alias("contexts"), F.array_join(F.array_sort(F.collect_set("grade")), ",").alias("grades"), F.slice(F.array_sort(F.collect_set("doc_id")), 1, n).alias("documents"))


def retrieval_summary(contexts: DataFrame) -> DataFrame:
    """Contexts of each channel, documents and best score of each question."""
    return contexts.groupBy("question_id").agg(F.count_if(F.col("source") == 0).alias("keyword"), F.count_if(F.col("source") == 1).alias("vector"), F.countDistinct("doc_id").alias("documents"), F.max("score").alias("best"))


def context_preview(contexts: DataFrame, each: int = 1200, total: int = 12000) -> DataFrame:
    """One text a question: contexts clipped to each characters, in order, as long as they end within total."""
    clipped = contexts.select("question_id", "rank", F.left("content", F.lit(each)).alias("part"))
    running = F.sum(F.length("part")).over(Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = clipped.withColumn("chars", running).where(F.col("chars") <= total)
    return kept.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("p")).select("question_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("preview"))


def route_summary(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """For every question (question_id, route): its candidates, contexts (selected), different documents and best score."""
    found = contexts.groupBy("question_id").agg(F.count("*").alias("candidates"), F.count_if("selected").alias("contexts"), F.countDistinct(F.when(F.col("selected"), F.col("doc_id"))).alias("documents"), F.max(F.when(F.col("selected"), F.col("score"))).alias("best"))
    return questions.select("question_id", "route").join(found, "question_id", "left").fillna({"candidates": 0, "contexts": 0, "documents": 0, "best": 0.0})


def graph_flags(questions: DataFrame, asks: list[str], leads: list[str]) -> DataFrame:
    """graph_check and graph_primary of each question (question, route): whether relations are looked up, which metadata
    and summary questions never need, and whether they come first, which never holds for tables."""
    has = lambda words: any_of([F.contains(F.regexp_replace(F.lower("question"), r"\s+", ""), F.lit(w)) for w in words])
    check = has(asks) & ~F.col("route").isin("metadata", "summary")
    return questions.withColumn("graph_check", check).withColumn("graph_primary", check & has(leads) & (F.col("route") != "table"))


def header_fields(chunks: DataFrame) -> DataFrame:
    """doc_id and highlight: sheet label and different header cells of chunks with a header line, each once a document.

    A header line begins with 表头 and holds cells after bars, a cell's name following an optional column and `=`."""
    head = F.element_at(F.concat(F.filter(F.split("content", "\n"), lambda x: F.startswith(F.trim(x), F.lit("表头"))), F.array(F.lit(""))), 1)
    cells = F.filter(F.transform(F.slice(F.split(head, r"\|"), 2, 1 << 20), lambda c: F.trim(F.regexp_replace(c, "^[^=]*=", ""))), lambda c: c != "")
    sheet = F.regexp_extract("content", r"\[([^\]\r\n]{1,40})\]", 1)
    fields = chunks.select("doc_id", sheet.alias("sheet"), F.array_distinct(cells).alias("fields")).where(F.size("fields") > 0)
    return fields.select("doc_id", F.concat(F.when(F.col("sheet") != "", F.concat(F.lit("["), "sheet", F.lit("] "))).otherwise(""), F.array_join("fields", " | ")).alias("highlight")).distinct()


def source_diagnostics(contexts: DataFrame, chars: int = 80) -> DataFrame:
    return contexts.select("question_id", "rank", "doc_id", "chunk_index", F.round("score", 4).alias("score"), F.when(F.col("source") == 0, "keyword").otherwise("vector").alias("channel"), F.left("content", F.lit(chars)).alias("preview"))


def answer_mode(contexts: DataFrame) -> DataFrame:
    """extractive for questions with five contexts and 7000 characters or more, else composed."""
    found = contexts.groupBy("question_id").agg(F.count("*").alias("contexts"), F.sum(F.length("content")).alias("chars"))
    return found.withColumn("mode", F.when((F.col("contexts") >= 5) & (F.col("chars") >= 7000), "extractive").otherwise("composed"))


# sentences -------------------------------------------------------------------------------------------------------------


def sentences(text: Column, least: int = 12, most: int = 260) -> Column:
    """Sentences of least characters or more, clipped; a text without any is one."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?。！？])\s*", "$1\n"), "\n"), lambda s: F.left(F.trim(s), F.lit(most))), lambda s: F.length(s) >= least)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.left(F.trim(text), F.lit(most))))


def top_sentences(chunks: DataFrame, weights: list[tuple[str, int]], n: int) -> DataFrame:
    """The n sentences of each document with the largest sum of weights (of regular expressions that they meet, and 1 from
    40 characters on), in order for equal sums."""
    each = chunks.select("doc_id", "chunk_index", F.posexplode(sentences(F.col("content"))).alias("pos", "sentence"))
    score = sum((F.when(F.col("sentence").rlike(p), w).otherwise(0) for p, w in weights), F.when(F.length("sentence") >= 40, 1).otherwise(0))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_index", "pos")
    return each.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def bucket_sentences(chunks: DataFrame, buckets: list[tuple[str, str]], n: int = 12) -> DataFrame:
    """Different sentences of each document in the first bucket whose regular expression they meet, at most n a bucket."""
    each = chunks.select("doc_id", "chunk_index", F.posexplode(sentences(F.col("content"))).alias("pos", "sentence"))
    placed = each.withColumn("bucket", first_of([(F.col("sentence").rlike(p), name) for name, p in buckets], "other"))
    once = placed.groupBy("doc_id", "bucket", "sentence").agg(F.min(F.struct("chunk_index", "pos")).alias("at"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("at"))).where(F.col("k") <= n)


def focus_snippet(contexts: DataFrame, chars: int) -> DataFrame:
    """chars characters of the content from a quarter before its earliest term, or its beginning."""
    spots = F.filter(F.transform("terms", lambda t: F.position(t, F.lower("content"))), lambda p: p > 0)
    start = F.when(F.size(spots) > 0, F.greatest(F.lit(1), F.array_min(spots) - chars // 4)).otherwise(1)
    return contexts.withColumn("snippet", F.substring(F.col("content"), start.cast("int"), F.lit(chars)))


def strip_markers(text: Column) -> Column:
    """Text without source markers like [S1] or 【来源2】."""
    return F.trim(F.regexp_replace(text, r"\s*(\[S\s?[0-9]+\]|【来源[0-9]+】)", ""))
