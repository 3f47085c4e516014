"""Whole retrieval for tables of questions: several channels in one plan.

Every decision about a question is a column of it. A question that wiki pages answer takes its pages alone; any other
takes the contexts of its route, mixed with its pages where these were too weak, then those of relations and of the
documents that it names, without repeats, filtered by kind, and checked for its route. A channel reads only the
questions that ask for it, and what the kind filter or repeats take away is refilled from the channels behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .documents import first_of
from .retrieval import check_evidence, check_wiki_evidence, diversify, ranked
from .tables import soft_filter

#: What a context has in every channel. key tells contexts of a document apart.
CONTEXT = ["question_id", "channel", "doc_id", "key", "title", "content", "score"]


def in_order(contexts: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n different contexts (doc_id, key) of each question, numbered by place."""
    once = Window.partitionBy("question_id", "doc_id", "key").orderBy(*order)
    along = Window.partitionBy("question_id").orderBy(*order, "doc_id", "key")
    first = contexts.withColumn("place", F.row_number().over(once)).where("place = 1")
    return first.withColumn("place", F.row_number().over(along)).where(F.col("place") <= n)


def best_of(contexts: DataFrame, questions: DataFrame, score: Callable[[DataFrame], DataFrame], n: int, per_document: int) -> DataFrame:
    """Contexts (with rank) after re-ranking and selection, as place and reranked. score adds reranked and mismatch."""
    scored = score(contexts.join(questions.select("question_id", "question", "terms", "strict"), "question_id"))
    return diversify(ranked(scored.drop("rank"), 1 << 30, "doc_id", "key", by="reranked"), n, per_document)


def wiki_first(questions: DataFrame, pages: DataFrame, least: float, strong: float, several: tuple[str, ...]) -> DataFrame:
    """question_id and direct: whether its pages (CONTEXT, matched and quotes) answer a question; table questions have none."""
    checked = check_wiki_evidence(pages, questions.select("question_id", "question"), least, strong, several)
    return checked.select("question_id", F.col("sufficient").alias("direct"), F.col("reason").alias("wiki_reason"))


def retrieve(
    questions: DataFrame,
    wiki: Callable[[DataFrame], DataFrame],
    routes: dict[str, Callable[[DataFrame], DataFrame]],
    graph: Callable[[DataFrame], DataFrame],
    titles: Callable[[DataFrame], DataFrame],
    score: Callable[[DataFrame], DataFrame],
    kinds: DataFrame,
    allowed: list[str],
    *,
    limit: int = 8,
    per_document: int = 2,
    least: float = 0.6,
    strong: float = 0.6,
    several: tuple[str, ...] = ("compare", "several"),
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """question_id, backend, channel, doc_id, key, score, place, reason and sufficient; a question without contexts has one row.

    questions: question_id, question, terms, route, strict, graph_check and graph_primary. Each channel is a function of
    the questions that use it and gives CONTEXT and rank; routes has one for each route (text serves routes that it lacks), with
    reranked for those whose contexts are re-ranked already. wiki adds matched and quotes. score adds reranked and mismatch
    to contexts with question and terms. kinds is doc_id and kind; where a question has contexts of allowed kinds, the
    others go. keep may store a table that several channels read."""
    pages = keep(wiki(questions.where(F.col("route") != "table")))
    direct = keep(wiki_first(questions, pages, least, strong, several))
    asked = questions.join(direct, "question_id")
    left = asked.where("not direct")

    of_route = [routes[r](left.where(F.col("route") == r if r != "text" else ~F.col("route").isin([x for x in routes if x != "text"]))) for r in routes]
    base = of_route[0].select(*CONTEXT, "rank")
    for more in of_route[1:]:
        base = base.unionByName(more.select(*CONTEXT, "rank"))
    base = keep(base)
    # pages that were too weak to answer alone compete with the route's contexts
    weak = pages.join(left.select("question_id"), "question_id", "left_semi").select(*CONTEXT, "rank", F.lit(0).alias("tier"))
    mixed = base.join(weak.select("question_id").distinct(), "question_id", "left_semi").withColumn("tier", F.lit(1)).unionByName(weak)
    mixed = in_order(mixed, 2 * limit, "tier", "rank").drop("rank", "tier").withColumnRenamed("place", "rank")
    mixed = best_of(mixed, left, score, limit, per_document).select(*CONTEXT, F.col("place").alias("rank"))
    alone = base.join(weak.select("question_id").distinct(), "question_id", "left_anti")

    named = keep(titles(left.where(F.col("route") != "table")))
    led = left.join(named.select("question_id").distinct().withColumn("named", F.lit(True)), "question_id", "left").fillna({"named": False})
    related = keep(graph(left.where("graph_check and route <> 'table'")))
    found = related.select("question_id").distinct().withColumn("found", F.lit(True))
    led = led.join(found, "question_id", "left").withColumn("primary", F.coalesce("found", F.lit(False)) & F.col("graph_primary") & ~F.col("named"))
    flags = led.select("question_id", "named", "primary")

    def tiered(contexts: DataFrame, tier) -> DataFrame:
        return contexts.select(*CONTEXT, "rank").join(flags, "question_id").withColumn("tier", tier)

    # named documents come first; relations come before the rest unless a document is named, and alone where they lead
    rest = tiered(mixed.unionByName(alone.select(*CONTEXT, "rank")), F.lit(2)).where("not primary")
    parts = tiered(named, F.lit(0)).unionByName(rest).unionByName(tiered(related, F.when(F.col("named"), 3).otherwise(1)))
    own = pages.join(direct.where("direct"), "question_id", "left_semi").select(*CONTEXT, "rank", F.lit(False).alias("named"), F.lit(False).alias("primary"), F.lit(0).alias("tier"))

    fit = soft_filter(parts.join(kinds, "doc_id", "left"), F.col("kind").isin(allowed) | F.col("kind").isNull(), "question_id").drop("kind")
    placed = in_order(fit.unionByName(own), limit, "tier", "rank")
    routed = asked.join(flags, "question_id", "left").withColumn("checked_route", first_of([(F.col("direct"), "wiki"), (F.coalesce("primary", F.lit(False)), "text")], F.col("route")))
    verdict = check_evidence(placed.withColumn("is_header", F.lit(False)), routed.select("question_id", F.col("checked_route").alias("route")))
    backend = first_of([(F.col("direct"), "wiki"), (F.col("primary"), "graph"), (F.col("route").isin([r for r in routes if r != "text"]), F.col("route"))], "hybrid")
    heads = routed.select("question_id", backend.alias("backend")).join(verdict.select("question_id", "reason", "sufficient"), "question_id")
    return heads.join(placed.select("question_id", "channel", "doc_id", "key", "score", "place"), "question_id", "left").withColumn("score", F.round("score", 6))
