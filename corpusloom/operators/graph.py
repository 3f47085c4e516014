"""A small knowledge graph: entities and relations from rows and texts, resolved, gated, reviewed and searched.

Entities: name, type, doc_id, chunk_index, confidence, description. Relations: src, src_type, dst, dst_type, type, doc_id,
chunk_index, evidence, confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .commits import Tables
from .documents import first_of
from .retrieval import _nfkc


ENTITY_TYPES = ("unit", "place", "deadline", "rule", "role", "other")
RELATION_TYPES = ("handled_by", "due_in", "located_in", "requires", "related_to")
AUTO, LEAST = 0.85, 0.60
STATUS = ("rejected", "pending", "auto", "approved")


def normalize_entity(name: Column, unicode: bool = True) -> Column:
    """NFKC, lower case, without white space and punctuation, 255 characters at most."""
    return F.left(F.regexp_replace(F.lower(_nfkc(name) if unicode else name), r"[\s\p{Punct}，。、；：（）《》]+", ""), F.lit(255))


def normalize_types(df: DataFrame, column: str, known: tuple[str, ...], otherwise: str) -> DataFrame:
    kind = F.lower(F.trim(column))
    return df.withColumn(column, F.when(kind.isin(*known), kind).otherwise(otherwise))


def extract_row_graph(rows: DataFrame) -> DataFrame:
    """Relations of each row (doc_id, row_number, unit, place, month): the unit is located in the place and due in the month."""
    relation = lambda dst, kind, type_: F.when(F.col(dst) != "", F.struct(F.col("unit").alias("src"), F.lit("unit").alias("src_type"), F.col(dst).alias("dst"), F.lit(kind).alias("dst_type"), F.lit(type_).alias("type"), F.concat_ws(" ", "unit", dst).alias("evidence")))
    found = F.array_compact(F.array(relation("place", "place", "located_in"), relation("month", "deadline", "due_in")))
    return rows.where("unit <> ''").select("doc_id", F.col("row_number").alias("chunk_index"), F.explode(found).alias("x")).select("x.*", "doc_id", "chunk_index", F.lit(0.9).alias("confidence"))


def extract_rule_graph(chunks: DataFrame, rules: list[tuple[list[str], tuple[str, str, str, str, str], float]], window: int = 80) -> DataFrame:
    """Relations of the rules (phrases that a chunk must all hold, (src, src type, type, dst, dst type), confidence), with the
    text around the first phrase as evidence."""
    body = F.lower("content")
    each = [F.when(reduce(lambda a, b: a & b, [F.contains(body, F.lit(p)) for p in phrases]), F.struct(F.lit(t[0]).alias("src"), F.lit(t[1]).alias("src_type"), F.lit(t[3]).alias("dst"), F.lit(t[4]).alias("dst_type"), F.lit(t[2]).alias("type"), F.substring(F.col("content"), F.greatest(F.lit(1), F.locate(phrases[0], body) - window // 2), F.lit(window)).alias("evidence"), F.lit(c).alias("confidence"))) for phrases, t, c in rules]
    return chunks.select("doc_id", "chunk_index", F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*", "doc_id", "chunk_index")


def entities_of(relations: DataFrame) -> DataFrame:
    """Both ends of every relation as entities."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("name"), F.col("src_type").alias("type")), F.struct(F.col("dst").alias("name"), F.col("dst_type").alias("type"))))
    return relations.select(ends.alias("x"), "doc_id", "chunk_index", "confidence", "evidence").select("x.name", "x.type", "doc_id", "chunk_index", "confidence", F.col("evidence").alias("description"))


def merge_graph(first: DataFrame, second: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of both, each key once, the first table's before the second's."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", F.desc("confidence")))).where("_k = 1").drop("_o", "_k")


def resolve_entities(entities: DataFrame, unicode: bool = True) -> DataFrame:
    """One entity a normalised name and type: the first name and description by document and chunk, the best confidence."""
    at = F.struct("doc_id", "chunk_index", "name")
    return entities.withColumn("key", normalize_entity(F.col("name"), unicode)).where("key <> ''").groupBy("key", "type").agg(F.min_by("name", at).alias("name"), F.min_by("description", at).alias("description"), F.max("confidence").alias("confidence"), F.count("*").alias("mentions"))


def resolve_relations(relations: DataFrame) -> DataFrame:
    """One relation an end, type, place and evidence: the best confidence; none from an entity to itself."""
    kept = relations.where(F.lower("src") != F.lower("dst"))
    found = kept.groupBy("src", "dst", "type", "doc_id", "chunk_index", "evidence").agg(F.max("confidence").alias("confidence"))
    return found.withColumn("status", F.when(F.col("confidence") >= AUTO, "auto").otherwise("pending"))


def gate_graph(relations: DataFrame, per_chunk: int = 120, entities: int = 80) -> DataFrame:
    """Relations of enough confidence, the best per_chunk of a chunk, auto or pending; of a chunk's entities only the first
    (by their best relation) count, entities at most, and relations of others go."""
    own = Window.partitionBy("doc_id", "chunk_index")
    order = own.orderBy(F.desc("confidence"), "src", "dst", "type")
    kept = relations.where(F.col("confidence") >= LEAST).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_chunk)
    # at most per_chunk relations a chunk are left, so its names fit in an array
    names = F.transform(F.array_sort(F.collect_list(F.struct("_k", "src", "dst")).over(own)), lambda r: F.array(r["src"], r["dst"]))
    first = F.slice(F.array_distinct(F.flatten(names)), 1, entities)
    held = kept.withColumn("_names", first).where(F.array_contains("_names", F.col("src")) & F.array_contains("_names", F.col("dst"))).drop("_k", "_names")
    return held.withColumn("status", F.when(F.col("confidence") >= AUTO, "auto").otherwise("pending"))


def graph_counts(relations: DataFrame) -> DataFrame:
    """Entities, relations and pending relations of each document."""
    names = relations.select("doc_id", F.explode(F.array("src", "dst")).alias("name")).groupBy("doc_id").agg(F.countDistinct("name").alias("entities"))
    own = relations.groupBy("doc_id").agg(F.count("*").alias("relations"), F.count_if(F.col("status") == "pending").alias("pending"))
    return names.join(own, "doc_id")


def search_entities(entities: DataFrame, text: str, n: int) -> DataFrame:
    """The n entities of most mentions whose key holds a text."""
    return entities.where(F.contains("key", F.lit(text.lower()))).orderBy(F.desc("mentions"), "key", "type").limit(n)


def list_relations(relations: DataFrame, status: str | None = None, name: str | None = None) -> DataFrame:
    found = relations if status is None else relations.where(F.col("status") == status)
    return found if name is None else found.where((F.col("src") == name) | (F.col("dst") == name))


#: Relations that people have confirmed, or that are sure enough by themselves.
BELIEVED = ("confirmed", "auto")


def graph_topk(questions: DataFrame, relations: DataFrame, access: DataFrame, k: int, favoured: str | None = None, wants: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """The k best believed relations of documents that the asker may see, for each question (user_id, terms, named): 2 for
    each end that a term names and 0.25 for each term in its ends, type and evidence; the confidence decides between equals.

    0.4 more if the source holds a favoured text, and 3 for each of wants (a text in the question, a type, a text in the
    target) that is met. A question that names entities gets relations with one of them alone. access: user_id, doc_id."""
    question = F.lower("question") if "question" in questions.columns else F.lit("")
    asked = questions.select("question_id", "user_id", F.array_distinct("terms").alias("terms"), "named", question.alias("question"))
    seers = access.select("user_id", "doc_id").join(asked.select("user_id").distinct(), "user_id", "left_semi").distinct()
    believed = relations.where(F.col("status").isin(*BELIEVED)).select("src", "dst", "type", "doc_id", "chunk_index", "evidence", "confidence").distinct()
    # relations meet the users who may see them before the questions; the first end that a question names brings the relation
    ends = F.array_distinct(F.array(F.lower("src"), F.lower("dst")))
    seen = believed.join(seers, "doc_id").withColumn("ends", ends).select("*", F.posexplode("ends").alias("at", "term"))
    both = seen.join(asked.select("*", F.explode("terms").alias("term")), ["user_id", "term"])
    both = both.where((F.col("at") == 0) | ~F.coalesce(F.array_contains("terms", F.col("ends")[0]), F.lit(False)))
    body = F.lower(F.concat_ws(" ", "src", "dst", "type", "evidence"))
    strict = (F.size("named") == 0) | F.array_contains("named", F.lower("src")) | F.array_contains("named", F.lower("dst"))
    score = 2.0 * F.size(F.array_compact(F.array_intersect("terms", "ends"))) + 0.25 * F.size(F.filter("terms", lambda t: F.contains(body, t)))
    if favoured:
        score = score + F.when(F.contains(F.lower("src"), F.lit(favoured)), 0.4).otherwise(0.0)
    for text, kind, target in wants:
        score = score + F.when(F.contains("question", F.lit(text)) & (F.col("type") == kind) & F.contains(F.lower("dst"), F.lit(target)), 3.0).otherwise(0.0)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("confidence"), "doc_id", "chunk_index", "src", "dst", "type")
    scored = both.where(strict).withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scored.select("question_id", "src", "dst", "type", "doc_id", "chunk_index", "score", "rank")


def graph_overview(entities: DataFrame, relations: DataFrame) -> DataFrame:
    e = entities.agg(F.count("*").alias("entities"))
    return e.join(relations.agg(F.count("*").alias("relations"), F.count_if(F.col("status") == "pending").alias("pending"), F.countDistinct("doc_id").alias("documents")))


def graph_documents(docs: DataFrame, counts: DataFrame) -> DataFrame:
    return docs.select("doc_id", "title").join(counts, "doc_id", "left").fillna(0, ["entities", "relations", "pending"]).withColumn("status", F.when(F.col("relations") > 0, "extracted").otherwise("not_extracted"))


def apply_reviews(relations: DataFrame, reviews: DataFrame) -> DataFrame:
    """relations with people's decisions (src, dst, type, doc_id, new_status)."""
    return relations.join(reviews, ["src", "dst", "type", "doc_id"], "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def extract_graph(chunks: DataFrame, rules: list, chunks_per_doc: int = 80, least: int = 20, chars: int = 3000) -> DataFrame:
    """Relations found in, and chunks skipped of, each document (see graph_of), with whether anything was found."""
    found = graph_of(chunks, rules, None, chunks_per_doc, least, chars).groupBy("doc_id").agg(F.count("*").alias("relations"))
    skipped = chunks.groupBy("doc_id").agg(F.count_if((F.col("chunk_index") >= chunks_per_doc) | (F.length("content") < least)).alias("skipped"))
    return skipped.join(found, "doc_id", "left").fillna(0, ["relations"]).withColumn("status", F.when(F.col("relations") > 0, "extracted").otherwise("empty"))


def graph_of(chunks: DataFrame, rules: list, rows: DataFrame | None = None, chunks_per_doc: int = 80, least: int = 20, chars: int = 3000) -> DataFrame:
    """Gated relations of documents: of their rows (as extract_row_graph takes them) where they have some, else of the first
    chunks_per_doc chunks of least characters or more, chars of each at most. These bounds are the extraction's own."""
    fit = chunks.where((F.col("chunk_index") < chunks_per_doc) & (F.length("content") >= least)).withColumn("content", F.left("content", F.lit(chars)))
    if rows is None:
        return gate_graph(extract_rule_graph(fit, rules))
    texts = extract_rule_graph(fit.join(rows.select("doc_id").distinct(), "doc_id", "left_anti"), rules)
    return gate_graph(extract_row_graph(rows).unionByName(texts, allowMissingColumns=True))


def replace_graph(tables: Tables, batch: str, relations: DataFrame, docs: DataFrame) -> bool:
    """Replaces the relations, entities and extraction status of docs (doc_id) in all tables at once; False if the batch is
    done already. Documents without relations are left with the status empty."""
    counts = relations.groupBy("doc_id").agg(F.count("*").alias("relations"), F.count_if(F.col("status") == "pending").alias("pending"))
    status = docs.select("doc_id").distinct().join(counts, "doc_id", "left").fillna(0, ["relations", "pending"]).withColumn("status", F.when(F.col("relations") > 0, "ready").otherwise("empty"))
    return tables.commit(batch, {"relations": relations, "entities": entities_of(relations), "status": status}, docs)


def relation_view(relations: DataFrame, docs: DataFrame, labels: dict[str, str]) -> DataFrame:
    label = first_of([(F.col("type") == k, v) for k, v in labels.items()], "is related to")
    return relations.join(docs.select("doc_id", "title"), "doc_id").select("doc_id", "title", F.concat_ws(" ", "src", label, "dst").alias("sentence"), "status")


