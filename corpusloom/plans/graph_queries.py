"""Registered queries of the knowledge graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.access import for_readers
from ..operators.commits import Tables
from ..operators.components import shared_folder
from ..registry import register
from ..sources.model import view
from .document_queries import acl, chunks, docs
from .retrieval_queries import asked

RULES = [(["the", "erth"], ("office", "unit", "requires", "form", "rule"), 0.9), (["ander"], ("Office", "unit", "handled_by", "desk", "role"), 0.7), (["ing"], ("desk", "role", "related_to", "desk", "role"), 0.65)]
ROWS = "gr as (select o_orderkey as row_number, c_custkey as doc_id, c_name as unit, n_name as place, sheet as month from {lines})"
ROW_GRAPH = ROWS + ", rg as (select unit as src, 'unit' as src_type, place as dst, 'place' as dst_type, 'located_in' as type, unit || ' ' || place as evidence, doc_id, row_number as chunk_index, 0.9 as confidence from gr union all select unit, 'unit', month, 'deadline', 'due_in', unit || ' ' || month, doc_id, row_number, 0.9 from gr)"
RULE_GRAPH = "ug as (select 'office' as src, 'unit' as src_type, 'form' as dst, 'rule' as dst_type, 'requires' as type, substr(content, greatest(1, strpos(lower(content), 'the') - 40), 80) as evidence, 0.9 as confidence, doc_id, chunk_index from {chunks} where contains(lower(content), 'the') and contains(lower(content), 'erth') union all select 'Office', 'unit', 'desk', 'role', 'handled_by', substr(content, greatest(1, strpos(lower(content), 'ander') - 40), 80), 0.7, doc_id, chunk_index from {chunks} where contains(lower(content), 'ander') union all select 'desk', 'role', 'desk', 'role', 'related_to', substr(content, greatest(1, strpos(lower(content), 'ing') - 40), 80), 0.65, doc_id, chunk_index from {chunks} where contains(lower(content), 'ing'))"
RELATIONS = RULE_GRAPH + ", rel as (select src, dst, type, doc_id, chunk_index, evidence, confidence, case when confidence >= 0.85 then 'auto' else 'pending' end as status from ug where lower(src) <> lower(dst))"


def row_graph(spark, d):
    r = view(spark, d, "lines").selectExpr("o_orderkey as row_number", "c_custkey as doc_id", "c_name as unit", "n_name as place", "sheet as month")
    return G.extract_row_graph(r)


def rule_graph(spark, d):
    return G.extract_rule_graph(chunks(spark, d), RULES)


def relations(spark, d):
    return G.resolve_relations(rule_graph(spark, d))


@register("f01_row_graph", f"with {ROW_GRAPH} select * from rg")
def _(spark, d):
    return row_graph(spark, d)


@register("f02_rule_graph", f"with {RULE_GRAPH} select * from ug")
def _(spark, d):
    return rule_graph(spark, d)


@register("f03_merge_graph", f"with {RULE_GRAPH} select doc_id, type, max(confidence) as confidence from ug group by 1, 2")
def _(spark, d):
    g = rule_graph(spark, d).select("doc_id", "type", "confidence")
    return G.merge_graph(g.where("doc_id % 2 = 0"), g.where("doc_id % 2 = 1 or type = 'requires'"), ("doc_id", "type"))


@register("f04_normalize_entity")
def _(spark, d):
    return docs(spark, d).select("doc_id", G.normalize_entity(F.col("text")).alias("key"))


ENTITIES = ROW_GRAPH + ", en as (select unnest([src, dst]) as name, unnest([src_type, dst_type]) as type, evidence as description, doc_id, chunk_index, confidence from rg), ent as (select lower(regexp_replace(name, '[\\s[:punct:]]+', '', 'g')) as key, type, arg_min(name, (doc_id, chunk_index, name)) as name, arg_min(description, (doc_id, chunk_index, name)) as description, max(confidence) as confidence, count(*) as mentions from en group by 1, 2)"


def entities(spark, d):
    return G.resolve_entities(G.entities_of(row_graph(spark, d)))


@register("f05_resolve_entities", f"with {ENTITIES} select key, type, name, confidence, mentions from ent")
def _(spark, d):
    return entities(spark, d).drop("description")


@register("f06_resolve_relations", f"with {RELATIONS} select * from rel")
def _(spark, d):
    return relations(spark, d)


@register("f07_gate_graph", f"with {RULE_GRAPH} select doc_id, chunk_index, src, type, case when confidence >= 0.85 then 'auto' else 'pending' end as status from ug where confidence >= 0.6 qualify row_number() over (partition by doc_id, chunk_index order by confidence desc, src, dst, type) <= 120")
def _(spark, d):
    return G.gate_graph(rule_graph(spark, d)).select("doc_id", "chunk_index", "src", "type", "status")


COUNTS = RELATIONS + ", gc as (select doc_id, count(distinct name) as entities, any_value(r) as relations, any_value(p) as pending from (select doc_id, unnest([src, dst]) as name, count(*) over (partition by doc_id) as r, count(*) filter (status = 'pending') over (partition by doc_id) as p from rel) group by 1)"


@register("f08_graph_counts", f"with {COUNTS} select * from gc")
def _(spark, d):
    return G.graph_counts(relations(spark, d))


@register("f09_normalize_types", "select doc_id, case when doc_id % 3 = 0 then 'place' else 'other' end as type from {docs}")
def _(spark, d):
    return G.normalize_types(docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, " Place").otherwise("thing").alias("type")), "type", G.ENTITY_TYPES, "other")


@register("f10_search_entities", f"with {ENTITIES} select key, type, mentions from ent where contains(key, 'an') order by mentions desc, key, type limit 20")
def _(spark, d):
    return G.search_entities(entities(spark, d), "an", 20).select("key", "type", "mentions")


@register("f11_list_relations", f"with {RELATIONS} select doc_id, chunk_index, type from rel where status = 'pending' and (src = 'desk' or dst = 'desk')")
def _(spark, d):
    return G.list_relations(relations(spark, d), "pending", "desk").select("doc_id", "chunk_index", "type")


ASKERS = "q as (select question_id, question, cast(question_id % 50 as bigint) as user_id, case when question_id % 2 = 0 then ['office', 'the', 'form'] else ['desk', 'ander'] end as terms, case when question_id % 4 = 1 then ['desk'] else [] end as named from {questions})"


#: Rows of graph_topk for questions in q (question_id, question, user_id, terms, named) and relations in rel.
GRAPH_TOP = """gh as (select question_id, question, src, dst, type, doc_id, chunk_index, confidence, terms, list_contains(terms, lower(src))::int + case when lower(src) <> lower(dst) then list_contains(terms, lower(dst))::int else 0 end as ends, lower(concat_ws(' ', src, dst, type, evidence)) as body from q join (select * from rel where status in ('auto', 'confirmed')) on list_contains(terms, lower(src)) or list_contains(terms, lower(dst)) join {accessible} using (user_id, doc_id) where len(named) = 0 or list_contains(named, lower(src)) or list_contains(named, lower(dst))),
    gs as (select question_id, src, dst, type, doc_id, chunk_index, confidence, round(cast(2.0 * ends + 0.25 * len(list_filter(terms, lambda t: contains(body, t))) + case when contains(lower(src), 'off') then 0.4 else 0 end + case when contains(lower(question), 'that') and type = 'requires' and contains(lower(dst), 'form') then 3.0 else 0 end as double), 6) as score from gh),
    gt as (select *, row_number() over (partition by question_id order by score desc, confidence desc, doc_id, chunk_index, src, dst, type) as rank from gs qualify rank <= 10)"""


def askers(spark, d):
    return view(spark, d, "questions").selectExpr("question_id", "question", "question_id % 50 as user_id", "case when question_id % 2 = 0 then array('office', 'the', 'form') else array('desk', 'ander') end as terms", "case when question_id % 4 = 1 then array('desk') else cast(array() as array<string>) end as named")


def graph_hits(spark, d, questions):
    access = acl(spark, d)
    own = access.members.join(questions.select("user_id").distinct(), "user_id", "left_semi")
    return G.graph_topk(questions, relations(spark, d), for_readers(access.documents, own), 10, "off", (("that", "requires", "form"),))


@register("f12_graph_topk", f"with {RELATIONS}, {ASKERS}, {GRAPH_TOP} select question_id, src, dst, type, doc_id, chunk_index, score, rank from gt")
def _(spark, d):
    return graph_hits(spark, d, askers(spark, d))


@register("f13_graph_overview", f"with {RELATIONS}, {ENTITIES} select (select count(*) from ent) as entities, (select count(*) from rel) as relations, (select count(*) from rel where status = 'pending') as pending, (select count(distinct doc_id) from rel) as documents")
def _(spark, d):
    return G.graph_overview(entities(spark, d), relations(spark, d))


@register("f14_graph_documents", f"with {COUNTS} select d.doc_id, d.title, coalesce(entities, 0) as entities, coalesce(relations, 0) as relations, coalesce(pending, 0) as pending, case when relations > 0 then 'extracted' else 'not_extracted' end as status from {{docs}} d left join gc using (doc_id)")
def _(spark, d):
    return G.graph_documents(docs(spark, d), G.graph_counts(relations(spark, d)))


@register("f15_apply_reviews", f"with {RELATIONS} select case when doc_id % 5 = 0 and type = 'handled_by' then 'approved' else status end as status, count(*) as n from rel group by 1")
def _(spark, d):
    r = relations(spark, d)
    reviews = r.where("doc_id % 5 = 0 and type = 'handled_by'").select("src", "dst", "type", "doc_id").distinct().withColumn("new_status", F.lit("approved"))
    return G.apply_reviews(r, reviews).groupBy("status").agg(F.count("*").alias("n"))


@register("f16_extract_graph", f"with {RULE_GRAPH} select *, case when relations > 0 then 'extracted' else 'empty' end as status from (select doc_id, count(*) filter (chunk_index >= 80 or length(content) < 20) as skipped, coalesce((select count(*) from ug where ug.doc_id = c.doc_id and ug.chunk_index < 80 and exists (select 1 from {{chunks}} k where k.doc_id = ug.doc_id and k.chunk_index = ug.chunk_index and length(k.content) >= 20)), 0) as relations from {{chunks}} c group by 1)")
def _(spark, d):
    return G.extract_graph(chunks(spark, d), RULES)


@register("f16_replace_graph", f"""with {RULE_GRAPH}, fit as (select doc_id, chunk_index from {{chunks}} where chunk_index < 80 and length(content) >= 20), g as (select ug.*, case when confidence >= 0.85 then 'auto' else 'pending' end as status from ug join fit using (doc_id, chunk_index) where doc_id % 3 <> 0 or type = 'handled_by'),
    ge as (select doc_id, count(*) * 2 as entities from g group by 1), gr as (select doc_id, count(*) as relations, count(*) filter (status = 'pending') as pending, string_agg(distinct type, ',' order by type) as types from g group by 1)
    select doc_id, coalesce(relations, 0) as relations, coalesce(pending, 0) as pending, coalesce(entities, 0) as entities, coalesce(types, '') as types, case when relations > 0 then 'ready' else 'empty' end as status from {{docs}} left join gr using (doc_id) left join ge using (doc_id)""")
def _(spark, d):
    """All documents' relations, then those of every third document extracted again by one rule, twice by mistake."""
    tables, ids = Tables(spark, shared_folder(spark)), docs(spark, d).select("doc_id")
    G.replace_graph(tables, "all", G.graph_of(chunks(spark, d), RULES), ids)
    for _ in range(2):
        again = ids.where("doc_id % 3 = 0")
        G.replace_graph(tables, "again", G.graph_of(chunks(spark, d).join(again, "doc_id", "left_semi"), RULES[1:2]), again)
    types = tables.read("relations").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    entities = tables.read("entities").groupBy("doc_id").agg(F.count("*").alias("entities"))
    return tables.read("status").join(types, "doc_id", "left").join(entities, "doc_id", "left").fillna({"types": "", "entities": 0}).select("doc_id", "relations", "pending", "entities", "types", "status")


@register("f17_relation_view", f"with {RELATIONS} select doc_id, title, src || case type when 'requires' then ' requires ' else ' is related to ' end || dst as sentence, status from rel join {{docs}} using (doc_id)")
def _(spark, d):
    return G.relation_view(relations(spark, d), docs(spark, d), {"requires": "requires"})
