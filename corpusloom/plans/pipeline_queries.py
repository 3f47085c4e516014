"""The whole retrieval as a registered query, with its SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import ingest, pipeline
from ..operators import retrieval as R
from ..operators import wiki as W
from ..operators.components import keep
from ..operators.vectors import vector_topk
from ..registry import register
from ..sources.model import view
from .document_queries import chunks, docs
from .graph_queries import GRAPH_TOP, RELATIONS, graph_hits
from .retrieval_queries import BUCKETS, DIVERSE, EVIDENCE, KINDS, RERANKED, ROUTES, graded, profiled, titled  # noqa: F401
from .wiki_queries import WIKI_TOP, pages

NONE = "cast(array() as array<string>)"


def questions(spark, d):
    q = view(spark, d, "naming").withColumn("terms", F.array_sort(R.relevance_terms(F.col("question"))))
    q = R.label_by_markers(q, "question", KINDS, "text", "route").withColumn("strict", F.contains(F.lower("question"), F.lit("oned")))
    return R.graph_flags(q, ["that", "with"], ["ofthe"])


def of_chunks(known, found, channel):
    """Contexts of chunks found (question_id, doc_id, chunk_index, score, rank). These are few; as a kept table their size
    is known, so that Spark need not shuffle all texts (known) to meet them."""
    both = keep(found).join(known, ["doc_id", "chunk_index"])
    return both.select("question_id", F.lit(channel).alias("channel"), "doc_id", F.concat(F.lit("chunk-"), "chunk_index").alias("key"), "title", "content", "score", "rank")


def by_vectors(spark, d, asked):
    own = ingest.hash_vectors(chunks(spark, d), ["doc_id", "chunk_index"], "content")
    return vector_topk(ingest.hash_vectors(asked, ["question_id"], "question"), own, 10, ("doc_id", "chunk_index"), digits=6, dim=512)


def scored(spark, d, contexts):
    """reranked and mismatch of contexts with question and terms; those without a document are graded as good."""
    has = lambda c: F.contains(F.lower(c), F.lit("that"))
    known = contexts.join(graded(spark, d), "doc_id", "left").fillna({"penalty": 0.0})
    known = known.withColumns({"section": F.col("key") == "chunk-0", "mismatch": has("question") & ~has("content")})
    return R.rerank_score(profiled(known), EVIDENCE)


def by_text(spark, d, known, asked):
    """Keyword and vector candidates of documents that aren't blocked, re-ranked and selected."""
    words = R.keyword_topk(asked, known, 10).drop("matched")
    both = R.merge_unique(words, by_vectors(spark, d, asked), 16).withColumn("rank", F.col("merged"))
    fit = of_chunks(known, both, "text").join(graded(spark, d).where("grade <> 'blocked'").select("doc_id"), "doc_id", "left_semi")
    return pipeline.best_of(fit, asked, partial(scored, spark, d), 6, 2).withColumn("rank", F.col("place"))


def by_metadata(spark, d, asked):
    found = R.metadata_topk(asked.select("question_id", "terms", F.lit(".md").alias("wants"), (F.col("question_id") % 4 == 0).alias("newest")), docs(spark, d), 5)
    both = found.join(docs(spark, d).select("doc_id", "title", "filename"), "doc_id")
    return both.select("question_id", F.lit("metadata").alias("channel"), "doc_id", F.lit("metadata").alias("key"), "title", F.concat_ws(" ", "title", "filename").alias("content"), "score", "rank")


def by_table(known, asked):
    found = of_chunks(known, R.keyword_topk(asked, known, 10), "table")
    return found.where(F.contains("content", F.lit("|")))


def by_wiki(spark, d, asked):
    both = keep(W.wiki_topk(asked, pages(spark, d), 5)).join(pages(spark, d), "slug").join(asked.select("question_id", "terms"), "question_id")
    both = both.withColumn("content", F.left(F.concat_ws("\n", "title", "summary", "body"), F.lit(700))).withColumn("matched", F.filter("terms", lambda t: F.contains(F.lower("content"), t)))
    quotes = F.when(F.col("summary") == "", F.expr(NONE)).otherwise(F.array("summary"))
    return both.select("question_id", F.lit("wiki").alias("channel"), "doc_id", F.concat(F.lit("wiki-"), "slug").alias("key"), "title", "content", "score", "rank", "matched", quotes.alias("quotes"))


def by_graph(spark, d, asked):
    seekers = asked.selectExpr("question_id", "question", "question_id % 50 as user_id", "case when question_id % 2 = 0 then array('office', 'the', 'form') else array('desk', 'ander') end as terms", f"{NONE} as named")
    key = F.concat_ws("-", F.lit("graph"), "type", "src", "dst", "chunk_index")
    return graph_hits(spark, d, seekers).where("rank <= 8").select("question_id", F.lit("graph").alias("channel"), "doc_id", key.alias("key"), F.lit("").alias("title"), F.concat_ws(" ", "src", "type", "dst").alias("content"), "score", "rank")


def by_title(spark, d, known, asked):
    return of_chunks(known, R.title_contexts(keep(R.title_matches(asked, docs(spark, d))), asked, known, 8), "title")


def best_sql(source, tag, n):
    """Re-ranking and selection of source as div{tag}, two a document."""
    sql = f"{RERANKED}, {DIVERSE}".replace("{ctx}", source).replace("least(6, count", f"least({n}, count").replace("place <= 6", f"place <= {n}")
    for name in ("rr", "ranked", "e1", "e2", "e3", "e4", "diverse"):
        sql = sql.replace(f"from {name})", f"from {name}{tag})").replace(f"from {name} ", f"from {name}{tag} ").replace(f"{name} as (", f"{name}{tag} as (")
    return sql


KNOWN = "coalesce(case grade when 'blocked' then 0.45 when 'poor' then 0.18 end, 0.0) as penalty, chunk_index = 'chunk-0' as section, contains(lower(question), 'that') and not contains(lower(content), 'that') as mismatch"
VECTORS = """et as (select 'q' as kind, question_id as a, 0 as b, unnest(regexp_extract_all(lower(question), '[一-鿿]|[a-z0-9_]+')) as token from {naming} union all select 'c', doc_id, chunk_index, unnest(regexp_extract_all(lower(content), '[一-鿿]|[a-z0-9_]+')) from {chunks}),
    es as (select kind, a, b, cast('0x' || substr(md5(token), 1, 8) as bigint) % 512 as slot, sum(case when cast('0x' || substr(md5(token), 9, 2) as bigint) % 2 = 0 then 1 else -1 end) as w from et group by all),
    ew as materialized (select *, w / sqrt(sum(w * w) over (partition by kind, a, b)) as x from es where w <> 0),
    ev as (select q.a as question_id, c.a as doc_id, c.b as chunk_index, round(cast(sum(q.x * c.x) as double), 6) as score from ew q join ew c on q.kind = 'q' and c.kind = 'c' and q.slot = c.slot group by 1, 2, 3),
    vt as (select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_index) as rank from ev qualify rank <= 10)"""

E46 = (
    f"with {ROUTES.replace('{asked}', '{asked_naming}')}, qc as (select *, regexp_replace(lower(question), '\\s+', '', 'g') as c from ro), qf as materialized (select *, contains(lower(question), 'oned') as strict, gc as graph_check, gc and contains(c, 'ofthe') and route <> 'table' as graph_primary from (select *, (contains(c, 'that') or contains(c, 'with')) and route not in ('metadata', 'summary') as gc from qc)), "
    + WIKI_TOP.replace("{asked}", "{asked_naming}")
    + r""", pg as materialized (select question_id, 'wiki' as channel, doc_id, 'wiki-' || slug as key, title, content, score, rank, list_filter(terms, lambda t: contains(lower(content), t)) as m, case when summary = '' then [] else [summary] end as quotes from (select wt.question_id, wt.slug, wt.score, wt.rank, p.doc_id, p.title, p.summary, left(concat_ws(chr(10), p.title, p.summary, p.body), 700) as content, qf.terms from wt join {wiki_pages} p using (slug) join qf using (question_id) where route <> 'table')),
    gw as (select question_id, min(own) as weakest, count(*) as docs from (select question_id, doc_id, max(score) as own from pg group by 1, 2) group by 1),
    gf as (select question_id, count(*) as n, max(score) as best, len(list_distinct(flatten(list(m)))) as terms, sum(len(quotes)) as quoted, regexp_replace(lower(string_agg(content || ' ' || array_to_string(quotes, ' '), ' ')), '\s+', '', 'g') as body from pg group by 1),
    gd as materialized (select q.question_id, not (n is null or best < 0.92 or gf.terms < 2 or quoted = 0 or (docs > 1 and weakest < 0.5) or (docs < 2 and contains(lower(question), 'than')) or len(list_filter(regexp_extract_all(question, '[0-9]+(?:\.[0-9]+)?%?'), lambda x: not contains(body, x))) > 0) as direct from qf q left join gf using (question_id) left join gw using (question_id)),
    lf as materialized (select qf.* from qf join gd using (question_id) where not direct), """
    + VECTORS
    + """, mg as (select question_id, doc_id, chunk_index, score, 0 as source, rank from {top_naming} union all select question_id, doc_id, chunk_index, score, 1, rank from vt), mo as (select * from mg qualify row_number() over (partition by question_id, doc_id, chunk_index order by source, rank) = 1), mm as (select *, row_number() over (partition by question_id order by source, rank, doc_id, chunk_index) as merged from mo qualify merged <= 16),
    ca as (select *, """
    + KNOWN
    + """ from (select mm.question_id, mm.doc_id, 'chunk-' || cast(mm.chunk_index as string) as chunk_index, mm.score, mm.merged as rank, c.content, dd.title, lf.terms, lf.question, g.grade from mm join lf using (question_id) join {chunks} c using (doc_id, chunk_index) join {docs} dd using (doc_id) join {graded} g using (doc_id) where g.grade <> 'blocked' and lf.route not in ('table', 'metadata'))), """
    + best_sql("ca", "1", 6)
    + """, ms as (select lf.question_id, doc_id, round(cast(least(1.0, 0.18 + hits + case when ends_with(filename, '.md') then 0.2 else 0 end + case when question_id % 4 = 0 then 0.18 else 0 end) as double), 6) as score, title, title || ' ' || filename as content from (select question_id, route, unnest([true]) as one, terms from lf where route = 'metadata') lf, (select *, lower(title || filename || source_type) as body from {docs}) dd, lateral (select coalesce(list_sum(list_transform(list_filter(lf.terms, lambda t: contains(dd.body, t)), lambda t: case when length(t) <= 4 then 0.16 else 0.24 end)), 0) as hits) where hits > 0 or ends_with(filename, '.md') or question_id % 4 = 0),
    bs as materialized (select question_id, 'text' as channel, doc_id, chunk_index as key, title, content, score, place as rank from diverse1
        union all select question_id, 'metadata', doc_id, 'metadata', title, content, score, row_number() over (partition by question_id order by score desc, doc_id) as rank from ms qualify rank <= 5
        union all select t.question_id, 'table', t.doc_id, 'chunk-' || cast(t.chunk_index as string), dd.title, c.content, t.score, t.rank from {top_naming} t join lf using (question_id) join {chunks} c using (doc_id, chunk_index) join {docs} dd using (doc_id) where lf.route = 'table' and contains(c.content, '|')),
    wp as (select question_id, channel, doc_id, key, title, content, score, rank from pg where question_id in (select question_id from lf)),
    mx as (select *, 0 as tier from wp union all select *, 1 from bs where question_id in (select question_id from wp)), my as (select * from mx qualify row_number() over (partition by question_id, doc_id, key order by tier, rank) = 1), mz as (select *, row_number() over (partition by question_id order by tier, rank, doc_id, key) as place from my qualify place <= 16),
    cb as (select *, """
    + KNOWN
    + """ from (select mz.question_id, channel, doc_id, key as chunk_index, score, place as rank, content, title, terms, question, grade from mz join lf using (question_id) left join {graded} using (doc_id))), """
    + best_sql("cb", "2", 8)
    + f""", {RELATIONS}, q as (select question_id, question, cast(question_id % 50 as bigint) as user_id, case when question_id % 2 = 0 then ['office', 'the', 'form'] else ['desk', 'ander'] end as terms, [] as named from lf where graph_check and route <> 'table'), """
    + GRAPH_TOP
    + """, nm as (select question_id, doc_id, terms from lf join {docs} on list_contains(regexp_split_to_array(lower(question), '[^a-z0-9-]+'), lower(title)) where route <> 'table'),
    ns as (select question_id, doc_id, 'chunk-' || cast(chunk_index as string) as key, chunk_index, round(cast(least(0.99, 0.86 + least(0.12, 0.015 * len(list_filter(terms, lambda x: contains(lower(title || ' ' || content), x)))) + least(0.08, 0.02 * len(list_filter(terms, lambda x: contains(lower(title), x))))) as double), 6) as score from nm join {chunks} using (doc_id) join {docs} using (doc_id)), nt as (select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_index) as rank from ns qualify rank <= 8),
    fl as (select question_id, question_id in (select question_id from nt) as named, graph_primary and question_id in (select question_id from gt where rank <= 8) and question_id not in (select question_id from nt) as leads from lf),
    pt as (select question_id, 'title' as channel, doc_id, key, score, rank, 0 as tier from nt
        union all select question_id, channel, doc_id, chunk_index, score, place, 2 from diverse2 join fl using (question_id) where not leads
        union all select question_id, channel, doc_id, key, score, rank, 2 from bs join fl using (question_id) where not leads and question_id not in (select question_id from wp)
        union all select question_id, 'graph', doc_id, concat_ws('-', 'graph', type, src, dst, cast(chunk_index as string)), score, rank, case when named then 3 else 1 end from gt join fl using (question_id) where rank <= 8),
    pk as (select *, max(case when doc_id % 5 < 4 then 1 else 0 end) over (partition by question_id) as fitting from pt),
    al as (select question_id, channel, doc_id, key, score, rank, tier from pk where doc_id % 5 < 4 or fitting = 0 union all select question_id, channel, doc_id, key, score, rank, 0 from pg where question_id in (select question_id from gd where direct)),
    ao as (select * from al qualify row_number() over (partition by question_id, doc_id, key order by tier, rank) = 1), ap as (select *, row_number() over (partition by question_id order by tier, rank, doc_id, key) as place from ao qualify place <= 8),
    hd as (select qf.question_id, case when direct then 'wiki' when leads then 'graph' when route in ('metadata', 'table') then route else 'hybrid' end as backend, case when direct then 'wiki' when leads then 'text' else route end as r, (select count(*) from ap where ap.question_id = qf.question_id) as n from qf join gd using (question_id) left join fl using (question_id)),
    hr as (select question_id, backend, case when r = 'table' and n = 0 then 'table_route_no_data_rows' when r = 'table' then 'table_rows_found' when r = 'metadata' and n = 0 then 'metadata_route_no_sources' when r = 'metadata' then 'metadata_sources_found' when r = 'summary' and n = 0 then 'summary_route_no_accessible_documents' when r = 'summary' then 'summary_sources_found' when n = 0 then 'text_route_no_contexts' else 'text_contexts_found' end as reason from hd)
    select question_id, backend, reason, not contains(reason, '_no_') as sufficient, channel, doc_id, key, round(score, 6) as score, place from hr left join ap using (question_id)"""
)


@register("e46_retrieve", E46)
def retrieve(spark, d):
    # all channels read the same chunks, so these are cut and titled once
    known = keep(titled(spark, d).select("doc_id", "chunk_index", "title", "content"))
    routes = {"text": partial(by_text, spark, d, known), "metadata": partial(by_metadata, spark, d), "table": partial(by_table, known)}
    kinds = docs(spark, d).select("doc_id", (F.col("doc_id") % 5).cast("string").alias("kind"))
    wiki, graph, title, score = partial(by_wiki, spark, d), partial(by_graph, spark, d), partial(by_title, spark, d, known), partial(scored, spark, d)
    return pipeline.retrieve(questions(spark, d), wiki, routes, graph, title, score, kinds, ["0", "1", "2", "3"], least=0.92, strong=0.5, several=("than",), keep=keep)
