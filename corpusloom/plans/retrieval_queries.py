"""Registered queries of batch retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.components import keep
from ..operators.vectors import vector_topk
from ..registry import register
from ..sources.model import view
from .document_queries import chunks, docs

DUCK_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9_]{{2,}}')"


def asked(spark, d):
    return view(spark, d, "questions").withColumn("terms", F.array_sort(R.relevance_terms(F.col("question"))))


def titled(spark, d):
    return chunks(spark, d).join(docs(spark, d).select("doc_id", "title"), "doc_id")


def top(spark, d):
    return R.keyword_topk(asked(spark, d), titled(spark, d), 10)


PENALTY = {"blocked": 0.45, "poor": 0.18}
EVIDENCE = ["tion", "edly", "wh"]
PROFILE = {"intent": (["the", "ing", "oned"], 0.08, 0.2), "conflict": (["ander", "erth"], -0.2, -0.3)}
KINDS = [("table", ["tionth"]), ("summary", ["ent"]), ("metadata", ["erea"])]


def graded(spark, d):
    grades = view(spark, d, "graded")
    return grades.withColumn("penalty", F.coalesce(*[F.when(F.col("grade") == g, x) for g, x in PENALTY.items()], F.lit(0.0)))


def contexts(spark, d):
    """Candidates with all that is known of them."""
    both = top(spark, d).drop("matched").join(titled(spark, d).drop("page"), ["doc_id", "chunk_index"]).join(asked(spark, d), "question_id").join(graded(spark, d), "doc_id")
    has = lambda c: F.contains(F.lower(c), F.lit("that"))
    return both.withColumns({"section": F.col("chunk_index") == 0, "mismatch": has("question") & ~has("content")})


def routed(spark, d):
    return R.label_by_markers(asked(spark, d), "question", KINDS, "text", "route")


def joined(c, sep=","):
    return F.array_join(F.array_sort(c), sep)


def term_query(name, fn, sql):
    @register(name, sql)
    def _(spark, d):
        return view(spark, d, "questions").select("question_id", joined(fn(F.col("question"))).alias("terms"))


_sorted = "select question_id, array_to_string(list_sort({0}), ',') as terms from {{questions}}"
term_query("e01_relevance_terms", R.relevance_terms, _sorted.format(f"list_distinct({DUCK_WORDS.format('question')})"))
term_query("e02_keyword_terms", lambda c: R.keyword_terms(c), "select question_id, array_to_string(list_sort(list(t)), ',') as terms from (select question_id, t, row_number() over (partition by question_id order by length(t) desc, t) as k from (select distinct question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9_]{{2,}}')) as t from {questions})) where k <= 80 group by 1".replace("{{2,}}", "{2,}"))
term_query("e03_table_terms", R.table_terms, "select question_id, array_to_string(list_sort(list(t)), ',') as terms from (select question_id, t, row_number() over (partition by question_id order by length(t) desc, t) as k from (select distinct question_id, unnest(list_concat(regexp_extract_all(lower(question), '[a-z0-9_]{2,}'), regexp_extract_all(question, '[0-9]+'))) as t from {questions})) where k <= 120 group by 1")
term_query("e04_wiki_terms", lambda c: R.wiki_terms(c, ["the", "of", "and"]), _sorted.format(f"list_filter(list_distinct({DUCK_WORDS.format('question')}), lambda t: t not in ('the', 'of', 'and'))"))
term_query("e04_phrases", R.phrases, "select question_id, array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(question, '[\\s,.;:!?，。；：！？]+'), lambda p: lower(p)), lambda p: length(p) between 4 and 12)), ',') as terms from {questions}")
term_query("e05_topic_tokens", lambda c: R.topic_tokens(c, ["with", "from"]), _sorted.format("list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]{2,}')), lambda t: length(t) >= 4 and t not in ('with', 'from') and not regexp_matches(t, '^[0-9_]+$'))"))


@register("e07_expand_terms", "select question_id, array_to_string(list_sort(list_distinct(list_concat(terms, case when contains(lower(question), 'that') then ['this'] else [] end))), ',') as terms from {asked}")
def _(spark, d):
    return R.expand_terms(asked(spark, d), {"that": ["this"]}).select("question_id", joined("terms").alias("terms"))


@register("e06_normalize_text")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(R.normalize_text(F.col("text"))).alias("normal_md5"))


@register("e07_expand_questions", "select question_id, case when contains(lower(question), 'that') then 2 else 0 end + len(terms) - case when contains(lower(question), 'that') and list_contains(terms, 'thing') then 1 else 0 end as n from {asked}")
def _(spark, d):
    return R.expand_terms(asked(spark, d), {"that": ["thing", "idea!"]}).select("question_id", F.size("terms").alias("n"))


@register("e08_vector_topk", """with q as (select vec_id as question_id, embedding as q from embeddings where vec_id % 20 = 0) select question_id, vec_id, score, rank from (select question_id, vec_id, s as score, row_number() over (partition by question_id order by s desc, vec_id) as rank from
    (select question_id, vec_id, list_sum(list_transform(range(1, 65), lambda i: cast(q[i] as double) * cast(embedding[i] as double))) / (sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) * sqrt(list_sum(list_transform(q, lambda x: cast(x as double) * cast(x as double))))) as s from q, embeddings)) where rank <= 10""")
def _(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return vector_topk(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "question_id"), v, 10)


@register("e09_keyword_topk", "select * from {top}")
def _(spark, d):
    return top(spark, d)


def two_lists(spark, d):
    # both lists come from one search
    t = keep(top(spark, d).drop("matched"))
    return t.where("rank <= 4"), t.where("rank % 2 = 0")


MERGED = "m0 as (select *, case when rank <= 4 then 0 else 1 end as source from {top} where rank <= 4 or rank % 2 = 0), merged as (select question_id, doc_id, chunk_index, score, source, row_number() over (partition by question_id order by source, rank, doc_id, chunk_index) as merged from m0 qualify merged <= 6)"


def merged(spark, d):
    return R.merge_unique(*two_lists(spark, d), 6)


@register("e10_merge_unique", f"with {MERGED} select * from merged")
def _(spark, d):
    return merged(spark, d)


@register("e11_penalize", "select question_id, doc_id, chunk_index, greatest(0.0, score - case grade when 'blocked' then 0.45 when 'poor' then 0.18 else 0 end) as score from {top} join {graded} using (doc_id)")
def _(spark, d):
    return R.penalize(top(spark, d), graded(spark, d)).select("question_id", "doc_id", "chunk_index", "score")


@register("e12_relevance_gate", "select question_id, doc_id, chunk_index, least(12, len(list_filter(terms[2:], lambda t: contains(lower(content), t)))) as n from {ctx} where n > 0 or score >= 0.5")
def _(spark, d):
    c = contexts(spark, d).withColumn("terms", F.slice("terms", 2, 100))
    return R.relevance_gate(c, 0.5).select("question_id", "doc_id", "chunk_index", F.size("matched").alias("n"))


@register("e13_plan_bucket", "select question_id, bucket, case bucket when 'deep' then 12 when 'broad' then 10 when 'precise' then 5 else 8 end as \"limit\", case bucket when 'deep' then 0.28 when 'broad' then 0.25 when 'precise' then 0.4 else 0.32 end as least from (select question_id, case when contains(lower(question), 'ente') then 'deep' when contains(lower(question), 'that') then 'broad' when contains(lower(question), 'of') then 'precise' else 'balanced' end as bucket from {questions})")
def _(spark, d):
    return R.plan_bucket(view(spark, d, "questions"), ["ente"], ["that"], ["of"]).drop("question")


@register("e14_complexity", "select question_id, round(case when contains(lower(question), 'the') then 0.3 else 0 end + case when contains(lower(question), 'and') then 0.2 else 0 end + 0.01 * greatest(0, len(string_split(question, ' ')) - 10), 4) as complexity from {questions}")
def _(spark, d):
    return R.complexity(view(spark, d, "questions"), {"the": 0.3, "and": 0.2}).select("question_id", "complexity")


@register("e15_rewrite", "select question_id, left(case when contains(lower(question), 'the') and not contains(lower(question), 'zzz') then question || ' zzz' else question || ' ' end, 360) as rewritten from {questions}")
def _(spark, d):
    return R.rewrite(view(spark, d, "questions"), {"the": ["zzz", "the"]}).select("question_id", "rewritten")


RERANKED = """rr as (select *, n / len(terms) as coverage, round(cast(0.35 * least(score, 1.0) + 0.30 * (n / len(terms)) + least(0.24, 0.08 * proof) + least(0.22, 0.07 * titled) + case when section then 0.16 else 0 end + intent + conflict - penalty - case when mismatch then 0.3 else 0 end - least(0.08, 0.004 * (rank - 1)) as double), 6) as reranked
    from (select *, least(0.2, 0.08 * (contains(lower(content), 'the')::int + contains(lower(content), 'ing')::int + contains(lower(content), 'oned')::int)) as intent, greatest(-0.3, -0.2 * (contains(lower(content), 'ander')::int + contains(lower(content), 'erth')::int)) as conflict,
        contains(lower(title || ' ' || content), 'tion')::int + contains(lower(title || ' ' || content), 'edly')::int + contains(lower(title || ' ' || content), 'wh')::int as proof, len(list_filter(terms, lambda t: contains(lower(title || ' ' || content), t))) as n, len(list_filter(terms, lambda t: contains(lower(title), t))) as titled from {ctx}))"""


def profiled(c):
    """Contexts with their profile, and a penalty that also counts a mismatch of topic."""
    return R.profile_features(c, PROFILE).withColumn("penalty", F.col("penalty") + F.when(F.col("mismatch"), 0.3).otherwise(0.0))


def reranked(spark, d):
    return R.rerank_score(profiled(contexts(spark, d)), EVIDENCE)


BUCKETS = "pb as (select question_id, case when contains(lower(question), 'ente') then 'deep' when contains(lower(question), 'that') then 'broad' when contains(lower(question), 'of') then 'precise' else 'balanced' end as bucket from {questions})"


@register("e16_evidence_quality", f"with {BUCKETS}, e as (select question_id, max(score) as best, avg(score) filter (rank <= 3) as mean3, count(distinct doc_id) as documents, count(*) as contexts, any_value(terms) as terms, string_agg(lower(title || ' ' || content), ' ' order by rank) as body from {{ctx}} where rank <= 6 group by 1), q as (select question_id, contexts, documents, case bucket when 'precise' then 0.42 when 'deep' then 0.52 else 0.46 end as threshold, round(cast(least(1.0, 0.45 * best + 0.25 * mean3 + 0.45 * least(len(list_intersect(terms, regexp_extract_all(body, '[a-z0-9_]{{{{2,}}}}'))) / len(terms), 0.45) + 0.12 * least(documents, 3) / 3) as double), 6) as quality from e join pb using (question_id)) select *, quality >= threshold and contexts >= case bucket when 'deep' then 3 when 'broad' then 3 when 'precise' then 1 else 2 end as enough from (select q.*, bucket from q join pb using (question_id))".replace("{{2,}}", "{2,}").replace("select *, quality", "select question_id, contexts, documents, threshold, quality, quality"))
def _(spark, d):
    plans = R.plan_bucket(view(spark, d, "questions"), ["ente"], ["that"], ["of"]).withColumn("min_contexts", R.first_of([(F.col("bucket") == b, n) for b, n in R.MIN_CONTEXTS.items()], 5))
    return R.evidence_quality(contexts(spark, d), plans).select("question_id", "contexts", "documents", F.col("threshold").cast("decimal(2,2)").alias("threshold"), "quality", "enough")


ASPECTS = {"domain": [("process", ["erth"]), ("policy", ["the"])], "task": [("compare", ["than"]), ("list", ["all"])], "actor": [("manager", ["ander"]), ("staff", ["sh"])], "topic": [("forms", ["oned"]), ("leave", ["at "])]}


@register("e17_query_profile", "select question_id, case when contains(q, 'erth') then 'process' when contains(q, 'the') then 'policy' else 'general' end as domain, case when contains(q, 'than') then 'compare' when contains(q, 'all') then 'list' else 'general' end as task, case when contains(q, 'ander') then 'manager' when contains(q, 'sh') then 'staff' else 'general' end as actor, case when contains(q, 'oned') then 'forms' when contains(q, 'at ') then 'leave' else 'general' end as topic from (select question_id, lower(question) as q from {questions})")
def _(spark, d):
    return R.query_profile(view(spark, d, "questions"), ASPECTS).drop("question")


@register("e18_profile_features", "select question_id, doc_id, chunk_index, least(0.2, 0.08 * (contains(lower(content), 'the')::int + contains(lower(content), 'ing')::int + contains(lower(content), 'oned')::int)) as intent, greatest(-0.3, -0.2 * (contains(lower(content), 'ander')::int + contains(lower(content), 'erth')::int)) as conflict from {ctx}")
def _(spark, d):
    return R.profile_features(contexts(spark, d), PROFILE).select("question_id", "doc_id", "chunk_index", "intent", "conflict")


@register("e19_rerank_score", f"with {RERANKED} select question_id, doc_id, chunk_index, reranked from rr")
def _(spark, d):
    return reranked(spark, d).select("question_id", "doc_id", "chunk_index", "reranked")


STRICT = "contains(lower(question), 'oned')"
DIVERSE = f"""ranked as (select *, {STRICT} as strict, row_number() over (partition by question_id order by reranked desc, doc_id, chunk_index) as r2 from rr),
    e1 as (select *, not (mismatch and (reranked < 0.45 or strict)) as fits from ranked), e2 as (select *, fits and row_number() over (partition by question_id, doc_id, fits order by r2) <= 2 as early from e1),
    e3 as (select *, least(6, count(*) filter (early) over (partition by question_id)) as ahead from e2), e4 as (select *, row_number() over (partition by question_id order by early desc, r2) as place from e3 where early or not (strict and mismatch and ahead >= 3)),
    diverse as (select * from e4 where place <= 6 and (early or place <= 4))"""


def best_first(spark, d):
    ordered = R.ranked(reranked(spark, d).drop("rank"), 1 << 30, "doc_id", "chunk_index", by="reranked")
    return ordered.withColumn("strict", F.contains(F.lower("question"), F.lit("oned")))


@register("e20_diversify", f"with {RERANKED}, {DIVERSE} select question_id, doc_id, chunk_index, place from diverse")
def _(spark, d):
    return R.diversify(best_first(spark, d), 6, 2).select("question_id", "doc_id", "chunk_index", "place")


@register("e21_expand_neighbors", """with n as (select question_id, doc_id, chunk_index + s as chunk_index, max(greatest(0.1, score - 0.03 * abs(s))) as score from (select *, unnest([-2, -1, 1, 2]) as s from {top}) group by 1, 2, 3)
    select question_id, doc_id, chunk_index, score, row_number() over (partition by question_id order by score desc, doc_id, chunk_index) as rank from n where not exists (select 1 from {top} t where t.question_id = n.question_id and t.doc_id = n.doc_id and t.chunk_index = n.chunk_index) and exists (select 1 from {chunks} c where c.doc_id = n.doc_id and c.chunk_index = n.chunk_index) qualify rank <= 5""")
def _(spark, d):
    return R.expand_neighbors(top(spark, d).select("question_id", "doc_id", "chunk_index", "score"), chunks(spark, d), 2, 5)


@register("e22_section_topk", """with s as (select doc_id, chunk_index as line, list_distinct(regexp_extract_all(lower(left(content, 40) || ' ' || content), '[a-z0-9_]{2,}')) as nw, list_distinct(regexp_extract_all(lower(left(content, 40)), '[a-z0-9_]{2,}')) as hw, list_distinct(regexp_extract_all(lower(title), '[a-z0-9_]{2,}')) as dw from {chunks} join {docs} using (doc_id)),
    h as (select question_id, doc_id, line, len(list_intersect(terms, nw)) as n, len(list_intersect(terms, hw)) as h, len(list_intersect(terms, dw)) as w from {asked}, s where n > 0 or w > 0),
    x as (select question_id, doc_id, line, round(cast(least(0.92, 0.18 + least(0.56, 0.08 * n) + least(0.22, 0.07 * h) + least(0.12, 0.03 * w)) as double), 6) as score from h)
    select question_id, doc_id, line, score, row_number() over (partition by question_id, doc_id order by score desc, line) as rank from x qualify rank <= 2""")
def _(spark, d):
    sections = titled(spark, d).select("doc_id", F.col("chunk_index").alias("line"), F.left("content", F.lit(40)).alias("title"), F.col("content").alias("summary"), F.col("title").alias("doc_title"))
    return R.section_topk(asked(spark, d), sections)


@register("e23_section_content", "select doc_id, s as start, s as \"end\", md5(left(string_agg(content, chr(10) order by page), 1800)) as m from (select doc_id, chunk_index as s from {chunks}) x join (select doc_id, chunk_index as page, content from {chunks}) p using (doc_id) where page between s - 1 and s + 1 group by 1, 2")
def _(spark, d):
    c = chunks(spark, d)
    sections = c.selectExpr("doc_id", "chunk_index as start", "chunk_index as end")
    pages = c.selectExpr("doc_id", "chunk_index as page", "content as text")
    return R.section_content(sections, pages).select("doc_id", "start", "end", F.md5("content").alias("m"))


@register("e24_process_filter", "select question_id, doc_id, chunk_index from (select *, max(case when contains(content, '|') then 0 else 1 end) over (partition by question_id) as k from {ctx}) where not contains(content, '|') or k = 0")
def _(spark, d):
    from ..operators.tables import soft_filter

    return soft_filter(contexts(spark, d), ~F.contains("content", F.lit("|")), "question_id").select("question_id", "doc_id", "chunk_index")


@register("e25_kind_filter", "select question_id, doc_id, chunk_index from (select *, max(case when doc_id % 5 = 0 then 1 else 0 end) over (partition by question_id) as k from {top}) where doc_id % 5 = 0 or k = 0")
def _(spark, d):
    from ..operators.tables import soft_filter

    return soft_filter(top(spark, d).withColumn("kind", F.col("doc_id") % 5), F.col("kind").isin(0), "question_id").select("question_id", "doc_id", "chunk_index")


ASKED_DOCS = "ad as (select user_id as question_id, ['src' || cast(user_id % 20 as string), cast(user_id * 3 % 200 as string) || '.'] as terms, case user_id % 3 when 0 then '.md' when 1 then '.pdf' else '.txt' end as wants, user_id % 4 = 0 as newest from {users})"


@register("e26_metadata_topk", f"with {ASKED_DOCS}, h as (select question_id, doc_id, created_at, coalesce(list_sum(list_transform(list_filter(terms, lambda t: contains(body, t)), lambda t: case when length(t) <= 4 then 0.16 else 0.24 end)), 0) as hits, ends_with(filename, wants) as kind, newest from ad, (select *, lower(title || filename || source_type) as body, doc_id % 100 as created_at from {{docs}})), s as (select question_id, doc_id, created_at, round(cast(least(1.0, 0.18 + hits + case when kind then 0.2 else 0 end + case when newest then 0.18 else 0 end) as double), 6) as score from h where hits > 0 or kind or newest) select question_id, doc_id, score, row_number() over (partition by question_id order by score desc, created_at desc, doc_id) as rank from s qualify rank <= 5")
def _(spark, d):
    q = view(spark, d, "users").selectExpr("user_id as question_id", "array('src' || cast(user_id % 20 as string), cast(user_id * 3 % 200 as string) || '.') as terms", "case user_id % 3 when 0 then '.md' when 1 then '.pdf' else '.txt' end as wants", "user_id % 4 = 0 as newest")
    return R.metadata_topk(q, docs(spark, d).withColumn("created_at", F.col("doc_id") % 100), 5)


NAMED = "nq as (select user_id as question_id, 'what does src' || cast(user_id % 20 as string) || '-' || cast(user_id as string) || ' say of the thing' as question from {users}), nm as (select question_id, question, doc_id, least(0.99, 0.86 + 0.01 * greatest(0, length(title) - 4)) as score from nq join {docs} on doc_id = question_id)"


def named(spark, d):
    return view(spark, d, "users").selectExpr("user_id as question_id", "'what does SRC' || cast(user_id % 20 as string) || '-' || cast(user_id as string) || ' say of the thing' as question")


@register("e27_title_matches", f"with {NAMED} select question_id, doc_id, score from nm")
def _(spark, d):
    return R.title_matches(named(spark, d), docs(spark, d))


@register("e27_title_contexts", f"""with {NAMED}, t as (select *, list_distinct(regexp_extract_all(question, '[a-z0-9_]{{2,}}')) as terms from nm), c as (select question_id, doc_id, chunk_index, round(cast(least(0.99, 0.86 + least(0.12, 0.015 * len(list_filter(terms, lambda x: contains(lower(title || ' ' || content), x)))) + least(0.08, 0.02 * len(list_filter(terms, lambda x: contains(lower(title), x))))) as double), 6) as score from t join {{chunks}} using (doc_id) join {{docs}} using (doc_id))
    select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_index) as rank from c qualify rank <= 8""")
def _(spark, d):
    q = named(spark, d).withColumn("terms", R.relevance_terms(F.col("question")))
    return R.title_contexts(R.title_matches(q, docs(spark, d)), q, titled(spark, d))


@register("e28_label_route", "select question_id, case when contains(lower(question), 'ent') then 'summary' when contains(lower(question), 'ing') then 'table' else 'text' end as route from {questions}")
def _(spark, d):
    return R.label_by_markers(view(spark, d, "questions"), "question", [("summary", ["ent"]), ("table", ["ing"])], "text", "route").select("question_id", "route")


@register("e29_label_turn", "select session_id, turn, case when length(content) < 60 then 'chat' when contains(lower(content), 'that') then 'follow-up' else 'knowledge' end as label from {messages} where role = 'user'")
def _(spark, d):
    users = view(spark, d, "messages").where("role = 'user'")
    labelled = R.label_by_markers(users, "content", [("follow-up", ["that"])], "knowledge")
    return labelled.select("session_id", "turn", F.when(F.length("content") < 60, "chat").otherwise(F.col("label")).alias("label"))


ROUTES = "ro as (select *, case when contains(lower(question), 'tionth') then 'table' when contains(lower(question), 'ent') then 'summary' when contains(lower(question), 'erea') then 'metadata' else 'text' end as route from {asked})"


@register("e30_check_evidence", f"with {ROUTES}, f as (select question_id, route, count(doc_id) as contexts, count(distinct doc_id) as documents, coalesce(max(score), 0) as best, count(*) filter (not contains(content, '|')) as r from ro left join (select * from {{ctx}} where score >= 0.9 and grade = 'good') using (question_id) group by 1, 2), x as (select question_id, route, contexts, documents, best, case when route = 'table' and r = 0 then 'table_route_no_data_rows' when route = 'table' then 'table_rows_found' when route = 'metadata' and contexts = 0 then 'metadata_route_no_sources' when route = 'metadata' then 'metadata_sources_found' when route = 'summary' and contexts = 0 then 'summary_route_no_accessible_documents' when route = 'summary' then 'summary_sources_found' when contexts = 0 then 'text_route_no_contexts' else 'text_contexts_found' end as reason from f) select *, not contains(reason, '_no_') as sufficient from x")
def _(spark, d):
    c = contexts(spark, d).where("score >= 0.9 and grade = 'good'").withColumn("is_header", F.contains("content", F.lit("|")))
    return R.check_evidence(c, routed(spark, d))


@register("e31_wiki_evidence", r"""with k as (select *, list_filter(terms, lambda t: contains(lower(content), t)) as m, case when chunk_index < 2 then [left(content, 50)] else [] end as quotes from {ctx} where score >= 0.7), w as (select question_id, min(own) as weakest, count(*) as docs from (select question_id, doc_id, max(score) as own from k group by 1, 2) group by 1),
    f as (select question_id, count(*) as n, max(score) as best, len(list_distinct(flatten(list(m)))) as terms, sum(len(quotes)) as quoted, regexp_replace(lower(string_agg(content || ' ' || array_to_string(quotes, ' '), ' ')), '\s+', '', 'g') as body from k group by 1)
    select question_id, reason, reason = 'wiki_evidence_sufficient' as sufficient from (select q.question_id, case when n is null then 'wiki_no_contexts' when best < 0.6 then 'wiki_score_below_direct_threshold' when terms < 2 then 'wiki_match_terms_too_weak' when quoted = 0 then 'wiki_sources_missing' when docs > 1 and weakest < 0.95 then 'wiki_mixed_document_confidence' when docs < 2 and contains(lower(question), 'than') then 'wiki_multi_document_evidence_missing' when len(list_filter(regexp_extract_all(question, '[0-9]+(?:\.[0-9]+)?%?'), lambda x: not contains(body, x))) > 0 then 'wiki_critical_terms_missing' else 'wiki_evidence_sufficient' end as reason from {questions} q left join f using (question_id) left join w using (question_id))""")
def _(spark, d):
    c = contexts(spark, d).where("score >= 0.7")
    c = c.withColumn("matched", R.matched_terms(c, 1 << 20)).withColumn("quotes", F.when(F.col("chunk_index") < 2, F.array(F.left("content", F.lit(50)))).otherwise(F.array().cast("array<string>")))
    return R.check_wiki_evidence(c, view(spark, d, "questions"), strong=0.95, several=("than",))


@register("e32_answer_gate", f"with {RERANKED}, g as (select *, case when rank % 5 = 0 then 'table' when rank % 7 = 0 then 'graph' else 'text' end as channel, chunk_index = 0 as is_header, len(list_filter(list_filter(terms, lambda t: contains(lower(content), t))[1:12], lambda t: t not in ('the', 'of', 'and', 'in') and length(t) >= 2)) as specific from rr) select question_id, doc_id, chunk_index from g where grade <> 'blocked' and ((channel in ('table', 'graph') and not is_header) or (channel <> 'table' and (score >= 0.95 or (specific > 0 and coverage >= 0.12 and score > 0))))")
def _(spark, d):
    c = reranked(spark, d).withColumns({"channel": F.when(F.col("rank") % 5 == 0, "table").when(F.col("rank") % 7 == 0, "graph").otherwise("text"), "is_header": F.col("chunk_index") == 0})
    return R.answer_gate(c.withColumn("matched", R.matched_terms(c)), ["the", "of", "and", "in"], 0.95).select("question_id", "doc_id", "chunk_index")


@register("e33_char_budget", "select question_id, rank, least(length(content), 2500 - before) as chars from (select *, coalesce(sum(length(content)) over (partition by question_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from {ctx}) where rank <= 5 and before < 2500")
def _(spark, d):
    return R.char_budget(contexts(spark, d), 5, 2500).select("question_id", "rank", F.length("content").alias("chars"))


@register("e34_token_budget")
def _(spark, d):
    c = contexts(spark, d).withColumn("quotes", F.array(F.left("content", F.lit(200)), F.right("content", F.lit(100))))
    return R.token_budget(c, 1000).select("question_id", "rank", F.length("content").alias("chars"), F.size("quotes").alias("quotes"))


@register("e35_cap_sources", "select question_id, doc_id, chunk_index, row_number() over (partition by question_id order by rank) as place from (select * from {top} qualify row_number() over (partition by question_id, doc_id order by rank) <= 1) qualify place <= 5")
def _(spark, d):
    return R.cap_sources(top(spark, d), 1, 5).select("question_id", "doc_id", "chunk_index", "place")


@register("e36_highlight")
def _(spark, d):
    return R.highlight(contexts(spark, d)).select("question_id", "doc_id", "chunk_index", F.size("ranges").alias("n"), F.to_json("ranges").alias("ranges"))


@register("e37_citations", "select question_id, '[' || cast(rank as string) || ']' as label, doc_id, title || ' / chunk ' || cast(chunk_index + 1 as string) as place, left(trim(content), 300) as snippet, score from {ctx}")
def _(spark, d):
    return R.citations(contexts(spark, d))


@register("e38_confidence", "select question_id, round(cast(least(1.0, max(score) + case when max(len(list_filter(terms, lambda t: contains(lower(content), t)))) > 0 then 0.12 else 0 end + case when max(section::int) = 1 then 0.08 else 0 end) as double), 4) as confidence, case when confidence < 0.35 then 'weak' else 'grounded' end as reason from {ctx} group by 1")
def _(spark, d):
    c = contexts(spark, d)
    return R.confidence(c.withColumn("matched", R.matched_terms(c)))


@register("e39_quality_notice", "select question_id, count(*) as contexts, string_agg(distinct grade, ',' order by grade) as grades, list_sort(list(distinct doc_id))[1:6] as documents from {ctx} where grade <> 'good' group by 1")
def _(spark, d):
    return R.quality_notice(contexts(spark, d))


@register("e40_retrieval_summary", f"with {MERGED} select question_id, count(*) filter (source = 0) as keyword, count(*) filter (source = 1) as vector, count(distinct doc_id) as documents, max(score) as best from merged group by 1")
def _(spark, d):
    return R.retrieval_summary(merged(spark, d))


@register("e41_context_preview", "select question_id, md5(string_agg(left(content, 400), chr(10) order by rank)) as m from (select *, sum(length(left(content, 400))) over (partition by question_id order by rank rows unbounded preceding) as chars from {ctx}) where chars <= 2000 group by 1")
def _(spark, d):
    return R.context_preview(contexts(spark, d), 400, 2000).select("question_id", F.md5("preview").alias("m"))


SENTENCES = r"""sents as (select doc_id, chunk_index, pos, sentence from (select doc_id, chunk_index, unnest(case when len(p) > 0 then p else [left(trim(content), 260)] end) as sentence, generate_subscripts(case when len(p) > 0 then p else [left(trim(content), 260)] end, 1) - 1 as pos from (select *, list_filter(list_transform(string_split(regexp_replace(content, '([.!?。！？])\s*', '\1' || chr(10), 'g'), chr(10)), lambda s: left(trim(s), 260)), lambda s: length(s) >= 12) as p from {chunks})))"""


@register("e42_top_sentences", f"with {SENTENCES} select doc_id, chunk_index, pos, score, rank from (select *, row_number() over (partition by doc_id order by score desc, chunk_index, pos) as rank from (select *, case when length(sentence) >= 40 then 1 else 0 end + case when regexp_matches(sentence, '[0-9]') then 2 else 0 end + case when regexp_matches(sentence, 'er.*th') then 3 else 0 end as score from sents)) where rank <= 5")
def _(spark, d):
    return R.top_sentences(chunks(spark, d), [("[0-9]", 2), ("er.*th", 3)], 5).drop("sentence")


@register("e43_bucket_sentences", f"with {SENTENCES} select doc_id, bucket, count(*) as n from (select doc_id, bucket, sentence from (select *, case when regexp_matches(sentence, '[0-9]') then 'numbers' when regexp_matches(sentence, 'er.*th') then 'process' else 'other' end as bucket from sents) group by 1, 2, 3 qualify row_number() over (partition by doc_id, bucket order by min(chunk_index)) <= 12) group by 1, 2")
def _(spark, d):
    return R.bucket_sentences(chunks(spark, d), [("numbers", "[0-9]"), ("process", "er.*th")]).groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))


@register("e44_focus_snippet", "select question_id, doc_id, chunk_index, substr(content, case when len(p) > 0 then greatest(1, list_min(p) - 25) else 1 end, 100) as snippet from (select *, list_filter(list_transform(terms, lambda t: strpos(lower(content), t)), lambda x: x > 0) as p from {ctx})")
def _(spark, d):
    return R.focus_snippet(contexts(spark, d), 100).select("question_id", "doc_id", "chunk_index", "snippet")


@register("e45_header_fields", "select distinct document as doc_id, '[' || sheet || '] ' || array_to_string(list_value(k1, k2, k3, k4, k5), ' | ') as highlight from {flat_rows}")
def _(spark, d):
    cells = F.concat_ws(" | ", F.lit("表头"), *[F.concat(F.lit(f"{c}1="), f"k{k}") for k, c in enumerate("ABCDE", 1)])
    sheets = view(spark, d, "flat_rows").select(F.col("document").alias("doc_id"), F.concat(F.lit("["), "sheet", F.lit("]\n"), cells, F.lit("\n表格行 2 | x")).alias("content"))
    return R.header_fields(sheets)


@register("e47_answer_mode", "select question_id, count(*) as contexts, sum(length(content)) as chars, case when count(*) >= 5 and sum(length(content)) >= 7000 then 'extractive' else 'composed' end as mode from {ctx} group by 1")
def _(spark, d):
    return R.answer_mode(contexts(spark, d))


@register("e48_dedupe_contexts", "select question_id, doc_id, chunk_index, score from {top}")
def _(spark, d):
    t = top(spark, d).select("question_id", "doc_id", "chunk_index", "score")
    return R.dedupe_contexts(t.unionByName(t.withColumn("score", F.col("score") - 0.1)))


@register("e49_graph_flags", f"with {ROUTES}, c as (select question_id, route, regexp_replace(lower(question), '\\s+', '', 'g') as q from ro), g as (select *, (contains(q, 'that') or contains(q, 'with')) and route not in ('metadata', 'summary') as graph_check from c) select question_id, graph_check, graph_check and contains(q, 'ofthe') and route <> 'table' as graph_primary from g")
def _(spark, d):
    return R.graph_flags(routed(spark, d), ["that", "with"], ["ofthe"]).select("question_id", "graph_check", "graph_primary")


@register("e50_strip_markers", "select session_id, turn, md5(trim(regexp_replace(trim(content), '\\s+$', ''))) as m from {messages}")
def _(spark, d):
    said = view(spark, d, "messages").select("session_id", "turn", F.concat(F.trim("content"), F.lit(" [S1] [S 2]【来源3】")).alias("c"))
    return said.select("session_id", "turn", F.md5(R.strip_markers(F.col("c"))).alias("m"))


@register("e51_source_diagnostics", "select question_id, rank, doc_id, chunk_index, round(score, 4) as score, case when rank % 2 = 0 then 'keyword' else 'vector' end as channel, left(content, 80) as preview from {ctx}")
def _(spark, d):
    return R.source_diagnostics(contexts(spark, d).withColumn("source", F.col("rank") % 2))


@register("e52_route_summary", f"with {ROUTES} select question_id, route, count(doc_id) as candidates, count(*) filter (score >= 0.9) as contexts, count(distinct doc_id) filter (score >= 0.9) as documents, coalesce(max(score) filter (score >= 0.9), 0) as best from ro left join {{top}} using (question_id) group by 1, 2")
def _(spark, d):
    return R.route_summary(top(spark, d).withColumn("selected", F.col("score") >= 0.9), routed(spark, d))
