"""Registered queries of conversation, feedback, operations and evaluation reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insight as I
from ..operators import retrieval as R
from ..registry import register
from ..sources.model import view
from .document_queries import docs
from .retrieval_queries import ASPECTS, contexts, top

SINCE = "2024-01-15 00:00:00"


@register("k01_status_counts", "select status as value, count(*) as n, case status when 'done' then 'Ready' else status end as label from {tasks} group by 1, 3")
def _(spark, d):
    return I.counts(view(spark, d, "tasks"), "status", {"done": "Ready"})


@register("k02_feedback_stats", f"select \"by\", value, count(*) as n from (select unnest(['status', 'root_cause', 'category', 'unresolved']) as \"by\", unnest([status, root_cause, category, case when status in ('new', 'reviewed') then 'true' else 'false' end]) as value from {{feedback}} where created_at >= timestamp '{SINCE}') group by 1, 2")
def _(spark, d):
    return I.feedback_stats(view(spark, d, "feedback"), SINCE)


PAIRED = "paired as (select *, last_value(case when role = 'user' then turn end ignore nulls) over (partition by session_id order by turn rows between unbounded preceding and 1 preceding) as question_turn from {messages})"


@register("k03_unanswered", f"with {PAIRED} select session_id, turn, question_turn from paired where role = 'assistant' and (sources = '[]' or contains(lower(content), 'not found') or contains(lower(content), 'no answer'))")
def _(spark, d):
    return I.unanswered(view(spark, d, "messages"))


@register("k04_chat_stats", "select count(*) filter (role = 'user') as questions, count(*) filter (role = 'assistant') as answers, count(distinct session_id) as sessions from {messages}")
def _(spark, d):
    return I.chat_stats(view(spark, d, "messages"))


ADOPT = "adopt as (select event_id as adoption_id, ['t' || cast(event_id % 13 as string), 't' || cast(user_id % 5 as string)] as templates, [case event_id % 4 when 0 then 'form' when 1 then 'policy' else 'guide' end, 'general'] as kinds, ts as created_at from events where event_type = 'purchase')"


def adoptions(spark, d):
    return view(spark, d, "events").where("event_type = 'purchase'").selectExpr("event_id as adoption_id", "array('t' || cast(event_id % 13 as string), 't' || cast(user_id % 5 as string)) as templates", "array(case event_id % 4 when 0 then 'form' when 1 then 'policy' else 'guide' end, 'general') as kinds", "ts as created_at")


def templates(spark, d):
    return spark.range(9).selectExpr("'t' || cast(id as string) as template")


@register("k05_adoption_stats", f"with {ADOPT}, e as (select unnest(templates) as template, kinds, created_at from adopt) select template, count(*) as wins, max(created_at) as latest, len(list_distinct(flatten(list(kinds)))) as kinds from e group by 1 order by wins desc, template limit 12")
def _(spark, d):
    return I.adoption_stats(adoptions(spark, d))


RECOMMENDED = ADOPT + ", e as (select template, unnest(kinds) as kind, created_at from (select unnest(templates) as template, kinds, created_at from adopt)), rec as (select kind, template, count(*) as wins, row_number() over (partition by kind order by count(*) desc, max(created_at) desc, template) as rank from e where cast(substr(template, 2) as int) < 9 group by 1, 2 qualify rank <= 3)"


def recommended(spark, d):
    return I.recommend_templates(adoptions(spark, d), templates(spark, d))


@register("k06_recommend_templates", f"with {RECOMMENDED} select * from rec")
def _(spark, d):
    return recommended(spark, d)


KINDS = "kinds as (select question_id, case doc_id % 3 when 0 then 'form' when 1 then 'policy' else 'guide' end as kind from {top})"


def kinds(spark, d):
    return top(spark, d).selectExpr("question_id", "case doc_id % 3 when 0 then 'form' when 1 then 'policy' else 'guide' end as kind")


@register("k07_select_templates", f"with {RECOMMENDED}, {KINDS}, tk as (select question_id, kind, row_number() over (partition by question_id order by count(*) desc, kind) as k from kinds group by 1, 2), o as (select question_id, template, min((k, rank)) as seen from (select question_id, template, k, rank from tk join rec using (kind) where k <= 3 union all select distinct question_id, 't0', 1048576, 1 from kinds) group by 1, 2) select question_id, template, row_number() over (partition by question_id order by seen, template) as place from o qualify place <= 4")
def _(spark, d):
    return I.select_templates(kinds(spark, d), recommended(spark, d))


@register("k08_operations_overview", f"select d as documents, f as risk_unresolved, u as risk_unanswered, case when f > 0 and u > 0 then 'risk_unresolved,risk_unanswered' when f > 0 then 'risk_unresolved' when u > 0 then 'risk_unanswered' else '' end as risks from (select (select count(*) from {{docs}}) as d, (select count(*) from {{feedback}} where status in ('new', 'reviewed') and created_at >= timestamp '{SINCE}') as f, (select count(*) from {{messages}} where role = 'assistant' and (sources = '[]' or contains(lower(content), 'not found') or contains(lower(content), 'no answer'))) as u)")
def _(spark, d):
    stats = I.feedback_stats(view(spark, d, "feedback"), SINCE).where("by = 'unresolved' and value = 'true'").agg(F.coalesce(F.sum("n"), F.lit(0)))
    return I.overview({"documents": docs(spark, d).agg(F.count("*")), "risk_unresolved": stats, "risk_unanswered": I.unanswered(view(spark, d, "messages")).agg(F.count("*"))})


@register("k09_feedback_search", "select feedback_id from {feedback} where status = 'new' and created_at >= timestamp '2024-01-10' and created_at < timestamp '2024-01-21' and contains(note, 'err')")
def _(spark, d):
    return I.feedback_search(view(spark, d, "feedback"), text="ERR", since="2024-01-10", until="2024-01-20", status="new").select("feedback_id")


@register("k10_feedback_updates", "select case when feedback_id % 10 = 0 then 'resolved' else status end as status, count(*) as n from {feedback} group by 1")
def _(spark, d):
    f = view(spark, d, "feedback")
    return I.apply_updates(f, f.where("feedback_id % 10 = 0").select("feedback_id", F.lit("resolved").alias("status")), "feedback_id", "status").groupBy("status").agg(F.count("*").alias("n"))


@register("k11_feedback_snapshots", f"with {PAIRED} select p.session_id * 1000 + p.turn as feedback_id, md5(q.content) as question, md5(p.content) as answer from paired p left join {{messages}} q on q.session_id = p.session_id and q.turn = p.question_turn where p.role = 'assistant'")
def _(spark, d):
    m = view(spark, d, "messages")
    f = m.where("role = 'assistant'").selectExpr("session_id * 1000 + turn as feedback_id", "session_id", "turn")
    return I.feedback_snapshots(f, m).select("feedback_id", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@register("k12_session_summaries", "select session_id, left(arg_min(content, turn) filter (role = 'user'), 28) as title, left(arg_max(content, turn), 42) as preview, count(*) as messages from {messages} group by 1")
def _(spark, d):
    return I.session_summaries(view(spark, d, "messages"))


@register("k13_recent_turns", "select session_id, turn, row_number() over (partition by session_id order by turn desc) as back from {messages} qualify back <= 6")
def _(spark, d):
    return I.recent_turns(view(spark, d, "messages")).select("session_id", "turn", "back")


@register("k14_recent_sources", "with l as (select session_id, sources, row_number() over (partition by session_id order by turn desc) as back from {messages} where role = 'assistant' qualify back <= 4), e as (select session_id, unnest(cast(sources as json)::varchar[]) as source, generate_subscripts(cast(sources as json)::varchar[], 1) as pos, back from l), o as (select session_id, source, min((back, pos)) as seen from e group by 1, 2) select session_id, source, row_number() over (partition by session_id order by seen) as place from o qualify place <= 6")
def _(spark, d):
    return I.recent_sources(view(spark, d, "messages"))


CHECKS = {"must_include": "cast(question_id * 7 % 200 as string)", "must_not_include": "cast(question_id as string)", "must_match": "'then'", "top_doc": "cast(question_id * 3 % 200 as string)", "title_group": "'src1|src2'", "content_group": "'zzz|onthe'", "signal": "'good'", "max_contexts": "'9'", "profile": "'policy'"}


def cases(spark, d):
    checks = ", ".join(f"struct('{k}' as check, {v} as arg)" for k, v in CHECKS.items())
    return view(spark, d, "questions").selectExpr("question_id as case_id", f"explode(array({checks})) as x").selectExpr("case_id", "x.check", "x.arg", "5 as top_n")


def case_contexts(spark, d):
    return contexts(spark, d).selectExpr("question_id as case_id", "rank", "cast(doc_id as string) as document", "title", "content", "array(grade) as signals")


def results(spark, d):
    profiles = R.query_profile(view(spark, d, "questions"), ASPECTS).selectExpr("question_id as case_id", "domain as profile")
    return I.evaluate(cases(spark, d), case_contexts(spark, d), profiles)


EVALUATED = f"""cs as (select question_id, question, unnest({list(CHECKS)}) as chk, unnest([{', '.join(CHECKS.values())}]) as arg from {{questions}}), ev as (select case_id, chk as "check", arg, case when chk = 'must_not_include' then not hit else hit end as passed from (select q.question_id as case_id, chk, arg, case chk when 'max_contexts' then count(c.doc_id) <= 9 when 'profile' then max(case when contains(lower(q.question), 'erth') then 'process' when contains(lower(q.question), 'the') then 'policy' else 'general' end) = 'policy'
    else coalesce(bool_or(case chk when 'top_doc' then rank = 1 and cast(doc_id as string) = arg when 'must_match' then rank <= 5 and contains(content, arg) when 'title_group' then rank <= 5 and (contains(lower(title), 'src1') or contains(lower(title), 'src2')) when 'content_group' then rank <= 5 and (contains(lower(content), 'zzz') or contains(lower(content), 'onthe')) when 'signal' then rank <= 5 and grade = 'good' else rank <= 5 and cast(doc_id as string) = arg end), false) end as hit from cs q left join {{ctx}} c on c.question_id = q.question_id group by 1, 2, 3))"""


@register("k15_evaluate_retrieval", f"with {EVALUATED} select * from ev")
def _(spark, d):
    return results(spark, d)


@register("k16_source_overlap", "select question_id as case_id, len(list_intersect(a, b)) as shared, len(a) - len(list_intersect(a, b)) as lost, len(b) - len(list_intersect(a, b)) as gained from (select question_id, coalesce(list(distinct doc_id) filter (rank <= 5), []) as a, coalesce(list(distinct doc_id) filter (rank % 2 = 0), []) as b from {top} group by 1)")
def _(spark, d):
    t = top(spark, d).selectExpr("question_id as case_id", "cast(doc_id as string) as document", "rank")
    return I.source_overlap(t.where("rank <= 5"), t.where("rank % 2 = 0"))


@register("k17_suite_report", f"with {EVALUATED} select count(*) as cases, count(*) filter (ok) as passed, count(*) filter (ok) / count(*) as rate from (select case_id, bool_and(passed) as ok from ev group by 1)")
def _(spark, d):
    return I.suite_report(results(spark, d))


@register("k17_suite_failures", f"with {EVALUATED}, f as (select case_id, string_agg(distinct \"check\" || ':' || arg, ',' order by \"check\" || ':' || arg) as failed from ev where not passed group by 1) select case_id, failed, coalesce(documents, '') as documents from f left join (select question_id as case_id, string_agg(cast(doc_id as string), ',' order by rank) as documents from {{ctx}} where rank <= 5 group by 1) using (case_id)")
def _(spark, d):
    return I.suite_failures(results(spark, d), case_contexts(spark, d))


def answers(spark, d):
    return view(spark, d, "benchmark").selectExpr("item_id as case_id", "text as answer", "array('the ', 'zzz') as titles")


@register("k18_evaluate_answers", "select item_id as case_id, array_to_string(list_filter([case when not contains(text, 'the') then 'missing:the' end, case when contains(text, 'that') then 'forbidden:that' end, case when length(text) < 200 then 'short' end, case when length(text) > 400 then 'long' end, case when item_id % 3 > 0 then 'meta:mode' end, 'meta:scope'], lambda x: x is not null), ',') as errors from benchmark")
def _(spark, d):
    c = answers(spark, d).selectExpr("case_id", "array('the') as required", "array('that') as forbidden", "200 as least", "400 as most", "map('mode', 'm0', 'scope', 'all') as meta")
    return I.evaluate_answers(c, answers(spark, d).withColumn("meta", F.create_map(F.lit("mode"), F.concat(F.lit("m"), F.col("case_id") % 3))))


@register("k19_citation_counts", "select question_id as case_id, count(doc_id) as citations, count(doc_id) between 1 and question_id % 12 as passed from {questions} left join (select * from {ctx} where score >= 0.9) using (question_id) group by 1")
def _(spark, d):
    cited = contexts(spark, d).where("score >= 0.9").selectExpr("question_id as case_id", "doc_id")
    return I.citation_counts(view(spark, d, "questions").selectExpr("question_id as case_id", "1 as least", "question_id % 12 as most"), cited)


@register("k19_evaluate_citations", "select question_id as case_id, cast(doc_id as string) as document, count(*) filter (rank <= 5) = 0 as \"foreign\", min(rank) % 2 = 0 or count(*) filter (rank <= 5) = 0 as absent from {ctx} group by 1, 2")
def _(spark, d):
    c = contexts(spark, d).selectExpr("question_id as case_id", "cast(doc_id as string) as document", "content", "rank")
    best = c.groupBy("case_id", "document").agg(F.min("rank").alias("r"), F.min_by("content", "rank").alias("content"))
    cited = best.select("case_id", "document", F.when(F.col("r") % 2 == 0, F.lit("zzzz not there")).otherwise(F.left("content", F.lit(50))).alias("snippet"))
    return I.evaluate_citations(cited, c.where("rank <= 5")).drop("snippet")


@register("k20_evaluate_groups", "select case item_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as category, count(*) as cases, count(*) filter ((contains(text, 'the') or contains(text, 'das')) and (contains(text, 'ing'))) as passed, avg(item_id / 10) as elapsed from benchmark group by 1")
def _(spark, d):
    c = answers(spark, d).selectExpr("case_id", "case case_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as category", "array(array('the', 'das'), array('ing')) as groups")
    return I.evaluate_groups(c, answers(spark, d).withColumn("elapsed", F.col("case_id") / 10))


@register("k21_answer_signals", "select item_id as case_id, length(text) as chars, false as structured, false as empty, contains(text, 'the ') or contains(text, 'zzz') as named from benchmark")
def _(spark, d):
    return I.answer_signals(answers(spark, d))


@register("k22_evaluation_overview", "select (select count(*) from benchmark) as cases, (select count(*) from {docs} where scope = 'test') as risk_test_documents, case when (select count(*) from {docs} where scope = 'test') > 0 then 'risk_test_documents' else '' end as risks")
def _(spark, d):
    return I.overview({"cases": view(spark, d, "benchmark").agg(F.count("*")), "risk_test_documents": docs(spark, d).where("scope = 'test'").agg(F.count("*"))})


@register("k23_audit_slice", "select event_id as audit_id, event_type as action, row_number() over (partition by event_type order by ts desc, event_id desc) as rank from events where event_type in ('click', 'view') and user_id % 3 = 1 qualify rank <= 10")
def _(spark, d):
    audit = view(spark, d, "events").selectExpr("event_id as audit_id", "event_type as action", "ts as created_at", "to_json(named_struct('scope', cast(user_id % 3 as string))) as detail")
    return I.audit_slice(audit, ["click", "view"], "scope", "1", 10).select("audit_id", "action", "rank")


@register("k24_task_list", "select t.task_id, t.status, d.title, w.status as state from {tasks} t left join {docs} d using (doc_id) left join {wiki_statuses} w using (doc_id)")
def _(spark, d):
    return I.task_list(view(spark, d, "tasks"), docs(spark, d), view(spark, d, "wiki_statuses").withColumnRenamed("status", "state"))


@register("k25_kind_mix", f"with {KINDS} select question_id, kind, count(*) as n from kinds group by 1, 2")
def _(spark, d):
    return I.kind_mix(kinds(spark, d))


@register("k26_latest_status", "select doc_id, arg_max(status, (created_at, task_id)) as status from {tasks} group by 1")
def _(spark, d):
    return I.latest_status(view(spark, d, "tasks"), "doc_id", "created_at").select("doc_id", "status")


@register("k27_clean_templates", "select 'k-' || cast(event_id % 50 as string) as \"key\", min(event_id) as position from events where event_id % 4 <> 0 group by 1")
def _(spark, d):
    t = view(spark, d, "events").selectExpr("' K ' || cast(event_id % 50 as string) || '!' as key", "event_id as position", "case when event_id % 4 = 0 then ' ' else 'body' end as content")
    return I.clean_templates(t).select("key", "position")


@register("k28_compare_variants", "select question_id as case_id, count(*) as contexts, max(b.n) as chars_a, false as structured_a, max(least(b.n, 100)) + 2 as chars_b, true as structured_b from {top} join (select item_id as question_id, length(text) as n from benchmark) b using (question_id) group by 1")
def _(spark, d):
    a = answers(spark, d)
    return I.compare_variants(top(spark, d).withColumnRenamed("question_id", "case_id"), a, a.withColumn("answer", F.concat(F.lit("- "), F.left("answer", F.lit(100)))))


@register("k29_append_adoptions", "select event_id as adoption_id from events where event_type in ('purchase', 'signup') and event_id % 13 < 9 order by ts desc, event_id desc limit 300")
def _(spark, d):
    e = view(spark, d, "events").selectExpr("event_id as adoption_id", "'t' || cast(event_id % 13 as string) as template", "ts as created_at", "event_type")
    return I.append_adoptions(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'signup'").drop("event_type"), templates(spark, d)).select("adoption_id")


@register("k30_eval_cases", "select item_id % 30 as case_id, left(text, 200) as question, least(20, greatest(1, item_id - 5)) as top_k, item_id % 2 as origin, row_number() over (partition by item_id % 30 order by item_id % 2, left(text, 200)) > 1 as repeated from benchmark")
def _(spark, d):
    c = view(spark, d, "benchmark").selectExpr("item_id % 30 as case_id", "text as question", "item_id - 5 as top_k", "item_id % 2 as o")
    return I.eval_cases(c.where("o = 0").drop("o"), c.where("o = 1").drop("o"))


@register("k31_message_view", "select session_id, turn, case when role = 'assistant' then len(s) else 0 end as sources, role = 'assistant' and len(s) > 0 and len(list_filter(s, lambda x: not ends_with(x, '0'))) = 0 as overview from (select *, cast(sources as json)::varchar[] as s from {messages})")
def _(spark, d):
    return I.message_view(view(spark, d, "messages"))


_said = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"


@register("k32_feedback_view", f"select session_id, turn, left({_said}, 180) as content, left({_said}, 220) as question, left({_said}, 260) as answer, left(case when turn % 2 = 0 then role else {_said} end, 180) as note, (cast(sources as json)::varchar[])[1:2] as sources from {{messages}}")
def _(spark, d):
    f = view(spark, d, "messages").selectExpr("named_struct('session_id', session_id, 'turn', turn) as feedback_id", "content", "content as question", "content as answer", "case when turn % 2 = 0 then ' ' else content end as admin_note", "role as review_note", "sources")
    return I.feedback_view(f).select("feedback_id.*", "content", "question", "answer", "note", "sources")


@register("k33_validate_feedback", "select session_id * 1000 + turn as feedback_id, case when turn % 7 = 3 then 'rating' when session_id % 5 = 0 then 'category' when role <> 'assistant' then 'no_answer' when session_id % 4 = 0 then 'not_own' end as reason from {messages}")
def _(spark, d):
    m = view(spark, d, "messages")
    f = m.selectExpr("session_id * 1000 + turn as feedback_id", "session_id", "turn", "case when turn % 7 = 3 then 'x' else 'up' end as rating", "case when session_id % 5 = 0 then 'y' else 'other' end as category", "'n' as note", "case when session_id % 4 = 0 then -1 else user_id end as user_id")
    return I.validate_feedback(f, m, ["other"])


@register("k34_status_view", "select doc_id, arg_max(status, (created_at, task_id)) as status, any_value(d.title) as title from {tasks} join {docs} d using (doc_id) group by 1")
def _(spark, d):
    return I.latest_status(view(spark, d, "tasks"), "doc_id", "created_at").join(docs(spark, d).select("doc_id", "title"), "doc_id").select("doc_id", "status", "title")
