"""Registered queries of the streams' batch twins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import register
from ..sources.model import view
from ..streaming import jobs


def logins(spark, d):
    return view(spark, d, "events").selectExpr("user_id", "event_id", "cast(ts as timestamp) as ts", "event_type <> 'signup' as failed")


@register("s02_lockouts")
def _(spark, d):
    """Attempts are rare in the table: two days count as the window, and a lock holds for one."""
    return jobs.lockouts_batch(logins(spark, d), 2 * 86400, 86400)


@register("s03_tumbling_counts", "select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def _(spark, d):
    return jobs.rolling_counts(view(spark, d, "events"), "ts", "event_type", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("s03_sliding_counts", "select time_bucket(interval '6 hours', ts) - to_hours(6 * k) as start, event_type, count(*) as n from events, range(4) r(k) group by 1, 2")
def _(spark, d):
    return jobs.rolling_counts(view(spark, d, "events"), "ts", "event_type", "1 day", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("s03_sessions", "select min(ts) as start, user_id, count(*) as n from (select *, sum(new) over (partition by user_id order by ts) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events)) group by user_id, s")
def _(spark, d):
    return jobs.sessions(view(spark, d, "events"), "ts", "user_id", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@register("s04_dedupe_tasks", "select doc_id, status, arg_min(task_id, (created_at, task_id)) as task_id from {tasks} group by 1, 2")
def _(spark, d):
    return jobs.dedupe_tasks_batch(view(spark, d, "tasks"), ["doc_id", "status"], "created_at").select("doc_id", "status", "task_id")


@register("s05_pair_turns", "select session_id, turn, question_turn from (select *, last_value(case when role = 'user' then turn end ignore nulls) over (partition by session_id order by turn rows between unbounded preceding and 1 preceding) as question_turn from {messages}) where role = 'assistant'")
def _(spark, d):
    return jobs.pair_turns_batch(view(spark, d, "messages"))


@register("s01_ingest_status", "select d.doc_id, case when coalesce(length(trim(text)), 0) >= 40 then 'done' else 'failed' end as status, case when coalesce(length(trim(text)), 0) < 40 then 'reason=low_text extracted=' || cast(coalesce(length(trim(text)), 0) as string) || ' threshold=40' end as message, case when contains(lower(concat_ws(' ', title, text)), 'erth') then 'process' when contains(lower(concat_ws(' ', title, text)), 'ander') then 'rule' else 'general' end as kind, coalesce(n, 0) as chunks from {docs} d left join (select doc_id, count(*) as n from {chunks} group by 1) using (doc_id)")
def _(spark, d):
    made = jobs.ingest_documents(view(spark, d, "docs").select("doc_id", "title", "text"), [("process", ["erth"]), ("rule", ["ander"])], 40)
    n = made["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return made["status"].join(made["kinds"], "doc_id").join(n, "doc_id", "left").fillna(0, ["chunks"])
