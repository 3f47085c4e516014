"""The application tables, derived from the driver's tables.

Each is one SELECT that Spark and DuckDB both read; braces name the tables and views it stands on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations")

VIEWS = {
    "docs": """select doc_id, source || '-' || cast(doc_id as string) as title,
        source || '-' || cast(doc_id as string) || case doc_id % 5 when 0 then '.txt' when 1 then '.md' when 2 then '.pdf' when 3 then '.xlsx' else '.csv' end as filename,
        case when doc_id % 7 = 0 then 'chat_upload' else 'admin_upload' end as source_type,
        case when doc_id % 10 = 0 then 'test' else 'production' end as scope, doc_id % 20 as owner, source as team, lang, text
        from {documents}""",
    "pages": "select doc_id, 1 as page, text from {documents}",
    "chunks": "select doc_id, 1 as page, i as chunk_index, substr(t, i * 850 + 1, 1000) as content from (select doc_id, t, unnest(range(0, 1 + greatest(0, cast(ceil((length(t) - 1000) / 850.0) as bigint)))) as i from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from {documents}) where t <> '')",
    "sampled": "select doc_id, title, filename, lower(title || ' ' || sample) as body from (select d.doc_id, d.title, d.filename, left(string_agg(c.content, chr(10) order by c.chunk_index), 4000) as sample from {docs} d join {chunks} c on c.doc_id = d.doc_id and c.chunk_index < 3 group by 1, 2, 3)",
    "graded": "select doc_id, case when coalesce(length(trim(text)), 0) < 80 then 'blocked' when length(trim(text)) < 400 then 'poor' else 'good' end as grade from {documents}",
    "asked": "select question_id, question, list_sort(list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]{2,}'))) as terms from {questions}",
    "hits": "select question_id, len(terms) as asked, doc_id, chunk_index, case when contains(lower(content), term) then 0.12 + 0.10 * (least(length(term), 12) / 12.0) else 0.0 end as c, case when contains(lower(title), term) then 0.18 + 0.12 * (least(length(term), 12) / 12.0) else 0.0 end as t from (select *, unnest(terms) as term from {asked}) q join (select c.*, d.title from {chunks} c join {docs} d using (doc_id)) c on contains(lower(content), term) or contains(lower(title), term)",
    "top": "select *, row_number() over (partition by question_id order by score desc, matched desc, doc_id, chunk_index) as rank from (select question_id, doc_id, chunk_index, round(cast(least(0.96, sum(c + t) + least(0.22, 0.35 * count(*) / max(asked))) as double), 6) as score, count(*) as matched from {hits} group by 1, 2, 3) qualify rank <= 10",
    "ctx": "select t.question_id, t.doc_id, t.chunk_index, t.score, t.rank, c.content, d.title, a.terms, a.question, grade, case grade when 'blocked' then 0.45 when 'poor' then 0.18 else 0.0 end as penalty, t.chunk_index = 0 as section, contains(lower(a.question), 'that') and not contains(lower(c.content), 'that') as mismatch from {top} t join {chunks} c using (doc_id, chunk_index) join {docs} d using (doc_id) join {asked} a using (question_id) join {graded} using (doc_id)",
    "wiki_pages": """select doc_id, lower(title) as slug, case when doc_id % 50 = 9 then 'Shared title' else title end as title, scope, case doc_id % 4 when 0 then 'process' when 1 then 'rule' when 2 then 'entity' else 'concept' end as page_type, 0.3 + (doc_id % 7) / 10.0 as confidence, case when doc_id % 23 = 0 then '' else left(replace(text, chr(10), ' '), 100) end as summary, doc_id % 29 = 0 as stale, doc_id as position,
        case when doc_id % 31 = 0 then 'short' else '# ' || title || chr(10) || chr(10) || '## Summary' || chr(10) || left(replace(text, chr(10), ' '), 100) || chr(10) || chr(10) || '- ' || replace(text, chr(10), case when doc_id % 3 = 0 then '' else ' [S1]' end || chr(10) || '- ') || ' [S' || cast(doc_id % 5 as string) || ']' || chr(10) || '- [[' || source_slug || '|next]]' || case when doc_id % 7 = 0 then ' [[missing-' || cast(doc_id as string) || ']]' else '' end end as body
        from (select *, lower(team || '-' || cast(doc_id + 20 as string)) as source_slug from {docs})""",
    "wiki_links": "select lower(title) as slug, case when doc_id % 13 = 0 then 'gone-' || cast(doc_id as string) else lower(team || '-' || cast(doc_id - doc_id % 40 as string)) end as target from {docs} where doc_id % 2 = 0",
    "wiki_statuses": "select doc_id, scope, case when coalesce(length(trim(text)), 0) < 40 then 'failed' else 'compiled' end as status from {docs}",
    "wiki_sources": "select lower(title) as slug, doc_id, 1 as idx from {docs} where doc_id % 37 <> 0 union all select lower(team || '-' || cast(doc_id - 20 as string)), doc_id, 2 from {docs} where doc_id >= 20 and doc_id % 3 = 0",
    "doc_groups": "select doc_id, team as group_id from {docs}",
    "user_groups": "select user_id, 'src' || cast(user_id % 20 as string) as group_id from {users} union select user_id, 'src' || cast((user_id + 7) % 20 as string) from {users}",
    "accessible": "select owner as user_id, doc_id from {docs} where source_type like 'chat%' and scope = 'production' and owner in (select user_id from {users}) union select g.user_id, d.doc_id from {docs} d join {doc_groups} x on x.doc_id = d.doc_id join {user_groups} g on g.group_id = x.group_id where d.source_type not like 'chat%' and d.scope = 'production' union select u.user_id, d.doc_id from {docs} d, {users} u where u.is_admin and d.source_type not like 'chat%' and d.scope = 'production'",
    "lines": "select o.o_orderkey, r.r_name, n.n_name, c.c_name, c.c_custkey, o.o_orderstatus, o.o_orderpriority, o.o_totalprice, r.r_regionkey, cast(year(o.o_orderdate) * 100 + month(o.o_orderdate) as string) as sheet from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey",
    # schema-on-read rows: each region has spellings of its own
    "flat_rows": """select 'orders-' || r_name as document, sheet, o_orderkey as row_number,
        case r_regionkey % 3 when 0 then 'nation' when 1 then 'Nation name' else 'country' end as k1, n_name as v1,
        case r_regionkey % 3 when 0 then 'customer' when 1 then 'Customer company' else 'client' end as k2, c_name as v2,
        case r_regionkey % 3 when 0 then 'status' when 1 then 'Order status' else 'state of order' end as k3, o_orderstatus as v3,
        case r_regionkey % 3 when 0 then 'priority' when 1 then 'Priority' else 'urgency' end as k4, case when o_orderkey % 11 = 0 then '' when o_orderkey % 13 = 0 then '-' else o_orderpriority end as v4,
        case r_regionkey % 3 when 0 then 'amount' when 1 then 'Total amount' else 'amount paid' end as k5, case when o_orderkey % 17 = 0 then 'n/a' else cast(cast(o_totalprice as decimal(12,2)) as string) || ' USD' end as v5
        from {lines}""",
    "cells": "select document, sheet, row_number, 1 as pos, k1 as name, v1 as value from {flat_rows} union all select document, sheet, row_number, 2, k2, v2 from {flat_rows} union all select document, sheet, row_number, 3, k3, v3 from {flat_rows} union all select document, sheet, row_number, 4, k4, v4 from {flat_rows} union all select document, sheet, row_number, 5, k5, v5 from {flat_rows}",
    "questions": "select item_id as question_id, replace(text, chr(10), ' ') as question from {benchmark}",
    "messages": "select conv_id as session_id, turn, role, text as content, case when (conv_id * 7 + turn * 3) % 5 = 0 then '[]' else '[\"doc-' || cast(conv_id % 9 as string) || '\",\"doc-' || cast(turn % 4 as string) || '\"]' end as sources, conv_id % 50 as user_id from {conversations}",
    "feedback": "select event_id as feedback_id, user_id, ts as created_at, case event_id % 4 when 0 then 'wrong_source' when 1 then 'incomplete' when 2 then 'outdated' else 'other' end as category, case event_id % 3 when 0 then 'new' when 1 then 'reviewed' else 'resolved' end as status, 'cause-' || cast(event_id % 7 as string) as root_cause, case when value > 50 then 'up' else 'down' end as rating, cast(user_id as string) || ' ' || event_type as note from {events} where event_type in ('error', 'click')",
    "tasks": "select event_id as task_id, user_id as doc_id, ts as created_at, event_type as task_type, case event_id % 4 when 0 then 'pending' when 1 then 'running' when 2 then 'done' else 'failed' end as status from {events}",
    "users": "select distinct user_id, user_id % 50 = 0 as is_admin from {events}",
    # every fifth question names a document
    "naming": "select question_id, case when question_id % 5 = 0 then question || ' see src' || cast(question_id % 20 as string) || '-' || cast(question_id as string) else question end as question from {questions}",
}
for _name, _base in (("asked", "questions"), ("hits", "asked"), ("top", "hits")):
    VIEWS[f"{_name}_naming"] = VIEWS[_name].replace(f"{{{_base}}}", "{naming}" if _base == "questions" else f"{{{_base}_naming}}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view of the application model, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = VIEWS[name]
    return spark.sql(body, **{x: view(spark, sf_dir, x) for x in set(re.findall(r"\{(\w+)\}", body))})


def with_views(body: str) -> str:
    """DuckDB SQL in which {view} names are defined by common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for x in re.findall(r"\{(\w+)\}", text):
            if x in VIEWS and x not in order:
                need(VIEWS[x])
                if x not in order:
                    order.append(x)

    need(body)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    head = ", ".join(f"{x} as ({plain(VIEWS[x])})" for x in order)
    text = plain(body).strip()
    if not head:
        return text
    if text.lower().startswith("with recursive "):
        return f"with recursive {head}, {text[15:]}"
    return f"with {head}, {text[5:]}" if text.lower().startswith("with ") else f"with {head} {text}"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema-on-read rows: document, sheet, row_number, row (a map) and row_keys, in column order."""
    from pyspark.sql import functions as F

    flat = view(spark, sf_dir, "flat_rows")
    keys, values = F.array("k1", "k2", "k3", "k4", "k5"), F.array("v1", "v2", "v3", "v4", "v5")
    return flat.select("document", "sheet", "row_number", F.map_from_arrays(keys, values).alias("row"), keys.alias("row_keys"))
