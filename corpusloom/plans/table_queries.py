"""Registered queries of the table operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import tables as T
from ..registry import register
from ..sources.model import rows, view

LEXICON = {
    "city": ["nation", "country"],
    "company": ["customer", "client", "company"],
    "status": ["status", "state"],
    "priority": ["priority", "urgency"],
    "amount": ["amount", "total"],
}
HINTS = {"city": (1.0, ["FRANCE", "GERMANY"]), "status": (1.0, ["F", "O"]), "company": (0.9, ["Customer#"])}
Q = T.TableQuery(LEXICON)
#: The best column of each meaning, by region, in the views.
NUMBER = "try_cast(regexp_extract(replace(v5, ',', ''), '-?[0-9]+(?:\\.[0-9]+)?', 0) as double)"


def semantics(spark, d):
    return T.infer_semantics(rows(spark, d), LEXICON, HINTS)


def typed(spark, d):
    """Rows with the columns found by meaning. The lexicon alone maps them; scores are what d01 reports."""
    return T.with_semantics(rows(spark, d), semantics(spark, d).select("document", "semantic", "raw_name"))


SCORES = """with c as (select distinct document, pos, name, replace(lower(name), ' ', '') as key from {cells}),
    s as (select document, name, value, row_number() over (partition by document, name order by sheet, row_number, value) as k from
        (select document, name, value, min(sheet) as sheet, arg_min(row_number, (sheet, row_number)) as row_number from {cells} where value <> '' group by document, name, value)),
    t as (select document, name, string_agg(value, ' ' order by k) as txt, list(value order by k) as samples from s where k <= 8 group by document, name),
    a(semantic, word) as (values ('city','nation'),('city','country'),('company','customer'),('company','client'),('company','company'),('status','status'),('status','state'),('priority','priority'),('priority','urgency'),('amount','amount'),('amount','total')),
    w as (select c.document, c.pos, c.name, a.semantic, sum(case when key = word then 3.0 when contains(key, word) or contains(word, key) then 1.6 else 0.0 end) as score from c, a group by all),
    x as (select w.document, w.pos, w.name, w.semantic, cast(w.score as double) + case when semantic = 'city' and (contains(txt, 'FRANCE') or contains(txt, 'GERMANY')) then 1.0 when semantic = 'status' and (contains(txt, 'F') or contains(txt, 'O')) then 1.0 when semantic = 'company' and contains(txt, 'Customer#') then 0.9 else 0.0 end as score, samples from w left join t on w.document = t.document and w.name = t.name),
    b as (select document, semantic, name as raw_name, round(score, 4) as score, samples from x where score >= 1 qualify row_number() over (partition by document, semantic order by round(score, 4) desc, pos) = 1)"""


@register("d01_infer_semantics", f"{SCORES} select document, semantic, raw_name, score from b")
def _(spark, d):
    return semantics(spark, d).select("document", "semantic", "raw_name", "score")


def _aliases(spark, d):
    return view(spark, d, "flat_rows").select("document", F.col("k4").alias("raw_name")).distinct().withColumn("semantic", F.when(F.col("document") == "orders-ASIA", "company").otherwise("priority")).withColumn("status", F.when(F.col("document") == "orders-EUROPE", "ignored").otherwise("confirmed")).withColumn("updated_at", F.length("document"))


ALIASES = "a0 as (select distinct document, k4 as raw_name, case when document = 'orders-ASIA' then 'company' else 'priority' end as semantic, case when document = 'orders-EUROPE' then 'ignored' else 'confirmed' end as status, length(document) as updated_at from {flat_rows})"


@register("d02_apply_aliases", f"""{SCORES}, {ALIASES}, k as (select b.* from b left join a0 on a0.status = 'ignored' and a0.document = b.document and a0.raw_name = b.raw_name and a0.semantic = b.semantic where a0.status is null), f as (select * from a0 where status = 'confirmed')
    select coalesce(k.document, f.document) as document, coalesce(k.semantic, f.semantic) as semantic, coalesce(f.raw_name, k.raw_name) as raw_name, case when f.raw_name is not null then greatest(coalesce(k.score, 0), 9.0) else k.score end as score from k full join f on k.document = f.document and k.semantic = f.semantic""")
def _(spark, d):
    return T.apply_aliases(semantics(spark, d), _aliases(spark, d), rows(spark, d))


@register("d03_upsert_aliases", f"with {ALIASES} select document, raw_name, semantic, case when document like '%A%' then 'ignored' else status end as status, case when document like '%A%' then updated_at + 1 else updated_at end as updated_at from a0")
def _(spark, d):
    base = _aliases(spark, d)
    changes = base.where("document like '%A%'").withColumns({"status": F.lit("ignored"), "updated_at": F.col("updated_at") + 1})
    return T.upsert_aliases(base, changes)


@register("d04_schema_suggestions", f"{SCORES} select document || ':' || raw_name || ':' || semantic as suggestion, document, raw_name, semantic, score, array_to_string(samples[1:3], '|') as samples from b")
def _(spark, d):
    return T.schema_suggestions(semantics(spark, d))


def flat(body):
    return body.replace("{NUMBER}", NUMBER)


@register("d05_semantic_value", "select document, sheet, row_number, v3 as status, coalesce(nullif(v4, ''), '') as priority from {flat_rows}")
def _(spark, d):
    return Q.select(typed(spark, d), "status", "priority")


FILTERS = {
    "d06_filter_eq": (Q.where("status", "eq", "O"), "v3 = 'O'"),
    "d06_filter_ne": (Q.where("city", "ne", "FRANCE"), "v1 <> 'FRANCE'"),
    "d07_filter_contains": (Q.where("city", "contains", "AN"), "contains(v1, 'AN')"),
    "d07_filter_not_contains": (Q.where("city", "not_contains", "AN"), "not contains(v1, 'AN')"),
    "d08_filter_is_empty": (Q.where("priority", "is_empty"), "v4 = ''"),
    "d08_filter_is_not_empty": (Q.where("priority", "is_not_empty"), "v4 <> ''"),
    "d09_filter_is_concrete": (Q.where("priority", "is_concrete"), "v4 not in ('', '-')"),
    "d10_filter_gte_number": (Q.where("amount", "gte", "100,000"), "case when v5 = 'n/a' then v5 >= '100,000' else cast(replace(v5, ' USD', '') as double) >= 100000 end"),
    "d10_filter_lt_text": (Q.where("city", "lt", "F"), "v1 < 'F'"),
    "d11_fallback_to_any_value": (Q.where("owner", "contains", "BRAZIL"), "v1 = 'BRAZIL'"),
    "d12_any_of_groups": (Q.any_of([T.Filter("status", "eq", "F"), T.Filter("city", "eq", "CHINA")], [T.Filter("amount", "gt", "300000")]), "(v3 = 'F' and v1 = 'CHINA') or case when v5 = 'n/a' then v5 > '300000' else cast(replace(v5, ' USD', '') as double) > 300000 end"),
    "d13_synonyms": (T.TableQuery(LEXICON, synonyms={"USA": ["UNITED STATES"]}).where("city", "contains", "USA"), "contains(v1, 'USA') or contains(v1, 'UNITED STATES')"),
    "d15_months": (Q.in_months("199503", "199604"), "sheet in ('199503', '199604')"),
    "d15_no_such_month": (Q.in_months("203001"), "false"),
    "d16_years": (Q.in_years("1997"), "contains(sheet, '1997')"),
}
for _name, (_query, _sql) in FILTERS.items():

    @register(_name, f"select document, sheet, row_number from {{flat_rows}} where {_sql}")
    def _(spark, d, query=_query):
        return query.rows(typed(spark, d)).select("document", "sheet", "row_number")


@register("d14_collapse_filters", "with f as (select distinct r_regionkey as query, 'city' as meaning, 'contains' as operator, v as value from (select r_regionkey, n_name as v from {lines} union all select r_regionkey, substr(n_name, 1, 4) from {lines})) select query, meaning, operator, value from f where not exists (select 1 from f g where g.query = f.query and contains(g.value, f.value) and g.value <> f.value)")
def _(spark, d):
    lines = view(spark, d, "lines")
    f = lines.select(F.col("r_regionkey").alias("query"), F.explode(F.array("n_name", F.substring("n_name", 1, 4))).alias("value")).distinct().select("query", F.lit("city").alias("meaning"), F.lit("contains").alias("operator"), "value")
    return T.collapse_filters(f)


@register("d17_soft_filter", "select document, sheet, row_number from (select *, max(case when v3 = 'P' then 1 else 0 end) over (partition by document, sheet) as met from {flat_rows}) where v3 = 'P' or met = 0")
def _(spark, d):
    return T.soft_filter(typed(spark, d).withColumn("s", Q.value("status")), F.col("s") == "P", "document", "sheet").select("document", "sheet", "row_number")


@register("d18_require_column", "select document, sheet, row_number from {flat_rows} where v4 <> ''")
def _(spark, d):
    return T.soft_filter(typed(spark, d).withColumn("p", Q.value("priority")), F.col("p").isNotNull(), "document").select("document", "sheet", "row_number")


@register("d19_numeric", flat("select row_number, {NUMBER} as amount from {flat_rows}"))
def _(spark, d):
    return typed(spark, d).select("row_number", T.numeric(Q.value("amount")).alias("amount"))


@register("d20_count", "select count(*) as n from {flat_rows} where v3 = 'O'")
def _(spark, d):
    return Q.where("status", "eq", "O").count(typed(spark, d))


@register("d21_aggregate", flat("select count(x) as numbers, sum(x) as total, avg(x) as mean, min(x) as least, max(x) as largest from (select {NUMBER} as x from {flat_rows})"))
def _(spark, d):
    return Q.aggregate(typed(spark, d), "amount")


@register("table_group_count", "select coalesce(nullif(v4, ''), 'not stated') as key, count(*) as n from {flat_rows} where v3 = 'O' group by 1")
def _(spark, d):
    """d22"""
    return Q.where("status", "eq", "O").group_count(typed(spark, d), "priority")


@register("d23_group_aggregate", flat("select coalesce(nullif(v4, ''), 'not stated') as key, count(*) as n, count(x) as numbers, sum(x) as total, avg(x) as mean, min(x) as least, max(x) as largest from (select v4, {NUMBER} as x from {flat_rows}) group by 1 having count(x) > 0"))
def _(spark, d):
    return Q.group_aggregate(typed(spark, d), "priority", "amount")


@register("d24_metrics_by_count", flat("select v1 as key, count(*) as n, sum(x) as total from (select v1, {NUMBER} as x from {flat_rows}) group by 1 order by n desc, key limit 5"))
def _(spark, d):
    return T.top(Q.group_aggregate(typed(spark, d), "city", "amount"), "n", 5).select("key", "n", "total")


@register("d25_distinct", "select distinct v4 as value from {flat_rows} where v4 <> ''")
def _(spark, d):
    return Q.distinct(typed(spark, d), "priority")


@register("d26_dedupe_complete", "select document, sheet, row_number from (select *, row_number() over (partition by document, sheet, v4 order by row_number) as k from {flat_rows}) where v4 = '' or k = 1")
def _(spark, d):
    r = typed(spark, d).select("document", "sheet", "row_number", Q.value("priority").alias("p"))
    return T.dedupe_complete(r, ("document", "sheet", "p"), ("row_number",)).select("document", "sheet", "row_number")


@register("d27_unique_rows", "select distinct document, sheet, v1, v3 from {flat_rows}")
def _(spark, d):
    return typed(spark, d).select("document", "sheet", Q.value("city").alias("v1"), Q.value("status").alias("v3")).dropDuplicates()


@register("d28_completed", "select row_number from {flat_rows} where (contains(v4, 'URGENT') or contains(v4, 'HIGH')) and not contains(v4, 'NOT')")
def _(spark, d):
    return typed(spark, d).where(T.completed(["URGENT", "HIGH"], ["NOT"], F.coalesce(Q.value("priority"), F.lit("")))).select("row_number")


@register("d29_top_ascending", "select v1 as key, count(*) as n from {flat_rows} group by 1 order by n, key limit 7")
def _(spark, d):
    return T.top(Q.group_count(typed(spark, d), "city"), "n", 7, descending=False)


@register("d30_projection", "select document, sheet, row_number, v1 as city, v2 as company, v5 as amount from {flat_rows}")
def _(spark, d):
    return Q.select(typed(spark, d), "city", "company", "amount")


@register("d31_focus_columns", "select document, sheet, row_number, k1 || '=' || v1 || '|' || k3 || '=' || v3 as focus from {flat_rows}")
def _(spark, d):
    return T.focus_columns(rows(spark, d), ["nation", "country"], ["status", "state"])


@register("d32_distinct_pairs", "select distinct v1 as city, v2 as company from {flat_rows}")
def _(spark, d):
    return Q.select(typed(spark, d), "city", "company").select("city", "company").distinct()


@register("d33_compare_periods", """with f as (select * from {flat_rows} qualify row_number() over (partition by document, v2, sheet order by row_number) = 1),
    c as (select document, v2 as company, sheet, unnest([k1, k2, k3, k4, k5]) as field, unnest([v1, v2, v3, v4, v5]) as value from f)
    select document, company, field, count(distinct sheet) as periods, count(distinct value) as different, count(distinct value) > 1 as changed from c group by 1, 2, 3 having count(distinct sheet) >= 2""")
def _(spark, d):
    return T.compare_periods(typed(spark, d).withColumn("company", Q.value("company")), "company")


BONUSES = [T.Bonus(("urgent",), ("urgency", "Priority"), 0.6), T.Bonus(("urgent",), ("status", "Order status", "priority"), 0.15, each=True, most=0.2), T.Bonus(("place", "urgent"), ("country", "state of order"), 0.45, every=True)]
RANKED = """dd as (select document, lower(min(v1) || ' ' || max(v1) || ' ' || min(v3)) as samples, list(distinct sheet) as months, list(distinct k1) || list(distinct k3) || list(distinct k4) as fields, max(row_number) % 7 as created_at from {flat_rows} group by 1),
    qq as (select r_regionkey as question_id, [lower(split_part(r_name, ' ', 1)), lower(substr(r_name, 1, 3)), 'o', 'france'] as terms, ['19950' || cast(r_regionkey + 1 as string)] as months, case when r_regionkey % 2 = 0 then ['urgent'] else ['place'] end as asks from region),
    sx as (select question_id, document, round(cast(0.04 + list_sum(list_transform(terms, lambda t: case when contains(lower(document), t) then case when length(t) <= 3 then 0.12 else 0.18 end else 0 end + case when contains(samples, t) then case when length(t) <= 3 then 0.03 else 0.05 end else 0 end)) + case when list_has_any(qq.months, dd.months) then 0.5 else 0 end + case when len(list_filter(qq.months, lambda m: contains(lower(document), m) or contains(samples, m))) > 0 then 0.32 else 0 end + case when list_contains(asks, 'urgent') and list_has_any(fields, ['urgency', 'Priority']) then 0.6 else 0 end + case when list_contains(asks, 'urgent') then least(0.2, 0.15 * len(list_intersect(fields, ['status', 'Order status', 'priority']))) else 0 end + case when list_has_any(asks, ['place', 'urgent']) and list_has_all(fields, ['country', 'state of order']) then 0.45 else 0 end as double), 4) as score, created_at from qq, dd),
    ranked as (select question_id, document, score, row_number() over (partition by question_id order by score desc, created_at desc, document) as rank from sx where score >= 0.45 qualify rank <= 3)"""


def ranked_tables(spark, d):
    f = view(spark, d, "flat_rows")
    docs = f.groupBy("document").agg(F.concat_ws(" ", F.min("v1"), F.max("v1"), F.min("v3")).alias("samples"), F.collect_set("sheet").alias("months"), F.concat(F.collect_set("k1"), F.collect_set("k3"), F.collect_set("k4")).alias("fields"), (F.max("row_number") % 7).alias("created_at")).withColumn("title", F.col("document"))
    q = view(spark, d, "region").select(F.col("r_regionkey").alias("question_id"), F.array(F.split_part("r_name", F.lit(" "), F.lit(1)), F.substring("r_name", 1, 3), F.lit("O"), F.lit("FRANCE")).alias("terms"), F.array(F.concat(F.lit("19950"), F.col("r_regionkey") + 1)).alias("months"), F.array(F.when(F.col("r_regionkey") % 2 == 0, "urgent").otherwise("place")).alias("asks"))
    return T.rank_tables(q, docs, BONUSES)


@register("d34_rank_tables", f"with {RANKED} select * from ranked")
def _(spark, d):
    return ranked_tables(spark, d)


@register("d35_rank_rows", f"""with {RANKED}, q as (select r_regionkey as question_id, ['china', 'france'] as places, case when r_regionkey < 3 then '199' || cast(r_regionkey % 5 + 3 as string) || '06' end as month, ['1-urgent', 'usd', 'orders'] as tokens, ['urgent'] as asks from region),
    p as (select q.*, r.document, r.rank - 1 as doc_rank, sheet, row_number, k1, k3, k4, row_number % 19 = 0 as header, lower(concat_ws(' ', sheet, k1, k2, k3, k4, k5, trim(v1), trim(v2), trim(v3), trim(v4), trim(v5), r.document, '1996-03 1997/4')) as t from q join ranked r using (question_id) join {{flat_rows}} f on f.document = r.document),
    s as (select *, case when header then -1.0 else round(cast(0.4 - 0.05 * doc_rank + 0.6 * (contains(t, 'china')::int + contains(t, 'france')::int) + case when month is null then case when sheet in ('199603', '199704') then 0.35 else 0 end when sheet = month then 8.0 when contains(t, month) then 1.5 else -1.25 end + case when contains(t, '1-urgent') then 0.28 else 0 end + case when contains(t, 'usd') then 0.18 else 0 end + case when contains(t, 'orders') then 0.28 else 0 end
        + case when k4 in ('urgency', 'Priority') then 0.6 else 0 end + least(0.2, 0.15 * ((k3 = 'status')::int + (k3 = 'Order status')::int + (k4 = 'priority')::int)) + case when k1 = 'country' and k3 = 'state of order' then 0.45 else 0 end as double), 4) end as score from p)
    select question_id, document, sheet, row_number, score, row_number() over (partition by question_id order by score desc, doc_rank, document, sheet, row_number) as rank from s qualify rank <= 20""")
def _(spark, d):
    q = view(spark, d, "region").selectExpr("r_regionkey as question_id", "array('China', 'FRANCE') as places", "case when r_regionkey < 3 then '199' || cast(r_regionkey % 5 + 3 as string) || '06' end as month", "array('1-URGENT', 'usd', 'Orders') as tokens", "array('urgent') as asks")
    ranked = ranked_tables(spark, d).select("question_id", "document", (F.col("rank") - 1).alias("doc_rank"), F.concat("document", F.lit(" 1996-03 1997/4")).alias("title"))
    own = rows(spark, d).withColumns({"fields": F.col("row_keys"), "is_header": F.col("row_number") % 19 == 0})
    return T.rank_rows(q, ranked, own, BONUSES)


@register("d36_headers_kept", "select document, min(row_number) as row_number, k1 || '|' || k3 as content from {flat_rows} where document in (select document from {flat_rows} where v1 = 'CHINA') group by 1, 3")
def _(spark, d):
    r = typed(spark, d)
    headers = view(spark, d, "flat_rows").select("document", "row_number", F.concat_ws("|", "k1", "k3").alias("content"))
    return T.with_headers(Q.where("city", "eq", "CHINA").rows(r), headers)


@register("d37_hit_columns", "select document, name, row_number() over (partition by document order by case name when 'amount' then 1 when 'client' then 2 else 3 end, pos) as k from (select distinct document, pos, name from {cells}) qualify k <= 3")
def _(spark, d):
    return T.hit_columns(rows(spark, d), ["amount", "client"], 3)


@register("d38_month_tokens", "select distinct sheet, [sheet] as months from {flat_rows}")
def _(spark, d):
    said = view(spark, d, "flat_rows").select("sheet").distinct().withColumn("q", F.concat(F.lit("rows of "), F.substring("sheet", 1, 4), F.lit("年"), F.substring("sheet", 5, 2).cast("int"), F.lit("月 or "), "sheet", F.lit(", not 12345678")))
    return T.month_tokens(said, "q").select("sheet", "months")


@register("d40_records_from_pairs", "select o_orderkey as doc_id, 3 + case when o_orderkey % 2 = 0 then 1 else 0 end as n, o_orderpriority as priority from orders where o_orderkey % 3 <> 0")
def _(spark, d):
    o = view(spark, d, "orders")
    text = F.concat(F.lit("order: "), "o_orderkey", F.lit("\npriority: "), "o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("\nstatus: "), "o_orderstatus")).otherwise(""), F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderkey") % 3 != 0), "\nclerk: x\nstatus: again").otherwise("\nother"))
    found = T.records_from_pairs(o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), ["order", "priority", "status", "clerk"])
    return found.select("doc_id", F.size("fields").alias("n"), F.get(F.filter("fields", lambda f: f["name"] == "priority"), 0)["value"].alias("priority"))


@register("d41_normalize_fields", "select o_orderkey, case o_orderkey % 3 when 0 then strftime(date '1899-12-30' + cast(40000 + o_orderkey % 1000 as integer), '%Y-%m-%d') when 1 then cast(cast((o_orderkey % 100) as decimal(9,2)) as string) || '%' else 'x' end as normal from orders")
def _(spark, d):
    k = F.col("o_orderkey")
    r = view(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, "Start date").when(k % 3 == 1, "fund ratio").otherwise("note").alias("field"), F.when(k % 3 == 0, (40000 + k % 1000).cast("string")).when(k % 3 == 1, (k % 100 / 100).cast("string")).otherwise("x").alias("value"))
    return T.normalize_fields(r).select("o_orderkey", "normal")


@register("d42_dedupe_records", "select min(o_orderkey) as id from orders group by case when o_orderkey % 5 = 0 then 'text:' || o_orderpriority else cast(o_custkey as string) end")
def _(spark, d):
    r = view(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("content"))
    return T.dedupe_records(r, "key", "content", "id").select("id")


@register("d43_group_fields", "select name as field, case when contains(lower(name), 'nation') or contains(lower(name), 'country') then 'place' when contains(lower(name), 'amount') then 'money' else 'other' end as \"group\", count(*) as n from {cells} group by 1, 2")
def _(spark, d):
    fields = rows(spark, d).select(F.explode("row_keys").alias("field"))
    return T.group_fields(fields, [("place", ["nation", "country"]), ("money", ["amount"])]).groupBy("field", "group").agg(F.count("*").alias("n"))


@register("d44_flagged_fields", "select row_number, name as field from {cells} where contains(value, 'URGENT') or contains(value, 'n/a')")
def _(spark, d):
    cells = rows(spark, d).select("row_number", F.explode("row").alias("field", "value"))
    return cells.where(T.any_of([F.contains("value", F.lit(w)) for w in ("URGENT", "n/a")])).select("row_number", "field")


@register("d45_sheet_digest", "select document, sheet, count(*) as n, least(count(*), 80) as shown, min(row_number) as first_row from {flat_rows} group by 1, 2")
def _(spark, d):
    return T.sheet_digest(rows(spark, d))


@register("d46_table_query", flat("select v1 as key, count(*) as n, count(x) as numbers, sum(x) as total, avg(x) as mean, min(x) as least, max(x) as largest from (select *, {NUMBER} as x from {flat_rows}) where v3 <> 'P' and contains(sheet, '1996') and v4 not in ('', '-') group by 1 having count(x) > 0 order by n desc, key limit 10"))
def _(spark, d):
    """Filters, a period and a concrete column; then groups with measures, the largest first."""
    q = Q.where("status", "ne", "P").where("priority", "is_concrete").in_years("1996")
    return T.top(q.group_aggregate(typed(spark, d), "city", "amount"), "n", 10)


@register("d46_table_counters", flat(f"with {RANKED}, f as (select question_id, v1, v3 <> 'P' as a, v3 <> 'P' and contains(sheet, '1996') as b, v3 <> 'P' and contains(sheet, '1996') and v4 not in ('', '-') as c from ranked join {{flat_rows}} using (document)) select question_id, count(*) as rows, count(*) filter (a) as valued, count(*) filter (b) as dated, count(*) filter (c) as required, count(distinct v1) filter (c) as \"distinct\" from f group by 1"))
def _(spark, d):
    """Rows of each question's documents after a value filter, a period and a required column, and how many places are left."""
    filters = {"valued": F.col("v3") != "P", "dated": F.contains("sheet", F.lit("1996")), "required": ~F.col("v4").isin("", "-")}
    return T.table_counters(view(spark, d, "flat_rows"), ranked_tables(spark, d), filters, F.col("v1"))


@register("d47_row_contexts", "select document, document || ' / ' || sheet || ' / row ' || cast(row_number as string) as place, k1 || '=' || v1 || ' | ' || k2 || '=' || v2 || ' | ' || k3 || '=' || v3 || ' | ' || k4 || '=' || v4 || ' | ' || k5 || '=' || v5 as content, case when row_number <= 1 then 0.45 else 0.82 end as score from {flat_rows}")
def _(spark, d):
    return T.row_contexts(rows(spark, d))


@register("d48_title_months", "select distinct document || ' ' || substr(sheet, 1, 4) || '-' || substr(sheet, 5, 2) as title, [sheet] as months from {flat_rows}")
def _(spark, d):
    titles = view(spark, d, "flat_rows").select(F.concat("document", F.lit(" "), F.substring("sheet", 1, 4), F.lit("-"), F.substring("sheet", 5, 2)).alias("title")).distinct()
    return T.month_tokens(titles, "title")


@register("d49_has_columns", "select document, max(contains(lower(k3), 'state')) as present from {flat_rows} group by 1")
def _(spark, d):
    return T.has_columns(rows(spark, d), ["state"])


@register("d50_alias_list", f"with {ALIASES} select document || ':' || raw_name || ':' || semantic as suggestion, document, raw_name, semantic, status, updated_at from a0 where status = 'confirmed'")
def _(spark, d):
    return T.alias_list(_aliases(spark, d), "confirmed")


@register("d39_records_from_cells", "select c_custkey as doc_id, 2 as row_number, 'nation=' || cast(c_nationkey as string) || ',name=' || c_name || ',segment=' || c_mktsegment || case when c_custkey % 3 = 0 then '' else ',D=x' end as fields from customer where c_custkey % 3 <> 0")
def _(spark, d):
    c = view(spark, d, "customer")
    head = F.lit("A1: nation | B1: the long name | C1: segment")
    body = F.concat(F.lit("B1: name A2: "), "c_nationkey", F.lit(" | B2: old"))
    rest = F.concat(F.lit("B2: "), "c_name", F.lit(" C2: "), "c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, " | D2: x | E2:").otherwise(""))
    chunks = c.select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.array(head, body, rest)).alias("chunk_index", "content"))
    return T.records_from_cells(chunks).select("doc_id", "row_number", F.array_join("fields", ",").alias("fields"))


WHOLE = """tq as (select r_regionkey as question_id, r_regionkey % 2 = 0 as analysis, r_regionkey % 3 > 0 as completion, r_regionkey < 4 as needs from region),
    w as (select question_id, analysis, completion, needs, document, sheet, row_number, v1, {NUMBER} as x, v3 <> 'P' as a, contains(sheet, '1996') as b, k1 = 'nation' and contains(v4, '1-') as c, (contains(v4, 'URGENT') or contains(v4, 'HIGH')) and not contains(v4, 'NOT') as e, v4 not in ('', '-') and contains(v2, '777') as f from tq left join ranked using (question_id) left join {flat_rows} using (document)),
    w1 as (select *, a as o1 from w), w2 as (select *, o1 and b as o2 from w1), w3 as (select *, o2 and c as m3, o2 and (not analysis or c or max((o2 and c)::int) over (partition by question_id) = 0) as o3 from w2),
    w4 as (select *, o3 and e as m4, o3 and (not completion or e) as o4 from w3), w5 as (select *, o4 and f as m5, o4 and (not needs or f or max((o4 and f)::int) over (partition by question_id) = 0) as o5 from w4),
    wc as (select question_id, count(distinct document) as documents, count(row_number) as rows, count(*) filter (o1) as valued, count(*) filter (o2) as dated, count(*) filter (m3 and analysis) as progressed, count(*) filter (m4 and completion) as completed, count(*) filter (m5 and needs) as required, count(*) filter (o5) as matched, count(distinct v1) filter (o5) as different from w5 group by 1),
    wg as (select question_id, v1 as key, count(*) as n, round(coalesce(sum(x), 0), 2) as total, row_number() over (partition by question_id order by count(*) desc, v1) as place from w5 where o5 group by 1, 2 qualify place <= 10)"""


@register("d46_whole_table_query", flat(f"with {RANKED}, {WHOLE} select wc.*, key, n, total, place from wc left join wg using (question_id)"))
def whole_table_query(spark, d):
    """Documents chosen for each question; filters of values, a period, progress, completion and required columns; counters of each; the ten largest groups of what is left."""
    f = view(spark, d, "flat_rows")
    q = view(spark, d, "region").selectExpr("r_regionkey as question_id", "r_regionkey % 2 = 0 as analysis", "r_regionkey % 3 > 0 as completion", "r_regionkey < 4 as needs")
    steps = [
        T.Step("valued", F.col("v3") != "P"),
        T.Step("dated", F.contains("sheet", F.lit("1996"))),
        T.Step("progressed", (F.col("k1") == "nation") & F.contains("v4", F.lit("1-")), F.col("analysis"), soft=True),
        T.Step("completed", T.completed(["URGENT", "HIGH"], ["NOT"], F.col("v4")), F.col("completion")),
        T.Step("required", ~F.col("v4").isin("", "-") & F.contains("v2", F.lit("777")), F.col("needs"), soft=True),
    ]
    left, counters = T.table_query(q, ranked_tables(spark, d), f, steps, F.col("v1"))
    groups = left.groupBy("question_id", F.col("v1").alias("key")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(T.numeric(F.col("v5"))), F.lit(0.0)), 2).alias("total"))
    return counters.join(R.ranked(groups, 10, "key", by="n", name="place"), "question_id", "left")
