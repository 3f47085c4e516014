"""Registered queries of wiki compilation, health, link graph and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import wiki as W
from ..operators.components import keep
from ..registry import register
from ..sources.model import view
from .document_queries import chunks, docs
from .retrieval_queries import SENTENCES, asked

FAMILIES = {"process": ["erth", "oned"], "rule": ["ander", "ing"]}


def pages(spark, d):
    return view(spark, d, "wiki_pages")


def sources(spark, d):
    return view(spark, d, "wiki_sources")


def findings(spark, d):
    return W.wiki_findings(pages(spark, d), sources(spark, d), view(spark, d, "wiki_links"), view(spark, d, "wiki_statuses"))


def health(spark, d):
    return W.wiki_health(pages(spark, d), findings(spark, d), W.citation_coverage(pages(spark, d), sources(spark, d)), view(spark, d, "wiki_statuses"))


@register("g01_sentences", f"with {SENTENCES} select doc_id, chunk_index, pos, md5(sentence) as m from sents")
def _(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index", F.posexplode(R.sentences(F.col("content"))).alias("pos", "s")).select("doc_id", "chunk_index", "pos", F.md5("s").alias("m"))


@register("g02_summaries", f"with {SENTENCES} select doc_id, left(string_agg(sentence || ' [S' || cast(chunk_index + 1 as string) || ']', ' ' order by k), 1200) as summary from (select *, row_number() over (partition by doc_id order by chunk_index, pos) as k from sents where pos < 3) where k <= 5 group by 1")
def _(spark, d):
    return W.summaries(chunks(spark, d))


@register("g03_fact_bullets", f"with {SENTENCES}, f as (select doc_id, lower(left(sentence, 80)) as key, min(chunk_index) as chunk_index from sents where pos = 0 group by 1, 2) select doc_id, row_number() over (partition by doc_id order by chunk_index) as k, chunk_index from f qualify k <= 12")
def _(spark, d):
    return W.fact_bullets(chunks(spark, d)).drop("sentence")


@register("g04_checksum", "select d.doc_id, sha256(cast(d.doc_id as string) || chr(10) || coalesce(string_agg(cast(chunk_index as string) || ':' || content, chr(10) order by chunk_index), '')) as checksum from {docs} d left join {chunks} using (doc_id) group by 1")
def _(spark, d):
    return W.wiki_checksum(docs(spark, d), chunks(spark, d))


DERIVED = "derived as (select doc_id, chunk_index, page_type, score, row_number() over (partition by doc_id, page_type order by score desc, chunk_index desc) as k from (select doc_id, chunk_index, unnest(['process', 'rule']) as page_type, unnest([contains(lower(content), 'erth')::int + contains(lower(content), 'oned')::int, contains(lower(content), 'ander')::int + contains(lower(content), 'ing')::int]) as score from {chunks}) where score > 0 qualify k <= 8)"


@register("g05_derived_pages", f"with {DERIVED} select * from derived")
def _(spark, d):
    return W.derived_pages(chunks(spark, d), FAMILIES)


@register("g06_slugify", "select doc_id, left(trim(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '-', 'g'), '-'), 120) as slug from {docs}")
def _(spark, d):
    return docs(spark, d).select("doc_id", W.slugify(F.col("text")).alias("slug"))


@register("g07_page_confidence", "select doc_id, case when doc_id % 2 = 0 then 0.68 else least(0.86, 0.74 + 0.01 * count(*)) end as confidence from {chunks} group by 1")
def _(spark, d):
    n = chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.select("doc_id", W.page_confidence(F.col("n"), F.col("doc_id") % 2 == 0).alias("confidence"))


@register("g08_render_pages")
def _(spark, d):
    return W.render_pages(docs(spark, d), chunks(spark, d), "2024-01-01").select("doc_id", "slug", F.length("body").alias("chars"))


@register("g08_render_derived")
def _(spark, d):
    c = chunks(spark, d)
    return W.render_derived(docs(spark, d), c, W.derived_pages(c, {"process": ["the", "ing"], "rule": ["erth"]}), "2024-01-01").select("doc_id", "page_type", "slug", F.length("body").alias("chars"))


@register("g09_page_sources", "select doc_id, chunk_index + 1 as marker, left(trim(content), 360) as quote from {chunks} where chunk_index < 24")
def _(spark, d):
    return W.page_sources(chunks(spark, d))


@register("g09_page_links", f"with {DERIVED}, t as (select distinct doc_id, page_type from derived) select doc_id, 'main' as source, page_type as target, 'derived' as kind from t union all select doc_id, page_type, 'main', 'derived' from t union all select a.doc_id, a.page_type, b.page_type, 'sibling' from t a join t b on a.doc_id = b.doc_id and a.page_type <> b.page_type")
def _(spark, d):
    return W.page_links(W.derived_pages(chunks(spark, d), FAMILIES))


@register("g10_stale_pages", "select doc_id, page_type from (select doc_id, 'process' as page_type from {docs} where doc_id % 2 = 0) where doc_id % 4 = 0")
def _(spark, d):
    old = docs(spark, d).where("doc_id % 2 = 0").select("doc_id", F.lit("process").alias("page_type"))
    new = docs(spark, d).where("doc_id % 4 = 0").select("doc_id", F.lit("rule").alias("page_type"))
    return W.stale_pages(old, new)


@register("g11_compile_status", "select d.doc_id, count(c.doc_id) as chunks, case when count(c.doc_id) > 0 then 'compiled' else 'failed' end as status from {docs} d left join (select * from {chunks} where doc_id % 6 <> 0) c using (doc_id) group by 1")
def _(spark, d):
    return W.compile_status(docs(spark, d), chunks(spark, d).where("doc_id % 6 <> 0"))


LINKS = r"pl as (select slug, unnest(string_split(body, chr(10))) as t, generate_subscripts(string_split(body, chr(10)), 1) - 1 as line from {wiki_pages}), lk as (select slug, line, unnest(regexp_extract_all(t, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)) as target from pl), mk as (select slug, line, cast(unnest(regexp_extract_all(t, '\[S([0-9]+)\]', 1)) as int) as marker from pl)"


@register("g12_extract_links", f"with {LINKS} select * from lk")
def _(spark, d):
    return W.extract_links(pages(spark, d))


@register("g12_extract_markers", f"with {LINKS} select * from mk")
def _(spark, d):
    return W.extract_markers(pages(spark, d))


CLAIMS = "cb as (select slug, line, trim(case when starts_with(t, '- ') then substr(t, 3) else t end) as claim from pl where not starts_with(t, '#') and trim(t) <> '' and length(trim(case when starts_with(t, '- ') then substr(t, 3) else t end)) >= 12)"


@register("g13_claim_blocks", f"with {LINKS}, {CLAIMS} select slug, md5(claim) as m from cb")
def _(spark, d):
    return W.claim_blocks(pages(spark, d)).select("slug", F.md5("claim").alias("m"))


COVER = LINKS + ", " + CLAIMS + r""", cv as (select p.slug, coalesce(c.claims, 0) as claims, coalesce(c.cited, 0) as cited, coalesce(s.n, 0) as sources, (select count(*) from mk where mk.slug = p.slug and (marker < 1 or marker > coalesce(s.n, 0))) as outside from {wiki_pages} p left join (select slug, count(*) as claims, count(*) filter (regexp_matches(claim, '\[S([0-9]+)\]')) as cited from cb group by 1) c on c.slug = p.slug left join (select slug, count(*) as n from {wiki_sources} group by 1) s on s.slug = p.slug)"""


@register("g14_citation_coverage", f"with {COVER} select *, case when claims > 0 then cited / claims else 1.0 end as coverage from cv")
def _(spark, d):
    return W.citation_coverage(pages(spark, d), sources(spark, d))


RESOLVED = "rl as (select l.*, (select p.slug from {wiki_pages} p where l.target in (p.slug, trim(regexp_replace(lower(p.title), '[^a-z0-9一-鿿]+', '-', 'g'), '-'), regexp_replace(lower(p.title), '\\s+', '', 'g')) order by position limit 1) as leads_to from lk l)"
FINDINGS = COVER + ", " + RESOLVED + r""", pk as (select l.slug, l.target, t.slug as there from {wiki_links} l left join {wiki_pages} t on t.slug = l.target),
    lp as (select slug, leads_to from rl where leads_to is not null and leads_to <> slug union select slug, target from pk where there is not null and target <> slug), bl as (select leads_to as slug, count(*) as n from lp group by 1), ol as (select slug, count(*) as n from lp group by 1),
    ff as (select p.*, claims, cited, sources, outside, coalesce(bl.n, 0) as b, coalesce(ol.n, 0) as o, count(*) over (partition by regexp_replace(lower(title), '\s+', '', 'g')) as same from {wiki_pages} p join cv using (slug) left join bl on bl.slug = p.slug left join ol on ol.slug = p.slug),
    fi as (select slug, unnest(list_filter([case when sources = 0 then 'missing-source' end, case when trim(summary) = '' then 'missing-summary' end, case when length(trim(body)) < 80 then 'empty-page' end, case when confidence < 0.45 then 'low-confidence' end, case when stale then 'stale-page' end, case when outside > 0 then 'source-marker-out-of-range' end, case when sources > 0 and claims > 0 and cited / claims < 0.55 then 'low-citation-coverage' end, case when b = 0 and o = 0 then 'orphan-page' end, case when b = 0 and o > 0 then 'no-backlink' end, case when same > 1 then 'duplicate-title' end], lambda x: x is not null)) as rule from ff
        union all select slug, 'broken-wikilink' from rl where leads_to is null union all select slug, 'broken-page-link' from pk where there is null union all select 'document:' || cast(doc_id as string), 'compile-failed' from {wiki_statuses} where status = 'failed'),
    fs as (select slug, rule, case when rule in ('missing-source', 'empty-page', 'source-marker-out-of-range', 'compile-failed') then 'error' when rule = 'no-backlink' then 'info' else 'warning' end as severity from fi)"""


@register("g15_findings", f"with {FINDINGS} select * from fs")
def _(spark, d):
    return findings(spark, d)


HEALTH = FINDINGS + """, wh as (select slug, scope from {wiki_pages} union all select 'document:' || cast(doc_id as string), scope from {wiki_statuses}), hc as (select scope, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos, sum(case severity when 'error' then 6.0 when 'warning' then 2.0 else 0.5 end) as cost from wh join fs using (slug) group by 1),
    hh as (select scope, count(*) as pages, round(avg((sources > 0)::int), 4) as source_coverage, sum(claims) as claims, sum(cited) as cited from {wiki_pages} join cv using (slug) group by 1),
    health as (select scope, pages, source_coverage, claims, cited, case when claims > 0 then round(cited / claims, 4) else 1.0 end as citation_coverage, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(infos, 0) as infos, greatest(0.0, round(cast(100 - coalesce(cost, 0) as double), 1)) as score from hh left join hc using (scope))"""


@register("g16_health", f"with {HEALTH} select * from health")
def _(spark, d):
    return health(spark, d)


@register("g17_resolve_links", f"with {LINKS}, {RESOLVED} select * from rl")
def _(spark, d):
    return W.resolve_links(pages(spark, d), W.extract_links(pages(spark, d)))


STOP = ["shared"]
MENTIONS = r"""tk as (select slug as b, lower(trim(title)) as title, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[0-9a-z]{2,}'), lambda t: length(t) <= 18 and not (length(t) < 4 and (regexp_matches(t, '^[0-9]+$') or regexp_matches(t, '^[a-z]+$'))) and not regexp_matches(t, '^(page|doc|wiki)[0-9]*$') and t <> 'shared'))) as term from {wiki_pages}),
    tn as (select term from tk group by 1 having count(*) <= 64), px as (select slug as a, lower(concat_ws(' ', title, summary, body)) as body from {wiki_pages}),
    mp as (select a, b, title, any_value(body) as body, count(*) as n, bool_or(length(term) >= 4 or regexp_matches(term, '[0-9]')) as strong, bool_or(term = title) as same from px join (select * from tk join tn using (term)) x on a <> b and contains(body, term) group by 1, 2, 3),
    mw as (select *, length(regexp_replace(title, '\s+', '', 'g')) >= 4 and contains(regexp_replace(body, '\s+', '', 'g'), regexp_replace(title, '\s+', '', 'g')) as whole from mp),
    mentions as (select least(a, b) as a, greatest(a, b) as b, sum(least(8, n + case when whole and not same then 1 else 0 end)) as mentions from mw where whole or strong or n >= 2 group by least(a, b), greatest(a, b))"""


@register("g18_mention_edges", f"with {MENTIONS} select * from mentions")
def _(spark, d):
    return W.mention_edges(pages(spark, d), STOP)


_near = " ".join(f"when ta = '{x}' and tb = '{y}' then {v}" for x, row in W.AFFINITY.items() for y, v in row.items())
EDGES = LINKS + ", " + RESOLVED + ", " + MENTIONS + f""", el as (select least(slug, leads_to) as a, greatest(slug, leads_to) as b, count(*) as directions, sum(n) as links from (select slug, leads_to, count(*) as n from rl where leads_to is not null and leads_to <> slug group by 1, 2) group by 1, 2),
    ee as (select a, b, coalesce(directions, 0) as directions, coalesce(links, 0) as links, coalesce(mentions, 0) as mentions from el full join mentions using (a, b)), ow as (select distinct slug, doc_id from {{wiki_sources}}),
    sh as (select a, b, count(*) as shared from ee join ow x on x.slug = a join ow y on y.slug = b and y.doc_id = x.doc_id group by 1, 2), en as (select a, b from ee union all select b, a from ee), dg as (select a, count(*) as degree from en group by 1),
    cn as (select e.a, e.b, sum(1 / ln(greatest(degree, 2))) as near from ee e join en x on x.a = e.a join en y on y.a = e.b and y.b = x.b join dg on dg.a = x.b group by 1, 2),
    ev as (select a, b, coalesce(shared, 0) as shared, cast(3.0 * directions + 0.25 * (links - directions) as double) as direct_link, cast(4.0 * coalesce(shared, 0) as double) as source_overlap, cast(2.0 * least(mentions, 5) as double) as title_mention, round(1.5 * coalesce(near, 0), 4) as common_neighbor, cast(case {_near} else 0.5 end as double) as type_affinity from ee left join sh using (a, b) left join cn using (a, b) join (select slug as a, page_type as ta from {{wiki_pages}}) using (a) join (select slug as b, page_type as tb from {{wiki_pages}}) using (b)),
    edges as (select *, round(direct_link + source_overlap + title_mention + common_neighbor + type_affinity, 4) as weight from ev)"""


def edges(spark, d):
    return W.wiki_edges(pages(spark, d), sources(spark, d), STOP)


@register("g19_edges", f"with {EDGES} select *, case when weight >= 8 then 'strong' when weight >= 5 then 'medium' else 'weak' end as strength from edges")
def _(spark, d):
    return edges(spark, d)


NODES = EDGES + """, nodes as (select slug, title, page_type, (select count(distinct leads_to) from rl where rl.slug = p.slug and leads_to is not null and leads_to <> p.slug) as "out", (select count(distinct rl.slug) from rl where leads_to = p.slug and rl.slug <> p.slug) as "into", (select count(*) from rl where rl.slug = p.slug and leads_to is null) as broken, coalesce((select degree from dg where dg.a = p.slug), 0) as degree from {wiki_pages} p)"""


def nodes(spark, d):
    return W.wiki_nodes(pages(spark, d), edges(spark, d))


@register("g20_nodes", f"with {NODES} select *, degree = 0 as orphan from nodes")
def _(spark, d):
    return nodes(spark, d)


GROUPS = NODES + """, se as (select a, b from edges where weight >= (select greatest(3.5, median(weight)) from edges)), sy as (select a, b from se union select b, a from se),
    rc(node, other) as (select a, b from sy union select rc.node, sy.b from rc join sy on sy.a = rc.other), gr as (select slug as node, least(slug, coalesce(min(other), slug)) as component from {wiki_pages} left join rc on rc.node = slug group by slug),
    go as (select component, title, page_type, degree, row_number() over (partition by component order by degree desc, title, node) as k from gr join nodes on slug = node), gi as (select x.component, count(*) as edges from edges join gr x on x.node = a join gr y on y.node = b and y.component = x.component group by 1),
    st as (select component, count(*) as size, coalesce(max(gi.edges), 0) as edges, round(coalesce(max(gi.edges), 0) / case when count(*) > 1 then count(*) * (count(*) - 1) / 2 else 1 end, 4) as cohesion, sum(degree) as degrees, list(title order by k) filter (k <= 5) as top from go left join gi using (component) group by 1)"""


def graph(spark, d):
    """Edges, nodes, communities and their figures; edges and nodes are read many times, so they are tables."""
    e = keep(edges(spark, d))
    n = keep(W.wiki_nodes(pages(spark, d), e))
    found = W.communities(e, n)
    return e, n, found, W.community_stats(found, e, n)


@register("g21_communities", f"with recursive {GROUPS} select * from gr")
def _(spark, d):
    return graph(spark, d)[2]


@register("g21_community_stats", f"with recursive {GROUPS} select component, size, edges, cohesion, degrees, array_to_string(top, '|') as top, types from st join (select component, string_agg(page_type || '=' || cast(n as string), ',' order by page_type) as types from (select component, page_type, count(*) as n from go group by 1, 2) group by 1) using (component)")
def _(spark, d):
    return graph(spark, d)[3].withColumn("top", F.array_join("top", "|"))


@register("g21_community_order", f"with recursive {GROUPS} select component, row_number() over (order by size desc, degrees desc, top[1], component) as place from st qualify place <= 200")
def _(spark, d):
    return W.community_order(graph(spark, d)[3]).select("component", "place")


INSIGHTS = GROUPS + """, no as (select * from nodes join gr on node = slug), sc as (select e.a, e.b, e.weight, x.title as ta, case when x.component <> y.component then 3 else 0 end + case when x.page_type <> y.page_type then 2 else 0 end + case when least(x.degree, y.degree) <= 1 and greatest(x.degree, y.degree) >= greatest(2, 0.5 * (select max(degree) from nodes)) then 2 else 0 end + case when weight < 5 then 1 else 0 end + case when x.page_type <> y.page_type and shared > 0 then 1 else 0 end as score from edges e join no x on x.slug = a join no y on y.slug = b),
    re as (select s.a, count(distinct y.component) as "all", count(distinct y.component) filter (y.component <> x.component) as others from en s join gr x on x.node = s.a join gr y on y.node = s.b group by 1)
    select 'surprising' as kind, a, b, cast(score as double) as score from (select * from sc where score >= 2 order by score desc, weight desc, ta, a, b limit 8) union all select 'isolated-node', slug, null, degree from nodes where degree <= 1 union all select 'broken-link', slug, null, broken from nodes where broken > 0 union all select 'sparse-community', component, null, cohesion from st where size >= 3 and cohesion < 0.15 union all select 'bridge-node', a, null, others from (select re.*, degree, title from re join nodes on slug = a where others >= 2 order by "all" desc, degree desc, title, a limit 3)"""


@register("g22_insights", f"with recursive {INSIGHTS}")
def _(spark, d):
    return W.graph_insights(*graph(spark, d))


@register("g23_index", f"with {FINDINGS} select p.slug, p.page_type, count(*) filter (severity = 'error') as errors, count(rule) as findings, coalesce((select string_agg(rule, ',' order by r, rule) from (select distinct rule, case severity when 'error' then 0 when 'warning' then 1 else 2 end as r from fs where fs.slug = p.slug order by r, rule limit 4)), '') as first from {{wiki_pages}} p left join fs using (slug) group by 1, 2")
def _(spark, d):
    return W.wiki_index(pages(spark, d), findings(spark, d))


WIKI_TOP = r"""wb as materialized (select slug, confidence, regexp_replace(lower(title), '\s+', '', 'g') as ti, regexp_replace(lower(summary), '\s+', '', 'g') as su, regexp_replace(lower(concat_ws(' ', title, summary, body)), '\s+', '', 'g') as fu from {wiki_pages}),
    wq as materialized (select question_id, terms, list_distinct(list_filter(list_transform(regexp_split_to_array(question, '[\s,.;:!?，。；：！？]+'), lambda p: lower(p)), lambda p: length(p) between 4 and 12)) as said from {asked}),
    wx as (select question_id, slug, confidence, length(fu) as chars, len(terms) as asked, len(list_filter(terms, lambda x: contains(fu, x))) as n, len(list_filter(terms, lambda x: contains(ti, x))) as t, len(list_filter(terms, lambda x: contains(su, x))) as s, len(list_filter(said, lambda x: contains(fu, x))) as p from wq, wb),
    wt as (select question_id, slug, round(greatest(0.0, least(0.99, cast(0.68 * n / asked + least(0.2, 0.065 * t) + least(0.16, 0.04 * s) + least(0.14, 0.07 * p) + least(0.06, 0.06 * confidence) + 0.04 - least(0.08, 0.01 * log10(greatest(1000, chars))) as double))), 4) as score, row_number() over (partition by question_id order by score desc, slug) as rank from wx where n > 0 and (n / asked >= 0.16 or t > 0) qualify rank <= 5)"""


def hits(spark, d):
    return W.wiki_topk(asked(spark, d), pages(spark, d), 5)


@register("g24_wiki_topk", f"with {WIKI_TOP} select * from wt")
def _(spark, d):
    return hits(spark, d)


BLOCKS = r"""br as (select slug, unnest(regexp_split_to_array(body, '\n\s*\n')) as raw, generate_subscripts(regexp_split_to_array(body, '\n\s*\n'), 1) - 1 as block from {wiki_pages}), bt as (select slug, block, trim(raw, chr(32) || chr(9) || chr(13) || chr(10)) as raw from br), bh as (select *, case when starts_with(raw, '#') then trim(string_split(raw, chr(10))[1]) end as head from bt where raw <> '' and not starts_with(raw, '---')),
    bb as (select slug, block, head is not null as head, case when head is not null then raw else concat_ws(chr(10), last_value(head ignore nulls) over (partition by slug order by block), raw) end as t from bh), bl as (select *, regexp_replace(lower(t), '\s+', '', 'g') as low from bb)"""


@register("g25_best_blocks", f"with {WIKI_TOP}, {BLOCKS}, x as (select question_id, slug, block, round(coalesce(list_sum(list_transform(terms, lambda t: least(3.0, cast((length(low) - length(replace(low, t, ''))) / length(t) as double)) * (1 + least(length(t), 8) / 10))), 0) + case when contains(low, '[s') then 0.5 else 0 end + case when head then 0.25 else 0 end, 4) as score from wt join {{asked}} using (question_id) join bl using (slug)) select question_id, slug, block, score from (select *, row_number() over (partition by question_id, slug order by score desc, block) as k from x) where k <= 5 and (score > 0 or k = 1)")
def _(spark, d):
    return W.best_blocks(hits(spark, d), pages(spark, d), asked(spark, d)).drop("text")


@register("g26_wiki_contexts", f"with {WIKI_TOP} select question_id, slug, rank, md5(left(title || chr(10) || summary || chr(10) || body, 700)) as m from wt join {{wiki_pages}} using (slug)")
def _(spark, d):
    return W.wiki_contexts(hits(spark, d), pages(spark, d)).select("question_id", "slug", "rank", F.md5("content").alias("m"))


@register("g27_status", "select scope, count(*) as pages, count(*) filter (stale) as stale, count(*) filter (confidence < 0.45) as weak from {wiki_pages} group by 1")
def _(spark, d):
    return W.status_counts(pages(spark, d))


@register("g28_page_list", "select p.slug, title, position, count(s.slug) as sources from {wiki_pages} p left join {wiki_sources} s on s.slug = p.slug group by 1, 2, 3 order by position desc limit 50")
def _(spark, d):
    return W.page_list(pages(spark, d), sources(spark, d), 50)


@register("g29_lint_log", f"with {HEALTH} select 'wiki_lint' as action, '2024-02-01' as created_at, scope, pages, errors from health")
def _(spark, d):
    log = W.lint_log(health(spark, d), "2024-02-01")
    x = F.from_json("detail", "scope string, pages long, errors long")
    return log.select("action", "created_at", x.alias("x")).select("action", "created_at", "x.*")
