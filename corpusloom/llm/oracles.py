"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"

OP4 = """with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(24 + length(replace(replace(replace(role, '%', '%25'), '<|', '%3C|'), chr(10), '%0A')) + length(replace(replace(text, '%', '%25'), '<|', '%3C|'))) as formatted_chars
from m group by conv_id"""

OP7 = rf"""with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, {WORDS.format("text")} as w from documents),
    wins as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
    again as (select doc_id, k from wins group by 1, 2 having count(*) > 1),
    rep as (select doc_id, count(distinct i + j) as n from (select doc_id, i from wins join again using (doc_id, k)), range(8) r(j) group by 1),
    l as (select doc_id, host, unnest(string_split(text, chr(10))) as line from d),
    own as (select doc_id, host, line, len({WORDS.format("line")}) as n, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) as k from l),
    dup as (select doc_id, count(*) - count(distinct line) as n from own where n > 0 group by 1),
    freq as (select host, k, count(distinct doc_id) as docs from own where n > 0 group by 1, 2),
    cut as (select f.host, f.k from freq f join (select host, count(distinct doc_id) as n from d group by 1) t on t.host = f.host where docs > 20 and docs > 0.001 * t.n),
    gone as (select doc_id, sum(n) as n from own join cut using (host, k) group by 1),
    f as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(gone.n, 0) as n_removed_words
        from d left join dup on dup.doc_id = d.doc_id left join rep on rep.doc_id = d.doc_id left join gone on gone.doc_id = d.doc_id)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - n_removed_words >= 0.3 * n_words as kept from f"""

OP9 = rf"""with recursive d as (select doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
    s as (select distinct doc_id, md5(array_to_string(w[i:i + 3], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from d where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by 1),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as same from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 85 * (x.n + y.n - same)),
    r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) as component_id from d left join n on n.doc_id = d.doc_id left join r on r.a = d.doc_id group by 1, 2"""

LINKS = OP9.replace("select d.doc_id, coalesce(n.n, 0) as n_shingles,", "select d.doc_id, coalesce((select count(*) from e where e.a = d.doc_id), 0) as n_links,")

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = f"""with t as (select item_id, {_TOKENS} as w from benchmark), d as (select doc_id, {_TOKENS} as w from documents),
    i as (select distinct cast(item_id as varchar) as item_id, least(10, len(w)) as n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') as k from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from t where len(w) > 0)),
    o as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from i) where len(w) >= n)),
    h as (select doc_id, item_id, p, n from o join i using (n, k)),
    c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by 1),
    m as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from h) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join c on c.doc_id = d.doc_id left join m on m.doc_id = d.doc_id"""

OP13 = f"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, {WORDS.format("text")} as w from documents),
    firsts as (select text, min(doc_id) as least from d group by 1),
    said as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by 1),
    m as (select part, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 4 else 0 end
            + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when coalesce(doc_id > least, false) then 16 else 0 end as failed, coalesce(good, false) as good, coalesce(toxic, false) as toxic
        from d join firsts using (text) left join said using (doc_id)),
    c as (select part, failed, good, toxic, count(*) as n from m group by all),
    f(x, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    o as (select i.x || j.x || k.x || l.x || m.x as filter_order, [i.b, j.b, k.b, l.b, m.b] as bits from f i, f j, f k, f l, f m where i.b + j.b + k.b + l.b + m.b = 31 and i.b | j.b | k.b | l.b | m.b = 31),
    s as (select filter_order, step, bits[step] as b, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier from o, (select cast(unnest(range(1, 6)) as int) as step)),
    r as (select part, filter_order, step, b, coalesce(sum(n) filter (failed & b = 0 and failed & earlier = 0), 0) as kept, coalesce(sum(n) filter (failed & b <> 0 and failed & earlier = 0), 0) as removed,
            coalesce(sum(n) filter (failed & b <> 0 and failed & earlier <> 0), 0) as redundant, coalesce(sum(n) filter (failed = b), 0) as unique_fails,
            coalesce(sum(n) filter (failed & b <> 0 and failed & earlier = 0 and good), 0) as good_lost, coalesce(sum(n) filter (failed & b <> 0 and failed & earlier = 0 and toxic), 0) as toxic_lost
        from c, s group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, b) as shapley from r"""

ORACLES: dict[str, str] = {"op13_filter_audit": OP13, "op4_chat_formatting": OP4, "op7_quality_rules": OP7, "op9_jaccard_join": OP9, "jaccard_links": LINKS, "op10_decontamination": OP10}
