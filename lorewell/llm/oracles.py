"""DuckDB SQL for the queries of the corpus operators that SQL can express."""

ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
with n as (select doc_id, sha256(translate(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) as text_sha256,
                  length(coalesce(text, '')) as n_chars, translate(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '') as body from documents),
w as (select doc_id, text_sha256, first_value(doc_id) over (partition by body order by n_chars desc, doc_id) as keep_id, count(*) over (partition by body) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w""",
    "op8_url_filter": r"""
with p as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest,
             regexp_replace(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') as seen from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path,
        len(regexp_extract_all(seen, '###|\*\*\*|\$\$\$|%%%|&amp;&amp;&amp;')) >= 0.05 * greatest(len(regexp_extract_all(seen, '[^\x20\x09-\x0D]+')), 1) as junk, seen from p),
o as (select host, junk or list_has_any(regexp_split_to_array(concat_ws('/', host, lower(path)), '[^a-z]+'), ['ads', 'adult', 'bet', 'bets', 'casino', 'escort', 'loan', 'pills', 'poker', 'porn', 'spam', 'viagra', 'xxx']) as bad from q where host <> '' and seen is not null),
h1 as (select host, regexp_replace(host, ':\d*$', '') as name, count(*)::double as n, sum(bad::int)::double as bad from o group by host),
h2 as (select *, array_to_string(string_split(name, '.')[-2:], '.') as two, array_to_string(string_split(name, '.')[-3:], '.') as three, regexp_full_match(name, '\d+\.\d+\.\d+\.\d+') or starts_with(name, '[') as address from h1),
h as (select host, n, bad, case when address then name when many then three else two end as domain, case when address then '' when many then two else string_split(name, '.')[-1] end as suffix
      from (select *, two in ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk') as many from h2)),
s0 as (select suffix, sum(n) as n, sum(bad) as bad, (select (sum(bad) + 0.5) / (sum(n) + 1) from h) as m from h group by 1),
s1 as (select *, (select case when sum(n * (n - 1) * m * (1 - m)) > 0 and sum(pow(bad - n * m, 2)) > sum(n * m * (1 - m)) then greatest(1, sum(n * (n - 1) * m * (1 - m)) / (sum(pow(bad - n * m, 2)) - sum(n * m * (1 - m))) - 1) end from s0) as k from s0),
d0 as (select domain, h.suffix, sum(h.n) as n, sum(h.bad) as bad, coalesce((any_value(k * m) + any_value(s1.bad) - sum(h.bad)) / (any_value(k) + any_value(s1.n) - sum(h.n)), any_value(m)) as m from h join s1 on s1.suffix = h.suffix group by 1, 2),
d1 as (select *, (select case when sum(n * (n - 1) * m * (1 - m)) > 0 and sum(pow(bad - n * m, 2)) > sum(n * m * (1 - m)) then greatest(1, sum(n * (n - 1) * m * (1 - m)) / (sum(pow(bad - n * m, 2)) - sum(n * m * (1 - m))) - 1) end from d0) as k from d0),
h0 as (select host, h.n, h.bad, coalesce((k * m + d1.bad - h.bad) / (k + d1.n - h.n), m) as m from h join d1 on d1.domain = h.domain),
g1 as (select *, (select case when sum(n * (n - 1) * m * (1 - m)) > 0 and sum(pow(bad - n * m, 2)) > sum(n * m * (1 - m)) then greatest(1, sum(n * (n - 1) * m * (1 - m)) / (sum(pow(bad - n * m, 2)) - sum(n * m * (1 - m))) - 1) end from h0) as k from h0),
post as (select host, m, k * m + bad as a, k * (1 - m) + n - bad as b from g1),
rated as (select host, coalesce(a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))), m) as bound from post),
r(rule_host, rule_path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (select page_id, first(rule_host || rule_path order by length(rule_host || rule_path) desc) as rule, first(r.verdict order by length(rule_host || rule_path) desc) as verdict from q join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by 1)
select q.page_id, q.host, q.path, rule, coalesce(fit.verdict, case when greatest(bound, 0) * (1 - overall) > 2 * overall * (1 - greatest(bound, 0)) then 'block' else 'allow' end) as verdict from q left join fit on fit.page_id = q.page_id left join rated on rated.host = q.host cross join (select (sum(bad) + 0.5) / (sum(n) + 1) as overall from h)""",
    "op11_exact_top_k": r"""
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s)
select query_id, place::int as rank, vec_id, score from r where place <= 5""",
    "op12_hard_negatives": r"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
           from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.v, c.v)::bigint as score from e a join e c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same),
n as (select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as place
      from p join s using (anchor_id) where p.place <= 5 and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, place::int as rank, negative_id, positive_score, negative_score from n where place <= 10""",
    "op13_merkle_manifest": r"""
with recursive crc_table as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, bit: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
docs as (select d.*, row_number() over () as i, coalesce(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0, false) as touched from documents d, crc_table),
leaves as (select i, doc_id, touched, case when source is null then '-' else '=' || source end as tree, sha256(concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-'), coalesce(strlen(text) || ':' || text, '-'))) as leaf,
    sha256(concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-'), coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) as lowered from docs),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place from leaves),
up(level, tree, place, node, many) as (
    select 0, tree, place, leaf, count(*) over (partition by tree) from placed
    union all select level + 1, tree, run, node, count(*) over (partition by tree) from
        (select level, tree, place // 16 as run, sha256(string_agg(node, '' order by place)) as node from up where many > 1 group by all)),
runs as (select level, tree, place // 16 as run, string_agg(node, '' order by place) as nodes from up where many > 1 group by all),
subroots as (select tree, node as subroot, row_number() over (order by tree) - 1 as place from up where many = 1),
top(level, place, node, many) as (
    select 0, place, subroot, count(*) over () from subroots
    union all select level + 1, run, node, count(*) over () from
        (select level, place // 16 as run, sha256(string_agg(node, '' order by place)) as node from top where many > 1 group by all)),
top_runs as (select level, place // 16 as run, string_agg(node, '' order by place) as nodes from top where many > 1 group by all),
walk(i, tree, place, level, siblings, folded) as (
    select i, tree, place, 0, '', case when touched then lowered else leaf end from placed
    union all select w.i, w.tree, w.place // 16, w.level + 1, siblings || substr(nodes, 1, 64 * (w.place % 16)) || substr(nodes, 64 * (w.place % 16) + 65),
        sha256(substr(nodes, 1, 64 * (w.place % 16)) || folded || substr(nodes, 64 * (w.place % 16) + 65))
    from walk w join runs r on r.level = w.level and r.tree = w.tree and r.run = w.place // 16),
ends as (select i, any_value(tree) as tree, max_by(siblings, level) as siblings, max_by(folded, level) as folded from walk group by i),
half as (select e.i, s.subroot, s.place, e.siblings, e.folded from ends e join subroots s on s.tree = e.tree),
walk2(i, place, level, siblings, folded) as (
    select i, place, 0, siblings, folded from half
    union all select w.i, w.place // 16, w.level + 1, siblings || substr(nodes, 1, 64 * (w.place % 16)) || substr(nodes, 64 * (w.place % 16) + 65),
        sha256(substr(nodes, 1, 64 * (w.place % 16)) || folded || substr(nodes, 64 * (w.place % 16) + 65))
    from walk2 w join top_runs r on r.level = w.level and r.run = w.place // 16),
done as (select i, max_by(siblings, level) as siblings, max_by(folded, level) as folded from walk2 group by i)
select p.doc_id, p.leaf, h.subroot, t.node as root, sha256(d.siblings) as proof_sha256, d.folded as folded_root, d.folded = t.node as verified
from placed p join half h on h.i = p.i join done d on d.i = p.i cross join (select node from top where many = 1) t""",
}
