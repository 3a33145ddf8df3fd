"""DuckDB SQL for the registered queries of the graph engine."""

from __future__ import annotations

KG = r"""
with line0 as (
  select l_orderkey, 'o' || l_orderkey as chunk_id, l_linenumber, l_quantity,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_discount, l_returnflag, l_linestatus) - 1 as position,
         s_name as head, case when l_linenumber % 3 = 0 then replace(p_name || ' ' || p_brand, ' ', '-') else p_name || ' ' || p_brand end as tail,
         case when l_returnflag = 'A' and l_linestatus = 'F' then 'ACTIVATES' when l_returnflag = 'A' then 'INHIBITS' when l_returnflag = 'N' and l_linestatus = 'F' then 'BINDS'
              when l_returnflag = 'N' then 'UPREGULATES' when l_linestatus = 'F' then 'DOWNREGULATES' else 'ASSOCIATED_WITH' end as label,
         round(1.0 - l_discount * 5, 2)::double as confidence
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey),
line as (select *, head || ' ' || label || ' ' || tail || ' q' || cast(l_quantity as int) as evidence,
                sha256(lower(translate(head, ' -', '__')) || chr(1) || 'Gene') as head_id, sha256(lower(translate(tail, ' -', '__')) || chr(1) || 'Compound/Drug') as tail_id from line0),
mention0 as (
  select chunk_id, head as name, 'Gene' as type, position * 2 as position from line union all select chunk_id, tail, 'Compound/Drug', position * 2 + 1 from line
  union all select 's' || s_suppkey, s_name, 'Gene', 0 from supplier union all select 'n' || n_nationkey, n_name, 'Tissue/Region', 0 from nation
  union all select 'r' || r_regionkey, r_name, 'Tissue/Region', 0 from region union all select 'c' || c_custkey, c_name, 'Phenotype', 0 from customer
  union all select 'c' || c_custkey, c_mktsegment, 'Disease', 1 from customer),
mention as (select *, lower(translate(name, ' -', '__')) as normalized_name from mention0),
spelling as (select normalized_name, type, lower(name) as low, first(name order by chunk_id, position) as name, min((chunk_id, position)) as place from mention group by 1, 2, 3),
named as (select normalized_name, type, first(name order by place) as name, first(low order by place) as low from spelling group by 1, 2),
ent as (select sha256(normalized_name || chr(1) || type) as id, n.name, normalized_name, type,
               coalesce((select string_agg(s.name, '|' order by s.name) from spelling s where s.normalized_name = n.normalized_name and s.type = n.type and s.low <> n.low and s.low <> n.normalized_name), '') as aliases from named n),
edge as (
  select head_id, tail_id, label, confidence from line
  union all select sha256(lower(s_name) || chr(1) || 'Gene'), sha256(lower(translate(n_name, ' -', '__')) || chr(1) || 'Tissue/Region'), 'EXPRESSED_IN', 1.0 from supplier join nation on n_nationkey = s_nationkey
  union all select sha256(lower(translate(n_name, ' -', '__')) || chr(1) || 'Tissue/Region'), sha256(lower(r_name) || chr(1) || 'Tissue/Region'), 'PART_OF', 1.0 from nation join region on r_regionkey = n_regionkey
  union all select sha256(lower(c_name) || chr(1) || 'Phenotype'), sha256(lower(translate(n_name, ' -', '__')) || chr(1) || 'Tissue/Region'), 'EXPRESSED_IN', 0.9 from customer join nation on n_nationkey = c_nationkey
  union all select sha256(lower(c_name) || chr(1) || 'Phenotype'), sha256(lower(c_mktsegment) || chr(1) || 'Disease'), 'ASSOCIATED_WITH', 0.8 from customer),
rel as (select sha256(head_id || chr(1) || tail_id || chr(1) || label) as id, head_id, tail_id, label, max(confidence)::double as confidence from edge group by head_id, tail_id, label),
raw as (select sha256(head_id || chr(1) || tail_id || chr(1) || label) as relation_id, chunk_id, position, evidence as quote, sha256(evidence) as quote_hash from line),
ev as (select sha256(relation_id || chr(1) || quote_hash) as id, relation_id, first(chunk_id order by chunk_id, position) as chunk_id, first(quote order by chunk_id, position) as quote, quote_hash from raw group by relation_id, quote_hash),
chunk as (select chunk_id as id, string_agg(evidence, '. ' order by position) as text from line group by 1),
me as (select sha256(lower(translate(first(s_name order by s_suppkey), ' -', '__')) || chr(1) || 'Gene') as id from supplier),
m20 as (select * from (select *, row_number() over (partition by chunk_id order by position) as rn from mention where chunk_id like 'o%') where rn <= 20),
t30 as (select * from (select *, row_number() over (partition by chunk_id order by confidence desc, position) as rn from line where l_orderkey % 50 <> 0 and confidence >= 0.5) where rn <= 30),
both_ways as (select head_id as node, tail_id as neighbor, false as back, id as edge, label, confidence from rel union all select tail_id, head_id, true, id, label, confidence from rel)
"""
CHARS = r"""
with doc as (select doc_id as id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents where text is not null),
chunk as (select id as document_id, i::int as chunk_index, substr(t, i * 800 + 1, 1000) as text, (i * 800)::int as start_offset, least(length(t), i * 800 + 1000)::int as end_offset
          from (select id, t, unnest(generate_series(0, greatest(0, ceil((length(t) - 1000) / 800.0)::bigint))) as i from doc where t <> ''))
"""

# Sentences with offsets in the stripped text, then greedy packing: one step a sentence, a cut where a chunk is full.
SENTENCES = r"""
with recursive doc as (select doc_id as id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents where text is not null),
part as (select id, t, unnest(p) as part, generate_subscripts(p, 1) as pos from (select id, t, string_split(regexp_replace(t, '([.!?])(\s+)([A-Z])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) as p from doc where t <> '')),
sent0 as (select id, t, pos, case when contains(part, chr(2)) then length(split_part(part, chr(2), 1)) else 0 end as gap, case when contains(part, chr(2)) then split_part(part, chr(2), 2) else part end as s from part),
sent as (select *, sum(gap + length(s)) over (partition by id order by pos) as stop, sum(length(s) + 1) over (partition by id order by pos) as packed from sent0),
doc2 as (select id, first(t) as t, count(*) as n, list(s order by pos) as ss, list(stop - length(s) order by pos) as starts, list(stop order by pos) as stops, list_concat([0], list(packed::bigint order by pos)) as total from sent group by id),
sized as (select *, %s as size, %s as overlap from doc2),
split as (select *, greatest(1, overlap // greatest(1, size // n)) as carry from sized where length(t) > size and n > 1),
walk as (select id, n, carry, size, total, 0::bigint as i, 0::bigint as first, null::bigint as cut_from, null::bigint as cut_to from split
         union all select id, n, carry, size, total, i + 1, case when full_ then case when i + 1 - first > carry then i + 1 - carry else i + 1 end else first end, case when full_ then first end, case when full_ then i + 1 end
         from (select *, i + 1 > first and total[i + 3] - total[first + 1] > size as full_ from walk where i + 1 < n)),
cut as (select id, cut_from as a, cut_to as b from walk where cut_to is not null union all select id, first, n from walk where i + 1 = n),
packed as (select id, row_number() over (partition by id order by b) - 1 as k, array_to_string(ss[a + 1 : b], ' ') as text, starts[a + 1] as a, stops[b] as b from cut join split using (id)
           union all select id, 0, t, 0, length(t) from sized where length(t) <= size or n = 1)
"""
DEGREE = "select e.id, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) as degree from ent e left join (select head_id, count(*) n from rel group by 1) o on o.head_id = e.id left join (select tail_id, count(*) n from rel group by 1) i on i.tail_id = e.id"

#: Two levels around the region Africa: nodes seen, in order, and edges; caps of 50 and 100.
TWO = """, start as (select sha256('africa' || chr(1) || 'Tissue/Region') as id),
    r0 as (select neighbor, edge, (0, back, edge) as place from both_ways, start where node = start.id and confidence >= 0),
    g0 as (select edge from (select edge, min(place) as place from r0 group by 1 order by 2 limit 100)),
    n1 as (select id, row_number() over (order by place) as rank from (select neighbor as id, min(place) as place from r0, start where neighbor <> start.id group by 1 order by 2 limit 49)),
    r1 as (select neighbor, edge, (rank, back, edge) as place from both_ways join n1 on node = n1.id where confidence >= 0),
    g1 as (select edge from (select edge, min(place) as place from r1 where edge not in (select edge from g0) group by 1 order by 2 limit (select 100 - count(*) from g0))),
    n2 as (select id from (select neighbor as id, min(place) as place from r1, start where neighbor <> start.id and neighbor not in (select id from n1) group by 1 order by 2 limit (select 49 - count(*) from n1))),
    seen as (select id, 0 as depth from start union all select id, 1 from n1 union all select id, 2 from n2), edges as (select edge from g0 union all select edge from g1) """

_kg = {
    "x2_repair_json": "select chunk_id, md5('{\"entities\": [' || string_agg('{\"name\":\"' || name || '\",\"type\":\"' || type || '\",\"normalized_name\":\"' || normalized_name || '\"}', ', ' order by position) || ']}') as h from mention where chunk_id like 'o%' group by 1",
    "x7_match_relation_label": "select label, count(*) as count from line group by 1",
    "x9_validate_vocabulary": "select p_type as value, count(*) as rows, 'ECONOMY, PROMO' as allowed from part where p_type not in ('ECONOMY', 'PROMO') group by 1",
    "x10_normalize_name": r"select p_partkey, lower(upper(p_name) || ' ' || p_brand) as name from part",
    "g8_extract_document": "select sha256(head_id || chr(1) || tail_id || chr(1) || label) as id, head_id, tail_id, label, max(confidence) as confidence from t30 where chunk_id in (select 'o' || o_orderkey from orders where o_custkey = 7) and (chunk_id, head) in (select chunk_id, name from m20) and (chunk_id, tail) in (select chunk_id, name from m20) group by 2, 3, 4",
    "g9_build_kg_evidence": ", t as (select *, sha256(head_id || chr(1) || tail_id || chr(1) || label) as relation_id, sha256(evidence) as quote_hash from t30 where (chunk_id, head) in (select chunk_id, name from m20) and (chunk_id, tail) in (select chunk_id, name from m20)) select sha256(relation_id || chr(1) || quote_hash) as id, relation_id, first(chunk_id order by chunk_id, position) as chunk_id, first(evidence order by chunk_id, position) as quote from t group by relation_id, quote_hash",
    "g9_build_kg_entities": "select sha256(normalized_name || chr(1) || type) as id, first(name order by chunk_id, rn) as name, normalized_name, type from m20 group by normalized_name, type",
    "q4_get_entity": "select e.id, name, type, (select count(*) from spelling s where s.normalized_name = e.normalized_name and s.type = e.type) - 1 as aliases from ent e, me where e.id = me.id",
    "q8_entity_names": "select id, (select string_agg(x, '|' order by x) from (select name as x union all select s.name from spelling s where s.normalized_name = e.normalized_name and s.type = e.type and s.low <> lower(e.name) and s.low <> e.normalized_name)) as names from ent e",
    "q10_get_document": "select c_custkey as id, count(o_orderkey) as chunk_count, count(u.chunk_id) > 0 as has_extractions from customer left join orders on o_custkey = c_custkey left join (select distinct chunk_id from ev) u on u.chunk_id = 'o' || o_orderkey where c_custkey = 7 group by 1",
    "q11_delete_documents_rest": ", d as (select c_custkey as id from customer where c_custkey % 5 = 0), k as (select 'o' || o_orderkey as id, o_custkey in (select id from d) as gone from orders) select 'documents' as kind, c_custkey::varchar as id from customer where c_custkey % 5 <> 0 union all select 'chunks', id from k where not gone union all select 'DELETE documents', id::varchar from d union all select 'DELETE chunks', id from k where gone union all select 'DELETE evidence', id from ev where chunk_id in (select id from k where gone)",
    "q13_delete_entities": ", p as (select id from ent where normalized_name like '%\\_brand#1' escape '\\'), r as (select * from rel where head_id not in (select id from p) and tail_id not in (select id from p)) select 'entities' as kind, id from ent where id not in (select id from p) union all select 'relations', id from r union all select 'evidence', id from ev where relation_id in (select id from r)",
    "s7_read_write": "select 'entity' as kind, id, name as value from ent union all select 'evidence', id, chunk_id from ev",
    "t4_find_paths": """, s as (select * from both_ways where label in ('EXPRESSED_IN', 'ASSOCIATED_WITH') and confidence >= 0), goal as (select min(sha256(lower(c_mktsegment) || chr(1) || 'Disease')) as id from customer),
        n1 as (select s.neighbor as id, min([(s.back, s.edge)]) as place from s, me, goal where node = me.id and neighbor not in (me.id, goal.id) group by 1),
        n2 as (select s.neighbor as id, min(list_concat(n1.place, [(s.back, s.edge)])) as place from s join n1 on s.node = n1.id, me, goal where s.neighbor not in (me.id, goal.id) and s.neighbor not in (select id from n1) group by 1),
        hit as (select list_concat(n2.place, [(s.back, s.edge)]) as place, n2.id as last, s.confidence as c3, row_number() over (order by list_concat(n2.place, [(s.back, s.edge)])) as path_rank from s join n2 on s.node = n2.id, goal where s.neighbor = goal.id),
        flat as (select path_rank, unnest(place) as way, generate_subscripts(place, 1) as step from hit where path_rank <= 5),
        steps as (select path_rank, step, way[1] as back, way[2] as edge, r.confidence, case when way[1] then r.head_id else r.tail_id end as node from flat join rel r on r.id = way[2]),
        total as (select path_rank, product(confidence) as c from steps group by 1)
        select path_rank::int as path_rank, 3 as path_length, round(c, 6) as total_confidence, step::int as step, node, edge, back from (select path_rank, step, node, edge, back from steps union all select distinct path_rank, 0, me.id, null, null from steps, me) x join total using (path_rank)""",
    "t1_subgraph_depth2": TWO + "select e.id, e.name, depth from ent e join seen using (id)",
    "t2_subgraph_edges_depth2": TWO + "select id, head_id, tail_id, label, confidence from rel where id in (select edge from edges)",
    "t3_subgraph_summary": TWO + """, n as (select e.id, e.type, depth from ent e join seen using (id)), g as (select label from rel where id in (select edge from edges))
        select 'nodes' as kind, null as key, count(*) as count from n union all select 'edges', null, count(*) from g union all select 'depth', null, max(depth) from n union all select 'truncated', null, ((select count(*) from n) >= 50 or (select count(*) from g) >= 100)::bigint union all select 'type', type, count(*) from n group by 2 union all select 'label', label, count(*) from g group by 2""",
    "t7_multi_center_depth2": ", c as (select id from ent where normalized_name ilike '%africa%' or normalized_name ilike '%household%'), one as (select distinct neighbor as id from both_ways where node in (select id from c) and neighbor not in (select id from c)), two as (select distinct neighbor as id from both_ways where node in (select id from one) and neighbor not in (select id from one) and neighbor not in (select id from c)), far as (select * from (select id, 1 as hops from one union all select id, 2 from two) where id in (select id from ent) order by hops, id limit (select greatest(0, 150 - count(*)) from c)), k as (select id from c union all select id from far) select id, head_id, tail_id from rel where head_id in (select id from k) and tail_id in (select id from k)",
    "t9_graph_view_nodes": f", top as (select id from ({DEGREE}) order by degree desc, id limit 200), ends as (select unnest([head_id, tail_id]) as id from rel where head_id in (select id from top) and tail_id in (select id from top)) select e.id, (select count(*) from ends where ends.id = e.id) as connections, case when length(name) > 22 then substr(name, 1, 22) || '…' else name end as view_label, true as is_centre from ent e where e.id in (select id from top)",
    "e12_terms_connected": ", pair(a, b) as (values ('supplier#00000000', 'asia'), ('customer#00000000', 'household'), ('ring', 'africa')), h as (select a, b, id from pair join ent on normalized_name ilike '%' || a || '%'), t as (select a, b, id from pair join ent on normalized_name ilike '%' || b || '%'), n as (select a, b, (select count(*) from rel where head_id in (select id from h where h.a = pair.a and h.b = pair.b) and tail_id in (select id from t where t.a = pair.a and t.b = pair.b)) as direct, (select count(distinct tail_id) from rel where head_id in (select id from h where h.a = pair.a and h.b = pair.b) and tail_id in (select head_id from rel where tail_id in (select id from t where t.a = pair.a and t.b = pair.b))) as common from pair) select *, direct > 0 or common > 0 as passed from n",
    "e13_overall_score": ", x as (select (select count(*) from rel where head_id in (select id from ent where normalized_name ilike '%supplier#00000000%') and tail_id in (select head_id from rel where tail_id in (select id from ent where normalized_name ilike '%asia%'))) > 0 or (select count(*) from rel where head_id in (select id from ent where normalized_name ilike '%supplier#00000000%') and tail_id in (select id from ent where normalized_name ilike '%asia%')) > 0 as p union all select (select count(*) from rel where head_id in (select id from ent where normalized_name ilike '%ring%') and tail_id in (select head_id from rel where tail_id in (select id from ent where normalized_name ilike '%africa%'))) > 0 or (select count(*) from rel where head_id in (select id from ent where normalized_name ilike '%ring%') and tail_id in (select id from ent where normalized_name ilike '%africa%')) > 0 union all select (select count(*) from rel where head_id in (select id from ent where normalized_name ilike '%supplier#00000000%')) > 0 union all select (select count(*) from rel where tail_id in (select id from ent where normalized_name ilike '%africa%')) > 0), n as (select count(*) filter (p) as passed, count(*) as checks from x) select *, case when passed / checks >= 0.8 then 'PASS' when passed / checks >= 0.5 then 'WARN' else 'FAIL' end as score from n",
    "e14_example_queries": f", found as (select d.id, e.name, degree from ({DEGREE}) d join ent e on e.id = d.id where normalized_name ilike '%supplier#00000000%'), f1 as (select id from found where degree > 0 order by name, id limit 1), near as (select neighbor, confidence, edge from both_ways, f1 where node = f1.id) select * from (select 'search' as query, name, degree::double as value from found order by name, id limit 5) union all select * from (select 'types', type, count(*)::double from ent group by 2 order by 3 desc, 2 limit 5) union all select * from (select 'neighbors', e.name, confidence from near join ent e on e.id = neighbor order by confidence desc nulls last, edge, neighbor limit 5)",
    "e16_check_constraints": """select 'entities: unique normalized_name, type' as rule, (select count(*) from (select 1 from ent group by normalized_name, type having count(*) > 1)) as violations
        union all select 'relations: unique head_id, tail_id, label', (select count(*) from (select 1 from rel group by head_id, tail_id, label having count(*) > 1)) union all select 'evidence: unique relation_id, chunk_id, quote_hash', (select count(*) from (select 1 from raw group by relation_id, chunk_id, quote_hash having count(*) > 1))
        union all select 'relations.head_id in entities', (select count(*) from rel where head_id not in (select id from ent)) union all select 'relations.tail_id in entities', (select count(*) from rel where tail_id not in (select id from ent)) union all select 'evidence.relation_id in relations', (select count(*) from raw where relation_id not in (select id from rel))
        union all select 'relations: confidence between 0 and 1', (select count(*) from rel where confidence not between 0 and 1) union all select 'entities.name not null', (select count(*) from ent where name is null) union all select 'entities.normalized_name not null', (select count(*) from ent where normalized_name is null) union all select 'entities.type not null', (select count(*) from ent where type is null)
        union all select 'relations.label not null', (select count(*) from rel where label is null) union all select 'evidence.quote not null', (select count(*) from raw where quote is null) union all select 'evidence.quote_hash not null', (select count(*) from raw where quote_hash is null)""",
    "a7_apply_repairs": "select id, case when id[1] = 'a' then upper(quote) else quote end as quote, case when id[1] = 'a' then sha256(upper(quote)) else quote_hash end as quote_hash from ev",
    "a8_repair_summary": ", n as (select length(quote) / 100.0 as s, length(quote) % 3 + 1 as k from ev where id[1] = 'a') select count(*) as repairs, round(min(s), 6)::double as min_similarity, round(avg(s), 6)::double as avg_similarity, round(max(s), 6)::double as max_similarity, count(*) filter (k = 1) as single_sentence, count(*) filter (k > 1) as multi_sentence from n",
    "a13_exact_match": ", q as (select id, chunk_id, case when id[:2] < '20' then upper(quote) when id[:2] = '20' then regexp_replace(quote, ' [A-Z_]+ ', ' ... ', 'g') when id[:2] = '21' then regexp_replace(quote, ' [A-Z_]+ ', ' acts on ', 'g') when id[:2] = '22' then substr(quote, 1, 12) || ' x ' || substr(quote, 13, 1000) when id[:2] = '23' then quote || ' and so does ' || quote when id[:2] = '24' then 'Nothing of this stands in the text at all.' else quote end as quote from ev) select q.id, contains(text, quote) or contains(lower(text), lower(quote)) as exact from q join chunk on chunk.id = chunk_id",
    "a14_diagnosis_recommendations": ", c as (select case when id[1] < '8' then 'ELLIPSIS' when id[1] < 'c' then 'CHUNK_EDGE' else 'HALLUCINATED' end as cause from ev) select cause, count(*) as count, round(count(*) * 100 / (select count(*) from c), 1)::double as pct, case cause when 'ELLIPSIS' then 61 when 'CHUNK_EDGE' then 29 else 45 end::int as advice from c group by 1",
    "x3_parse_entities": "select chunk_id, cast(rn - 1 as int) as position, name, type, normalized_name from m20",
    "x4_parse_relations": "select chunk_id, cast(position as int) as position, head, tail, label, confidence, evidence from t30",
    "x5_extraction_errors": "select 'run1' as run_id, chunk_id, 'relations' as pass, 'not JSON' as error, 'no json' as raw from (select distinct chunk_id from line where l_orderkey % 50 = 0)",
    "x11_extraction_summary": "select 'run1' as run_id, (select count(distinct chunk_id) from line) as chunks, (select count(*) from m20) as entities, (select count(*) from t30) as relations, (select count(distinct chunk_id) from line where l_orderkey % 50 = 0) as errors",
    "g1_build_entities": "select id, name, normalized_name, type, aliases from ent",
    "g2_resolve_mentions": "select chunk_id, cast(position as int) as position, head_id, tail_id from line",
    "g3_build_relations": "select * from rel",
    "g4_locate_quotes": "select ev.id, cast(instr(text, quote) - 1 as int) as quote_start, cast(instr(text, quote) - 1 + length(quote) as int) as quote_end from ev join chunk on chunk.id = chunk_id",
    "g6_build_evidence": "select * from ev",
    "g7_pending_chunks": "select 'o' || o_orderkey as id from orders where 'o' || o_orderkey not in (select chunk_id from ev)",
    "g9_build_kg": "select sha256(head_id || chr(1) || tail_id || chr(1) || label) as id, head_id, tail_id, label, max(confidence) as confidence from t30 where (chunk_id, head) in (select chunk_id, name from m20) and (chunk_id, tail) in (select chunk_id, name from m20) group by 2, 3, 4",
    "g11_quarantine_relations": "select chunk_id, cast(position as int) as position, round(confidence * 1.25, 4) as confidence from line where confidence * 1.25 > 1",
    "g12_triples": "select r.id, concat_ws(' ', h.name, label, t.name) as triple, count(ev.id) as evidence_count, count(ev.id) > 0 as has_evidence, confidence >= 0.7 as is_high_confidence, label not in ('ASSOCIATED_WITH', 'BINDS') as is_directional from rel r left join ent h on h.id = head_id left join ent t on t.id = tail_id left join ev on relation_id = r.id group by r.id, h.name, label, t.name, confidence",
    "g13_relation_evidence": "select r.id, count(ev.id) as evidence_count, coalesce(string_agg(quote, '|' order by ev.id), '') as quotes from rel r left join ev on relation_id = r.id group by r.id",
    "q1_search_entities": f"select d.id, e.name, e.type, out_degree, in_degree, degree from ({DEGREE}) d join ent e on e.id = d.id where normalized_name ilike '%ring_brand#1%' or name ilike '%ring_brand#1%' or exists (select 1 from spelling s where s.normalized_name = e.normalized_name and s.type = e.type and s.name ilike '%ring_brand#1%')",
    "q2_entity_matches": "select id, name from ent e where contains(lower(name), 'ring brand') or contains(normalized_name, 'ring brand') or exists (select 1 from spelling s where s.normalized_name = e.normalized_name and s.type = e.type and contains(s.low, 'ring brand'))",
    "q3_entity_type_counts": "select type, count(*) as count from ent group by 1",
    "q5_neighborhood": """, side as (select rel.*, tail_id as neighbor_id, 'outgoing' as direction, row_number() over (order by confidence desc nulls last, rel.id) rn from rel, me where head_id = me.id
        union all select rel.*, head_id, 'incoming', row_number() over (order by confidence desc nulls last, rel.id) from rel, me where tail_id = me.id)
        select s.id, label, confidence, neighbor_id, e.name as neighbor, direction, (select count(*) from ev where relation_id = s.id) as evidence_count from side s join ent e on e.id = neighbor_id where rn <= 25""",
    "q6_neighborhood_stats": """, side as (select rel.*, tail_id as neighbor_id, row_number() over (order by confidence desc nulls last, rel.id) rn from rel, me where head_id = me.id
        union all select rel.*, head_id, row_number() over (order by confidence desc nulls last, rel.id) from rel, me where tail_id = me.id), shown as (select s.label, e.type from side s join ent e on e.id = neighbor_id where rn <= 25)
        select 'total' as kind, null as key, count(*) as count from rel, me where head_id = me.id or tail_id = me.id union all select 'label', label, count(*) from shown group by 2 union all select 'neighbor_type', type, count(*) from shown group by 2""",
    "q7_entity_relations": "select rel.id, label, confidence, (select count(*) from ev where relation_id = rel.id) as quotes from rel, me where head_id = me.id or tail_id = me.id order by confidence desc nulls first, rel.id limit 20 offset 20",
    "q9_list_documents": "select c_custkey as id, count(o_orderkey) as chunk_count, count(u.chunk_id) > 0 as has_extractions from customer left join orders on o_custkey = c_custkey left join (select distinct chunk_id from ev) u on u.chunk_id = 'o' || o_orderkey group by 1",
    "q11_delete_documents": "select id, chunk_id from ev where chunk_id not in (select 'o' || o_orderkey from orders join customer on c_custkey = o_custkey where c_custkey % 5 = 0)",
    "q12_paginate": "select id, name from ent order by name, id limit 20 offset 40",
    "t1_subgraph": ", near as (select neighbor, min((back, edge)) as place from both_ways, me where node = me.id and confidence >= 0 and neighbor <> me.id group by 1 order by place limit 49) select e.id, e.name, case when e.id = me.id then 0 else 1 end as depth from ent e, me where e.id = me.id or e.id in (select neighbor from near)",
    "t2_subgraph_edges": ", near as (select edge, min((back, edge)) as place from both_ways, me where node = me.id and confidence >= 0.7 and label = 'BINDS' and neighbor in (select id from ent where type = 'Compound/Drug') group by 1 order by place limit 100) select id, head_id, tail_id, label, confidence from rel where id in (select edge from near)",
    "t6_shortest_hops": ", one as (select distinct neighbor as id from both_ways, me where node = me.id and neighbor <> me.id), two as (select distinct neighbor as id from both_ways where node in (select id from one) and neighbor not in (select id from one) and neighbor not in (select id from me)) select id, 0 as hops from me union all select id, 1 from one union all select id, 2 from two",
    "t7_multi_center_subgraph": ", c as (select id from ent where normalized_name ilike '%supplier#00000000%' or normalized_name ilike '%household%'), one as (select distinct neighbor as id from both_ways where node in (select id from c) and neighbor not in (select id from c) and neighbor in (select id from ent) order by 1 limit (select greatest(0, 150 - count(*)) from c)) select id, 0 as depth from c union all select id, 1 from one",
    "t8_top_degree_graph": f", top as (select id from ({DEGREE}) order by degree desc, id limit 200) select id, head_id, tail_id, label, confidence from rel where head_id in (select id from top) and tail_id in (select id from top)",
    "t9_graph_view": f", top as (select id from ({DEGREE}) order by degree desc, id limit 200), q as (select relation_id, count(*) as n, string_agg(case when length(quote) > 147 then substr(quote, 1, 147) || '...' else quote end, '|' order by rn) filter (rn <= 3) as quotes from (select *, row_number() over (partition by relation_id order by id) rn from ev) group by 1) select id, round(1 + 2 * confidence + 0.3 * least(coalesce(n, 0), 5), 6)::double as width, coalesce(n, 0) as evidence_count, coalesce(quotes, '') as quotes, case when n > 3 then 'and ' || (n - 3) || ' more' end as more from rel left join q on relation_id = id where head_id in (select id from top) and tail_id in (select id from top)",
    "t10_graph_stats": "select 'entities' as kind, null as key, count(*)::double as value from ent union all select 'relations', null, count(*) from rel union all select 'evidence', null, count(*) from ev union all select 'type', type, count(*) from ent group by 2 union all select 'label', label, count(*) from rel group by 2 union all select 'avg_confidence', null, round(avg(confidence), 3) from rel",
    "t11_degree": DEGREE,
    "t12_common_neighbors": ", a as (select id from ent where normalized_name ilike '%supplier#00000000%'), b as (select id from ent where normalized_name ilike '%asia%'), n as (select (select count(*) from rel where head_id in (select id from a) and tail_id in (select id from b)) as direct, (select count(distinct tail_id) from rel where head_id in (select id from a) and tail_id in (select head_id from rel where tail_id in (select id from b))) as common) select direct, common, direct > 0 or common > 0 as passed from n",
    "e1_summary_stats": """, n as (select (select count(*) from customer) as documents, (select count(*) from orders) as chunks, (select count(*) from ent) as entities, (select count(*) from ev) as evidence, (select count(distinct chunk_id) from ev) as chunks_processed,
        (select count(distinct relation_id) from ev) as covered, (select count(*) from rel) as relations, (select round(avg(confidence), 3) from rel) as avg_confidence, (select round(min(confidence), 3) from rel) as min_confidence, (select round(max(confidence), 3) from rel) as max_confidence)
        select *, round(chunks_processed * 100.0 / chunks, 2)::double as processed_pct, round(covered * 100.0 / relations, 2)::double as evidence_coverage_pct from n""",
    "e2_duplicates": "select 'entities' as kind, count(*) - count(distinct (normalized_name, type)) as duplicates from mention union all select 'relations', count(*) - count(distinct (head_id, tail_id, label)) from line union all select 'evidence', count(*) - count(distinct (relation_id, quote_hash)) from raw",
    "e3_orphan_relations": "select id, head_id, tail_id, label from rel where head_id not in (select id from ent) or tail_id not in (select id from ent)",
    "e4_relations_without_evidence": "select id, label from rel where id not in (select relation_id from ev)",
    "e5_entities_without_relations": "select id, name from ent where id not in (select head_id from rel) and id not in (select tail_id from rel)",
    "e6_ratios": "select round((select count(*) from rel) * 2 / (select count(*) from ent), 2) as relations_per_entity, round((select count(*) from ev) / (select count(*) from rel), 2) as evidence_per_relation",
    "e7_invalid_values": "select 'type' as kind, type as value, count(*) as count from ent where type not in ('Gene', 'Disease') group by 2 union all select 'label', label, count(*) from rel where label not in ('BINDS', 'INHIBITS') group by 2",
    "e8_term_has_edges": ", c as (select id from ent where normalized_name ilike '%supplier#00000000%'), n as (select (select count(*) from c) as entities, (select count(*) from rel where head_id in (select id from c)) as edges) select *, edges > 0 as passed from n",
    "e9_term_coverage": "select 4 as terms, sum(x)::int as found, sum(x) >= 3 as passed from (select (exists (select 1 from ent where normalized_name ilike '%' || t || '%'))::int as x from (values ('Supplier#'), ('small'), ('HOUSE'), ('nowhere')) v(t))",
    "e10_diversity": "select count(distinct type) as kinds, count(distinct type) >= 3 as passed from ent",
    "e11_evidence_validity": ", n as (select count(*) filter (contains(text, quote)) as valid, count(*) filter (not contains(text, quote)) as invalid from ev join chunk on chunk.id = chunk_id) select *, invalid = 0 or valid > invalid as passed from n",
    "e15_extraction_progress": ", n as (select (select count(*) from orders) as total, (select count(*) from orders where 'o' || o_orderkey in (select chunk_id from ev)) as processed, (select count(*) from ent) as entities, (select count(*) from rel) as relations, 0::bigint as errors) select *, total - processed as remaining from n",
    "a11_dedup_evidence": "select first(chunk_id || ':' || position order by chunk_id || ':' || lpad(position::varchar, 4, '0'), chunk_id || ':' || position) as id, relation_id, first(quote order by chunk_id || ':' || lpad(position::varchar, 4, '0'), chunk_id || ':' || position) as quote from raw group by relation_id, quote_hash",
    "r5_merge_entities": ", p as (select id from ent where normalized_name like '%\\_brand#1' escape '\\'), t as (select min(id) as id from p), e2 as (select case when head_id in (select id from p) then t.id else head_id end as head_id, case when tail_id in (select id from p) then t.id else tail_id end as tail_id, label, confidence from rel, t) select sha256(head_id || chr(1) || tail_id || chr(1) || label) as id, head_id, tail_id, label, max(confidence) as confidence from e2 group by 2, 3, 4",
}

CHAINS = KG.replace("with", "with recursive", 1) + r""",
sk as (select s_suppkey as k, 'supplier#' as p from supplier),
map0 as (
  select sha256(p || lpad(k::varchar, 9, '0') || chr(1) || 'Gene') as source_id, sha256(p || lpad((case when k = 5 then 10 else k // 2 end)::varchar, 9, '0') || chr(1) || 'Gene') as target_id from sk where k >= 2 and k <> 7
  union select sha256(p || lpad(k::varchar, 9, '0') || chr(1) || 'Gene'), sha256(p || lpad((k - 1)::varchar, 9, '0') || chr(1) || 'Gene') from sk where k > 0 and k % 9 = 0
  union select sha256(p || lpad(k::varchar, 9, '0') || chr(1) || 'Gene'), 'nowhere' from sk where k = 7),
chosen as (select source_id, min(target_id) as target_id from map0 group by 1),
steps(source_id, last, n) as (select source_id, target_id, 1 from chosen union all select s.source_id, c.target_id, n + 1 from steps s join chosen c on c.source_id = s.last where n < 200),
ends as (select source_id, last as target_id from steps where last not in (select source_id from chosen)),
root as (select * from ends where target_id in (select id from ent)),
sound as (select * from rel where head_id in (select id from ent) and tail_id in (select id from ent)),
moved as (select s.id as old_id, coalesce(h.target_id, s.head_id) as head_id, coalesce(t.target_id, s.tail_id) as tail_id, label, confidence from sound s left join root h on h.source_id = s.head_id left join root t on t.source_id = s.tail_id),
merged as (select sha256(head_id || chr(1) || tail_id || chr(1) || label) as id, head_id, tail_id, label, max(confidence) as confidence from moved group by 2, 3, 4),
mev as (select sha256(n.id || chr(1) || quote_hash) as id, n.id as relation_id, first(chunk_id order by chunk_id, ev.id) as chunk_id, quote_hash
        from ev join (select old_id, sha256(head_id || chr(1) || tail_id || chr(1) || label) as id from moved) n on n.old_id = ev.relation_id group by n.id, quote_hash)
"""

ORACLES = {
    "c3_chunk_sentences": SENTENCES % (1000, 200) + "select id as document_id, k::int as chunk_index, text, a::int as start_offset, b::int as end_offset, greatest(1, length(text) // 4)::int as token_count from packed",
    "c6_chunk_pending": SENTENCES % (1000, 200) + "select id as document_id, count(*) as chunks, sum(greatest(1, length(text) // 4))::bigint as tokens from packed group by 1",
    "c6_rechunk": SENTENCES % (1000, 200) + ", old as (" + (SENTENCES % (500, 50)).replace("with recursive", "with recursive", 1) + "select * from packed where k = 0 and id % 3 = 0) select id as document_id, count(*) as chunks, sum(greatest(1, length(text) // 4))::bigint as tokens from packed group by 1 union all select -id - 1, 1, greatest(1, length(text) // 4) from old",
    "c8_document_chunks": CHARS + "select document_id, chunk_index, chunk_index % 2 = 0 as has_extractions from chunk where document_id = 7",
    "c9_chunk_at_offset_first": CHARS + "select document_id, o::int as offset, min(chunk_index)::int as chunk_index, (o - min(start_offset))::int as relative from chunk, (values (0), (850), (1700)) v(o) where start_offset <= o and o < end_offset group by document_id, o",
    "c10_offsets": CHARS + "select document_id, chunk_index, case when 900 >= start_offset and 900 < end_offset then 900 - start_offset end::int as relative, case when 150 < end_offset - start_offset then 150 + start_offset end::int as absolute from chunk",
    "r2_list_jobs": "with r as (select user_id as id, min(ts) as t, count(*) as n from events group by 1), d as (select * from r where n >= 20) select id, 'completed' as status, (select count(*) from d) as total, (select ceil(count(*) / 15)::bigint from d) as pages from d order by t desc, id limit 15 offset 15",
    "r6_bulk_delete_audit": "select 'customer' as table_name, 'BULK_DELETE' as action, 'test' as reason, count(*) as ids from customer where c_custkey % 5 = 0",
    "r7_audit_history": "select c_custkey::varchar as record_id, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' as old_data from customer where c_custkey % 7 = 0",
    "s3_ingest_documents": "with x as (select doc_id as id, cast(doc_id // 10 as varchar) as pmid from documents), old as (select * from x where id % 20 = 0) select * from old union all select min(id), pmid from x where pmid not in (select pmid from old) group by pmid",
    "s4_filter_corpus": "with x as (select doc_id as id, lower(text) as t from documents), y as (select id, contains(t, 'the')::int as a, contains(t, 'la ')::int as b, contains(t, 'tion')::int as c, contains(t, 'ung')::int as d from x) select id, a + b + c + d as score from y where a + b > 0 and c + d > 0",
    "s5_full_text": "select doc_id as id, md5(concat_ws(chr(10) || chr(10), source, nullif(text, ''))) as h from documents",
    "c1_split_sentences": r"select id, cast(pos - 1 as int) as pos, sentence from (select id, unnest(s) as sentence, generate_subscripts(s, 1) as pos from (select doc_id as id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as s from documents))",
    "c2_split_paragraphs": r"select id, cast(pos - 1 as int) as pos, paragraph from (select id, unnest(s) as paragraph, generate_subscripts(s, 1) as pos from (select doc_id as id, list_filter(list_transform(regexp_split_to_array(text, '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as s from documents))",
    "c4_chunk_chars": CHARS + "select document_id, chunk_index, text, start_offset, end_offset from chunk",
    "c5_estimate_tokens": "select doc_id as id, cast(case when coalesce(length(text), 0) = 0 then 0 else greatest(1, length(text) // 4) end as int) as tokens from documents",
    "c7_chunking_stats": CHARS + "select (select count(*) from documents) as documents, (select count(*) from documents where coalesce(text, '') <> '') as with_abstract, count(distinct document_id) as chunked, (select count(*) from documents where coalesce(text, '') <> '' and doc_id not in (select document_id from chunk)) as needing, count(*) as chunks, sum(length(text))::bigint as total_chars, sum(greatest(1, length(text) // 4))::bigint as total_tokens, round(count(*) / count(distinct document_id), 6) as avg_chunks from chunk",
    "c9_chunk_at_offset": CHARS + "select document_id, o::int as offset, chunk_index, (o - start_offset)::int as relative from chunk, (values (0), (850), (1700)) v(o) where start_offset <= o and o < end_offset",
    "x6_match_entity_type": "select distinct p_type as value, case when p_type = 'ECONOMY' then 'ECO NOMY' when p_type = 'STANDARD' then 'Standard' when p_type = 'PROMO' then 'pro/mo' end as type from part",
    "r1_job_metrics": "with r as (select user_id as id, min(ts) as a, max(ts) as b, count(*) as n from events group by 1) select id, least(100, floor(n * 100 / 20))::int as progress, greatest(0, 20 - n)::int as items_remaining, round(epoch_us(b) / 1e6 - epoch_us(a) / 1e6, 3) as duration_seconds, n >= 20 as is_terminal from r",
    "r3_job_transitions": "with e as (select user_id as job_id, event_id, ts, case event_type when 'click' then 'pending' when 'view' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'cancelled' end as status from events), s as (select *, lag(status) over (partition by job_id order by ts, event_id) as before from e) select job_id, event_id, status, before from s where not case when before is null then status = 'pending' when before = 'pending' then status in ('running', 'cancelled') when before = 'running' then status in ('completed', 'failed', 'cancelled') else false end",
    "r4_diff_snapshots": "select 'customer' as table_name, c_custkey::varchar as record_id, case when c_custkey % 7 = 0 then 'DELETE' else 'UPDATE' end as action from customer where c_custkey % 7 = 0 or (c_custkey % 5 = 0 and c_nationkey <> 0)",
    "r5_merge_chains": CHAINS + "select id, head_id, tail_id, label, confidence from merged",
    "r5_merge_evidence": CHAINS + "select id, relation_id, chunk_id, quote_hash from mev",
    "r5_merge_report": CHAINS + "select 'several targets' as what, count(*) as rows from map0 where (source_id, target_id) not in (select source_id, target_id from chosen) having count(*) > 0 union all select 'cycle', count(*) from chosen where source_id not in (select source_id from ends) having count(*) > 0 union all select 'no such target', count(*) from ends where target_id not in (select id from ent) having count(*) > 0 union all select 'merged', count(*) from root having count(*) > 0 union all select 'entities', (select count(*) from ent) - count(*) from root union all select 'orphan edges', 0 union all select 'orphan evidence', 0",
    "s4_filter_corpus_dates": "with x as (select doc_id as id, lower(text) as t, date '2024-01-01' + (doc_id % 365)::int as publication_date from documents), y as (select id, contains(t, 'the')::int + contains(t, 'la ')::int + contains(t, 'der ')::int as score, publication_date from x where publication_date between date '2024-02-01' and date '2024-04-30') select id, score::int as score, publication_date::date as publication_date from y where score > 0 order by score desc, id limit 25",
    "c11_preview_chunks": SENTENCES % (1000, 200) + "select id as document_id, k::int as chunk_index, text, a::int as start_offset, b::int as end_offset from packed where id in (select doc_id from documents order by doc_id limit 5)",
    "q9_list_documents_newest": KG + ", n as (select c_custkey as id, count(o_orderkey) as chunk_count, count(u.chunk_id) > 0 as has_extractions, min(o_orderdate) as born from customer left join orders on o_custkey = c_custkey left join (select distinct chunk_id from ev) u on u.chunk_id = 'o' || o_orderkey group by 1) select id, chunk_count, has_extractions from n order by born desc nulls last, id limit 20 offset 20",
    "g9_build_kg_drop_on_error": KG + "select chunk_id, (rn - 1)::int as position, name, type from m20 where substr(chunk_id, 2)::bigint % 50 <> 0",
    "x2_repairs_parsed": KG + ", n as (select *, row_number() over (partition by chunk_id order by position) - 1 as rn, count(*) over (partition by chunk_id) as many from mention where chunk_id like 'o%') select chunk_id, rn::int as position, name, type, normalized_name from n where rn < 20 and (substr(chunk_id, 2)::bigint % 6 <> 5 or rn < many - 2)",
    "x3_parse_capped": KG + ", n as (select 'c' || o_custkey as chunk_id, head, tail, row_number() over (partition by o_custkey order by o_orderkey, position) - 1 as p from line join orders on o_orderkey = l_orderkey) select chunk_id, (2 * p)::int as position, head as name, 'Gene' as type from n where p < 10 union all select chunk_id, (2 * p + 1)::int, tail, 'Compound/Drug' from n where p < 10",
    "x4_parse_capped": KG + ", n as (select 'c' || o_custkey as chunk_id, head, tail, label, confidence, row_number() over (partition by o_custkey order by o_orderkey, position) - 1 as p from line join orders on o_orderkey = l_orderkey), r as (select *, row_number() over (partition by chunk_id order by confidence desc, p) as place from n where confidence >= 0.5) select chunk_id, p::int as position, head, tail, label, confidence from r where place <= 30",
    "i1_stream_ingest": "with x as (select doc_id, doc_id // 10 as pmid from documents), old as (select min(doc_id::varchar) as id, pmid from x where doc_id % 20 = 0 group by pmid) select id, pmid::varchar as pmid from old union all select min(doc_id::varchar), pmid::varchar from x where pmid not in (select pmid from old) group by pmid",
    "i2_stream_relations": KG + _kg["g9_build_kg"],
    "i2_stream_evidence": "select id, relation_id, quote from (" + KG + _kg["g9_build_kg_evidence"] + ")",
    "i2_stream_entities": "select id, normalized_name, type from (" + KG + _kg["g9_build_kg_entities"] + ")",
    "e8_term_has_edges_indexed": KG + _kg["e8_term_has_edges"],
    "q1_search_indexed": KG + "select p as pattern, id, name from ent, (values ('RING_brand#1'), ('supplier#%7'), ('a_b'), ('er'), ('no such name')) v(p) where normalized_name ilike '%' || p || '%' or name ilike '%' || p || '%' or len(list_filter(string_split(aliases, '|'), lambda a: a ilike '%' || p || '%')) > 0",
    **{name: KG + sql for name, sql in _kg.items()},
}
