"""SQL that gives the rows of the general problems' queries."""

_REFS = """with refs as (
  select 'observation' as table_name, row_no, 'subject.reference' as field_name, subject.reference as r, received_at, 'p' as k from observation
  union all select 'claim_response', row_no, 'patient.reference', patient.reference, received_at, 'p' from claim_response
  union all select 'claim_response', row_no, 'insurer.reference', insurer.reference, received_at, 'o' from claim_response),
 keyed as (select *, regexp_replace(regexp_replace(regexp_replace(trim(r), '^https://fhir.example.org/r4/', ''), '/_history(/[^/]*)?$', ''), '^[A-Za-z]+/', '') as key from refs where r is not null),
 targets as (select 'p' as k, id, min(received_at) as f, min(deleted_at) as g from patient group by id
  union all select 'o', id, min(received_at), min(deleted_at) from organization group by id),
 judged as (select keyed.*, strftime(received_at, '%Y-%m') as period, t.id is null or f > received_at or coalesce(g <= received_at, false) as orphan
  from keyed left join targets t on t.k = keyed.k and t.id = keyed.key)"""

# A document's leaves, sorted by their paths, stand for its value.
_CHANGES = """with docs as (select id, batch_no, coalesce(updated_at, created_at) as stamp, resource, case when json_valid(resource) then resource end as doc,
   coalesce(resource_id, case when json_valid(resource) then json_extract_string(resource, '$.id') end,
    case when json_valid(resource) and json_type(resource) = 'VARCHAR' then json_extract_string(json_extract_string(resource, '$'), '$.id') end) as key from fhir_resources),
 leaves as (select d.id, t.fullkey as path, case when t.type in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'n' || cast(cast(t.atom as double) as varchar) when t.type in ('OBJECT', 'ARRAY') then t.type else t.type || coalesce(cast(t.atom as varchar), '') end as v
  from docs d, json_tree(d.doc) t),
 states as (select id, md5(string_agg(path || '=' || v, chr(10) order by path)) as h from leaves group by id),
 versions as (select key, batch_no, stamp, d.id, case when resource is null then 'deleted' else coalesce(h, 't' || md5(resource)) end as state from docs d left join states s on s.id = d.id where key is not null),
 runs as (select run_no, last_batch, lag(run_no) over (order by run_no) as before from pipeline_run where run_status = 'succeeded'),
 seen as (select run_no, before, key, state from (select r.run_no, r.before, v.key, v.state, row_number() over (partition by r.run_no, v.key order by v.stamp desc nulls last, v.id desc) as k from runs r join versions v on v.batch_no <= r.last_batch) where k = 1)
 select a.run_no as run_no, a.key as resource_id from seen a left join seen b on b.run_no = a.before and b.key = a.key where b.key is null or a.state <> b.state"""

_ALWAYS = r"'(^|[.])(coding|telecom|identifier|line)([.]|$)', '\1\2[0]\3', 'g'"
_ELEMENTS = rf"""with docs as (select id, case when not json_valid(resource) then null when json_type(resource) <> 'VARCHAR' then resource when json_valid(json_extract_string(resource, '$')) then json_extract_string(resource, '$') end as doc from fhir_resources),
 nodes as (select d.id, t.type as type, regexp_replace(regexp_replace(regexp_replace(t.fullkey, '^[$][.]?', ''), {_ALWAYS}), {_ALWAYS}) as p from docs d, json_tree(d.doc) t)
 select id, p as node_path, regexp_extract(regexp_replace(p, '\[[0-9]+\]$', ''), '^(.*\])', 1) as parent_path from nodes where p like '%]' and type not in ('ARRAY', 'NULL')"""

# What each spelling means is counted from rows that have a code beside it, so the SQL needs no list of spellings.
_NUMBER = r"'([0-9]+(?:[.,][0-9]+)?)\s*([^0-9]*)'"
_PLAIN = r"'\s+|\.?\s*\(measured\)\s*$|\.$', '', 'g'"
_QUANTITIES = rf"""with o as (select row_no, [trim(c.code) for c in code.coding if c.system = 'urn:oid:2.16.840.1.113883.6.1' and trim(c.code) in ('29463-7', '8302-2', '8310-5', '4548-4', '2345-7', '2160-0', '8480-6', '718-7')][1] as own,
   [trim(c.code) for c in code.coding if c.system = 'http://lab.example.org/local'][1] as local, cast(valueQuantity.value as double) as v, nullif(trim(valueQuantity.code), '') as ucum, valueQuantity.unit as unit, valueString as s, code.text as text,
   [n.text for n in note if n.text is not null][1] as remark from observation),
 meant as (select local, arg_max(own, n) as loinc from (select local, own, count(*) as n from o where local is not null and own is not null group by 1, 2) group by 1),
 parts as (select row_no, coalesce(own, loinc) as loinc, ucum, case when v is not null then [v] else [cast(replace(x, ',', '.') as double) for x in regexp_extract_all(s, {_NUMBER}, 1)] end as numbers,
   case when v is null then regexp_extract_all(s, {_NUMBER}, 2) end as units, unit,
   regexp_extract(text, '^[^(\[,]*?(?: ?\((.+)\)| ?\[(.+)\]|, (.+)| in (.+))$', ['a', 'b', 'c', 'd']) as named,
   regexp_extract(regexp_replace(remark, '\s+per\s+\S+\s+\S+$', ''), '(?i)(?:(?:given|reported|measured|recorded) (?:in|as)|units? ?:|^in) *(.+?)[.]?$', 1) as noted from o left join meant using (local)),
 spelt as (select row_no, loinc, ucum, numbers, [regexp_replace(lower(u), {_PLAIN}) for u in units] as units,
   nullif(regexp_replace(lower(coalesce(nullif(trim(unit), ''), case when len(units) = 1 then nullif(trim(units[1]), '') end, nullif(named.a, ''), nullif(named.b, ''), nullif(named.c, ''), nullif(named.d, ''), nullif(noted, ''))), {_PLAIN}), '') as written
   from parts where loinc is not null and len(numbers) > 0),
 beside as (select loinc, written, unit_code, count(*) as n from spelt join unit_conversion on loinc_code = loinc and unit_code = ucum where len(numbers) = 1 and written is not null group by 1, 2, 3
   union all select loinc_code, lower(unit_code), unit_code, 0 from unit_conversion union all select loinc_code, w, unit_code, 0 from unit_conversion join (values (chr(39), '[ft_i]'), (chr(34), '[in_i]')) t(w, u) on u = unit_code),
 meaning as (select loinc, written, factor, shift from (select loinc, written, arg_max(unit_code, n) as u from beside group by 1, 2) join unit_conversion on loinc_code = loinc and unit_code = u),
 found as (select row_no, loinc, numbers[1] * factor + shift as common from spelt join unit_conversion on loinc_code = loinc and unit_code = ucum where len(numbers) = 1
   union all select row_no, s.loinc, numbers[1] * factor + shift from spelt s join meaning m on m.loinc = s.loinc and m.written = s.written where len(numbers) = 1 and ucum is null
   union all select row_no, s.loinc, numbers[1] * a.factor + numbers[2] * b.factor from spelt s join meaning a on a.loinc = s.loinc and a.written = units[1] join meaning b on b.loinc = s.loinc and b.written = units[2] where len(numbers) = 2)
 select row_no, loinc as loinc_code, cast(round(common * pow(10, decimals)) as bigint) as scaled_value from found join unit_target on loinc_code = loinc"""

ORACLES: dict[str, str] = {
    "p2_found": _REFS + " select table_name, row_no, field_name, period from judged where orphan",
    "p2_report": _REFS + " select table_name, field_name, period, count(*) as n_refs, count(*) filter (orphan) as n_orphans from judged group by 1, 2, 3",
    "p4_found": _CHANGES,
    "p5_found": _ELEMENTS,
    "p7_found": _QUANTITIES,
}
