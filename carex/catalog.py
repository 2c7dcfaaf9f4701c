"""Queries of the engine's own operators over a data folder, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from carex.functions.path_compiler import compile_path
from carex.operators.terminology import validate_codes, value_set
from carex.plans.measures import Measure, continuous, measure_report, membership, population_counts, proportion
from carex.plans.population import Population, group_statistics, most_recent, patient_windows
from carex.plans.views import preset, view_rows
from carex.session import table
from carex.sources.store import typed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2025-07-01 00:00:00"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _population(spark: SparkSession, sf: str) -> Population:
    names = {"Patient": "patient", "Observation": "observation", "ClaimResponse": "claim_response", "Organization": "organization"}
    return Population({k: table(spark, sf, v) for k, v in names.items()}, _value_sets(spark), AS_OF)


def _value_sets(spark: SparkSession) -> DataFrame:
    loinc = "urn:oid:2.16.840.1.113883.6.1"
    return value_set(spark, "glycaemia", [(loinc, "2345-7"), (loinc, "4548-4")]).unionByName(value_set(spark, "vitals", [(loinc, "8480-6"), (loinc, "29463-7"), (None, "HGT")]))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# Views
@query("""select id, name1.family as family, coalesce(array_to_string([g for g in name1.given if g is not null], ' '), '') as given, gender,
  birthDate as birth_date, active from (select *, [x for x in name if x is not null][1] as name1 from patient)""")
def view_patient_demographics(spark, sf):
    return view_rows(table(spark, sf, "patient"), preset("patient_demographics"))


@query("""select id as patient_id, a.use as use, coalesce(array_to_string([l for l in a.line if l is not null], ', '), '') as lines, a.city as city,
  a.state as state, a.postalCode as postal_code, a.country as country from (select id, unnest(address) as a from patient)""")
def view_for_each(spark, sf):
    return view_rows(table(spark, sf, "patient"), preset("patient_addresses"))


@query("""select id, a.city as city, a.state as state from (select id, unnest(case when coalesce(len(address), 0) = 0 then [null] else address end) as a from patient)""")
def view_for_each_or_null(spark, sf):
    view = {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}, {"forEachOrNull": "address", "column": [{"name": "city", "path": "city"}, {"name": "state", "path": "state"}]}]}
    return view_rows(table(spark, sf, "patient"), view)


@query("""select id, patient, i.itemSequence as item_no, a.category.text as category, a.amount as amount from
  (select id, patient, i, unnest(i.adjudication) as a from (select id, patient.reference as patient, unnest(item) as i from claim_response))""")
def view_nested_for_each(spark, sf):
    return view_rows(table(spark, sf, "claim_response"), preset("claim_adjudications"))


@query("""select id, t.value as phone, a.city as city from (select id, t, unnest(address) as a from (select id, address, unnest(telecom) as t from patient))""")
def view_two_for_each(spark, sf):
    view = {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}, {"forEach": "telecom", "column": [{"name": "phone", "path": "value"}]}, {"forEach": "address", "column": [{"name": "city", "path": "city"}]}]}
    return view_rows(table(spark, sf, "patient"), view)


@query("""select id, t.value as entry, 'telecom' as kind from (select id, unnest(telecom) as t from patient)
  union all select id, a.city, 'address' from (select id, unnest(address) as a from patient)""")
def view_union_all(spark, sf):
    branches = [{"forEach": p, "column": [{"name": "entry", "path": v}, {"name": "kind", "path": f"'{p}'"}]} for p, v in (("telecom", "value"), ("address", "city"))]
    return view_rows(table(spark, sf, "patient"), {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}, {"unionAll": branches}]})


@query("""select id, t.value as value from (select id, unnest([t for t in telecom if t.system = 'phone' and t.use = 'mobile']) as t from patient where gender = 'female')""")
def view_constants_and_where(spark, sf):
    view = {
        "resource": "Patient", "constant": [{"name": "kind", "valueCode": "phone"}, {"name": "use", "valueString": "mobile"}],
        "where": [{"path": "gender = 'female'"}],
        "select": [{"column": [{"name": "id", "path": "id"}]}, {"forEach": "telecom.where(system = %kind and use = %use)", "column": [{"name": "value", "path": "value"}]}],
    }
    return view_rows(table(spark, sf, "patient"), view)


@query("""select id, subject.reference as subject, [c for c in code.coding if c is not null][1].code as code, valueQuantity.value as value, valueQuantity.unit as unit
  from observation where len([c for c in flatten([k.coding for k in category]) if c.code = 'laboratory']) > 0""")
def view_filtered_by_category(spark, sf):
    return view_rows(table(spark, sf, "observation"), preset("lab_results"))


@query("""select 'Observation/' || id as key, case when starts_with(subject.reference, 'Patient/') then subject.reference end as patient_key from observation""")
def view_reference_keys(spark, sf):
    return view_rows(table(spark, sf, "observation"), {"resource": "Observation", "select": [{"column": [{"name": "key", "path": "getResourceKey()"}, {"name": "patient_key", "path": "subject.getReferenceKey(Patient)"}]}]})


@query("""with docs as (select case when json_type(resource) = 'VARCHAR' then json_extract_string(resource, '$') else resource end as d from fhir_resources where resource_type = 'Observation' and json_valid(resource)),
  objects as (select d from (select d from docs where json_valid(d)) where json_type(d) = 'OBJECT')
  select json_extract_string(d, '$.id') as id, json_extract_string(d, '$.status') as status, json_extract_string(d, '$.subject.reference') as subject,
  case json_type(d, '$.code.coding') when 'OBJECT' then json_extract_string(d, '$.code.coding.code') else json_extract_string(d, '$.code.coding[0].code') end as code, try_cast(json_extract_string(d, '$.valueQuantity.value') as double) as value from objects""")
def view_of_json_store(spark, sf):
    ddl = "struct<id:string,status:string,subject:struct<reference:string>,code:struct<coding:array<struct<code:string>>>,valueQuantity:struct<value:double>>"
    rows = table(spark, sf, "fhir_resources")
    view = {"resource": "Observation", "select": [{"column": [{"name": "id", "path": "id"}, {"name": "status", "path": "status"}, {"name": "subject", "path": "subject.reference"}, {"name": "code", "path": "code.coding[0].code"}, {"name": "value", "path": "valueQuantity.value"}]}]}
    return view_rows(typed(rows, "Observation", ddl), view)


@query("select resource_type, count(*) as n from fhir_resources group by resource_type")
def store_resource_counts(spark, sf):
    return table(spark, sf, "fhir_resources").groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with their items nested: orders and line items."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))).alias("item")
    )
    return table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Patient/"), F.col("o_custkey")).alias("patient"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), "item")


@query("""select o_orderkey as id, l_partkey as part, l_quantity as quantity from orders left join lineitem on l_orderkey = o_orderkey""")
def view_items_or_null(spark, sf):
    view = {"resource": "Claim", "select": [{"column": [{"name": "id", "path": "id"}]}, {"forEachOrNull": "item", "column": [{"name": "part", "path": "part"}, {"name": "quantity", "path": "quantity"}]}]}
    return view_rows(_claims(spark, sf), view)


@query("""select o_orderkey as id, count(l_orderkey) as items, count(*) filter (l_quantity > 25) as large, count(*) filter (l_returnflag = 'R') > 0 as returned, round(coalesce(sum(l_extendedprice), 0), 2) as price
  from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def path_over_items(spark, sf):
    view = {"resource": "Claim", "select": [{"column": [
        {"name": "id", "path": "id"}, {"name": "items", "path": "item.count()"}, {"name": "large", "path": "item.where(quantity > 25).count()"},
        {"name": "returned", "path": "item.exists(flag = 'R')"}, {"name": "price", "path": "item.price.aggregate($this + $total, 0.0)"}]}]}
    out = view_rows(_claims(spark, sf), view)
    return _long(out, "items", "large").withColumn("price", F.round("price", 2))


# Paths
def _paths(df: DataFrame, resource: str, **paths: str) -> DataFrame:
    made = {n: compile_path(p, df.schema, resource, as_of=AS_OF) for n, p in paths.items()}
    return df.select(*[t.one().col.alias(n) for n, t in made.items()])


@query("""select row_no, upper(code.text) as up, code.text[2:] as rest, strpos(code.text, 'o') - 1 as at, replace(code.text, 'Body', 'X') as swapped, contains(code.text, 'weight') as has,
  starts_with(code.text, 'Gl') as starts, cast(length(code.text) as bigint) as size, regexp_replace(code.text, '[aeiou]', '', 'g') as bare, trim(id) || '/' || status as joined from observation""")
def path_strings(spark, sf):
    out = _paths(table(spark, sf, "observation"), "Observation", row_no="row_no", up="code.text.upper()", rest="code.text.substring(1)", at="code.text.indexOf('o')", swapped="code.text.replace('Body', 'X')", has="code.text.contains('weight')", starts="code.text.startsWith('Gl')", size="code.text.length()", bare="code.text.replaceMatches('[aeiou]', '')", joined="id.trim() + '/' + status")
    return _long(out, "at", "size")


@query("""select row_no, round(abs(v - 100), 4) as a, cast(ceil(v) as bigint) as c, cast(floor(v) as bigint) as f, round(v, 1) as r, round(sqrt(v), 4) as q, cast(trunc(v) as bigint) as t, round(v * 2 + 1, 4) as lin, round(v / 7, 4) as d, cast(floor(v / 7) as bigint) as i
  from (select row_no, cast(valueQuantity.value as double) as v from observation) where v is not null""")
def path_math(spark, sf):
    v = "valueQuantity.value"
    out = _paths(table(spark, sf, "observation").where("valueQuantity.value is not null"), "Observation", row_no="row_no", a=f"({v} - 100).abs()", c=f"{v}.ceiling()", f=f"{v}.floor()", r=f"{v}.round(1)", q=f"{v}.sqrt()", t=f"{v}.truncate()", lin=f"{v} * 2 + 1", d=f"{v} / 7", i=f"{v} div 7")
    return out.withColumns({n: F.round(n, 4) for n in ("a", "q", "lin", "d")})


@query("""select row_no, cast(len(code.coding) as bigint) as n, len(code.coding) > 0 as some, code.coding[1].code as first_code, code.coding[len(code.coding)].code as last_code,
  cast(greatest(len(code.coding) - 1, 0) as bigint) as rest, cast(len(list_distinct([c.system for c in code.coding])) as bigint) as systems,
  len([c for c in code.coding if c.code like 'H%']) > 0 as h, array_to_string([c.code for c in code.coding], ',') as codes from observation""")
def path_collections(spark, sf):
    c = "code.coding"
    out = _paths(table(spark, sf, "observation"), "Observation", row_no="row_no", n=f"{c}.count()", some=f"{c}.exists()", first_code=f"{c}.first().code", last_code=f"{c}.last().code", rest=f"{c}.tail().count()", systems=f"{c}.system.distinct().count()", h=f"{c}.exists(code.startsWith('H'))", codes=f"{c}.code.join(',')")
    return _long(out, "n", "rest", "systems")


@query("""select id, active and gender = 'male' as both, active or gender = 'male' as either, not active as inverse, (not active) or gender = 'male' as implied, active <> (gender = 'male') as one_of,
  coalesce(len(address), 0) > 0 and coalesce(len(telecom), 0) = 0 as mailed, gender in ('male', 'female') as stated from patient""")
def path_logic(spark, sf):
    return _paths(table(spark, sf, "patient"), "Patient", id="id", both="active and gender = 'male'", either="active or gender = 'male'", inverse="active.not()", implied="active implies gender = 'male'", one_of="active xor (gender = 'male')", mailed="address.exists() and telecom.empty()", stated="gender in ('male' | 'female')")


@query("""select row_no, try_cast(v as integer) as i, try_cast(v as double) as d, try_cast(v as double) is not null as is_number from
  (select row_no, regexp_extract(valueString, '[0-9]+') as v from observation where valueString is not null)""")
def path_conversions(spark, sf):
    rows = table(spark, sf, "observation").where("valueString is not null").select("row_no", F.regexp_extract("valueString", "[0-9]+", 0).alias("v"))
    return _paths(rows, "Observation", row_no="row_no", i="v.toInteger()", d="v.toDecimal()", is_number="v.convertsToDecimal()")


@query("""select row_no, year(received_at) as y, month(received_at) as m, received_at + interval 3 month as later, cast(received_at as date) as day,
  date_diff('year', received_at, timestamp '2025-07-01') as crossed, cast(extract(year from age(timestamp '2025-07-01', received_at)) as bigint) as whole from claim_response""")
def path_dates(spark, sf):
    out = _paths(table(spark, sf, "claim_response"), "ClaimResponse", row_no="row_no", y="year from received_at", m="month from received_at", later="received_at + 3 months", day="date from received_at", crossed="difference in years between received_at and Now()", whole="years between received_at and Now()")
    return _long(out, "y", "m")


@query("""select vec_id, round(list_sum(e), 4) as total, round(list_avg(e), 4) as mean, round(list_max(e), 4) as top, round(list_min(e), 4) as low, round(list_median(e), 4) as middle
  from (select vec_id, [cast(x as double) for x in embedding] as e from embeddings)""")
def path_statistics(spark, sf):
    out = _paths(table(spark, sf, "embeddings"), "Vector", vec_id="vec_id", total="Sum(embedding)", mean="Avg(embedding)", top="Max(embedding)", low="Min(embedding)", middle="Median(embedding)")
    return out.withColumns({n: F.round(n, 4) for n in ("total", "mean", "top", "low", "middle")})


@query("""select id, greatest(received_at, timestamp '2022-01-01') < least(coalesce(deleted_at, timestamp '2030-01-01'), timestamp '2024-01-01') as overlaps,
  received_at >= timestamp '2022-01-01' and coalesce(deleted_at, timestamp '2030-01-01') <= timestamp '2024-01-01' as during, coalesce(deleted_at, timestamp '2030-01-01') < timestamp '2022-01-01' as before, received_at > timestamp '2024-01-01' as after from patient""")
def interval_relations(spark, sf):
    mine, year = "Interval[received_at, Coalesce(deleted_at, @2030-01-01T00:00:00))", "Interval[@2022-01-01T00:00:00, @2024-01-01T00:00:00)"
    rows = table(spark, sf, "patient").select("id", "received_at", F.coalesce("deleted_at", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).alias("deleted_at"))
    mine = "Interval[received_at, deleted_at]"
    return _paths(rows, "Patient", id="id", overlaps=f"{mine} overlaps Interval(@2022-01-01T00:00:00, @2024-01-01T00:00:00)", during=f"{mine} during Interval[@2022-01-01T00:00:00, @2024-01-01T00:00:00]", before=f"{mine} before Interval[@2022-01-01T00:00:00, @2024-01-01T00:00:00]", after=f"{mine} after Interval[@2022-01-01T00:00:00, @2024-01-01T00:00:00]")


# Populations
@query("""select row_no, id from observation where len([c for c in code.coding if trim(c.code) in ('2345-7', '4548-4') and c.system = 'urn:oid:2.16.840.1.113883.6.1']) > 0""")
def population_retrieve_value_set(spark, sf):
    return _population(spark, sf).query('[Observation: "glycaemia"] o return {row_no: o.row_no, id: o.id}')


@query("""select id, gender from patient p where exists (select 1 from observation o where list_last(string_split(o.subject.reference, '/')) = p.id and o.status = 'final')""")
def population_with(spark, sf):
    return _population(spark, sf).query("[Patient] p with [Observation] o such that o.subject references p and o.status = 'final' return {id: p.id, gender: p.gender}")


@query("""select id from patient p where not exists (select 1 from claim_response c where list_last(string_split(c.patient.reference, '/')) = p.id)""")
def population_without(spark, sf):
    return _population(spark, sf).query("[Patient] p without [ClaimResponse] c such that c.patient references p return {id: p.id}")


@query("""select id from patient p where gender = 'female' and exists (select 1 from observation o where list_last(string_split(o.subject.reference, '/')) = p.id and o.received_at > p.received_at)
  and not exists (select 1 from claim_response c where list_last(string_split(c.patient.reference, '/')) = p.id and c.status = 'cancelled')""")
def population_with_and_without(spark, sf):
    return _population(spark, sf).query("""[Patient] p with [Observation] o such that o.subject references p and o.received_at after p.received_at
      without [ClaimResponse] c such that c.patient references p and c.status = 'cancelled' where p.gender = 'female' return {id: p.id}""")


@query("""select row_no, round(cast(valueQuantity.value as double) * 2, 4) as doubled, case when cast(valueQuantity.value as double) * 2 > 100 then 'high' else 'low' end as band, coalesce(valueQuantity.unit, 'none') as unit
  from observation where valueQuantity.value is not null and status = 'final'""")
def population_let_return(spark, sf):
    out = _population(spark, sf).query("""[Observation] o let d: o.valueQuantity.value * 2, b: case when d > 100 then 'high' else 'low' end
      where o.valueQuantity.value is not null and o.status = 'final' return {row_no: o.row_no, doubled: d, band: b, unit: Coalesce(o.valueQuantity.unit, 'none')}""")
    return out.withColumn("doubled", F.round("doubled", 4))


@query("select round(avg(cast(valueQuantity.value as double)), 4) as value from observation where valueQuantity.unit = 'mg/dL'")
def population_average(spark, sf):
    return _population(spark, sf).query("Avg([Observation] o where o.valueQuantity.unit = 'mg/dL' return o.valueQuantity.value)").select(F.round(F.col("value").cast("double"), 4).alias("value"))


@query("select count(*) as value from claim_response where outcome = 'error'")
def population_count(spark, sf):
    return _population(spark, sf).query("Count([ClaimResponse] c where c.outcome = 'error')")


@query("""select round(sum(a.amount), 2) as value from (select unnest(i.adjudication) as a from (select unnest(item) as i from claim_response))""")
def population_aggregate(spark, sf):
    p = _population(spark, sf)
    amounts = view_rows(p.tables["ClaimResponse"], preset("claim_adjudications"))
    out = Population({"Amount": amounts}).query("[Amount] x aggregate t starting 0: t + x.amount")
    return out.select(F.round("value", 2).alias("value"))


@query("""select distinct list_last(string_split(subject.reference, '/')) as value from observation where subject.reference is not null
  intersect select list_last(string_split(patient.reference, '/')) from claim_response where patient.reference is not null""")
def population_intersect(spark, sf):
    return _population(spark, sf).query("([Observation] o where o.subject.reference is not null return o.subject.reference.split('/').last()) intersect ([ClaimResponse] c where c.patient.reference is not null return c.patient.reference.split('/').last())")


@query("""select id as value from patient except select list_last(string_split(subject.reference, '/')) from observation where subject.reference is not null""")
def population_except(spark, sf):
    return _population(spark, sf).query("([Patient] p return p.id) except ([Observation] o where o.subject.reference is not null return o.subject.reference.split('/').last())")


@query("""select id as value from organization union select list_last(string_split(insurer.reference, '/')) from claim_response where insurer.reference is not null""")
def population_union(spark, sf):
    return _population(spark, sf).query("([Organization] o return o.id) union ([ClaimResponse] c where c.insurer.reference is not null return c.insurer.reference.split('/').last())")


@query("""select c.row_no as row_no, o.name as insurer from claim_response c, organization o where list_last(string_split(c.insurer.reference, '/')) = o.id and c.outcome = 'complete'""")
def population_two_sources(spark, sf):
    return _population(spark, sf).query("from [ClaimResponse] c, [Organization] o where c.insurer.reference.split('/').last() = o.id and c.outcome = 'complete' return {row_no: c.row_no, insurer: o.name}")


@query("""select coalesce(text, 'none') as measured, count(*) as n, round(avg(v), 4) as mean, round(min(v), 4) as low, round(max(v), 4) as high, round(median(v), 4) as middle from
  (select code.text as text, cast(valueQuantity.value as double) as v from observation) group by 1""")
def population_group_statistics(spark, sf):
    obs = table(spark, sf, "observation")
    v = "valueQuantity.value + 0.0"
    out = group_statistics(obs, {"measured": "Coalesce(code.text, 'none')"}, {"n": ("Count", "row_no"), "mean": ("Avg", v), "low": ("Min", v), "high": ("Max", v), "middle": ("Median", v)})
    return out.withColumns({n: F.round(n, 4) for n in ("mean", "low", "high", "middle")})


@query("""select year(ts) as y, month(ts) as m, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2, 3""")
def population_time_series(spark, sf):
    out = group_statistics(table(spark, sf, "events"), {"y": "year from ts", "m": "month from ts", "event_type": "event_type"}, {"n": ("Count", "event_id"), "total": ("Sum", "value")})
    return _long(out.withColumn("total", F.round("total", 2)), "y", "m")


@query("""select event_type, round(quantile_cont(value, 0.25), 4) as p25, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.9), 4) as p90, round(stddev_samp(value), 4) as sd from events group by event_type""")
def population_percentiles(spark, sf):
    out = table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", [0.25, 0.5, 0.9]).alias("p"), F.round(F.stddev_samp("value"), 4).alias("sd"))
    return out.select("event_type", *[F.round(F.col("p")[k], 4).alias(n) for k, n in enumerate(("p25", "p50", "p90"))], "sd")


@query("""select user_id as patient, event_id as tie, value, row_number() over (partition by user_id order by ts, event_id) as record_sequence, count(*) over (partition by user_id) as patient_record_count,
  round(avg(value) over (partition by user_id), 4) as patient_avg, case when value > m then 'Above' when value < m then 'Below' when value is not null then 'At Median' end as side
  from events, (select median(value) as m from events)""")
def population_windows(spark, sf):
    out = patient_windows(table(spark, sf, "events"), F.col("user_id"), F.col("ts"), F.col("value"), F.col("event_id"))
    return _long(out.select("patient", "tie", "value", "record_sequence", "patient_record_count", F.round("patient_avg", 4).alias("patient_avg"), "side"), "record_sequence")


@query("""select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1""")
def population_most_recent(spark, sf):
    return most_recent(table(spark, sf, "events"), F.col("user_id"), F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type", "value")


@query("""select row_no, code.coding[1].code as code, exists (select 1 from unit_target t where t.loinc_code = trim(code.coding[1].code)) and code.coding[1].system = 'urn:oid:2.16.840.1.113883.6.1' as is_valid from observation""")
def terminology_validate(spark, sf):
    rows = table(spark, sf, "observation").select("row_no", F.get("code.coding", F.lit(0)).alias("c"))
    known = table(spark, sf, "unit_target").select(F.lit("LOINC").alias("system"), F.col("loinc_code").alias("code"))
    return validate_codes(rows, F.col("c.code"), F.col("c.system"), known).select("row_no", F.col("c.code").alias("code"), "is_valid")


# Measures
CONTACTABLE = Measure(
    "contactable", "proportion",
    {"initial-population": "gender.exists()", "denominator": "active", "denominator-exclusion": "deleted_at.exists()", "denominator-exception": "address.empty()", "numerator": "telecom.where(system = 'phone').exists()"},
    stratifiers={"gender": "gender"},
)
_MEMBERS = """with m as (select gender, gender is not null as ip, coalesce(gender is not null and active, false) as d, coalesce(gender is not null and active, false) and deleted_at is not null as dx,
  coalesce(gender is not null and active, false) and coalesce(len(address), 0) = 0 as de, coalesce(gender is not null and active, false) and len([t for t in telecom if t.system = 'phone']) > 0 as n0 from patient),
  c as (select *, coalesce(n0, false) as n from m)"""


@query(_MEMBERS + """ select count(*) filter (n and not dx) as numerator_count, count(*) filter (d and not dx and not (de and not n)) as denominator_count,
  round(100.0 * count(*) filter (n and not dx) / count(*) filter (d and not dx and not (de and not n)), 4) as score from c""")
def measure_proportion(spark, sf):
    counts = population_counts(membership(table(spark, sf, "patient"), CONTACTABLE))
    return proportion(counts).select("numerator_count", "denominator_count", F.round("score", 4).alias("score"))


@query(_MEMBERS + """ select gender, count(*) filter (ip) as initial_population, count(*) filter (d) as denominator, count(*) filter (dx) as denominator_exclusion, count(*) filter (n) as numerator from c group by gender""")
def measure_stratified(spark, sf):
    return population_counts(membership(table(spark, sf, "patient"), CONTACTABLE), ["gender"]).select("gender", "initial_population", "denominator", "denominator_exclusion", "numerator")


@query()
def measure_report_document(spark, sf):
    return measure_report(population_counts(membership(table(spark, sf, "patient"), CONTACTABLE)), CONTACTABLE, ("2025-01-01", "2025-12-31"))


@query("""select o_orderstatus as status, count(*) as n, round(avg(o_totalprice), 2) as mean, round(median(o_totalprice), 2) as middle, round(min(o_totalprice), 2) as low, round(max(o_totalprice), 2) as high from orders group by o_orderstatus""")
def measure_continuous(spark, sf):
    m = Measure("price", "continuous-variable", {}, observation="o_totalprice", stratifiers={"status": "o_orderstatus"})
    out = continuous(membership(table(spark, sf, "orders"), m, "o_orderkey"), ["status"])
    return out.select("status", "n", *[F.round(c, 2).alias(a) for c, a in (("mean", "mean"), ("median", "middle"), ("min", "low"), ("max", "high"))])


@query("""select r_name as region, n_name as nation, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def population_rollup(spark, sf):
    nations = F.broadcast(table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))  # fixed tables
    joined = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
