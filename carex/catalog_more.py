"""Queries of functions and operators that no other query runs, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from carex.catalog import _long, _paths, _population, query
from carex.operators import terminology as term
from carex.plans.library import Library, per_patient
from carex.plans.population import by_context, restricted
from carex.plans.views import template, view_rows
from carex.session import table


@query("""select id, len(t) = len(list_filter(t, lambda x: x)) as all_true, len(t) = len(list_filter(t, lambda x: not x)) as all_false, len(list_filter(t, lambda x: x)) > 0 as any_true, len(list_filter(t, lambda x: not x)) > 0 as any_false
  from (select id, [x.system = 'phone' for x in coalesce(telecom, [])] as t from patient where len(list_filter(coalesce(telecom, []), lambda x: x.system is null)) = 0)""")
def path_quantifiers(spark, sf):
    rows = table(spark, sf, "patient").where("size(filter(coalesce(telecom, array()), x -> x.system is null)) = 0")
    t = "telecom.select(system = 'phone')"
    return _paths(rows, "Patient", id="id", all_true=f"{t}.allTrue()", all_false=f"{t}.allFalse()", any_true=f"{t}.anyTrue()", any_false=f"{t}.anyFalse()")


@query("""select vec_id, list_distinct(e[1:4]) <> [] as some, cast(len(list_intersect(e[1:6], e[4:9])) as bigint) as common, len(list_filter(e[1:4], lambda x: not list_contains(e, x))) = 0 as subset, round(list_sum(e[1:3]), 4) + 0.0 as front,
  round(e[len(e)], 4) + 0.0 as last, round(coalesce(e[100000], -1.0), 4) + 0.0 as missing, round(list_product(e[1:3]), 4) + 0.0 as product, round(list_var_pop(e), 6) as variance, round(list_stddev_samp(e), 6) as deviation from
  (select vec_id, [cast(x as double) for x in embedding] as e from embeddings)""")
def path_lists_of_numbers(spark, sf):
    e = "embedding"
    out = _paths(table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "Vector", vec_id="vec_id", some=f"{e}.take(4).distinct().exists()", common=f"{e}.take(6).intersect({e}.skip(3).take(6)).count()", subset=f"{e}.take(4).subsetOf({e})", front=f"Sum({e}.take(3))", last=f"{e}.last()", missing=f"{e}.indexer(99999, -1.0)", product=f"Product({e}.take(3))", variance=f"PopulationVariance({e})", deviation=f"StdDev({e})")
    return _long(out, "common").withColumns({n: F.round(n, 4) + F.lit(0.0) for n in ("front", "last", "missing", "product")} | {n: F.round(n, 6) for n in ("variance", "deviation")})


@query("""select row_no, code.text = lower(code.text) as lowered, lower(trim(code.text)) is not distinct from lower(trim('BODY WEIGHT')) as alike, coalesce(array_to_string([x for x in string_split(code.text, '')], '-'), '') as chars, case when length(code.text) > 8 then 'long' when length(code.text) <= 8 then 'short' end as size,
  case when lower(status) in ('true', 'final') then 'x' else status end as picked, coalesce(array_to_string([c.code for c in code.coding if c.code is not null], ''), '') as glued from observation""")
def path_texts_more(spark, sf):
    return _paths(table(spark, sf, "observation"), "Observation", row_no="row_no", lowered="code.text = code.text.lower()", alike="code.text ~ 'Body Weight'", chars="code.text.toChars().join('-')", size="iif(code.text.length() > 8, 'long', 'short')", picked="if status in ('true' | 'final') then 'x' else status", glued="code.coding.code.join()")


@query("""select o_orderkey as id, o_orderstatus = 'F' as b, cast(o_custkey as varchar) as s, try_cast(cast(o_orderdate as varchar) as date) as d, cast(o_totalprice as bigint) is not null as is_number, try_cast(o_orderpriority as integer) is not null as whole,
  o_custkey - 1 as before, o_custkey + 1 as after, case when o_orderstatus = 'O' then null else o_orderstatus end as not_open, o_totalprice between 1000 and 100000 as within from orders""")
def path_conversions_more(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("b"), "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_totalprice").alias("total"), "o_orderpriority", "o_orderstatus")
    return _paths(rows, "Order", id="id", b="b.toBoolean()", s="o_custkey.toString()", d="d.toDate()", is_number="total.convertsToDecimal()", whole="o_orderpriority.convertsToInteger()", before="Predecessor(o_custkey)", after="Successor(o_custkey)", not_open="o_orderstatus.nullIf('O')", within="total.withinNormalRange(1000, 100000)")


_ITEMS = "select l_orderkey, list(struct_pack(n := l_linenumber, f := l_returnflag, q := l_quantity) order by l_linenumber, l_returnflag, l_quantity) as i from lineitem group by 1"


@query(f"""select l_orderkey as id, [x.q for x in i if x.q = list_min([y.q for y in i])][1] as least, cast(len(list_distinct([x.f for x in i])) as bigint) as flags, cast(len(i) - len(list_distinct([x.q for x in i])) as bigint) as repeats,
  [x.q for x in i] = list_sort([x.q for x in i]) as ordered, cast(len([x for x in i if x.f = 'R']) as bigint) as returned, len(list_distinct([x.f for x in i])) = len(i) as all_differ from ({_ITEMS})""")
def path_lists_of_objects(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q")))).alias("i"))
    out = _paths(items, "Order", id="id", least="i.sortBy(q).first().q", flags="i.f.frequencies().count()", repeats="i.q.count() - i.q.distinct().count()", ordered="i.q.isSorted()", returned="i.partitionBy(f = 'R').matching.count()", all_differ="i.f.duplicates().empty()")
    return _long(out, "flags", "repeats", "returned")


@query(f"""select l_orderkey as id, cast(len(list_distinct([x.f for x in i]) ) as bigint) as kinds, cast(len([x for x in i if x.f not in ('N')]) as bigint) as others, cast(len([x for x in i if x.f = 'N']) as bigint) as same, cast(len(i) + (case when len([x for x in i if x.f = 'Z']) = 0 then 1 else 0 end) as bigint) as with_z from ({_ITEMS})""")
def path_lists_by_key(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q")))).alias("i"))
    items = items.withColumn("ns", F.expr("array(named_struct('n', 0L, 'f', 'N', 'q', 0d))").cast(items.schema["i"].dataType)).withColumn("zs", F.expr("array(named_struct('n', 0L, 'f', 'Z', 'q', 0d))").cast(items.schema["i"].dataType))
    return _long(_paths(items, "Order", id="id", kinds="i.distinctBy(f).count()", others="i.exceptBy(ns, f).count()", same="i.intersectBy(ns, f).count()", with_z="i.unionBy(zs, f).count()"), "kinds", "others", "same", "with_z")


@query("""select event_id, date_trunc('year', ts) as y0, date_trunc('month', ts) + interval 1 month - interval 1 millisecond as m1, date_trunc('day', ts) as d0, date_trunc('day', ts) + interval 1 day - interval 1 millisecond as d1,
  make_date(2020, 1 + cast(event_id % 12 as integer), 1) as made, case when event_id % 2 = 0 then null else make_date(2020, 1, 1) end as guarded from events""")
def date_starts_and_ends(spark, sf):
    rows = table(spark, sf, "events").withColumn("m", (F.col("event_id") % 12 + 1).cast("int")).withColumn("bad", F.when(F.col("event_id") % 2 == 0, 13).otherwise(1))
    return _paths(rows, "Event", event_id="event_id", y0="start of year of ts", m1="end of month of ts", d0="start of day of ts", d1="end of day of ts", made="Date(2020, m, 1)", guarded="Date(2020, bad, 1)")


_BORN = "(select id, try_cast(birthDate as date) as b from patient where regexp_matches(birthDate, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'))"


@query(f"""select id, cast(extract(year from age(timestamp '2025-07-01', b)) as bigint) as years, cast(date_sub('month', b, date '2025-07-01') as bigint) as months, cast(date '2025-07-01' - b as bigint) as days from {_BORN} where b is not null""")
def date_ages_of_argument(spark, sf):
    rows = table(spark, sf, "patient").where(r"birthDate rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' and try_cast(birthDate as date) is not null").select("id", F.col("birthDate").alias("b"))
    return _paths(rows, "Row", id="id", years="AgeInYears(b)", months="AgeInMonths(b)", days="AgeInDays(b)")


@query("""select id, received_at = coalesce(deleted_at, received_at) as same, date_trunc('day', received_at) = date_trunc('day', coalesce(deleted_at, received_at)) as same_day, case when deleted_at is null then received_at end as point from patient where deleted_at is null or deleted_at >= received_at""")
def interval_same_and_point(spark, sf):
    rows = table(spark, sf, "patient").where("deleted_at is null or deleted_at >= received_at").withColumn("other", F.coalesce("deleted_at", "received_at"))
    return _paths(rows, "Patient", id="id", same="Interval[received_at, received_at] same as Interval[other, other]", same_day="received_at same day as other", point="point from Interval[received_at, other]")


@query("""select event_id as value from (select event_id from events order by ts, event_id limit 1)""")
def population_first(spark, sf):
    from carex.plans.population import Population

    return Population({"Event": table(spark, sf, "events")}).query("First([Event] e return {event_id: e.event_id, ts: e.ts} sort by ts, event_id)").select(F.col("event_id").alias("value"))


@query("""select event_id as value from (select event_id from events order by ts desc, event_id desc limit 1)""")
def population_last(spark, sf):
    from carex.plans.population import Population

    return Population({"Event": table(spark, sf, "events")}).query("Last([Event] e return {event_id: e.event_id, ts: e.ts} sort by ts, event_id)").select(F.col("event_id").alias("value"))


@query("""select id from patient p where gender = 'male' and exists (select 1 from observation o where list_last(string_split(o.subject.reference, '/')) = p.id and o.status = 'final') and not exists (select 1 from claim_response c where list_last(string_split(c.patient.reference, '/')) = p.id)""")
def population_exists_in_condition(spark, sf):
    return _population(spark, sf).query("""[Patient] p where p.gender = 'male' and exists ([Observation] o where o.subject references p and o.status = 'final')
      and not exists ([ClaimResponse] c where c.patient references p) return {id: p.id}""")


@query("""select id from patient p where exists (select 1 from claim_response c where list_last(string_split(c.patient.reference, '/')) = p.id and c.received_at >= p.received_at and c.received_at <= p.received_at + interval 1 year)""")
def population_with_during(spark, sf):
    return _population(spark, sf).query("[Patient] p with [ClaimResponse] c such that c.patient references p and c.received_at during Interval[p.received_at, p.received_at + 1 year] return {id: p.id}")


_KEY = "regexp_replace(regexp_replace(regexp_replace(trim({0}), '^https://fhir.example.org/r4/', ''), '/_history(/[^/]*)?$', ''), '^[A-Za-z]+/', '')"


@query(f"""select o.row_no as row_no from observation o where {_KEY.format('o.subject.reference')} in (select id from patient where gender = 'female' and regexp_matches(birthDate, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and extract(year from age(timestamp '2025-07-01', try_cast(birthDate as date))) between 30 and 50)""")
def population_restricted(spark, sf):
    p = _population(spark, sf)
    p.tables["Patient"] = p.tables["Patient"].where(r"birthDate rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'")
    return restricted(p, ages=(30, 50), gender="female").query("[Observation] o return {row_no: o.row_no}")


@query(f"""select {_KEY.format('subject.reference')} as context, count(*) as n, round(max(cast(valueQuantity.value as double)), 4) as top from observation group by 1""")
def population_by_context(spark, sf):
    out = by_context(table(spark, sf, "observation"), "subject.reference", {"top": ("Max", "valueQuantity.value + 0.0")})
    return out.withColumn("top", F.round("top", 4))


@query(f"""select p.id as id, coalesce(o.n, 0) as finals, coalesce(c.n, 0) as claims from (select distinct id from patient) p left join (select {_KEY.format('subject.reference')} as k, count(*) as n from observation where status = 'final' group by 1) o on o.k = p.id left join (select {_KEY.format('patient.reference')} as k, count(*) as n from claim_response where outcome = 'complete' group by 1) c on c.k = p.id""")
def library_per_patient(spark, sf):
    lib = Library.parse("""library Demo version '1.0' context Patient
      define finals: [Observation] o where o.status = 'final'
      define claims: [ClaimResponse] c where c.outcome = 'complete'""")
    p = _population(spark, sf)
    return per_patient(lib.bind(p), p.tables["Patient"], ["finals", "claims"])


_TREE = "select n_name as child, r_name as parent from nation join region on n_regionkey = r_regionkey union all select r_name, 'WORLD' from region"


@query(f"""with recursive e as ({_TREE}), c as (select child, parent from e union select c.child, e.parent from c join e on e.child = c.parent)
  select a.code as a, b.code as b, a.code = b.code or exists (select 1 from c where c.parent = a.code and c.child = b.code) as subsumes from (select distinct child as code from e union select 'WORLD') a, (select distinct child as code from e union select 'WORLD') b""")
def terminology_subsumes(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    edges = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")).unionByName(region.select(F.lit("WORLD").alias("parent"), F.col("r_name").alias("child")))
    codes = edges.select("child").union(edges.select("parent")).distinct()  # fixed tables
    pairs = codes.select(F.col("child").alias("a")).crossJoin(F.broadcast(codes.select(F.col("child").alias("b"))))
    return term.subsumes(pairs, F.col("a"), F.col("b"), term.subsumption_closure(edges))


_CONCEPTS = "(select 'http://loinc.org' as system, loinc_code as code, display from unit_target)"


def _concepts(spark, sf):
    return table(spark, sf, "unit_target").select(F.lit("http://loinc.org").alias("system"), F.col("loinc_code").alias("code"), "display")


@query(f"""select row_no, c.code as code, t.display as display, t.code is not null as found from (select row_no, code.coding[1] as c from observation) o left join {_CONCEPTS} t on t.code = trim(c.code) and c.system = 'urn:oid:2.16.840.1.113883.6.1'""")
def terminology_lookup(spark, sf):
    rows = table(spark, sf, "observation").select("row_no", F.get("code.coding", F.lit(0)).alias("c")).select("row_no", "c.code", "c.system")
    return term.lookup_codes(rows, F.col("code"), F.col("system"), _concepts(spark, sf)).select("row_no", "code", "display", "found")


@query(f"""select row_no, case when coalesce(c.system, '') <> 'urn:oid:2.16.840.1.113883.6.1' then 'unknown system' when t.code is null then 'unknown code' when c.display is not null and lower(trim(c.display)) <> lower(t.display) then 'another display' else 'valid' end as message
  from (select row_no, code.coding[1] as c from observation) o left join {_CONCEPTS} t on t.code = trim(c.code)""")
def terminology_validation_details(spark, sf):
    rows = table(spark, sf, "observation").select("row_no", F.get("code.coding", F.lit(0)).alias("c")).select("row_no", "c.code", "c.system", F.col("c.display").alias("shown"))
    return term.validation_details(rows, F.col("code"), F.col("system"), F.col("shown"), _concepts(spark, sf)).select("row_no", "message")


@query("""select code, 'WEIGHT' as name, display from (select loinc_code as code, display from unit_target where loinc_code in ('2345-7', '4548-4') and contains(lower(display), 'glu'))""")
def terminology_expand(spark, sf):
    out = term.expand(_population(spark, sf).value_sets, _concepts(spark, sf), "glycaemia", "Glu")
    return out.select("code", F.lit("WEIGHT").alias("name"), "display")


@query("""select p.id as id, 'A' as kind, t as line from (select id, unnest(address) as a from patient) p, unnest(p.a.line) as u(t) where t is not null""")
def view_this_and_literals(spark, sf):
    view = {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}, {"name": "kind", "path": "'A'"}]}, {"forEach": "address.line", "column": [{"name": "line", "path": "$this"}]}]}
    return view_rows(table(spark, sf, "patient"), view)


@query("""select id, subject.reference as subject, code.coding[1].code as code, effectiveDateTime as effective, valueQuantity.value as value, valueQuantity.unit as unit from observation
  where status in ('final', 'amended') and len([c for c in code.coding if c.code in ('2345-7', 'it''s')]) > 0""")
def view_template_with_parameters(spark, sf):
    return view_rows(table(spark, sf, "observation"), template("observations", codes=["2345-7", "it's"], status=["final", "amended"]))


@query("""select id, family, gender from (select id, [x for x in name if x is not null][1].family as family, gender from patient where gender = 'female' and active)""")
def view_template_demographics(spark, sf):
    return view_rows(table(spark, sf, "patient"), template("demographics", gender="female", active=True)).select("id", "family", "gender")
