"""More queries of the engine: families of functions, intervals, dates, relationships and measures."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from carex.catalog import CONTACTABLE, _long, _paths, _population, query
from carex.functions.path_compiler import Typed, compile_path
from carex.operators.references import resolve
from carex.operators.terminology import subsumption_closure
from carex.plans.measures import Measure, cohort, individual_reports, membership, nearest_rank, population_counts, ratio, subject_list
from carex.plans.population import group_statistics
from carex.plans.views import preset, view_rows
from carex.session import table


@query("""select id, cast(len(list_distinct(g)) as bigint) as union_n, cast(len(list_filter(g, lambda x: x not in ('John', 'Ann'))) as bigint) as others, cast(len(g) + 1 as bigint) as combined,
  len(list_filter(g, lambda x: x = 'John')) > 0 as has_john, len(g) = len(list_distinct(g)) as all_distinct from (select id, coalesce(flatten([coalesce(n.given, []) for n in name]), []) as g from patient)""")
def path_set_operations(spark, sf):
    g = "name.given"
    out = _paths(table(spark, sf, "patient"), "Patient", id="id", union_n=f"({g} | {g}).count()", others=f"{g}.exclude({{'John', 'Ann'}}).count()", combined=f"{g}.combine({{'x'}}).count()", has_john=f"'John' in {g}", all_distinct=f"{g}.isDistinct()")
    return _long(out, "union_n", "others", "combined")


@query("""select row_no, item[2].itemSequence as second, cast(len(coalesce(item, [])) as bigint) as n, cast(len(coalesce(item, [])[2:]) as bigint) as skipped, cast(least(len(coalesce(item, [])), 1) as bigint) as taken,
  case when len(item) = 1 then item[1].itemSequence end as only_one, coalesce(item[1].itemSequence, 0) as first_or_zero from claim_response""")
def path_slices(spark, sf):
    out = _paths(table(spark, sf, "claim_response"), "ClaimResponse", row_no="row_no", second="item[1].itemSequence", n="item.count()", skipped="item.skip(1).count()", taken="item.take(1).count()", only_one="item.single().itemSequence", first_or_zero="Coalesce(item[0].itemSequence, 0)")
    return _long(out, "n", "skipped", "taken")


@query("""select row_no, round(coalesce(list_sum([a.amount for a in adj]), 0), 2) as total, cast(len([a for a in adj if a.amount > 100]) as bigint) as large, len([a for a in adj if not coalesce(a.amount > 0, false)]) = 0 as all_positive,
  cast(len(list_distinct([coalesce(a.category.text, '?') for a in adj])) as bigint) as kinds, round(list_max([a.amount for a in adj]), 2) as top from (select row_no, coalesce(flatten([coalesce(i.adjudication, []) for i in item]), []) as adj from claim_response)""")
def path_folds(spark, sf):
    a = "item.adjudication"
    out = _paths(table(spark, sf, "claim_response"), "ClaimResponse", row_no="row_no", total=f"{a}.amount.aggregate($this + $total, 0.0)", large=f"{a}.where(amount > 100).count()", all_positive=f"{a}.all(amount > 0)", kinds=f"{a}.groupBy(category.text).count()", top=f"{a}.amount.max()")
    return _long(out.withColumns({"total": F.round("total", 2), "top": F.round("top", 2)}), "large", "kinds")


@query("""select row_no, cast(len([a for a in adj if a.amount > 100]) as bigint) as matching, cast(len([a for a in adj if not coalesce(a.amount > 100, false)]) as bigint) as others,
  cast(len(list_distinct([coalesce(a.category.text, '?') for a in adj])) as bigint) as first_of_kind from (select row_no, coalesce(flatten([coalesce(i.adjudication, []) for i in item]), []) as adj from claim_response)""")
def path_partitions(spark, sf):
    a = "item.adjudication"
    out = _paths(table(spark, sf, "claim_response"), "ClaimResponse", row_no="row_no", matching=f"{a}.partitionBy(amount > 100).matching.count()", others=f"{a}.partitionBy(amount > 100).nonMatching.count()", first_of_kind=f"{a}.distinctBy(category.text).count()")
    return _long(out, "matching", "others", "first_of_kind")


@query("""select row_no, base64(encode(id)) as b64, split_part(id, '-', 1) as head, cast(len(string_split(id, '-')) as bigint) as parts, regexp_matches(id, '^obs-0-') as matched, ends_with(id, '7') as seven, lower(status) = status as low from observation""")
def path_codecs(spark, sf):
    out = _paths(table(spark, sf, "observation"), "Observation", row_no="row_no", b64="id.base64Encode()", head="id.split('-').first()", parts="id.split('-').count()", matched="id.matches('^obs-0-')", seven="id.endsWith('7')", low="status.lower() = status")
    return _long(out, "parts")


# Each date text with the days at its ends: a year, a month, a day or a moment of a day; nulls for any other text.
_CLOCK = r"([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?"
_ENDS = rf"""with sized as (select id, birthDate as t, case when regexp_full_match(birthDate, '[0-9]{{4}}') then 4 when regexp_full_match(birthDate, '[0-9]{{4}}-[0-9]{{2}}') then 7
   when regexp_full_match(birthDate, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ]{_CLOCK}(Z|[+-][0-9]{{2}}:[0-9]{{2}})?)?') then 10 end as size from patient),
  ends as (select *, try_cast(case size when 4 then t || '-01-01' when 7 then t || '-01' when 10 then substr(t, 1, 10) end as date) as a, regexp_extract(t, '[T ]({_CLOCK})', 1) as clock,
   regexp_extract(t, ':[0-9]{{2}}([.][0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', 2) as zone from sized),
  dated as (select *, case size when 4 then try_cast(t || '-12-31' as date) when 7 then last_day(a) else a end as z from ends)"""


def _end(day: str, clock: str, zone: str) -> str:
    whole = f"strftime({day}, '%Y-%m-%d')"
    return f"case when size < 10 then {whole} when size = 10 then {whole} || 'T' || clock || substr('{clock}', length(clock) + 1) || case when zone = '' then '{zone}' else zone end end"


@query(f"{_ENDS} select id, {_end('a', '00:00:00.000', '+14:00')} as low, {_end('z', '23:59:59.999', '-12:00')} as high from dated")
def path_boundaries(spark, sf):
    return _paths(table(spark, sf, "patient"), "Patient", id="id", low="birthDate.lowBoundary()", high="birthDate.highBoundary()")


@query("""select row_no, valueQuantity.unit as unit, valueString as string_value, valueQuantity is not null as is_quantity, valueString is not null as is_string from observation""")
def path_choice_types(spark, sf):
    return _paths(table(spark, sf, "observation"), "Observation", row_no="row_no", unit="value.ofType(Quantity).unit", string_value="value.ofType(string)", is_quantity="value is Quantity", is_string="value is string")


@query("""select id, coalesce(gender, 'unstated') as stated, nullif(gender, 'unknown') as known, gender is null as missing, coalesce(active, false) as sure, case when gender = 'male' then 'm' when gender = 'female' then 'f' else 'x' end as short,
  case when active then 'on' when not active then 'off' end as switch from patient""")
def path_nulls_and_conditions(spark, sf):
    return _paths(table(spark, sf, "patient"), "Patient", id="id", stated="Coalesce(gender, 'unstated')", known="NullIf(gender, 'unknown')", missing="gender is null", sure="active is true", short="case gender when 'male' then 'm' when 'female' then 'f' else 'x' end", switch="iif(active, 'on', 'off')")


@query("""select row_no, length(split_part(cast(valueQuantity.value as varchar), '.', 2)) as digits, round(ln(cast(valueQuantity.value as double)), 4) as natural_log, round(log10(cast(valueQuantity.value as double)), 4) as ten_log,
  round(pow(cast(valueQuantity.value as double), 2), 2) as squared, cast(trunc(cast(valueQuantity.value as double)) as bigint) % 7 as remainder from observation where valueQuantity.value > 0""")
def path_more_math(spark, sf):
    v = "valueQuantity.value"
    out = _paths(table(spark, sf, "observation").where("valueQuantity.value > 0"), "Observation", row_no="row_no", digits=f"{v}.precision()", natural_log=f"{v}.ln()", ten_log=f"{v}.log()", squared=f"{v} ^ 2", remainder=f"{v}.truncate() mod 7")
    return _long(out.withColumns({"natural_log": F.round("natural_log", 4), "ten_log": F.round("ten_log", 4), "squared": F.round("squared", 2)}), "digits", "remainder")


@query("""select vec_id, round(stddev_samp(x), 4) as sd, round(var_samp(x), 4) as var, round(stddev_pop(x), 4) as sdp, round(quantile_cont(x, 0.9), 4) as p90, count(*) filter (x > 0) as positive from
  (select vec_id, cast(unnest(embedding) as double) as x from embeddings) group by vec_id""")
def path_distributions(spark, sf):
    e = "embedding"
    out = _paths(table(spark, sf, "embeddings"), "Vector", vec_id="vec_id", sd=f"StdDev({e})", var=f"Variance({e})", sdp=f"PopulationStdDev({e})", p90=f"Percentile({e}, 90)", positive=f"{e}.where($this > 0).count()")
    return _long(out.withColumns({n: F.round(n, 4) for n in ("sd", "var", "sdp", "p90")}), "positive")


@query("""select id, date_diff('month', received_at, timestamp '2025-07-01') as months_crossed, cast(floor(date_diff('second', received_at, timestamp '2025-07-01') / 86400.0) as bigint) as days_whole,
  date_diff('day', cast(received_at as date), date '2025-07-01') as days_crossed, cast(floor(date_diff('second', received_at, timestamp '2025-07-01') / 3600.0) as bigint) as hours_whole from patient""")
def date_durations(spark, sf):
    return _paths(table(spark, sf, "patient"), "Patient", id="id", months_crossed="difference in months between received_at and Now()", days_whole="days between received_at and Now()", days_crossed="difference in days between received_at and Now()", hours_whole="hours between received_at and Now()")


@query("""select id, received_at + interval 1 year as next_year, received_at - interval 2 day as before, received_at + interval 36 hour as later, strftime(received_at, '%H:%M:%S') as clock, make_date(year(received_at), 1, 1) as new_year from patient""")
def date_arithmetic(spark, sf):
    return _paths(table(spark, sf, "patient"), "Patient", id="id", next_year="received_at + 1 year", before="received_at - 2 days", later="received_at + 36 hours", clock="time from received_at", new_year="Date(year from received_at, 1, 1)")


@query(f"{_ENDS} select id, case when date_sub('year', a, date '2025-07-01') = date_sub('year', z, date '2025-07-01') then date_sub('year', a, date '2025-07-01') end as age from dated")
def date_ages(spark, sf):
    return _paths(table(spark, sf, "patient"), "Patient", id="id", age="AgeInYears()")


def _numbers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("a"), (F.col("p_size") + 10).alias("b"))


@query("""select p_partkey, greatest(p_size, 20) as low, least(p_size + 10, 30) as high, least(p_size, 20) as hull_low, greatest(p_size + 10, 30) as hull_high from part where p_size <= 30 and p_size + 10 >= 20""")
def interval_set_operations(spark, sf):
    i = "Interval[a, b]"
    rows = _numbers(spark, sf).where("a <= 30 and b >= 20")
    return _paths(rows, "Part", p_partkey="p_partkey", low=f"({i} intersect Interval[20, 30]).low", high=f"({i} intersect Interval[20, 30]).high", hull_low=f"({i} union Interval[20, 30]).low", hull_high=f"({i} union Interval[20, 30]).high")


@query("""select p_partkey, p_size as lower, p_size + 10 as upper, cast(10 as double) as width, p_size between 5 and 40 as inside, p_size = 5 as starts, p_size + 10 = 40 and p_size >= 5 as ends, p_size + 10 = 4 or p_size = 41 as meets, p_size >= 5 and p_size + 10 <= 40 and not (p_size = 5 and p_size + 10 = 40) as proper,
  p_size + 10 <= 20 as on_or_before from part""")
def interval_boundaries(spark, sf):
    i, w = "Interval[a, b]", "Interval[5, 40]"
    out = _paths(_numbers(spark, sf), "Part", p_partkey="p_partkey", lower=f"start of {i}", upper=f"end of {i}", width=f"width of {i}", inside=f"a in {w}", starts=f"a = 5 and {i} starts {w}", ends=f"{i} ends {w}", meets=f"{i} meets {w}", proper=f"{i} properly included in {w}", on_or_before=f"{i} on or before 20")
    return out


@query("""select p_partkey, case when p_size + 10 < 30 then 2 else 1 end as n, case when p_size + 10 < 30 then p_size + 10 else greatest(p_size + 10, 60) end as first_high from part""")
def interval_collapse(spark, sf):
    c = "collapse {Interval[a, b], Interval[30, 60]}"
    out = _paths(_numbers(spark, sf), "Part", p_partkey="p_partkey", n=f"({c}).count()", first_high=f"({c}).first().high")
    return out


# Populations
@query("""select row_no, o.id as organization, o.name as insurer from (select row_no, list_last(string_split(regexp_replace(trim(insurer.reference), '/_history/.*$', ''), '/')) as k from claim_response) c left join organization o on o.id = c.k""")
def resolve_references(spark, sf):
    out = resolve(table(spark, sf, "claim_response").select("row_no", F.col("insurer.reference").alias("ref")), F.col("ref"), table(spark, sf, "organization"))
    return out.select("row_no", F.col("resolved.id").alias("organization"), F.col("resolved.name").alias("insurer"))


@query("""select distinct status as value from observation where received_at > timestamp '2024-01-01'""")
def population_distinct(spark, sf):
    return _population(spark, sf).query("[Observation] o where o.received_at after @2024-01-01T00:00:00 return distinct o.status")


@query("""select p.id as id from patient p where p.gender = 'male' and exists (select 1 from claim_response c where c.outcome = 'error' and list_last(string_split(c.patient.reference, '/')) = p.id)""")
def population_definitions(spark, sf):
    pop = _population(spark, sf)
    pop.define("Men", "[Patient] p where p.gender = 'male'").define("Errors", "[ClaimResponse] c where c.outcome = 'error'")
    return pop.define("Concerned", "Men m with Errors e such that e.patient references m return {id: m.id}").run("Concerned")


@query("""select round(median(v), 4) as middle, round(stddev_samp(v), 4) as sd, round(min(v), 4) as low, round(max(v), 4) as high from (select cast(valueQuantity.value as double) as v from observation where valueQuantity.unit = 'kg')""")
def population_aggregates(spark, sf):
    pop = _population(spark, sf)
    rows = pop.query("[Observation] o where o.valueQuantity.unit = 'kg' return {v: o.valueQuantity.value}").select(F.col("v").cast("double").alias("v"))
    out = group_statistics(rows, {}, {"middle": ("Median", "v"), "sd": ("StdDev", "v"), "low": ("Min", "v"), "high": ("Max", "v")})
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("""select code, unit, n from (select *, row_number() over (partition by code order by n desc, unit) as k from (select code.coding[1].code as code, valueQuantity.unit as unit, count(*) as n from observation where valueQuantity.unit is not null group by 1, 2)) where k = 1""")
def population_mode(spark, sf):
    rows = table(spark, sf, "observation").where("valueQuantity.unit is not null").select(F.get("code.coding", F.lit(0))["code"].alias("code"), F.col("valueQuantity.unit").alias("unit"))
    counts = rows.groupBy("code", "unit").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("code").agg(F.min(F.struct((-F.col("n")).alias("m"), "unit", "n")).alias("b"))
    return best.select("code", "b.unit", "b.n")


@query("""select row_no from observation where len([c for c in code.coding if trim(c.code) in ('8310-5', 'TMP')]) > 0""")
def population_member_of(spark, sf):
    obs = table(spark, sf, "observation")
    codes = Typed(F.array(F.lit("8310-5"), F.lit("TMP")), T.StringType(), True)
    return obs.where(compile_path("code.memberOf(%temperature)", obs.schema, "Observation", {"temperature": codes}).col).select("row_no")


@query("""with recursive c(a, d) as (select r_regionkey, n_nationkey + 100 from region join nation on n_regionkey = r_regionkey union select 1000, r_regionkey from region),
  p as (select a, d from c union select x.a, y.d from c x join c y on x.d = y.a), s as (select a, d from p union select a, a from c union select d, d from c) select a as ancestor, d as descendant from s""")
def terminology_closure(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    edges = nation.select(F.col("n_regionkey").alias("parent"), (F.col("n_nationkey") + 100).alias("child")).unionByName(region.select(F.lit(1000).alias("parent"), F.col("r_regionkey").alias("child")))
    return subsumption_closure(edges)


@query("""select id, name, received_at from organization where deleted_at is null order by received_at desc, id limit 10""")
def population_top_k(spark, sf):
    return table(spark, sf, "organization").where("deleted_at is null").select("id", "name", "received_at").orderBy(F.desc("received_at"), "id").limit(10)


@query("""select gender, count(*) filter (gender is not null) as cohort from patient group by gender""")
def measure_cohort(spark, sf):
    return cohort(membership(table(spark, sf, "patient"), CONTACTABLE), ["gender"])


@query("""select count(*) filter (o_orderstatus = 'F') as numerator_count, count(*) filter (o_totalprice > 100000) as denominator_count, round(count(*) filter (o_orderstatus = 'F' and o_totalprice > 100000) * 1.0 / count(*) filter (o_totalprice > 100000), 6) as score
  from orders where o_totalprice > 100000""")
def measure_ratio(spark, sf):
    m = Measure("ratio", "ratio", {"denominator": "o_totalprice > 100000", "numerator": "o_orderstatus = 'F'"})
    out = ratio(population_counts(membership(table(spark, sf, "orders"), m, "o_orderkey")))
    return out.select("numerator_count", "denominator_count", F.round("score", 6).alias("score"))


@query("""select quantile_disc(o_totalprice, 0.25) as p25, quantile_disc(o_totalprice, 0.5) as p50, quantile_disc(o_totalprice, 0.95) as p95 from orders""")
def measure_percentiles(spark, sf):
    return nearest_rank(table(spark, sf, "orders"), "o_totalprice", [0.25, 0.5, 0.95])


@query("""select id as subject from patient where gender is not null and active and len([t for t in telecom if t.system = 'phone']) > 0""")
def measure_subject_list(spark, sf):
    return subject_list(membership(table(spark, sf, "patient"), CONTACTABLE), "numerator")


@query()
def measure_individual_reports(spark, sf):
    return individual_reports(membership(table(spark, sf, "patient"), CONTACTABLE), CONTACTABLE)


@query("""select id as patient_id, t.system as system, t.value as value, t.use as use from (select id, unnest(telecom) as t from patient)""")
def view_contacts(spark, sf):
    return view_rows(table(spark, sf, "patient"), preset("patient_contacts"))


@query("""select id, coalesce(array_to_string(flatten([coalesce(n.given, []) for n in name]), ';'), '') as given, cast(len(flatten([coalesce(n.given, []) for n in name])) as bigint) as n from patient where active""")
def view_collections(spark, sf):
    view = {"resource": "Patient", "where": [{"path": "active"}], "select": [{"column": [{"name": "id", "path": "id"}, {"name": "given", "path": "name.given", "collection": True}]}]}
    out = view_rows(table(spark, sf, "patient"), view)
    return out.select("id", F.array_join("given", ";").alias("given"), F.size("given").cast("bigint").alias("n"))


@query("""select id, v from (select id, unnest([t.value for t in telecom if t.system = 'email']) as v from patient where coalesce(gender, '') <> 'male' and received_at >= timestamp '2021-01-01' and active)""")
def view_typed_constants(spark, sf):
    view = {
        "resource": "Patient",
        "constant": [{"name": "sex", "valueCode": "male"}, {"name": "since", "valueDateTime": "2021-01-01T00:00:00"}, {"name": "on", "valueBoolean": True}, {"name": "kind", "valueString": "email"}],
        "where": [{"path": "Coalesce(gender, '') != %sex"}, {"path": "received_at >= %since"}, {"path": "active = %on"}],
        "select": [{"column": [{"name": "id", "path": "id"}]}, {"forEach": "telecom.where(system = %kind)", "column": [{"name": "v", "path": "value"}]}],
    }
    return view_rows(table(spark, sf, "patient"), view)


@query("""select doc_id, cast(length(text) as bigint) as n, contains(text, 'diff --git') as has_diff, starts_with(text, 'commit ') as headed, upper(lang) as lang, coalesce(source, 'unknown') as source from documents""")
def view_documents(spark, sf):
    out = _paths(table(spark, sf, "documents"), "DocumentReference", doc_id="doc_id", n="text.length()", has_diff="text.contains('diff --git')", headed="text.startsWith('commit ')", lang="lang.upper()", source="Coalesce(source, 'unknown')")
    return _long(out, "n")


@query("""select event_id, cast(json_extract_string(props, '$.k') as integer) as k, value from events where cast(json_extract_string(props, '$.k') as integer) > 50""")
def view_of_json_column(spark, sf):
    events = table(spark, sf, "events").withColumn("component", F.from_json("props", "struct<k:int>"))
    view = {"resource": "Observation", "where": [{"path": "component.k > 50"}], "select": [{"column": [{"name": "event_id", "path": "event_id"}, {"name": "k", "path": "component.k"}, {"name": "value", "path": "value"}]}]}
    return view_rows(events, view)
