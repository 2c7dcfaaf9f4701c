"""Quantities recorded in different units (problem 7).

A source is a label under which values of a quantity are recorded: a unit code, or a spelling of a unit. Sources are
linked by what they share. A row that has both a code and a spelling is the same value in two sources (scale 1, offset
0); values of one entity (patient and quantity) in two sources link them by their numbers. For any two sources of a
quantity, scale and offset between the two are estimated from quantiles over the shared entities. Estimates are snapped
to the known conversions of the quantity and propagated through this graph from the sources that are unit codes
themselves, until no further source is resolved. Of the partners of a source that are resolved, the one with the most
links speaks for it.

A source with `LEAST_LINKS` shared entities is decided by the estimate: values whose middle or spread fit no known
conversion are in no unit of the quantity ("points", or a label under which several units are mixed). Where rows write
codes beside the label, the estimate confirms the most frequent one. Sources with fewer links mean what the codes beside
them say, and nothing if no row has one.

Units that stand in text only are found by frames learned from the data: wherever a known label stands within a text,
what is left of the text is a candidate; a frame that held `LEAST_LABELS` labels is kept, and what stands in its place
in other texts is read as the unit, known or not. A text without such a frame names the known label that it ends with.

Null and edge cases: a row has no result if it has no value, no unit in any field, a unit that does not measure the
quantity, or no code that is, or accompanies elsewhere, a LOINC code of the targets. A unit is taken from the first
field that has one: the quantity's code, its unit, the text around the number, the name of the measurement, notes.
Decimal commas are read. A value of two parts (feet and inches, stones and pounds) is their sum. Ties between codes
go to the more frequent, then the smaller one. Repeated rows give repeated results; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from carex.operators.references import reference_key
from carex.plans.physical import checked_broadcast
from carex.session import materialise

LOINC = "urn:oid:2.16.840.1.113883.6.1"
LOCAL = "http://lab.example.org/local"
# Signs that stand for a unit without being its name.
SIGNS = {"'": "[ft_i]", "′": "[ft_i]", "’": "[ft_i]", '"': "[in_i]", "″": "[in_i]", "”": "[in_i]", "''": "[in_i]"}
NUMBER = r"([0-9]+(?:[.,][0-9]+)?)\s*([^0-9]*)"
LEAST_LINKS = 50
LEAST_LABELS = 3
MOST_MISFIT = 1.0
QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def _blank_to_null(c: Column) -> Column:
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(c != "", c)


def plain_text(c: Column) -> Column:
    """Lower case, single blanks, no final point."""
    return _blank_to_null(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"[\s.]+$", ""))


def spelling(c: Column) -> Column:
    """One spelling for texts that differ in case, blanks and a final point only."""
    return _blank_to_null(F.regexp_replace(F.lower(c), r"\s+|\.\s*$", ""))


def _codes_of(system: str) -> Column:
    mine = F.filter("code.coding", lambda c: F.trim(c["system"]) == system)
    return F.filter(F.transform(mine, lambda c: _blank_to_null(c["code"])), lambda c: c.isNotNull())


def readings(observation: DataFrame, targets: DataFrame) -> DataFrame:
    """Narrow rows of one scan: row_no, entity, own_code, local_code, numbers, parts (texts behind the numbers),
    unit_code, unit_text, and texts {kind, text} that may name the unit where no field does.

    targets: the fixed table of quantities, one row a LOINC code.
    """
    names = {r.loinc_code: r.display for r in targets.where("loinc_code is not null").collect()}
    value = F.col("valueQuantity.value").cast("double")
    written = F.regexp_extract_all("valueString", F.lit(NUMBER), F.lit(1))
    name = plain_text(F.col("code.text"))
    for display in sorted({d for d in names.values() if d}, key=len, reverse=True):
        name = F.replace(name, F.lit(display.lower()), F.lit("@"))
    texts = F.concat(
        F.array(
            F.struct(F.lit("value").alias("kind"), F.when(value.isNull(), plain_text(F.regexp_replace("valueString", r"[0-9]+(?:[.,][0-9]+)?", "#"))).alias("text")),
            F.struct(F.lit("name").alias("kind"), name.alias("text")),
        ),
        F.coalesce(F.transform("note", lambda n: F.struct(F.lit("note").alias("kind"), plain_text(n["text"]).alias("text"))), F.array()),
    )
    unit_code, unit_text = _blank_to_null(F.col("valueQuantity.code")), plain_text(F.col("valueQuantity.unit"))
    return observation.select(
        "row_no",
        reference_key(F.col("subject.reference")).alias("entity"),
        F.get(F.filter(_codes_of(LOINC), lambda c: c.isin(list(names))), F.lit(0)).alias("own_code"),
        F.get(_codes_of(LOCAL), F.lit(0)).alias("local_code"),
        F.when(value.isNotNull(), F.array(value)).otherwise(F.transform(written, lambda x: F.regexp_replace(x, ",", ".").try_cast("double"))).alias("numbers"),
        F.when(value.isNull(), F.transform(F.regexp_extract_all("valueString", F.lit(NUMBER), F.lit(2)), spelling)).alias("parts"),
        unit_code.alias("unit_code"),
        unit_text.alias("unit_text"),
        F.when(unit_code.isNull() & unit_text.isNull(), F.filter(texts, lambda t: t["text"].isNotNull())).alias("texts"),
    )


def local_codes(narrow: DataFrame) -> DataFrame:
    """(local_code, meant): the LOINC code that each local code accompanies most often."""
    counts = narrow.where("own_code is not null and local_code is not null").groupBy("local_code", F.col("own_code").alias("meant")).count()
    return counts.groupBy("local_code").agg(F.max_by("meant", F.struct("count", F.col("meant"))).alias("meant"))


def known_labels(rows: DataFrame, conversions: DataFrame) -> DataFrame:
    """(loinc_code, label): unit texts and unit codes; a vocabulary."""
    labels = rows.where("unit_text is not null").select("loinc_code", F.col("unit_text").alias("label"))
    return checked_broadcast(labels.unionByName(conversions.select("loinc_code", plain_text(F.col("unit_code")).alias("label"))).distinct())


def frames_of_units(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: frames, an array of {room, kind, before, behind}, those with the longest fixed text first.

    A frame is what stands around a label of the quantity within a text. It is kept if it held at least LEAST_LABELS
    different labels, so a word that happens to be a unit too ("in") makes no frame of its own.
    """
    texts = rows.select("loinc_code", F.explode("texts").alias("t")).select("loinc_code", "t.kind", "t.text").distinct()
    held = texts.join(labels, "loinc_code").where("contains(text, label)")
    places = F.expr("filter(sequence(1, length(text) - length(label) + 1), p -> substring(text, p, length(label)) = label)")
    at = held.select("kind", "text", "label", F.explode(places).alias("p")).select(
        "kind", "label",
        F.expr("substring(text, 1, p - 1)").alias("before"), F.expr("substring(text, p + length(label))").alias("behind"),
    )
    # A label begins and ends where a word does.
    word = r"[\p{L}\p{N}]"
    apart = ~(F.col("before").rlike(word + "$") & F.col("label").rlike("^" + word)) & ~(F.col("behind").rlike("^" + word) & F.col("label").rlike(word + "$"))
    kept = at.where(apart).groupBy("kind", "before", "behind").agg(F.count_distinct("label").alias("labels")).where(F.col("labels") >= LEAST_LABELS)
    kept = kept.where("before <> '' or behind <> ''")
    frame = F.struct((-F.length("before") - F.length("behind")).alias("room"), "kind", "before", "behind")
    return kept.agg(F.sort_array(F.collect_list(frame)).alias("frames"))


def unit_in_texts(texts: Column, frames: Column, labels: Column) -> Column:
    """What stands in the first frame that fits, or the longest label at the end, of the first text that has one.

    labels: those of the quantity.
    """

    def inside(t: Column) -> Column:
        fitting = F.filter(
            frames,
            lambda f: (f["kind"] == t["kind"]) & F.startswith(t["text"], f["before"]) & F.endswith(t["text"], f["behind"]) & (F.length(t["text"]) > -f["room"]),
        )
        f = F.get(fitting, F.lit(0))
        return F.substring(t["text"], F.length(f["before"]) + 1, F.length(t["text"]) + f["room"])

    def at_end(t: Column) -> Column:
        text = F.regexp_replace(t["text"], r"[\s.)\]]+$", "")
        before = F.filter(labels, lambda x: F.endswith(text, x) & ~F.substring(text, 1, F.length(text) - F.length(x)).rlike(r"[\p{L}\p{N}]$"))
        return F.get(F.reverse(F.array_sort(F.transform(before, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))), F.lit(0))["x"]

    return F.get(F.filter(F.transform(texts, lambda t: spelling(F.coalesce(inside(t), at_end(t)))), lambda x: x.isNotNull()), F.lit(0))


def source_graph(values: DataFrame) -> DataFrame:
    """(loinc_code, label, partner, links, qx, qy): for any two sources of a quantity that share LEAST_LINKS entities,
    in both directions, the quantiles of the one and of the other over these entities.

    values: entity, loinc_code, label, value. One mean stands for an entity within a source, so an entity with many
    rows counts once, and joins as often as it has pairs of sources; what is robust are the quantiles over the entities.
    """
    one = materialise(values.where("entity is not null").groupBy("entity", "loinc_code", "label").agg(F.avg("value").alias("v")))
    # Two sources share at most the entities of the smaller one, so sources below LEAST_LINKS have no pair that counts.
    sizes = one.groupBy("loinc_code", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_LINKS)
    linked = one.join(checked_broadcast(sizes.select("loinc_code", "label")), ["loinc_code", "label"], "left_semi")
    x, y = linked.alias("x"), linked.alias("y")
    shared = x.join(y, ["entity", "loinc_code"]).where("x.label < y.label")
    pairs = shared.groupBy("loinc_code", F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(
        F.count(F.lit(1)).alias("links"), F.percentile_approx("x.v", QUANTILES, 1000).alias("qa"), F.percentile_approx("y.v", QUANTILES, 1000).alias("qb")
    )
    # Each pair is met once and read in both directions.
    ways = [F.struct(F.col(a).alias("label"), F.col(b).alias("partner"), "links", F.col("q" + a).alias("qx"), F.col("q" + b).alias("qy")) for a, b in ("ab", "ba")]
    return pairs.where(F.col("links") >= LEAST_LINKS).select("loinc_code", F.inline(F.array(*ways)))


def estimated(edges: DataFrame) -> DataFrame:
    """Edges with the scale and offset that take the values of the source to those of the partner."""
    scale = F.try_divide(F.col("qy")[3] - F.col("qy")[1], F.col("qx")[3] - F.col("qx")[1])
    return edges.withColumn("scale", scale).withColumn("offset", F.col("qy")[2] - F.col("scale") * F.col("qx")[2])


def misfit(scale: Column, offset: Column) -> Column:
    """How far a known conversion from a source to a partner is from what the edge shows; 0 is a perfect fit.

    Three distances are added: of the middles in quartile ranges of the partner, and of the two spreads (quartiles, tenths)
    as logarithms of their ratio. Values in several units have spreads that no conversion explains.
    """
    least = F.greatest(F.abs(F.col("qy")[2]) * 0.01, F.lit(1e-9))
    inner, outer = (F.greatest(F.col("qy")[b] - F.col("qy")[a], least) for a, b in ((1, 3), (0, 4)))
    middle = F.abs(F.col("qx")[2] * scale + offset - F.col("qy")[2]) / inner
    spreads = [F.abs(F.ln(F.greatest((F.col("qx")[b] - F.col("qx")[a]) * scale, least) / s)) for (a, b), s in (((1, 3), inner), ((0, 4), outer))]
    return middle + spreads[0] + spreads[1]


def unit_dictionary(rows: DataFrame, conversions: DataFrame) -> DataFrame:
    """(loinc_code, label, unit_code, factor, shift): what each source of each quantity means.

    conversions: the fixed table of units, one row a unit of a quantity. Rounds end when no source is resolved anew.
    """
    known = F.broadcast(conversions.select("loinc_code", "unit_code", "factor", "shift"))
    single = rows.where("size(numbers) = 1").select("entity", "loinc_code", "unit_code", "written", F.get("numbers", F.lit(0)).alias("value"))
    labels = F.array_distinct(F.array_compact(F.array("written", spelling(F.col("unit_code")))))
    values = single.join(known.select("loinc_code", "unit_code", F.lit(True).alias("of_it")), ["loinc_code", "unit_code"], "left").where("unit_code is null or of_it")
    edges = materialise(estimated(source_graph(values.select("entity", "loinc_code", F.explode(labels).alias("label"), "value"))))
    # Codes beside a label, and how many rows write the label at all.
    beside = materialise(
        single.where("written is not null").groupBy("loinc_code", F.col("written").alias("label"), "unit_code").agg(F.count(F.lit(1)).alias("n"))
    )
    written = beside.groupBy("loinc_code", "label").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("unit_code").isNotNull(), F.col("n"))).alias("n_coded"))
    exact = beside.where("unit_code is not null").join(known.select("loinc_code", "unit_code"), ["loinc_code", "unit_code"])
    signs = rows.sparkSession.createDataFrame(list(SIGNS.items()), "label string, unit_code string")
    named = conversions.select("loinc_code", spelling(F.col("unit_code")).alias("label"), "unit_code", "factor", "shift")
    named = named.unionByName(conversions.join(F.broadcast(signs), "unit_code").select("loinc_code", "label", "unit_code", "factor", "shift"))
    meaning = named.dropDuplicates(["loinc_code", "label"])
    while True:
        # All that are resolved so far, so a late partner with few links does not undo what a better one refused.
        meaning = checked_broadcast(meaning)
        through = meaning.select("loinc_code", F.col("label").alias("partner"), F.col("factor").alias("its_factor"), F.col("shift").alias("its_shift"))
        tried = edges.join(through, ["loinc_code", "partner"]).join(known, "loinc_code")
        scale, offset = F.col("factor") / F.col("its_factor"), (F.col("shift") - F.col("its_shift")) / F.col("its_factor")
        fits = tried.select("loinc_code", "label", "unit_code", "links", "partner", misfit(scale, offset).alias("misfit"))
        fits = fits.groupBy("loinc_code", "label", "unit_code").agg(F.max_by("misfit", F.struct("links", "partner")).alias("misfit"))
        every = fits.join(exact, ["loinc_code", "label", "unit_code"], "full").join(written, ["loinc_code", "label"], "left")
        fitting = F.col("misfit") <= MOST_MISFIT
        by_codes = (F.col("n") > 0) & (F.col("misfit").isNull() | fitting | (2 * F.col("n") >= F.col("n_rows")))
        by_estimate = F.coalesce(F.col("n_coded"), F.lit(0)) == 0
        best = W.partitionBy("loinc_code", "label").orderBy(F.desc_nulls_last("n"), F.asc_nulls_last("misfit"), "unit_code")
        sure = every.where(by_codes | (by_estimate & fitting)).withColumn("k", F.row_number().over(best)).where("k = 1")
        new = materialise(sure.join(meaning, ["loinc_code", "label"], "left_anti").join(known, ["loinc_code", "unit_code"]).select(meaning.columns))
        meaning = meaning.unionByName(new)
        # Only a partner that is resolved anew can resolve others, and only what is not resolved yet.
        open_edges = edges.join(meaning, ["loinc_code", "label"], "left_anti")
        if open_edges.join(new.select("loinc_code", F.col("label").alias("partner")), ["loinc_code", "partner"], "left_semi").isEmpty():
            return meaning


def common_quantities(observation: DataFrame, targets: DataFrame, conversions: DataFrame) -> DataFrame:
    """(row_no, loinc_code, scaled_value): every value in the common unit of its code, times 10^decimals."""
    narrow = materialise(readings(observation, targets))
    local = checked_broadcast(local_codes(narrow))
    rows = narrow.where("size(numbers) > 0").join(local, "local_code", "left").withColumn("loinc_code", F.coalesce("own_code", "meant")).where("loinc_code is not null")
    labels = known_labels(rows, conversions)
    of_quantity = F.broadcast(labels.groupBy("loinc_code").agg(F.collect_list("label").alias("labels")))  # one row a quantity
    rows = rows.join(F.broadcast(frames_of_units(rows, labels))).join(of_quantity, "loinc_code", "left")  # the frames are one row
    written = F.when(F.size("numbers") == 1, F.coalesce(spelling(F.col("unit_text")), unit_in_texts(F.col("texts"), F.col("frames"), F.col("labels"))))
    rows = materialise(rows.select("row_no", "entity", "loinc_code", "unit_code", "numbers", "parts", written.alias("written")))
    lookup = checked_broadcast(unit_dictionary(rows, conversions).select("loinc_code", "label", "factor", "shift"))
    known = F.broadcast(conversions.select("loinc_code", "unit_code", F.col("factor").alias("code_factor"), F.col("shift").alias("code_shift")))
    meant = lookup.withColumnRenamed("label", "written")
    one = rows.where("size(numbers) = 1").join(known, ["loinc_code", "unit_code"], "left").join(meant, ["loinc_code", "written"], "left")
    value = F.get("numbers", F.lit(0))
    of_code, of_label = value * F.col("code_factor") + F.col("code_shift"), value * F.col("factor") + F.col("shift")
    single = one.select("row_no", "loinc_code", F.when(F.col("unit_code").isNotNull(), of_code).otherwise(of_label).alias("common")).where("common is not null")
    two = rows.where("size(numbers) = 2 and size(parts) = 2")
    for k in (0, 1):
        two = two.withColumn("part", F.get("parts", F.lit(k))).join(
            lookup.select("loinc_code", F.col("label").alias("part"), F.col("factor").alias(f"factor{k}")), ["loinc_code", "part"]
        ).drop("part")
    added = two.select("row_no", "loinc_code", (F.get("numbers", F.lit(0)) * F.col("factor0") + F.get("numbers", F.lit(1)) * F.col("factor1")).alias("common"))
    scaled = F.round(F.col("common") * F.pow(F.lit(10.0), F.col("decimals"))).cast("long")
    return single.unionByName(added).join(F.broadcast(targets.select("loinc_code", "decimals")), "loinc_code").select(
        "row_no", "loinc_code", scaled.alias("scaled_value")
    )
