"""Competitor profiles: what a listing proves, marks up and says alike everywhere, and measurable gaps against its peers.

A gap is a difference that goes with an observed one of visibility; none is said to be its cause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let, word_tokens

VERIFIED = 0.9
#: Share of a name's words that a surface must have.
COVERED = 0.8
#: Share of the peers beyond which an attribute is usual.
MAJORITY = 0.5
LEVELS = ["none", "partial", "full"]
# Words that tell Spanish text.
SPANISH = "el la los las del y con para una que por sus camiseta algodón manga tejido talla hombre mujer".split()  # noqa: SIM905
#: Spanish words, and their share, from which a text counts as partly Spanish.
SPANISH_HITS, SPANISH_SHARE = 3, 0.05
NUMERIC = ["attributes_present", "markup_fields", "verified_facts", "independent_evidence", "entity_consistency_pct", "contradictions"]
ISSUE = "array<struct<kind:string,label:string,field:string,statement:string,items:array<string>>>"


def covers(name: Column, surface: Column) -> Column:
    """Whether a surface has most distinct words of a name; false for a name without words."""
    return let(F.array_distinct(word_tokens(name)), lambda w: (F.size(w) > 0) & (F.size(F.array_intersect(w, word_tokens(surface))) >= COVERED * F.size(w)))


def spanish_text(text: Column) -> Column:
    """Whether a text has several Spanish function words, and not too thinly; never null."""
    enough = lambda w: let(F.size(F.filter(w, lambda x: x.isin(SPANISH))), lambda n: (n >= SPANISH_HITS) & (n >= SPANISH_SHARE * F.size(w)))
    return F.coalesce(let(word_tokens(text), enough), F.lit(False))


def entity_checks() -> dict[str, Column]:
    """Checks of a record's name and brand on the surfaces that exist; null where either is missing."""
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    checks = {f"name_in_{s}": F.when(known("name") & known(s), covers(F.col("name"), F.col(s))) for s in ("title", "h1", "meta_title", "markup_name")}
    heads = F.concat_ws(" ", "title", "meta_title")
    checks["brand_eq_markup"] = F.when(known("brand") & known("markup_brand"), word_tokens(F.col("brand")) == word_tokens(F.col("markup_brand")))
    checks["brand_in_title"] = F.when(known("brand") & (F.trim(heads) != ""), covers(F.col("brand"), heads))
    return checks


def spanish_content(records: DataFrame) -> DataFrame:
    """(id, spanish_content): full for a Spanish record or one with a described Spanish sibling, partial for a bare Spanish sibling or
    Spanish words in its own text, else none.

    Siblings share domain and group, or one of the codes. What counts is whether a group has a Spanish member, so groups and codes are
    summed up, never paired: a record that is not Spanish itself cannot be that member.
    """
    spanish = F.col("language") == "es"
    told = F.coalesce(F.col("description") != "", F.lit(False))
    level = F.when(spanish & told, 2).when(spanish, 1)
    keyed = records.select("id", level.alias("level"), F.explode(F.array_union(
        F.when(F.col("domain").isNotNull() & F.col("group").isNotNull(), F.array(F.to_json(F.struct("domain", "group")))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform("codes", lambda c: F.to_json(F.struct(c.alias("code")))), F.array().cast("array<string>")),
    )).alias("key"))
    best = keyed.where("level is not null").groupBy("key").agg(F.max("level").alias("sibling"))
    near = keyed.where("level is null").join(best, "key").groupBy("id").agg(F.max("sibling").alias("sibling"))
    own = records.select("id", F.when(spanish, 2).when(spanish_text(F.concat_ws(" ", "title", "description", "meta_description")), 1).otherwise(0).alias("own"))
    found = F.greatest(F.col("own"), F.coalesce("sibling", F.lit(0)))
    return own.join(near, "id", "left").select("id", F.get(F.array(*map(F.lit, LEVELS)), found).alias("spanish_content"))


def profiles(records: DataFrame, evidence: DataFrame, conflicts: DataFrame, markup: DataFrame) -> DataFrame:
    """One row a record with the measures of NUMERIC, spanish_content, failed_checks and the sorted arrays stated, marked and conflicting.

    ``records`` has (id, language, domain, group, codes, brand, name, title, h1, meta_title, markup_name, markup_brand, description,
    meta_description), id once each; ``evidence`` (id, field, confidence, host), ``conflicts`` (id, field) and ``markup`` (id, field) any number of rows.
    Evidence of a record is summed by field before it meets the record. independent_evidence counts hosts that are not the record's domain or below it
    and is null (not measured) where there are none; entity_consistency_pct is null where no check applies. Rows of unknown ids, and null fields and
    hosts, count nothing.
    """
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("double")
    rows = (
        evidence.select("id", "field", F.col("confidence").cast("double").alias("confidence"), yes.alias("stated"), no.alias("marked"), no.alias("conflicting"))
        .unionByName(conflicts.select("id", "field", none.alias("confidence"), no.alias("stated"), no.alias("marked"), yes.alias("conflicting")))
        .unionByName(markup.select("id", "field", none.alias("confidence"), no.alias("stated"), yes.alias("marked"), no.alias("conflicting")))
        .where("field is not null")
    )
    kinds = ["stated", "marked", "conflicting"]
    fields = rows.groupBy("id", "field").agg(F.max("confidence").alias("confidence"), *(F.bool_or(k).alias(k) for k in kinds))
    summed = fields.groupBy("id").agg(
        F.count_if((F.col("confidence") >= VERIFIED) & ~F.col("conflicting")).alias("verified_facts"),
        *(F.sort_array(F.collect_list(F.when(F.col(k), F.col("field")))).alias(k) for k in kinds),  # a record's distinct fields
    )
    said = evidence.where("host is not null and host <> ''").select("id", F.regexp_replace(F.lower("host"), "^www\\.", "").alias("host")).distinct()
    own = F.regexp_replace(F.lower("domain"), "^www\\.", "")
    foreign = F.coalesce((F.col("host") != own) & ~F.endswith("host", F.concat(F.lit("."), own)), F.lit(True))
    hosts = said.join(records.select("id", "domain"), "id").where(foreign).groupBy("id").agg(F.count("*").alias("independent_evidence"))
    checks = entity_checks()
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(name)) for name, c in checks.items())))
    count = sum((c.isNotNull().cast("int") for c in checks.values()), F.lit(0))
    checked = records.select("id", "language", "domain", failed.alias("failed_checks"), count.alias("checks"))
    out = checked.join(summed, "id", "left").join(hosts, "id", "left").join(spanish_content(records), "id")
    empty = F.array().cast("array<string>")
    size = lambda k: F.size(F.coalesce(k, empty)).cast("long")
    return out.select(
        "id", "language", "domain", size("stated").alias("attributes_present"), size("marked").alias("markup_fields"),
        F.coalesce("verified_facts", F.lit(0)).alias("verified_facts"), "spanish_content", "independent_evidence",
        F.when(F.col("checks") > 0, F.round(100.0 * (F.col("checks") - F.size("failed_checks")) / F.col("checks"), 1)).alias("entity_consistency_pct"),
        size("conflicting").alias("contradictions"), "failed_checks", *(F.coalesce(k, empty).alias(k) for k in kinds),
    )


def against_peers(found: DataFrame, peers: DataFrame, attributes: list[str]) -> DataFrame:
    """``found`` profiles with ``peers`` (how many), the peers' medians as peer_<measure>, peer_spanish of peers in the record's own language,
    usual (the ``attributes`` that most peers state) and peer_marked (all fields that peers mark up).

    ``peers`` has (target_id, peer_id), a bounded list for each target; a record without peers has null medians.
    """
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("p.spanish_content")) - 1
    pairs = peers.alias("k").join(found.alias("p"), F.col("k.peer_id") == F.col("p.id")).join(found.select("id", "language").alias("t"), F.col("k.target_id") == F.col("t.id"))
    has = [F.count_if(F.array_contains("p.stated", a)).alias(f"has_{i}") for i, a in enumerate(attributes)]
    sums = pairs.groupBy(F.col("t.id").alias("id")).agg(
        F.count("*").alias("peers"),
        *(F.round(F.median(F.col(f"p.{m}").cast("double")), 1).alias(f"peer_{m}") for m in NUMERIC),
        F.rint(F.median(F.when(F.col("p.language") == F.col("t.language"), level))).cast("int").alias("peer_level"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("p.marked")))).alias("peer_marked"),
        *has,
    )
    usual = F.array_compact(F.array(*(F.when(F.col(f"has_{i}") > MAJORITY * F.col("peers"), F.lit(a)) for i, a in enumerate(attributes))))
    sums = sums.withColumns({"usual": usual, "peer_spanish": F.get(F.array(*map(F.lit, LEVELS)), F.col("peer_level"))})
    return found.join(sums.drop("peer_level", *(f"has_{i}" for i in range(len(attributes)))), "id", "left").withColumn("peers", F.coalesce("peers", F.lit(0)))


def _number(c: str) -> Column:
    """A number as people write it, without an exponent below a thousandth."""
    small = (F.abs(c) < 0.001) & (F.col(c) != 0)
    plain = F.regexp_replace(F.col(c).cast("decimal(20,10)").cast("string"), "0+$", "")
    return F.coalesce(F.when(small, plain).otherwise(F.col(c).cast("string")), F.lit("not measured"))


def gap_issues(compared: DataFrame, gap: str) -> DataFrame:
    """(id, at, kind, label, field, statement, items): typed issues of each record of ``against_peers`` in a fixed order, numbered from 1.

    ``gap`` names the measured lead of English over Spanish visibility, null where it was not measured; only a lead above 0 makes thin
    Spanish coverage a hypothesis. Every record gets at least the note that the effect of a change is unmeasured.
    """
    none = F.array().cast("array<string>")
    missing = F.coalesce(F.array_except("usual", "stated"), none)
    at = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), F.col(c))
    thin = at("spanish_content") < at("peer_spanish")
    lead = F.col(gap) > 0

    def issue(when: Column, kind: str, label: str, field: str, statement: Column, items: Column = none) -> Column:
        parts = (F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(field).alias("field"), statement.alias("statement"), items.alias("items"))
        return F.when(F.coalesce(when, F.lit(False)), F.struct(*parts))

    fact, unknown = "OBSERVED_FACT", "UNKNOWN"
    issues = [
        issue(F.size(missing) > 0, "missing_attributes", fact, "attributes", F.format_string("%d attributes missing that most of %d peers state", F.size(missing), F.col("peers")), missing),
        issue(
            F.col("entity_consistency_pct") < 100, "entity_inconsistency", fact, "entity_consistency",
            F.concat(F.lit("entity consistency "), _number("entity_consistency_pct"), F.lit("%, peer median "), _number("peer_entity_consistency_pct")), F.col("failed_checks"),
        ),
        issue(
            F.col("markup_fields") < F.col("peer_markup_fields"), "incomplete_structured_data", fact, "markup_fields",
            F.concat(_number("markup_fields"), F.lit(" marked fields, peer median "), _number("peer_markup_fields")), F.array_except("peer_marked", "marked"),
        ),
        issue(thin, "weak_language_coverage", fact, "spanish_content", F.concat(F.lit("Spanish content is "), "spanish_content", F.lit(", median of peers in the same language "), "peer_spanish")),
        issue(thin & lead, "weak_language_coverage", "SUPPORTED_HYPOTHESIS", "spanish_content", F.concat(F.lit("goes with a measured gap of Spanish visibility of "), _number(gap))),
        issue(thin & ~F.coalesce(lead, F.lit(False)), "weak_language_coverage", unknown, "visibility_gap", F.concat(F.lit("no gap of Spanish visibility is established: "), _number(gap))),
        issue(F.col("contradictions") > 0, "factual_contradictions", fact, "conflicts", F.concat(_number("contradictions"), F.lit(" contradicting facts")), F.col("conflicting")),
        issue(F.col("independent_evidence").isNull(), "independent_evidence", unknown, "independent_evidence", F.lit("evidence of others is not measured")),
        issue(F.lit(True), "visibility_effect", unknown, "visibility_effect", F.lit("whether closing the gaps changes visibility is unmeasured")),
    ]
    listed = compared.select("id", F.posexplode(F.array_compact(F.array(*issues))).alias("i", "x"))
    return listed.select("id", (F.col("i") + 1).alias("at"), "x.*")


def price_ranges(items: DataFrame, peers: DataFrame) -> DataFrame:
    """(id, peers, priced, low, high, median, place) of every item with peers: prices of peers in the item's own known currency.

    ``items`` has (id, price, currency), ``peers`` (target_id, peer_id), a bounded list for each target. Prices that are null or not positive are unknown. place is below, within
    or above the peers' range, null where either side is unknown.
    """
    known = F.when(F.col("price") > 0, F.col("price"))
    own = items.select(F.col("id").alias("target_id"), known.alias("own"), F.col("currency").alias("own_currency"))
    theirs = items.select(F.col("id").alias("peer_id"), known.alias("price"), "currency")
    same = F.when(F.col("currency") == F.col("own_currency"), F.col("price"))
    sums = peers.join(theirs, "peer_id").join(own, "target_id").groupBy(F.col("target_id").alias("id")).agg(
        F.count("*").alias("peers"), F.count(same).alias("priced"), F.min(same).alias("low"), F.max(same).alias("high"), F.round(F.median(same), 2).alias("median"),
        F.first(F.when(F.col("own_currency").isNotNull(), F.col("own"))).alias("own"),
    )
    place = F.when(F.col("own") < F.col("low"), "below").when(F.col("own") > F.col("high"), "above").when(F.col("own").isNotNull() & F.col("low").isNotNull(), "within")
    return sums.withColumn("place", place).drop("own")


def side_by_side(items: DataFrame, peers: DataFrame) -> DataFrame:
    """(target_id, peer_id, price_diff_pct, shared, lacks, extra): each peer beside its target.

    ``items`` has (id, price, currency, stated), stated an array of attributes or null. The difference of prices is in per cent of the target's, one decimal, null
    unless both are known in one currency; shared counts attributes that both state, lacks and extra list those that only the peer or only the target states.
    """
    some = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("stated", F.array().cast("array<string>")))))
    side = lambda key, x: items.select(F.col("id").alias(key), F.when(F.col("price") > 0, F.col("price")).alias(f"{x}_price"), F.col("currency").alias(f"{x}_currency"), some.alias(x))
    met = peers.select("target_id", "peer_id").join(side("peer_id", "p"), "peer_id").join(side("target_id", "t"), "target_id")
    off = F.when(F.col("p_currency") == F.col("t_currency"), F.round(100 * (F.col("p_price") - F.col("t_price")) / F.col("t_price"), 1))
    return met.select(
        "target_id", "peer_id", off.alias("price_diff_pct"), F.size(F.array_intersect("t", "p")).alias("shared"), F.array_except("p", "t").alias("lacks"), F.array_except("t", "p").alias("extra")
    )


def unknown_sides(items: DataFrame, peers: DataFrame, column: str) -> DataFrame:
    """(id, peers, unknown): of each target that states ``column`` how many of its peers do not."""
    own = items.where(F.col(column).isNotNull()).select(F.col("id").alias("target_id"))
    theirs = items.select(F.col("id").alias("peer_id"), F.col(column).isNull().alias("unknown"))
    return peers.join(own, "target_id").join(theirs, "peer_id").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("peers"), F.count_if("unknown").alias("unknown"))
