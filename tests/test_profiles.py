"""Competitor profiles and gap issues: odd records one by one."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profiles as o

RECORD = (
    "id long, language string, domain string, `group` string, codes array<string>, brand string, name string, title string, h1 string, meta_title string, "
    "markup_name string, markup_brand string, description string, meta_description string"
)
EVIDENCE, FIELD = "id long, field string, confidence double, host string", "id long, field string"


def record(i, **over):
    base = {
        "id": i, "language": "en", "domain": "www.shop.example", "group": None, "codes": None, "brand": "Acme", "name": "Heavy Tee", "title": "Acme Heavy Tee", "h1": "Heavy Tee",
        "meta_title": None, "markup_name": "heavy tee", "markup_brand": "ACME", "description": "A tee.", "meta_description": None,
    }
    return tuple((base | over).values())


def profiled(spark, records, evidence=(), conflicts=(), markup=()):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((records, RECORD), (evidence, EVIDENCE), (conflicts, FIELD), (markup, FIELD))]
    return o.profiles(*frames)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_entity_checks_count_only_surfaces_that_exist(spark):
    got = by_id(profiled(spark, [
        record(1), record(2, h1="Tee", title="Heavy Tee", meta_title="by Acme"), record(3, name=None, brand=None), record(4, title="", meta_title="", h1=None, markup_name=None, markup_brand=None),
        record(5, name="!!", brand="", h1="!!"), record(6, name="a b c d e", title="Acme e d c b", h1="a b c", markup_name=None),
    ]))
    assert (got[1].entity_consistency_pct, got[1].failed_checks) == (100.0, [])
    assert (got[2].entity_consistency_pct, got[2].failed_checks) == (66.7, ["name_in_h1", "name_in_meta_title"])
    assert got[3].entity_consistency_pct is None and got[4].entity_consistency_pct is None
    assert got[5].failed_checks == ["name_in_title", "name_in_h1", "name_in_markup_name"] and got[5].entity_consistency_pct == 0.0
    assert got[6].failed_checks == ["name_in_h1"] and got[6].entity_consistency_pct == 75.0


def test_spanish_by_itself_by_siblings_and_by_words(spark):
    words = "Camiseta de algodón con manga corta para el verano y la playa"
    got = by_id(profiled(spark, [
        record(1, language="es", group="g", description=None), record(2, group="g"), record(3, group="g", domain="other.example"), record(4, language="es", codes=["9", "8"], description="larga"),
        record(5, codes=["8"], group="g"), record(6, description=words), record(7, description="el la " + "word " * 200), record(8, language=None, title=None, description=None, codes=[]), record(9, codes=[None]),
        record(10, description="el la los " + "word " * 57, title=None), record(11, description="el la los " + "word " * 58, title=None),
    ]))
    levels = {i: r.spanish_content for i, r in got.items()}
    assert levels == {1: "full", 2: "partial", 3: "none", 4: "full", 5: "full", 6: "partial", 7: "none", 8: "none", 9: "none", 10: "partial", 11: "none"}


def test_evidence_conflicts_and_hosts(spark):
    evidence = [
        (1, "fit", 0.9, "www.shop.example"), (1, "fit", 0.2, "blog.shop.example"), (1, "color", 0.95, "Review.example"), (1, "color", 0.95, "review.example"), (1, "size", 0.89, "notshop.example"),
        (1, None, 1.0, None), (2, "fit", None, ""), (99, "fit", 1.0, "x.example"), (3, "fit", 1.0, "x.example"),
    ]
    got = by_id(profiled(spark, [record(1), record(2), record(3, domain=None)], evidence, [(1, "color"), (1, "color"), (1, "care")], [(1, "name"), (1, "name"), (2, "offers"), (2, None)]))
    one = got[1]
    assert (one.verified_facts, one.contradictions, one.attributes_present, one.markup_fields, one.independent_evidence) == (1, 2, 3, 1, 2)
    assert (one.stated, one.conflicting, one.marked) == (["color", "fit", "size"], ["care", "color"], ["name"])
    assert (got[2].verified_facts, got[2].attributes_present, got[2].markup_fields, got[2].independent_evidence) == (0, 1, 1, None)
    assert got[3].independent_evidence == 1 and set(got) == {1, 2, 3}


def test_issues_in_order_and_only_where_measured(spark):
    records = [record(1, h1="x"), record(2, language="es"), record(3, description="la camiseta con manga"), record(4, description="el la los"), record(5)]
    markup = [(i, f) for i in (3, 4) for f in ("name", "offers")] + [(1, "brand")]
    evidence = [(i, "fit", 1.0, "y.example") for i in (2, 3, 4)] + [(3, "color", 1.0, None)]
    found = profiled(spark, records, evidence, [(1, "fit")], markup)
    peers = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 1), (5, 2), (1, 77)], "target_id long, peer_id long")
    compared = o.against_peers(found, peers, ["fit", "color"])
    one, alone = by_id(compared)[1], by_id(compared)[3]
    assert (one.peers, one.usual, one.peer_spanish, one.peer_markup_fields, one.peer_marked) == (3, ["fit"], "partial", 2.0, ["name", "offers"])
    assert (alone.peers, alone.usual, alone.peer_spanish, alone.peer_markup_fields) == (0, None, None, None)
    assert by_id(compared)[2].peer_spanish is None and by_id(compared)[5].peer_spanish is None

    def issues(gap):
        rows = o.gap_issues(compared.withColumn("gap", F.lit(gap).cast("double")), "gap").where("id = 1").orderBy("at").collect()
        assert [r.at for r in rows] == list(range(1, len(rows) + 1))
        return [(r.kind, r.label, list(r.items)) for r in rows]

    first = [
        ("missing_attributes", "OBSERVED_FACT", ["fit"]), ("entity_inconsistency", "OBSERVED_FACT", ["name_in_h1"]), ("incomplete_structured_data", "OBSERVED_FACT", ["name", "offers"]),
        ("weak_language_coverage", "OBSERVED_FACT", []),
    ]
    last = [("factual_contradictions", "OBSERVED_FACT", ["fit"]), ("independent_evidence", "UNKNOWN", []), ("visibility_effect", "UNKNOWN", [])]
    assert issues(0.2) == [*first, ("weak_language_coverage", "SUPPORTED_HYPOTHESIS", []), *last]
    assert issues(0.0) == issues(None) == issues(-0.1) == [*first, ("weak_language_coverage", "UNKNOWN", []), *last]
    rest = o.gap_issues(compared.withColumn("gap", F.lit(0.2)), "gap")
    assert [r.kind for r in rest.where("id = 3").collect()] == ["visibility_effect"]


@pytest.mark.parametrize("records", [[], [record(1)]])
def test_empty_tables(spark, records):
    found = profiled(spark, records)
    compared = o.against_peers(found, spark.createDataFrame([], "target_id long, peer_id long"), ["fit"])
    kinds = [r.kind for r in o.gap_issues(compared.withColumn("gap", F.lit(None).cast("double")), "gap").orderBy("at").collect()]
    assert kinds == (["independent_evidence", "visibility_effect"] if records else [])


def test_prices_and_attributes_of_peers(spark):
    rows = [(1, 10.0, "EUR", ["fit", "size", None]), (2, 12.0, "EUR", ["fit", "fit", "gtin"]), (3, -1.0, "EUR", None), (4, 8.0, "USD", []), (5, 9.0, None, ["care"]), (6, None, "EUR", ["fit"]), (7, 10.0, "EUR", [])]
    items = spark.createDataFrame(rows, "id int, price double, currency string, stated array<string>")
    peers = spark.createDataFrame([(1, p) for p in (2, 3, 4, 5, 7, 99)] + [(2, 1), (2, 7), (3, 1), (4, 1), (5, 1), (6, 3), (77, 1)], "target_id int, peer_id int")
    got = {r.id: (r.peers, r.priced, r.low, r.high, r.median, r.place) for r in o.price_ranges(items, peers).collect()}
    assert got == {
        1: (5, 2, 10.0, 12.0, 11.0, "within"), 2: (2, 2, 10.0, 10.0, 10.0, "above"), 3: (1, 1, 10.0, 10.0, 10.0, None), 4: (1, 0, None, None, None, None), 5: (1, 0, None, None, None, None),
        6: (1, 0, None, None, None, None),
    }
    pairs = {(r.target_id, r.peer_id): (r.price_diff_pct, r.shared, list(r.lacks), list(r.extra)) for r in o.side_by_side(items, peers).collect()}
    assert pairs[1, 2] == (20.0, 1, ["gtin"], ["size"]) and pairs[1, 3] == (None, 0, [], ["fit", "size"]) and pairs[1, 4] == (None, 0, [], ["fit", "size"]) and pairs[5, 1] == (None, 0, ["fit", "size"], ["care"]) and pairs[2, 1][0] == -16.7
    assert len(pairs) == 11
    sides = {r.id: (r.peers, r.unknown) for r in o.unknown_sides(items, peers, "currency").collect()}
    assert sides == {1: (5, 1), 2: (2, 0), 3: (1, 0), 4: (1, 0), 6: (1, 0)}
    none = items.where("false")
    assert o.price_ranges(none, peers).count() == o.side_by_side(none, peers).count() == o.unknown_sides(none, peers, "currency").count() == 0


def test_small_numbers_of_statements_have_no_exponent(spark):
    """A measured gap of 0.0005 was written as 5.0E-4."""
    rows = spark.createDataFrame([(0.0005,), (-0.0005,), (0.0012,), (0.5,), (0.0,), (-0.0,), (100.0,), (None,)], "x double")
    got = [r.n for r in rows.select(o._number("x").alias("n")).collect()]
    assert got == ["0.0005", "-0.0005", "0.0012", "0.5", "0.0", "-0.0", "100.0", "not measured"]


def test_gaps_of_visibility_keep_the_sign_of_a_small_lead(spark, tmp_path):
    from plumbline.plans import profile_plans

    n = 40_000
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "en").otherwise("es").alias("lang"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when((F.col("id") % n == 0) & (F.col("id") < n), 0).otherwise(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(2 * n).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    assert [str(r.gap) for r in profile_plans._gaps_of_visibility(spark, str(tmp_path)).collect()] == ["-0.0"]


def test_peers_move_once_and_parts_grow_with_the_lines(spark, sf_dir, monkeypatch):
    from plumbline import storage
    from plumbline.plans import profile_plans

    plain = sorted(map(tuple, profile_plans._peers(spark, sf_dir).collect()))
    monkeypatch.setattr(storage, "ROWS_A_PART", 500)
    found = profile_plans._peers(spark, sf_dir)
    assert found.rdd.getNumPartitions() >= 12 and sorted(map(tuple, found.collect())) == plain


def test_sibling_counts_equal_pairs(spark):
    from plumbline.operators import records

    rows = [(i, "xy"[i % 2] if i % 5 else None, i % 3, [str(i // 3), str(i // 3), f"x{i // 4}"]) for i in range(40)] + [(99, "z", 1, ["none"])]
    items = spark.createDataFrame(rows, "id long, brand string, size int, codes array<string>")
    pairs = records.siblings(items, "id", ["brand", "size"], "codes").collect()
    wanted = {}
    for pair in pairs:
        for one in pair:
            wanted[one] = wanted.get(one, 0) + 1
    counts = records.sibling_counts(items, "id", ["brand", "size"], "codes")
    assert {r.id: r.siblings for r in counts.collect()} == wanted and 99 not in wanted
