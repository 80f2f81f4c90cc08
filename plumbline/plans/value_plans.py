"""Value rules over whole tables, against values stated beside their inputs (see case_plans)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import values as x
from plumbline.plans.case_plans import Cases

RECORD = '{"id": "p1", "materials": {"primary": "cotton", "list": []}, "variants": [{"size": "S"}, {"size": ""}], "price": 0, "note": null, "care": {}}'
OFFERS = "array<struct<price:double,currency:string>>"
TOKENS = "array<struct<start:int,end:int,p:double>>"


def _listed(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda v: v != "")


CASES: dict[str, Cases] = {
    "record_numbers": Cases(
        "text string", "number DOUBLE", lambda v: [x.num(v)],
        [("1,234.5", 1234.5), (" 7 ", 7.0), ("nan", None), ("inf", None), ("true", None), (None, None), ("12 EUR", None), ("-3e2", -300.0), ("", None)],
    ),
    "record_ratings": Cases(
        "value double, best double, worst double", "of_five DOUBLE, out_of_range BOOLEAN", lambda v, b, w: [x.rating_of_five(v, b), x.rating_out_of_range(v, b, w)],
        [
            (8.0, 10.0, 1.0, 4.0, False), (4.5, None, None, None, False), (6.0, None, None, None, True), (11.0, 10.0, None, None, True), (0.5, 5.0, 1.0, 0.5, True), (None, 5.0, None, None, False), (-1.0, 5.0, None, None, True),
            (3.0, 0.0, None, None, True),
        ],
    ),
    "record_price_conflicts": Cases(
        "offers string, currency string, price double", "conflict BOOLEAN", lambda o, c, p: [x.prices_conflict(F.from_json(o, OFFERS), c, p)],
        [
            ('[{"price":10,"currency":"USD"},{"price":12,"currency":"USD"}]', "USD", 11.0, False), ('[{"price":10,"currency":"USD"},{"price":12,"currency":"EUR"}]', "USD", 10.0, True),
            ('[{"price":10,"currency":"USD"},{"price":21,"currency":"USD"}]', "USD", 15.0, True), ('[{"price":10,"currency":"USD"}]', "USD", 9.0, True), ("[]", "USD", 9.0, False), (None, "USD", 9.0, False),
            ('[{"price":0,"currency":"USD"},{"price":5}]', "USD", 5.0, False),
        ],
    ),
    "record_paths": Cases(
        "json string", "size VARCHAR, nothing VARCHAR, primary_there BOOLEAN, list_there BOOLEAN, care_there BOOLEAN, note_there BOOLEAN, price_there BOOLEAN, empty_there BOOLEAN",
        lambda j: [x.at_path(j, "variants[0].size"), x.at_path(j, "variants[5].size"), *(x.present(j, p) for p in ("materials.primary", "materials.list", "care", "note", "price", "variants[1].size"))],
        [(RECORD, "S", None, True, False, False, False, True, False), ("{}", None, None, False, False, False, False, False, False), (None, None, None, False, False, False, False, False, False), ("no json", None, None, False, False, False, False, False, False)],
    ),
    "model_outputs": Cases(
        "text string", "output VARCHAR", lambda t: [x.model_output(t)],
        [('```json\n{"a":1}\n```', '{"a":1}'), ('{"a":"b"}', '{"a":"b"}'), ("[1]", None), ("sure: {}", None), ('{"a":', None), (None, None), ('``` {"b":2} ```', '{"b":2}')],
    ),
    "lenient_scripts": Cases(
        "text string", "json VARCHAR", lambda t: [x.lenient_json(t)],
        [
            ('{"a":1}', '{"a":1}'), ('<!-- {"a":1,} -->', '{"a":1}'), ('//<![CDATA[\n{"a":[1,2,]}\n//]]>', '{"a":[1,2]}'), ("nothing", None), (None, None), ('[{"b":2},]', '[{"b":2}]'),
        ],
    ),
    "field_confidences": Cases(
        "tokens string, low int, high int", "confidence DOUBLE", lambda t, a, b: [x.geometric_mean(F.from_json(t, TOKENS), a, b)],
        [
            ('[{"start":0,"end":2,"p":0.5},{"start":2,"end":4,"p":0.5},{"start":4,"end":6,"p":0.1}]', 0, 4, 0.5), ('[{"start":0,"end":2,"p":0.9},{"start":2,"end":4,"p":0.4}]', 1, 3, 0.6), ('[{"start":0,"end":2,"p":0.9}]', 2, 4, None),
            ("[]", 0, 9, None), (None, 0, 9, None), ('[{"start":0,"end":2,"p":0.0},{"start":1,"end":3,"p":0.25}]', 0, 3, 0.25),
        ],
    ),
    "description_coverages": Cases(
        "text string, known string", "intents VARCHAR, value DOUBLE", lambda t, k: [F.array_join(x.description_coverage(t, _listed(k))["intents"], ","), x.description_coverage(t, _listed(k))["value"]],
        [
            ("A relaxed fit with short sleeves. Machine wash.", "fit,sleeve,care", "care,fit,sleeve", 0.3333), ("cotton tee shirt men women kids sale", "primary_material", "", 0.0), ("Made of 100% organic cotton.", "primary_material,composition", "composition,material", 0.2222),
            ("Made of 100% organic cotton.", "organic", "organic_material", 0.1111), ("", "fit", "", 0.0), ("A crew neck in jersey with stretch", "neckline,gsm,stretch", "fabric,neck_or_collar,stretch", 0.3333),
            ("con cuello y manga de algodón; con cuello y manga de algodón; con cuello y manga de algodón", "sleeve,collar", "neck_or_collar,sleeve", 0.0111),
        ],
    ),
    "experiment_states": Cases(
        "dev double, hidden double, held double, before double, afters string, controls int", "overfit BOOLEAN, general BOOLEAN, guardrail VARCHAR, status VARCHAR",
        lambda d, h, o, b, a, n: [
            x.overfits(d, h), x.generalizes(F.coalesce(h, d), o), x.guardrail(b, F.transform(_listed(a), lambda v: v.cast("double"))),
            x.experiment_status(x.guardrail(b, F.transform(_listed(a), lambda v: v.cast("double"))), F.coalesce(h, d).isNotNull(), n, x.overfits(d, h), x.generalizes(F.coalesce(h, d), o)),
        ],
        [
            (6.0, 0.5, 0.3, 0.9, "0.9,0.95", 3, True, True, "pass", "flagged"), (6.0, 4.0, 3.0, 0.9, "0.95", 3, False, True, "pass", "reported"), (6.0, 4.0, 1.0, 0.9, "0.95", 3, False, False, "pass", "flagged"),
            (6.0, 4.0, 3.0, 0.9, "0.8,0.95", 3, False, True, "fail", "rejected"), (None, None, None, 0.9, "0.9", 3, None, None, "pass", "pending"), (2.0, 2.0, None, None, "0.9", 3, False, None, "unknown", "unverified"),
            (2.0, 2.0, 2.0, 0.9, "", 3, False, True, "unknown", "unverified"), (2.0, 2.0, 2.0, 0.9, "0.9", 0, False, True, "pass", "flagged"), (-1.0, None, 2.0, 0.5, "0.5", 1, None, None, "pass", "reported"),
        ],
    ),
    "readability_es": Cases(
        "text string", "ease DOUBLE", lambda t: [x.readability_es(t)],
        [("Una camiseta de algodón.", 52.8), ("", None), ("Sí. No.", 145.8), ("123", None)],
    ),
}

QUERIES = {name: cases.spark for name, cases in CASES.items()}
ORACLE_SQL = {name: cases.sql() for name, cases in CASES.items()}
