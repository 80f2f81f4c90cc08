"""Audits and contests of generated copy against plain Python over all candidates, and odd ones one by one."""

import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.functions import audits as a
from plumbline.functions import keywords as k
from plumbline.functions.guard import NEUTRAL
from plumbline.operators import contests
from plumbline.plans import contest_plans, keyword_plans
from plumbline.plans.catalog import QUERIES


def words(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return re.findall("[a-z0-9]+", plain)


def plain_words(text):
    return {w for w in words(text) if not w[0].isdigit()}


def fact_words(text):
    return plain_words(text) - set(a.GENERIC)


def half_up(x, digits):
    return None if x is None else round(x + (1e-12 if x > 0 else -1e-12), digits)


def title(text, known, brand, kind, material, fit):
    have = {
        "brand": " ".join(words(brand)) in " " + " ".join(words(text)) + " " if words(brand) else None, "kind": bool(re.search(kind.lower(), (text or "").lower())) if kind else None,
        "material": bool(fact_words(material) & fact_words(text)) if fact_words(material) else None, "fit": bool(fact_words(fit) & fact_words(text)) if fact_words(fit) else None,
    }
    chars, sure = len((text or "").strip(" ")), [x for x in have.values() if x is not None]
    return {**have, "chars": chars, "length_ok": 15 <= chars <= 90, "passes": bool(text) and set(words(text)) <= known, "score": half_up((sum(sure) + (15 <= chars <= 90)) / (len(sure) + 1), 4)}


def tags(given, known, facts, foreign, wanted):
    given = [t.strip(" ") for t in given or [] if t and t.strip(" ")]
    first = list({" ".join(words(t)): t for t in reversed(given)}.values())[::-1]
    first = sorted(first, key=given.index)
    n = len(first)
    out = {"n": len(given), "duplicates": len(given) - n, "passing": [t for t in first if set(words(t)) <= known], "false": [t for t in first if not set(words(t)) <= known]}
    share = lambda f: half_up(sum(map(f, first)) / n, 4) if n else None
    out |= {"fact_relevance": share(lambda t: bool(plain_words(t) & facts)), "intent_relevance": share(lambda t: bool({w[:5] for w in words(t)} & wanted)), "language_match": share(lambda t: not plain_words(t) & set(foreign))}
    out["score"] = half_up((out["fact_relevance"] + out["intent_relevance"] + out["language_match"]) / 3 * (n / len(given)) * (len(out["passing"]) / n), 4) if n else 0.0
    return out | {"passes": n > 0 and not out["false"]}


def readability(text, language):
    spoken, parts = [w for w in words(text) if not w[0].isdigit()], re.split(r"(?<=[.!?])\s+|\n+", text)
    if not spoken:
        return None
    syllables, length = sum(max(1, len(re.findall("[aeiouy]+", w))) for w in spoken) / len(spoken), len(spoken) / len([p for p in parts if p.strip()] or [1])
    return half_up(206.84 - 60 * syllables - 1.02 * length if language == "es" else 206.835 - 1.015 * length - 84.6 * syllables, 1)


@pytest.fixture(scope="module")
def audited(spark, sf_dir):
    out = {}
    intents = [{w[:5] for w in words(p) if len(w) >= 4 and w not in k.STOP and w not in NEUTRAL} for p in keyword_plans.SHARED]
    for r in contest_plans._candidates(spark, sf_dir).collect():
        known = {*words(r.facts), *words(str(r.p_size)), "made", *NEUTRAL}
        parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", r.text) if p.strip()]
        stems, facts = {w[:5] for w in words(r.text)}, plain_words(r.facts)
        flagged = sum(not set(words(p)) <= known for p in parts)
        text = {
            "sentences": len(parts), "flagged": flagged, "passes": bool(r.text) and not flagged, "fact_coverage": half_up(len(facts & plain_words(r.text)) / len(facts), 4), "words": len(r.text.split()),
            "intent_coverage": half_up(sum(bool(i) and len(i & stems) >= min(2, len(i)) for i in intents) / len(intents), 4), "readability": readability(r.text, r.language),
            "markup_completeness": None if r.marked is None else half_up(len(set(r.marked) & set(a.MARKUP_KEYS)) / len(a.MARKUP_KEYS), 4),
        }
        out[r.p_partkey, r.generator] = (
            title(r.title, known, r.p_brand, None if r.p_type == "PROMO" else r.p_type, r.fabric, r.p_name.split(" ")[0] if r.p_size <= 25 else None),
            tags(r.tag_list, known, facts, contest_plans.FOREIGN, set().union(*intents)), text,
        )
    return out


def test_all_audits(spark, sf_dir, audited):
    rows = QUERIES["copy_audits"](spark, sf_dir).collect()
    assert len(rows) == len(audited)
    for r in rows:
        t, g, d = audited[r.p_partkey, r.generator]
        assert {c: r[f"title_{c}"] for c in t} == t
        assert {c: r[f"tags_{c}"] for c in g if c not in ("passing", "false", "passes")} == {c: v for c, v in g.items() if c not in ("passing", "false", "passes")}
        assert (r.passing, r.false) == (",".join(g["passing"]), ",".join(g["false"]))
        assert {c: r[c] for c in d if c not in ("passes", "readability")} == {c: v for c, v in d.items() if c not in ("passes", "readability")}
        assert r.readability == pytest.approx(d["readability"], abs=0.1001)
    for i, part in enumerate(("title", "tags", "description")):
        assert {x[i]["passes"] for x in audited.values()} == {True, False}, part


def test_all_winners_and_generators(spark, sf_dir, audited):
    seen = {(r.p_partkey, r.generator): r for r in contest_plans._measured(spark, sf_dir).collect()}
    by_part, by_generator = defaultdict(dict), defaultdict(list)
    for (part, g), x in audited.items():
        by_part[part][g] = x
        by_generator[g].append((x, seen.get((part, g))))
    got = {r.p_partkey: r for r in QUERIES["copy_winners"](spark, sf_dir).collect()}
    assert set(got) == set(by_part)
    for part, cands in by_part.items():
        order = sorted(cands)
        first = lambda score: max(((score(cands[g], seen.get((part, g))), -i, g) for i, g in enumerate(order) if score(cands[g], seen.get((part, g)))), default=(0, 0, None))[2]  # noqa: B023, E731
        best = first(lambda x, m: x[1]["passes"] and x[1]["n"] and (x[1]["score"],))
        assert got[part].title == first(lambda x, m: x[0]["passes"] and (x[0]["score"], -abs(x[0]["chars"] - 60)))
        assert got[part].tags == best
        assert got[part].description == first(lambda x, m: x[2]["passes"] and (m.mrr if m else -1, x[2]["fact_coverage"]))
        merged, sources, had = [], [], set()
        for g in ([best] if best else []) + [g for g in order if g != best]:
            for t in cands[g][1]["passing"]:
                if " ".join(words(t)) not in had and len(merged) < 8:
                    had.add(" ".join(words(t)))
                    merged.append(t)
                    sources += [g] * (g not in sources)
        assert ((got[part].merged or ""), (got[part].sources or "")) == (",".join(merged), ",".join(sources))
    for r in QUERIES["generator_summary"](spark, sf_dir).collect():
        rows = by_generator.pop(r.generator)
        good = [x[0]["passes"] and x[2]["passes"] and not x[1]["false"] for x, _ in rows]
        assert (r.candidates, r.qualified_products, r.qualified) == (len(rows), sum(good), all(good))
        assert r.title_score == pytest.approx(sum(x[0]["score"] for x, _ in rows) / len(rows), abs=1e-4)
        assert r.mrr == pytest.approx(sum(m.mrr for _, m in rows if m) / sum(bool(m) for _, m in rows), abs=1e-4)
        assert (r.flagged, r.tags_false) == (sum(x[2]["flagged"] for x, _ in rows), sum(len(x[1]["false"]) for x, _ in rows))
    assert not by_generator


def test_odd_copy(spark):
    rows = spark.createDataFrame([(0, None, None, None), (1, "", [], ""), (2, "  ", ["", None, " "], "\n\n"), (3, "Red", ["Red", "réd", "RED ", "12", "!!"], "12. 13!"), (4, "x" * 5000, ["x" * 500], "red. " * 2000)], "i int, title string, tags array<string>, text string")
    grounded = k.grounded_in(F.lit("red cotton"), [])
    none = F.lit(None).cast("string")
    got = rows.select(
        "i", a.title_audit(F.col("title"), grounded, none, none, F.lit("cotton"), none).alias("t"), a.tags_audit(F.col("tags"), grounded, F.array(F.lit("red")), F.array(F.lit("rojo")), F.array(F.lit("red"))).alias("g"),
        a.description_audit(F.col("text"), grounded, F.lit("en"), F.array().cast("array<string>"), F.array().cast("array<array<string>>"), F.lit(None).cast("array<string>")).alias("d"),
    ).collect()
    got = {r.i: r for r in got}
    for i in (0, 1, 2):
        assert (got[i].t.score, got[i].g.n, got[i].g.score, got[i].g.passes, got[i].g.language_match, got[i].d.sentences, got[i].d.readability) == (0.0, 0, 0.0, False, None, 0, None)
        assert got[i].t.brand is None and got[i].t.material is False and got[i].d.fact_coverage is None and got[i].d.markup_completeness is None
    assert not got[0].t.passes and not got[1].t.passes and not got[0].d.passes
    assert (got[3].g.n, got[3].g.duplicates, list(got[3].g.passing), list(got[3].g.false)) == (5, 2, ["Red", "!!"], ["12"]) and got[3].d.readability is None and got[3].d.flagged == 2
    assert got[4].t.chars == 5000 and not got[4].t.length_ok and got[4].d.flagged == 0 and got[4].d.words == 2000


def test_ties_and_nobody_passes(spark):
    schema = (
        "id int, generator string, title struct<passes:boolean,score:double,chars:int>, tags struct<passes:boolean,n:int,score:double,passing:array<string>,false:array<string>,duplicates:int,language_match:double>, "
        "description struct<passes:boolean,fact_coverage:double,flagged:int,intent_coverage:double,readability:double,words:int,markup_completeness:double>, mrr double, mention_rate double"
    )
    def row(i, g, ok, chars=60, tags=(), mrr=None):
        return (i, g, (ok, 0.5, chars), (ok, len(tags), 0.5, list(tags), [], 0, 1.0), (ok, None, 0, None, None, 1, None), mrr, mrr)

    rows = spark.createDataFrame([row(1, "b", True, 61, ["x", "Y"]), row(1, "a", True, 59, ["y", "z"]), row(1, "c", True, 90, ["q"] * 1, 0.0), row(2, "a", False), row(2, "b", False, 60, ["t"])], schema)
    won = contests.part_winners(rows, "id")
    got = {r.id: r for r in won.collect()}
    assert (got[1].title, got[1].tags, got[1].description) == ("a", "a", "c") and (got[2].title, got[2].tags, got[2].description) == (None, None, None)
    merged = {r.id: (r.tags, r.sources) for r in contests.merged_tags(rows, won, "id", 3).collect()}
    assert merged == {1: (["y", "z", "x"], ["a", "b"]), 2: (["t"], ["b"])}
    ranks = {r.generator: (r.qualified, r.rank) for r in contests.generator_summary(rows).collect()}
    assert ranks == {"a": (False, None), "b": (False, None), "c": (True, 1)}
    assert contests.part_winners(rows.where("false"), "id").count() == 0 and contests.generator_summary(rows.where("false")).count() == 0


def test_copy_is_made_and_judged_in_as_many_tasks_as_a_shuffle_has(spark, sf_dir):
    """All parts' copy, a small file, was made and audited by one task; words of facts were folded again for every text."""
    from plumbline.functions import keywords as k
    from plumbline.plans import contest_plans, keyword_plans

    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert keyword_plans._titles(spark, sf_dir).rdd.getNumPartitions() == wanted
    assert contest_plans._candidates(spark, sf_dir).rdd.getNumPartitions() == wanted
    rows = spark.createDataFrame([("Red Wool", "a red wool"), ("Red Wool", "a blue wool"), ("Red Wool", ""), (None, "red"), ("", None)], "facts string, text string")
    by, within = k.grounded_by(k.fact_words(F.col("facts")), ["a"]), k.grounded_in(F.col("facts"), ["a"])
    assert [tuple(r) for r in rows.select(by(F.col("text")), within(F.col("text"))).collect()] == [(True, True), (False, False), (True, True), (False, False), (True, True)]
