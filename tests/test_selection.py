"""Choice among generated copy against a walk through the rounds in plain Python."""

import json
import re

from pyspark.sql import functions as F

from plumbline.functions import keywords as k
from plumbline.functions.guard import NEUTRAL
from plumbline.operators import selection
from plumbline.plans import contest_plans
from plumbline.plans.catalog import QUERIES
from test_contests import plain_words, words


def parts(text):
    return [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if p.strip(" ")]


def scored(title, text, targets, known):
    ok = lambda s: set(words(s)) <= known
    title, text = (title or "").strip(" "), text or ""
    kept, removed = [p for p in parts(text) if ok(p)], [p for p in parts(text) if not ok(p)]
    bad = len(removed) + (not ok(title))
    said = plain_words(" ".join([title] * ok(title) + kept))
    return {"title": title, "text": text, "title_ok": ok(title), "kept": kept, "removed": removed, "passed": not bad, "format_ok": bool(title and text), "total": round((round(len(said & targets) / len(targets), 4) if targets else 0.0) - bad, 4)}


def walked(rows, fallback, facts):
    """rows: (round, order, scored) of one listing; rounds end at the first with a usable candidate."""
    tried = []
    for asked in sorted({r[0] for r in rows}):
        tried += [r for r in rows if r[0] == asked]
        if any(c["passed"] and c["format_ok"] for _, _, c in tried):
            break
    usable = [r for r in tried if r[2]["passed"] and r[2]["format_ok"]] or tried
    best = min(usable, key=lambda r: (-r[2]["total"], r[0], r[1]))
    c = best[2]
    title = c["title"] if c["title_ok"] and c["title"] and len(c["title"]) <= 90 else fallback
    out = (best[0], title, " ".join(c["kept"] or facts), [c["title"]] * (not c["title_ok"]) + c["removed"], c["passed"], c["total"], asked, not c["kept"])
    same = lambda x: (x["title"], x["text"])
    pairs = [(same(c), same(r[2]), c["total"], r[2]["total"]) for r in tried if c["passed"] and r[2]["total"] < c["total"] and same(r[2]) != same(c)]
    return out, pairs


def test_all_parts(spark, sf_dir):
    listed = {}
    for r in contest_plans._tried(spark, sf_dir).collect():
        known = {*words(r.facts), *words(str(r.p_size)), "made", *NEUTRAL}
        listed.setdefault(r.p_partkey, ([], r.fallback_title, r.known_facts))[0].append((r.round, r.order, scored(r.title, r.text, set(r.targets), known)))
    want = {key: walked(*x) for key, x in listed.items()}
    got = QUERIES["selected_copy"](spark, sf_dir).collect()
    assert {r.p_partkey: (r.round, r.title, r.text, r.removed, r.passed, r.total, r.attempts_until, r.used_fallback) for r in got} == {key: (*w[:3], "|".join(w[3]), *w[4:]) for key, (w, _) in want.items()}
    assert len(got) == len(want) and all(r.problems == 0 for r in got) and {r.passed for r in got} == {True, False} and {r.attempts_until for r in got} == {1, 2}
    pairs = sorted((r.p_partkey, r.chosen, r.rejected, r.chosen_total, r.rejected_total) for r in QUERIES["preference_pairs"](spark, sf_dir).collect())
    as_json = lambda x: json.dumps({"title": x[0], "text": x[1]}, separators=(",", ":"), ensure_ascii=False)
    assert pairs == sorted((key, as_json(a), as_json(b), x, y) for key, (_, ps) in want.items() for a, b, x, y in ps) and pairs


def test_odd_candidates(spark):
    rows = [
        (1, 1, 1, None, None), (1, 1, 2, "", "red"), (2, 1, 1, "Red", "Red. Bad one!"), (2, 2, 2, "red tee", "Red. Tee."), (2, 2, 1, "red tee", "Red. Tee."), (2, 3, 1, "red tee", "Red tee red."), (3, 1, 1, "bad", "worse. worst"),
        (4, 1, 1, "red " * 40, "Red."), (5, 1, 2, "red", "red"), (5, 1, 1, "red", "red"), (5, 1, 3, "tee", "bad"), (6, 1, 1, "red", " \n "), (7, 1, 1, "red tee", "red tee"), (7, 1, 2, "red", "x"), (7, 1, 3, "red", "red"),
    ]
    df = spark.createDataFrame(rows, "id int, round int, `order` int, title string, text string")
    df = df.withColumns({"targets": F.array(F.lit("red"), F.lit("tee")), "fallback_title": F.lit("Tee"), "facts": F.array(F.lit("Red."), F.lit("Tee."))})
    done = selection.scored_candidates(df, k.grounded_in(F.lit("red tee"), []))
    chosen = selection.selected_copy(done, "id")
    got = {r.id: (r.round, r.title, r.text, list(r.removed), r.passed, r.total, r.attempts_until, r.used_fallback) for r in chosen.collect()}
    want = {i: walked([(a, o, scored(t, x, {"red", "tee"}, {"red", "tee"})) for j, a, o, t, x in rows if j == i], "Tee", ["Red.", "Tee."]) for i in range(1, 8)}
    assert got == {i: w for i, (w, _) in want.items()}
    pairs = selection.preference_pairs(done, chosen, "id").collect()
    assert sorted((r.id, r.chosen_total, r.rejected_total) for r in pairs) == sorted((i, x, y) for i, (_, ps) in want.items() for _, _, x, y in ps) and {r.id for r in pairs} == {1, 2, 5, 7}
    bad = selection.ungrounded(spark.createDataFrame([(1, "red", "red. blue! tee"), (2, None, "red"), (3, "red", "red"), (4, "Blue", "")], "id int, title string, text string"), "id", k.grounded_in(F.lit("red tee"), []))
    assert sorted(((r.id, r.sentence) for r in bad.collect()), key=str) == [(1, "blue!"), (2, None), (4, "Blue"), (4, None)]
    assert selection.selected_copy(done.where("false"), "id").count() == 0
