"""Live checks against plain Python: every answer of the tables, odd answers one by one, questions by full ranking."""

import re
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plumbline.functions import answers as a
from plumbline.operators import live
from plumbline.plans import live_plans
from plumbline.plans.catalog import QUERIES


def norm(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return " " + " ".join(re.findall("[a-z0-9]+", plain)) + " " if re.search("[a-z0-9]", plain) else " "


def bare_host(url):
    return re.sub(r"^www\.", "", re.match(r"https?://([^/?#:]*)", url.lower()).group(1))


def key(url):
    return bare_host(url) + re.sub(r"/+$", "", re.match(r"https?://[^/?#]*([^?#]*)", url.lower()).group(1))


def links(text):
    return [u.rstrip(".,;:!?") for u in re.findall(r"https?://[^\s)\]>\"'<]+", text)]


def brand_in(item):
    found = re.search(r"\*\*(.+?)\*\*", item) or re.match(r"[^:(,]+", item)
    if not found:
        return ""
    head = found.group(1) if found.re.groups else found.group(0)
    head = re.sub(r"[*_`]", "", re.sub(r"^[\d.)\s*_]+", "", head)).strip(" .")
    words = re.split(r"\s[-–—:(]\s?|:", head)[0].split()
    advice = not words or words[0].lower().rstrip(",") in a.TIPS or not words[0][0].isupper()
    return "" if advice else " ".join(words[:4])


def judged(text, brand, name, url, site):
    brand, name, url, site = brand or "", name or "", url or "", (site or "").lower()
    aliases = [x for x in (brand if len(norm(brand).strip()) >= 3 else "", site) if norm(x).strip()]

    def named(line):
        n = norm(line)
        whole = bool(norm(name).strip()) and norm(name) in n and norm(brand) in n
        return whole or any(norm(x) in n for x in aliases) or any(url and key(u) == key(url) for u in links(line))

    lines = (text or "").split("\n")
    items = [m.group(1) for m in (re.match(r"^\s*(?:\d+[.)]|[-*•])\s+(.+)", x) for x in lines) if m]
    ours = [named(x) or (bool(site) and site in x.lower()) for x in items]
    cited = bool(site) and any(bare_host(u) == site or (url and key(u) == key(url)) for u in links(text or ""))
    position = ours.index(True) + 1 if True in ours else None
    others = [b for x, o in zip(items, ours, strict=True) if not o and (b := brand_in(x)) and norm(b) != norm(brand)]
    return any(map(named, lines)) or cited or position is not None, cited, position, others


def test_all_answers_and_their_summary(spark, sf_dir):
    asked = live_plans._asked(spark, sf_dir).collect()
    got = {r.l_orderkey: (r.mentioned, r.cited, r.position, r.others) for r in QUERIES["live_answers"](spark, sf_dir).collect()}
    want, groups = {}, defaultdict(list)
    for r in asked:
        mentioned, cited, position, others = judged(r.text, r.brand, r.name, r.url, r.site)
        want[r.l_orderkey] = (mentioned, cited, position, "|".join(others))
        groups[r.brand].append((mentioned, cited, position, others))
    assert got == want
    assert len({w[0] for w in want.values()}) == 2 and len({w[1] for w in want.values()}) == 2 and {w[2] for w in want.values()} >= {None, 1, 2} and any(w[3] for w in want.values())
    for r in QUERIES["live_check_summary"](spark, sf_dir).collect():
        rows = groups.pop(r.brand)
        places = [x[2] for x in rows if x[2]]
        instead = Counter(b for x in rows for b in dict.fromkeys(b.title() if b.islower() else b for b in x[3]))
        top = sorted(instead.items(), key=lambda x: (-x[1], x[0]))[:8]
        assert (r.asked, r.mentioned, r.cited, r.top3) == (len(rows), sum(x[0] for x in rows), sum(x[1] for x in rows), sum(p <= 3 for p in places))
        assert (r.best_position, r.mention_rate, r.instead) == (min(places, default=None), round(r.mentioned / r.asked, 4), "|".join(f"{b}:{n}" for b, n in top))
    assert not groups


def test_odd_answers(spark):
    tee = ("Acme", "Heavy Tee", "https://www.acme.example/p/1", "acme.example")
    cases = [
        (None, *tee), ("", *tee), ("1. **Acme** best", *tee), ("1. Other: good\n2) acmé heavy tee", *tee), ("Macmer heavy tees", *tee), ("see https://acme.example/x.", *tee), ("see https://ACME.example/P/1/?a=b!", *tee),
        ("- Wash, cold\n- wear it\n* Use: x\n• Nike - Air", *tee), ("- Acme, good\n- ACME: again", *tee), ("heavy tee", "AB", "Heavy Tee", "", ""), ("ab heavy tee\n- ab", "AB", "Heavy Tee", None, None),
        ("1. **Óscar Shirts of the Big City** - x\n2. **one** y\n3. __Two__ z", *tee), ("- (x)\n- **\n- 12 Things\n- 3. Four. Five", *tee), ("anything", None, None, None, None), ("- https://b.example/p/1", "B&B", "x", "http://b.example/p/1", ""),
        ("- notacme.example is fine", *tee), ("-\n1.\n- ", *tee), ("x " * 5000 + "\n1. acme", *tee),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, brand string, name string, url string, site string")
    found = rows.select("i", a.analysis(*(F.col(c) for c in ("text", "brand", "name", "url", "site"))).alias("x")).collect()
    for r in found:
        assert (r.x.mentioned, r.x.cited, r.x.position, list(r.x.others)) == judged(*cases[r.i]), cases[r.i]
    empty = live.check_summary(rows.where("false").select("brand", a.analysis(*(F.col(c) for c in ("text", "brand", "name", "url", "site"))).alias("x")).select("brand", "x.*"), ["brand"])
    assert empty.count() == 0


def test_summary_of_unknown_groups_and_ties(spark):
    rows = [(None, True, False, 2, ["Zed", "Amy"]), (None, False, False, None, ["zed"]), ("b", False, False, None, []), ("c", True, True, 4, ["x y", "X Y"])]
    got = {r.by: r for r in live.check_summary(spark.createDataFrame(rows, "by string, mentioned boolean, cited boolean, position int, others array<string>"), ["by"], 1).collect()}
    assert [(x.brand, x.answers) for x in got[None].instead] == [("Zed", 2)] and (got[None].top3, got[None].best_position, got[None].mention_rate) == (1, 2, 0.5)
    assert got["b"].instead == [] and got["b"].best_position is None and got["c"].top3 == 0 and len(got["c"].instead) == 1


def test_questions_by_full_ranking(spark):
    types = {"polo": ("polo", "polo"), "warm": ("heavy|wool", "warm")}
    texts = ["A polo?", "warm polo", "WARM", "any", None, "any", "polo", "x", "y", "z"]
    questions = [(i, ("en", "es")[i == 9], t, ("g", "h", None)[i % 3]) for i, t in enumerate(texts)]
    listings = [(1, "en", "Heavy Polo"), (2, "en", "wool"), (3, "en", None), (4, "es", "polo"), (5, "fr", "polo"), (6, None, "polo"), (7, "en", "POLO")]
    got = defaultdict(list)
    df = live.chosen_questions(spark.createDataFrame(listings, "id int, language string, what string"), spark.createDataFrame(questions, "question_id int, language string, text string, intent string"), types, ["g"], 4)
    for r in sorted(df.collect(), key=lambda r: (r.id, r.rank)):
        got[r.id].append(r.question_id)
    want = {}
    for i, language, what in listings:
        kinds = [k for k, (p, _) in enumerate(types.values()) if re.search(p, (what or "").lower())]
        stage = lambda q: next((k for k in kinds if re.search(list(types.values())[k][1], (q[2] or "").lower())), 2 if q[3] == "g" else 3)  # noqa: B023, E731
        ranked = sorted((q for q in questions if q[1] == language), key=lambda q: (stage(q), q[0]))  # noqa: B023
        if ranked:
            want[i] = [q[0] for q in ranked[:4]]
    assert got == want


def test_answers_are_spread_and_read_once(spark, sf_dir):
    from plumbline.plans import live_plans

    assert live_plans._analysed(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = live_plans.live_check_summary(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "regexp_extract" not in plan
