"""Vocabularies, listing filters and page checks over whole tables against Python's own regular expressions."""

import re
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from plumbline.functions import listings as g
from plumbline.functions import vocabulary as v
from plumbline.plans import listing_plans as p
from plumbline.plans.catalog import QUERIES
from plumbline.storage import table


def has(pattern, text):
    return bool(re.search(pattern, text or "", re.I))


def hits(text, vocabulary):
    return [value for value, pattern in vocabulary if has(pattern, text)]


def earliest(sources, vocabulary):
    for text in sources:
        places = [(m.start(), i, value) for i, (value, pattern) in enumerate(vocabulary) if (m := re.search(pattern, text or "", re.I))]
        if places:
            return min(places)[2]
    return None


def shirt(value, sleeve):
    if value == "_dress_shirt":
        return "short_sleeve_shirt" if sleeve == "short" else "long_sleeve_shirt"
    return {"short": "short_sleeve_shirt", "long": "long_sleeve_shirt"}.get(sleeve) if value == "_shirt" else value


def plain_attributes(title, rest):
    whole, out = f"{title}. {rest}", {}
    for name, vocabulary in p.VOCABULARIES.items():
        out[name], out[f"{name}_first"] = ",".join(hits(whole, vocabulary)), earliest([title, rest], vocabulary)
    sleeve, colors = out["sleeve_first"], hits(title, v.COLORS)
    colors = [c for c in colors if c != "blue" or "navy" not in colors]
    care = hits(whole, v.CARE)
    out |= {"color": colors[0] if len(colors) == 1 else None, "care": ",".join(c for c in care if v.RULED_OUT.get(c) not in care)}
    settled = [shirt(found[0], sleeve) for text in (title, rest) if (found := hits(text, v.PRODUCT_TYPE))]
    out |= {"settled": next((s for s in settled if s), None), "kind": "other", "type": None}
    for text in (title, rest):
        own, other = hits(text, v.PRODUCT_TYPE + v.EXTRA_SHIRT), hits(text, v.NON_SHIRT)
        if own or other:
            return out | ({"kind": "shirt", "type": shirt(own[0], sleeve) or "unknown"} if own else {"kind": "other", "type": other[0]})
    return out


def plain_decisions(title, rest):
    whole = f"{title}. {rest}"
    shirt_, tee = not has(g.NOT_SHIRT, f"{title} | ") and (has(g.SHIRT, title) or has(g.SHIRT, rest)), not has(g.NOT_SHIRT, f"{title} | ") and has(g.TEE, title) and not has(g.NOT_TEE, title)
    if has(g.ALWAYS_REJECT, title):
        rejected = True
    elif has(g.STRONG_SHIRT, title):
        rejected = False
    else:
        rejected = has(g.HARD_REJECT, title) or has(g.NON_APPAREL, title) and not has(g.APPAREL_CUE, title)
    tanks = [(m.group(), name) for text, name in ((title, "raw_product_name"), (rest, "raw_title")) if (m := re.search(g.TANK, text, re.I))]
    prices = []
    for m in re.finditer(g.PRICE_IN_TEXT, whole):
        mark = re.search(r"€|\$|£|[A-Z]{3}", m.group()).group()
        if mark in g.MARKS or mark in g.ISO_4217:
            prices.append((float(re.search(g.AMOUNT, m.group()).group().replace(",", ".")), g.MARKS.get(mark, mark)))
    return {
        "shirt": shirt_, "tee": tee, "rejected": rejected, "tank_word": tanks[0][0] if tanks else None, "tank_field": tanks[0][1] if tanks else None, "stock": (hits(whole, g.STOCK) or [None])[0],
        "price": prices[0][0] if prices else None, "currency": prices[0][1] if prices else None,
    }


def test_listings_equal_plain_python(spark, sf_dir):
    listings = {r.l_orderkey: (r.title, r.description) for r in p._listings(spark, sf_dir).collect()}
    for name, plain in (("listing_attributes", plain_attributes), ("listing_decisions", plain_decisions)):
        rows = [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]
        assert len(rows) == len(listings)
        for row in rows:
            title, rest = listings[row.pop("l_orderkey")]
            assert row == plain(title, rest), (title, rest)
        for column in rows[0]:
            assert len({r[column] for r in rows}) > 1, f"{column} never differs"


def allowed(robots, path):
    groups, agents, ruled = [], [], False
    for line in (robots or "").splitlines():
        key, mark, value = line.split("#")[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not mark:
            continue
        if key == "user-agent":
            agents = [value.lower()] if ruled or not agents else [*agents, value.lower()]
            ruled = False
        elif key in ("allow", "disallow") and agents:
            ruled = True
            if value:
                groups.append((tuple(agents), key == "allow", value))
    mine = [r for r in groups if any(a != "*" and a in p.AGENT for a in r[0])] or [r for r in groups if "*" in r[0]]
    fitting = [(len(rule), allow) for _, allow, rule in mine if re.match(re.escape(rule).replace(r"\*", ".*").removesuffix(r"\$") + ("$" if rule.endswith("$") else ""), path)]
    return max(fitting)[1] if fitting else True


def test_page_checks_equal_plain_python(spark, sf_dir):
    got = {r.page_id: r.asDict() for r in QUERIES["page_checks"](spark, sf_dir).collect()}
    pages = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        parts = urlsplit(r.url)
        host = parts.netloc.lower().split(":")[0].removeprefix("www.")
        assert got[r.page_id] == {
            "page_id": r.page_id, "page_key": (host + parts.path.lower()).rstrip("/"), "capture_key": host + parts.path.rstrip("/") + (f"?{parts.query}" if parts.query else ""),
            "problem": {0: "not_public", 1: "scheme_or_host"}.get(r.page_id % 9), "allowed": allowed(p.ROBOTS[r.page_id % len(p.ROBOTS)], parts.path),
            "home": r.page_id % 4 == 0 and parts.path.strip("/") != "" or r.page_id % 4 == 1 and parts.path.strip("/") != "" and "search" not in parts.path.lower(),
            "challenge": r.page_id % 7 == 0 or has(g.CHALLENGE_TITLE, re.search("(?is)<title[^>]*>(.*?)</title>", r.html).group(1)),
        }, r.url
    assert {True, False} == {x["allowed"] for x in got.values()}


def test_stems_rule_out_nothing_that_fits(spark):
    tables = [*p.VOCABULARIES.values(), v.COLORS, v.CARE, v.EXTRA_SHIRT, v.NON_SHIRT]
    assert all(len(stem) > 1 for t in tables for _, pattern in t for stem in v.stems(pattern)) and all(v.stems(pattern) for t in tables for _, pattern in t)
    texts = ["OVER\u017fized HENLEY", "\u212aids", "STR\u0130PED", "str\u0131ped knit", "PIQU\u00c9 Ni\u00d1os", "", None, "Mangas CORTAS 3/4 sleeves", "jersey de ALGOD\u00d3N"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for t in tables:
        plain = F.array_compact(F.array(*(F.when(v.matches(F.col("text"), x), F.lit(y)) for y, x in t)))
        assert rows.select(v.all_hits(F.col("text"), t).alias("x")).collect() == rows.select(plain.alias("x")).collect()
