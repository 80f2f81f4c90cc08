"""Filters and checks of listings, drafts, addresses and pages, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.functions.vocabulary import Table, first_of, matches

# Words that make a title a shirt, a t-shirt, or neither.
SHIRT = r"\b(shirts?|t-?shirts?|tees?|polos?|henleys?|camisas?|camisetas?|sobrecamisas?|guayaberas?|overshirts?)\b"
NOT_SHIRT = (
    r"\b(sweat ?shirts?|jackets?|chaquetas?|hoodies?|sudaderas?|packs?|\d-pack|dress(es)?|vestidos?|gift|cardigans?|trunks|boxers?|briefs|pants|pantalones|"
    r"shorts|bras?|jerseys?|socks|calcetines|bundle|blouses?|blusas?|bodys?|babygrow|onesie|pullovers?|sweaters?|jumpers?)\b"
)
TEE = r"\b(t-?shirts?|tees?|camisetas?)\b"
NOT_TEE = r"\b(polos?|camisas?|button[- ]?(down|up)|henleys?)\b"
STRONG_SHIRT = r"(?<!sweat)shirt|\bpolo\b|henley|blouse|camiseta"
HARD_REJECT = r"\b\d+([.,]\d+)?\s?(g|kg|ml|l|gram|grams)\b(?!/)|\bsweatshirts?\b|\bhoodies?\b"
NON_APPAREL = (
    r"\b(candles?|mugs?|teas?|matcha|chai|mate|coffee|lunch ?box(es)?|bottles?|tumblers?|posters?|stickers?|magnets?|keychains?|pillows?|blankets?|tote|"
    r"backpacks?|puzzles?|ornaments?|jackets?|coats?|socks|shorts|pants|trousers|jeans|leggings|dress(es)?|skirts?|caps?|hats?|beanies?|shoes|sneakers)\b"
)
APPAREL_CUE = (
    r"sleeve|\bfit(ted)?\b|relaxed|oversized?|youth|boyfriend|unisex|\bmen's\b|women's|ladies|\bkids\b|\btalla\b|\bsize\b|\btee\s*$|\btee\s+[-(]"
)
ALWAYS_REJECT = r"propane|adapter|splitter|pipe fitting|connector|\bcd\s*[&+]|[&+]\s*cd\b|\bcd\s+bundle|\bbundle\b"
TANK = r"tank\s*tops?|\btanks?\b|sleeveless|camisole|\bcami\b|singlet|racerback"
# Stock words, currency marks and codes, words of drafts by language.
STOCK: Table = [
    ("out_of_stock", r"\bout of stock\b|\bnot in stock\b|\bsold out\b|\bagotad[oa]s?\b|\bsin stock\b|\bsin existencias?\b|\bfuera de stock\b"),
    ("preorder", r"\bpre-?orders?\b|\bpreventa\b"),
    ("backorder", r"\bback-?orders?\b"),
    ("in_stock", r"\bin stock\b|\bavailable now\b|\ben stock\b|\ben existencias?\b"),
]
MARKS = {"€": "EUR", "$": "USD", "£": "GBP"}
ISO_4217 = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUC CUP CVE CZK "
    "DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW "
    "KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG "
    "QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VED VES "
    "VND VUV WST XAF XCD XCG XOF XPF YER ZAR ZMW ZWG ZWL"
).split()
AMOUNT = r"\d+(?:[.,]\d{1,2})?"
PRICE_IN_TEXT = rf"((?:€|\$|£|\b[A-Z]{{3}})\s?{AMOUNT}\b(?!\s?%)|\b{AMOUNT}\s?(?:€|\$|£|[A-Z]{{3}}\b))"
DRAFT_WORDS = {
    "en": "the with for and of in our cotton shirt tee sleeve sleeves short long men women fit neck crew soft heavyweight slim relaxed boxy printed".split(),
    "es": "de con para y el la los las algodón algodon camiseta camisa playera remera manga mangas hombre mujer cuello corte suave estampada talla".split(),
}
# Bot checks by title and by script, and addresses that no public page has.
CHALLENGE_TITLE = (
    "just a moment|attention required|access denied|captcha|robot or human|are you a robot|pardon our interruption|security check|"
    "verify you are (?:a )?human|bot protection"
)
CHALLENGE_BODY = r"cf-chl|/cdn-cgi/challenge-platform/h/|px-captcha|captcha-delivery\.com|_Incapsula_Resource"
NOT_PUBLIC = (
    r"^(?:localhost|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|198\.1[89]\.|"
    r"22[4-9]\.|2[3-5][0-9]\.|\[)"
)
# Words of a recorded link status that say it is of no use.
DEAD_LINKS = ["dead", "broken", "gone", "not_found", "redirected", "redirect", "error"]


def is_shirt(title: Column, kind: Column, tags: Column, tees_only: bool = False) -> Column:
    """By title and product type: no other goods, then a shirt word; the tags count where neither says anything."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" | "), F.coalesce(kind, F.lit("")))
    if tees_only:
        return ~matches(text, NOT_SHIRT) & matches(text, TEE) & ~matches(title, NOT_TEE)
    return ~matches(text, NOT_SHIRT) & (matches(text, SHIRT) | matches(tags, SHIRT))


def non_apparel(title: Column) -> Column:
    """Whether a title names something else than a shirt; hard shirt words override all but hardware and bundles."""
    return (
        F.when(matches(title, ALWAYS_REJECT), True)
        .when(matches(title, STRONG_SHIRT), False)
        .when(matches(title, HARD_REJECT), True)
        .otherwise(matches(title, NON_APPAREL) & ~matches(title, APPAREL_CUE))
    )


def tank_word(name: Column, title: Column) -> Column:
    """(word, field): the word that makes a listing a tank top, from its name or else its title; null if none does."""
    def found(text: Column, field: str) -> Column:
        return F.when(matches(text, TANK), F.struct(F.regexp_extract(text, f"(?i)({TANK})", 1).alias("word"), F.lit(field).alias("field")))

    return F.coalesce(found(name, "raw_product_name"), found(title, "raw_title"))


def stock_state(text: Column) -> Column:
    """The state that explicit stock words name; null if none does."""
    return first_of(text, STOCK)


def price_in_text(text: Column) -> Column:
    """(price, currency) of the first number beside a currency mark or code; null if there is none."""

    def read(part: Column) -> Column:
        mark = F.regexp_extract(part, r"(€|\$|£|[A-Z]{3})", 1)
        code = F.coalesce(*(F.when(mark == m, F.lit(c)) for m, c in MARKS.items()), F.when(mark.isin(ISO_4217), mark))
        amount = F.replace(F.regexp_extract(part, f"({AMOUNT})", 1), F.lit(","), F.lit(".")).try_cast("double")
        return F.struct(F.round(amount, 2).alias("price"), code.alias("currency"))

    parts = F.transform(F.regexp_extract_all(text, F.lit(PRICE_IN_TEXT), F.lit(1)), read)
    return F.get(F.filter(parts, lambda p: p.currency.isNotNull()), F.lit(0))


def draft_price(value: Column) -> Column:
    """(price, error): a price above 0 and below a thousand million of a draft, else why it is none; both null for no value."""
    number = F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")
    ok = F.coalesce((number > 0) & (number < 1e9), F.lit(False))
    given = F.coalesce(value, F.lit("")) != ""
    return F.struct(F.when(given & ok, F.round(number, 2)).alias("price"), F.when(given & ~ok, F.lit("invalid_price")).alias("error"))


def draft_currency(value: Column) -> Column:
    """(currency, error): a three-letter code of a draft, else why it is none; both null for no value."""
    code = F.upper(F.trim(value))
    given = F.coalesce(value, F.lit("")) != ""
    return F.struct(F.when(given & code.isin(ISO_4217), code).alias("currency"), F.when(given & ~code.isin(ISO_4217), F.lit("invalid_currency")).alias("error"))


def draft_parts(title: Column, description: Column, text: Column) -> Column:
    """(title, description): without a title the text's first line is it, and the rest joins the description."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    named = F.trim(F.coalesce(title, F.lit("")))
    rest = F.when(named != "", F.trim(F.coalesce(text, F.lit("")))).otherwise(F.array_join(F.slice(lines, 2, 2**30), "\n"))
    own = F.trim(F.coalesce(description, F.lit("")))
    return F.struct(
        F.when(named != "", named).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).alias("title"),
        F.concat(own, F.when((own != "") & (rest != ""), "\n").otherwise(""), rest).alias("description"),
    )


def draft_language(text: Column) -> Column:
    """The language with more of its words in the text; null for a tie."""
    w = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-záéíóúñü]+")

    def votes(known: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(known)))

    es, en = votes(DRAFT_WORDS["es"]), votes(DRAFT_WORDS["en"])
    return F.when(es > en, "es").when(en > es, "en")


def url_problem(url: Column) -> Column:
    """Why an address may not be fetched: no web scheme or host, or a host that is not public by its name; else null."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+|\[[^\]]*\])", 1))
    return F.when(~F.coalesce(scheme.isin("http", "https") & (host != ""), F.lit(False)), "scheme_or_host").when(host.rlike(NOT_PUBLIC), "not_public")


def went_home(url: Column, final: Column) -> Column:
    """Whether an address with a path was redirected to the site's root or to a search page."""
    path = lambda u: F.regexp_replace(F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    search = lambda u: F.contains(F.lower(path(u)), F.lit("search"))
    return (path(url) != "") & ((path(final) == "") | (search(final) & ~search(url)))


def is_challenge(html: Column) -> Column:
    """A bot check: by its title, or a small page with a challenge script and no structured data."""
    title = F.regexp_extract(F.substring(html, 1, 20_000), r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = (F.length(html) < 60_000) & matches(html, CHALLENGE_BODY) & ~F.contains(html, F.lit("ld+json"))
    return F.coalesce(matches(title, CHALLENGE_TITLE) | body, F.lit(False))


def _robot_rules(robots: Column) -> Column:
    """(agents, allow, pattern) of each rule of a robots.txt, with the agents of its group."""
    lines = F.transform(F.split(robots, r"\R"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("agents"),
        F.lit(False).alias("ruled"),
        F.array().cast("array<struct<agents:array<string>,allow:boolean,pattern:string>>").alias("rules"),
    )

    def step(s: Column, p: Column) -> Column:
        agent, rule = p.k == "user-agent", p.k.isin("allow", "disallow")
        fresh = F.when(s.ruled | (F.size(s.agents) == 0), F.array(F.lower(p.v))).otherwise(F.array_append(s.agents, F.lower(p.v)))
        one = F.struct(s.agents.alias("agents"), (p.k == "allow").alias("allow"), p.v.alias("pattern"))
        return F.struct(
            F.when(agent, fresh).otherwise(s.agents).alias("agents"),
            F.when(agent, F.lit(False)).otherwise(s.ruled | (rule & (F.size(s.agents) > 0))).alias("ruled"),
            F.when(rule & (p.v != "") & (F.size(s.agents) > 0), F.array_append(s.rules, one)).otherwise(s.rules).alias("rules"),
        )

    return F.aggregate(pairs, start, step, lambda s: s.rules)


def robots_allow(robots: Column, path: Column, agent: str) -> Column:
    """Whether a robots.txt lets ``agent`` read ``path``: its own groups or else those for all, the longest rule that fits,
    allow before disallow; * and a final $ are wildcards."""

    def fits(rule: Column) -> Column:
        quoted = F.regexp_replace(rule.pattern, r"([\\.\[\]{}()+?^|])", r"\\$1")
        # A dollar sign in the middle of a rule is itself.
        body = F.regexp_replace(F.regexp_replace(quoted, r"\$(?=.)", r"\\\$"), r"\*", ".*")
        return F.rlike(path, F.concat(F.lit("^"), body))

    def best(rules: Column) -> Column:
        named = lambda r: F.exists(r.agents, lambda a: (a != "*") & F.contains(F.lit(agent), a))
        mine = F.filter(rules, named)
        anyone = F.filter(rules, lambda r: F.array_contains(r.agents, "*"))
        used = F.when(F.size(mine) > 0, mine).otherwise(anyone)
        scored = F.transform(F.filter(used, fits), lambda r: F.struct(F.length(r.pattern).alias("n"), r.allow.alias("allow")))
        return F.coalesce(F.array_max(scored)["allow"], F.lit(True))

    return let(_robot_rules(F.coalesce(robots, F.lit(""))), best)


def link_dead(status: Column) -> Column:
    """Whether a recorded link status is a code other than 2xx, or a word for dead or moved away; false for none."""
    code = F.when(status.rlike("^[0-9]+$"), status.try_cast("int"))
    word = F.lower(status).isin(DEAD_LINKS)
    return F.coalesce(F.when(code.isNotNull(), (code < 200) | (code >= 300)).otherwise(word), F.lit(False))


def allowed_mode(action: Column, policy: dict[str, str]) -> Column:
    """The mode of a named action; forbidden for any that the policy does not name."""
    return reduce(lambda c, x: c.when(action == x[0], F.lit(x[1])), policy.items(), F.when(F.lit(False), "")).otherwise("forbidden")
