"""Facts of a listing's text as column expressions: materials, weight, sizes, pack, audience, offer, checked claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let

# Materials and their patterns; the first that fits counts.
MATERIALS = [
    ("organic_cotton", "organic cotton|algod[oó]n org[aá]nico|bio-?baumwolle|coton bio"),
    ("recycled_polyester", r"recycled polyester|poli[eé]ster reciclado|\brpet\b"),
    ("merino_wool", "merino"),
    ("modal", r"\bmodal\b"),
    ("lyocell", r"\blyocell\b"),
    ("other", r"\btencel\b"),
    ("cotton", r"\bcotton\b|\balgod[oó]n\b|\bbaumwolle\b|\bcoton\b"),
    ("polyester", r"\bpolyester\b|\bpoli[eé]ster\b"),
    ("linen", r"\blinen\b|\blino\b|\bleinen\b|\bflax\b"),
    ("viscose", r"\bviscose\b|\bviscosa\b|\becovero\b"),
    ("rayon", r"\brayon\b"),
    ("elastane", r"\belastane\b|\belastano\b|\belasthan\b"),
    ("spandex", r"\bspandex\b"),
    ("wool", r"\bwool\b|\blana\b|\bwolle\b"),
    ("nylon", r"\bnylon\b|\bpolyamide\b|\bpoliamida\b"),
    ("hemp", r"\bhemp\b|\bc[aá][ñn]amo\b"),
    ("silk", r"\bsilk\b|\bseda\b"),
]
# A percentage before or after the name of a fibre.
PERCENT = r"(\d{1,3}(?:[.,]\d+)?)\s*%"
FIBRE = r"[^\d%,;:/+()\n]{2,40}"
PERCENT_FIRST = rf"(?i){PERCENT}\s*(?:de\s+|of\s+)?({FIBRE})"
NAME_FIRST = rf"(?i)({FIBRE})\s+{PERCENT}"
# Fabric weights, and grams a square metre of an ounce a square yard.
GRAMS = r"(?i)(\d{2,4})\s*(?:gsm|g/m²|g/m2|gr/m2|grs?/m²|g/sqm|gramos(?: por metro cuadrado)?)"
OUNCES = r"(?i)(\d+(?:[.,]\d+)?)\s*(?:oz\.?\s*/\s*(?:yd²|yd2|sq\.? ?yd)|ounces? per square yard)"
BARE_OUNCES = r"(\d+(?:[.,]\d+)?)\s*oz\b\.?"
FABRIC_CUE = "fabric|cotton|jersey|heavyweight|midweight|lightweight|twill|denim|flannel|oxford"
GSM_OF_OUNCE = 33.906
# Letter sizes in order, and how texts list them.
SIZE_ORDER = ["XXS", "XS", "S", "M", "L", "XL", "2XL", "3XL", "4XL", "5XL", "6XL"]
SIZE = "(?:XXXXXL|XXXXL|XXXL|XXL|XXS|XS|XL|[2-6]XL|S|M|L)"
SIZE_CUE = r"(?i:\bsizes?\b|\btallas?\b|\bavailable in\b|\bdisponible en\b)\s*:?\s*"
SIZE_RANGE = rf"{SIZE_CUE}(?:from\s+|de\s+)?\b({SIZE})\s*(?:-|–|to|a|hasta)\s*({SIZE})\b"
SIZE_LIST = rf"{SIZE_CUE}((?:\b{SIZE}\b\s*[-,/|]?\s*(?:and\s|y\s|&\s)?\s*){{2,}})"
NUMBER_SIZES = rf"{SIZE_CUE}((?:\b\d{{2}}\b\s*[,/|]\s*)+\b\d{{2}}\b)"
ONE_SIZE = r"(?i)\bone[ -]size(?: fits (?:all|most))?\b|\btalla [uú]nica\b"
SIZE_NAMES = {"XXL": "2XL", "XXXL": "3XL", "XXXXL": "4XL", "XXXXXL": "5XL"}
# Pack sizes, words of children's and adults' goods, offer states.
PACK = (
    r"(?i)\b(\d{1,2})\s?-?\s?(?:pack|pk|pcs|pieces|piezas|unidades|er[- ]?pack)\b|"
    r"\b(?:pack|set|paquete|lote) (?:of|de) (\d{1,2})\b"
)
KIDS = (
    r"(?i)\b(?:kids?|child(?:ren)?|toddlers?|bab(?:y|ies)|infants?|youth|boys?|girls?|niñ[oa]s?|bebés?|infantil)\b"
)
ADULTS = r"(?i)\badults?\b|\badult[oa]s?\b"
OFFER_STATES = [
    ("instock", "in_stock"), ("outofstock", "out_of_stock"), ("soldout", "out_of_stock"), ("preorder", "preorder"),
    ("backorder", "backorder"), ("discontinued", "discontinued"), ("true", "in_stock"), ("false", "out_of_stock"),
]
# Rewards of a generated text, its title's longest length.
FORMAT_OK, FORMAT_FAIL, GROUNDED, FLAGGED, COVERAGE, TITLE_MAX = 1.0, -10.0, 1.0, -2.0, 2.0, 90
#: Shares whose sums are tried one by one.
SUBSETS = 6
SHARE = "array<struct<material:string,share:double>>"


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def material_of(text: Column) -> Column:
    """The first material of the table whose pattern fits the text; null if none does."""
    found = F.lit(None).cast("string")
    for value, pattern in reversed(MATERIALS):
        found = F.when(text.rlike(f"(?i){pattern}"), F.lit(value)).otherwise(found)
    return found


def percentages(text: Column) -> Column:
    """The percentages in a text, in order; every share that ``composition`` reads from it is one of them."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1)), _number), lambda x: x.isNotNull())


def makes_whole(shares: Column) -> Column:
    """Whether some of the shares may sum to 100 within 1; of more than ``SUBSETS`` shares this is not looked into further."""
    sums = F.aggregate(F.slice(shares, 1, SUBSETS), F.array(F.lit(0.0)), lambda xs, x: F.concat(xs, F.transform(xs, lambda y: x + y)))
    enough = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) >= 98.9
    return enough & ((F.size(shares) > SUBSETS) | F.exists(sums, lambda x: F.abs(x - 100) <= 1.001))


def composition(text: Column) -> Column:
    """(material, share) of each known material named with a percentage, if the shares sum to 100 within 1, else null.

    Percentages before their material are tried first, then those behind it. A material named twice has its shares added;
    one of more than 100 makes no composition.
    """

    def shares(pattern, percent, name):
        def cut(group):
            return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

        both = F.zip_with(cut(name), cut(percent), lambda n, p: F.struct(material_of(n).alias("material"), _number(p).alias("share")))
        return F.filter(both, lambda x: x.material.isNotNull()).cast(SHARE)

    def total(xs):
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.share)

    def merged(xs):
        names = F.array_distinct(F.transform(xs, lambda x: x.material))
        return F.transform(names, lambda n: F.struct(n.alias("material"), total(F.filter(xs, lambda x: x.material == n)).alias("share")))

    def sound(xs):
        return F.when((F.abs(total(xs) - 100) <= 1) & ~F.exists(merged(xs), lambda x: x.share > 100), merged(xs))

    def pick(first):
        return F.when(F.abs(total(first) - 100) <= 1, sound(first)).otherwise(let(shares(NAME_FIRST, 2, 1), sound))

    return let(shares(PERCENT_FIRST, 1, 2), pick)


def primary_material(parts: Column) -> Column:
    """The material with the largest share; null if two share it or there is no composition."""
    top = F.array_max(F.transform(parts, lambda x: x.share))
    return let(
        F.filter(parts, lambda x: x.share == top),
        lambda best: F.when(F.size(best) == 1, F.get(best, F.lit(0)).material),
    )


def fabric_weight(text: Column) -> Column:
    """Grams a square metre: stated, from ounces a square yard, or from bare ounces close to a fabric word; else null."""
    grams = F.regexp_extract(text, GRAMS + "(?![a-z])", 1)
    ounces = F.regexp_extract(text, OUNCES, 1)
    whole = rf"(?is)^(.*?){BARE_OUNCES}(?!\s*/)(.*)$"
    before, bare, after = (F.regexp_extract(text, whole, i) for i in (1, 2, 3))
    cued = F.lower(F.substring(after, 1, 30)).rlike(FABRIC_CUE) & ~F.lower(F.right(before, F.lit(12))).contains("weigh")
    converted = F.when(ounces != "", _number(ounces)).when((bare != "") & cued, _number(bare))
    return F.when(grams != "", grams.try_cast("long")).otherwise(F.bround(converted * GSM_OF_OUNCE).cast("long"))


def _size_name(token: Column) -> Column:
    named = token
    for raw, name in SIZE_NAMES.items():
        named = F.when(token == raw, F.lit(name)).otherwise(named)
    return named


def sizes(text: Column) -> Column:
    """Sizes that the text offers: one size, a list of three or more, a range, a list of two, or numbers; else null."""
    order = F.array(*map(F.lit, SIZE_ORDER))

    def letters(pattern, group):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), _size_name)

    listed = F.transform(F.regexp_extract_all(F.regexp_extract(text, SIZE_LIST, 1), F.lit(rf"\b({SIZE})\b"), F.lit(1)), _size_name)
    spans = F.zip_with(
        letters(SIZE_RANGE, 1), letters(SIZE_RANGE, 2), lambda a, b: F.struct(F.array_position(order, a).alias("a"), F.array_position(order, b).alias("b"))
    )
    span = F.get(F.filter(spans, lambda s: (s.a > 0) & (s.a < s.b)), F.lit(0))
    numbers = F.regexp_extract_all(F.regexp_extract(text, NUMBER_SIZES, 1), F.lit(r"(\d{2})"), F.lit(1))
    return (
        F.when(text.rlike(ONE_SIZE), F.array(F.lit("one_size")))
        .when(F.size(listed) >= 3, F.array_distinct(listed))
        .when(span.isNotNull(), F.slice(order, span.a.cast("int"), (span.b - span.a + 1).cast("int")))
        .when(F.size(F.array_distinct(listed)) >= 2, F.array_distinct(listed))
        .when(F.size(numbers) >= 2, F.array_distinct(numbers))
    )


def pack_size(title: Column) -> Column:
    """Pieces that a title states; 1 if none or one."""
    stated = F.concat(F.regexp_extract(title, PACK, 1), F.regexp_extract(title, PACK, 2)).try_cast("long")
    return F.when(stated > 1, stated).otherwise(F.lit(1).cast("long"))


def is_adult(audience: Column, title: Column) -> Column:
    """Whether a listing is for adults: by its audience, or without one by the words of its title."""
    said = F.when(F.coalesce(audience, F.lit("")) != "", audience != "kids")
    text = F.coalesce(title, F.lit(""))
    return F.coalesce(said, text.rlike(ADULTS) | ~text.rlike(KIDS))


def availability(text: Column) -> Column:
    """The state that an offer's text names; unknown for other text, null for none."""
    low = F.lower(text)
    flat = F.regexp_replace(low, "[_ ]", "")
    state = F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
    for key, value in OFFER_STATES:
        state = state.when(low == key if key in ("true", "false") else flat.contains(key), F.lit(value))
    return state.otherwise("unknown")


def price(text: Column) -> Column:
    """A price of two decimals, comma or point; null if the text is no number."""
    return F.round(_number(F.trim(text)), 2)


def agreed(values: Column) -> Column:
    """(value, conflict) of what several sources say: the one value, or null and true if they differ."""
    return let(
        F.array_distinct(F.array_compact(values)),
        lambda v: F.struct(F.when(F.size(v) == 1, F.get(v, F.lit(0))).alias("value"), (F.size(v) > 1).alias("conflict")),
    )


def claim_status(claim: Column, truth: Column, least: float, share: float) -> Column:
    """supported if the claim is within the larger of ``least`` and ``share`` of the truth, else contradicted; unverifiable without truth."""
    close = F.abs(claim - truth) <= F.greatest(F.lit(least), share * truth)
    return F.when(truth.isNull() | claim.isNull(), "unverifiable").when(close, "supported").otherwise("contradicted")


def copy_reward(title: Column, description: Column, sentences: Column, flagged: Column, covered: Column, targets: Column) -> Column:
    """Reward of a generated title and description: form, share of grounded sentences, flagged ones, covered targets."""
    formed = (F.trim(title) != "") & (F.trim(description) != "") & (F.length(title) <= TITLE_MAX)
    n = F.greatest(sentences, F.lit(1))
    grounding = F.round(GROUNDED * (n - flagged) / n, 4)
    coverage = F.when(targets > 0, F.round(COVERAGE * covered / targets, 4)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(formed, F.lit(False)), F.round(FORMAT_OK + grounding + FLAGGED * flagged + coverage, 4)).otherwise(F.lit(FORMAT_FAIL))
