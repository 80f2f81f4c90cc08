"""Whether a sentence of generated copy is grounded in what is known of a product, as column expressions.

A sentence passes when every claim in it is supported, every number is the known value of the field that its context
names, and every word comes from the known facts or from a small neutral vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import attributes as a
from plumbline.functions import claims as c
from plumbline.functions.text import folded, let
from plumbline.functions.vocabulary import PRODUCT_TYPE, matches

SENTENCE_END = r"(?<=[.!?])\s+|\n+"
NUMBER = r"\d+(?:[.,]\d+)?"
WORD = r"[\p{L}]+(?:['’-][\p{L}]+)*"
# Words that say nothing of a product, words of sales and stock, marks of currencies.
NEUTRAL = (
    "a an the this that these it its is are be has have with and or in of for from to at on by as per also both each all "
    "which made available comes come offered offer options option choose choice features featuring "
    "size sizes color colors colour colours fabric material materials composition blend weight weighs fit cut sleeve sleeves "
    "neck neckline collar price priced care style garment piece item product tee tees t-shirt shirt shirts top "
    "un una unos unas el la los las lo este esta estos estas es son esta estan tiene tienen con y e o u en de del para por "
    "al a su sus que se hecho hecha hechos hechas fabricado fabricada disponible disponibles viene vienen ofrece opciones "
    "talla tallas color colores tejido material materiales composicion mezcla gramaje peso corte manga mangas cuello precio "
    "cuidado prenda producto camiseta camisetas camisa camisas"
).split()
SALE = r"\b(?:sale|reduced|discount\w*|rebajad\w*|oferta|descuento)\b"
CURRENCY = r"(?:eur|usd|gbp|mxn|cad|aud|euros?|pesos?|dolares|dollars?|€|\$|£)"
IN_STOCK = r"\bin stock\b|\ben stock\b|\bavailable now\b|^\W*disponible\W*$|\bready to ship\b"
OUT_OF_STOCK = r"\bout of stock\b|\bsold out\b|\bagotad[oa]\b"
CARE_CONTEXT = r"(?:wash|iron|dry|lav|planch|secad|temperat)\w*\W+(?:\w+\W+){0,4}$"
CONTEXT = 30


def sentences(text: Column) -> Column:
    """The sentences and lines of a text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    """Folded words of letters, apostrophes and hyphens inside."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1)), lambda w: folded(F.replace(w, F.lit("’"), F.lit("'"))))


def _stripped(sentence: Column, truth: Column) -> Column:
    """The sentence without the exact name, brand and care texts, longer names first."""

    def without(text: Column, known: Column) -> Column:
        quoted = F.concat(F.lit("(?iu)\\Q"), known, F.lit("\\E"))
        return F.when(F.coalesce(F.trim(known), F.lit("")) == "", text).otherwise(F.regexp_replace(text, quoted, F.lit(" ")))

    named = F.length(F.coalesce(truth["name"], F.lit(""))) >= F.length(F.coalesce(truth["brand"], F.lit("")))
    both = F.when(named, F.array(truth["name"], truth["brand"])).otherwise(F.array(truth["brand"], truth["name"]))
    care = F.transform(F.coalesce(truth["care"], F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"\.+$", ""))
    return F.aggregate(F.concat(both, care), sentence, without)


def _placed_numbers(text: Column) -> Column:
    """(raw, before, after) of every number with up to 30 characters on either side."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    pieces = F.split(text, NUMBER, -1)
    length = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda t, x: t + F.length(x))

    def one(raw: Column, i: Column) -> Column:
        start = length(pieces, i + 1) + length(found, i)
        low = F.greatest(start - CONTEXT, F.lit(0))
        return F.struct(
            raw.alias("raw"), folded(F.substring(text, low + 1, start - low)).alias("before"), F.substring(text, start + F.length(raw) + 1, F.lit(CONTEXT)).alias("after")
        )

    return F.transform(found, one)


def _near(known: Column, number: Column) -> Column:
    return F.coalesce(F.abs(known - number) <= 0.005 * F.greatest(F.lit(1.0), F.abs(number)), F.lit(False))


def _number_ok(x: Column, truth: Column) -> Column:
    """Whether a number is the known value of the field that its context names."""
    n = F.replace(x["raw"], F.lit(","), F.lit(".")).try_cast("double")
    after, before = x["after"], x["before"]
    letters = F.regexp_extract(after, r"(?i)^(x{0,2}l)\b", 1)
    size = F.upper(F.concat(x["raw"], letters))
    known_sizes = F.transform(F.coalesce(truth["sizes"], F.array().cast("array<string>")), lambda s: F.coalesce(c.size_name(s), F.upper(s)))
    share = F.split(F.coalesce(truth["composition"], F.lit("")), ",")
    material = a.material_of(F.get(F.split(F.regexp_extract(after, r"(?s)^\s*%(.*)$", 1), r"[\d,;.]"), F.lit(0)))

    def of_material(part: Column) -> Column:
        name, percent = F.get(F.split(part, ":"), F.lit(0)), F.get(F.split(part, ":"), F.lit(1)).try_cast("double")
        same = (name == material) | (c._looked_up(name, c.KIND_OF, name) == material) | (c._looked_up(name, c.SAME_MATERIAL, name) == material)
        return same & _near(percent, n)

    care = F.array_join(F.coalesce(truth["care"], F.array().cast("array<string>")), " ")
    care_numbers = F.transform(F.regexp_extract_all(care, F.lit(f"({NUMBER})"), F.lit(1)), lambda v: F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))
    money = F.when(matches(before, SALE), truth["sale_price"]).otherwise(truth["price"])
    ok = (
        F.when((letters != "") & ~before.rlike(r"[\d.,]$"), F.array_contains(known_sizes, F.coalesce(c.size_name(size), size)))
        .when(F.startswith(after, F.lit("/4")) | F.endswith(before, F.lit("3/")), truth["sleeve"] == "three_quarter")
        .when(after.rlike(r"^\s*%"), F.exists(share, of_material))
        .when(after.rlike(r"(?i)^\s*(?:gsm|g/m|grs?\b|gramos|g\b)") | before.rlike(r"(?:weight|weighs|gramaje|peso)\W*$"), _near(truth["gsm"], n))
        .when(folded(after).rlike(r"^\s*" + CURRENCY) | before.rlike(CURRENCY + r"\s*$"), truth["currency"].isNotNull() & _near(money, n))
        .when(after.rlike(r"(?i)^\s*(?:º|°|c\b|degrees|grados)") | before.rlike(CARE_CONTEXT), F.array_contains(care_numbers, n))
    )
    return F.coalesce(ok, F.lit(False))


def _type_pattern(product_type: Column) -> Column:
    """The words of a product type as a pattern for whole words; null without one."""
    known = F.coalesce(*(F.when(product_type == value, F.lit(pattern)) for value, pattern in PRODUCT_TYPE))
    return F.coalesce(known, F.when(F.endswith(product_type, F.lit("_shirt")), F.lit(dict(PRODUCT_TYPE)["_shirt"])))


def problems(sentence: Column, truth: Column) -> Column:
    """What keeps a sentence from being grounded, in order: claims, numbers, sale and stock, words; empty if nothing does.

    ``truth`` has what ``claims.status`` reads, and name, brand, product_type, sale_price, availability, care (texts) and
    facts (all sentences and evidence that state what is known).
    """

    def found(s: Column) -> Column:
        claimed = F.transform(c.claims(s), lambda k: F.struct(k.field.alias("field"), c.status(k, truth).alias("status")))
        wrong = F.transform(F.filter(claimed, lambda k: k.status != c.SUPPORTED), lambda k: F.concat(k.field, F.lit(" is "), k.status))
        numbers = F.transform(F.filter(_placed_numbers(s), lambda x: ~_number_ok(x, truth)), lambda x: F.concat(F.lit("number "), x.raw))
        stated = F.array_compact(
            F.array(
                F.when(matches(s, SALE) & truth["sale_price"].isNull(), F.lit("no known sale price")),
                F.when(matches(s, IN_STOCK) & ~F.coalesce(truth["availability"] == "in_stock", F.lit(False)), F.lit("in stock is not known")),
                F.when(matches(s, OUT_OF_STOCK) & ~F.coalesce(truth["availability"] == "out_of_stock", F.lit(False)), F.lit("out of stock is not known")),
            )
        )
        stem = _type_pattern(truth["product_type"])
        fact_words = words(truth["facts"])
        parts = F.flatten(F.transform(fact_words, lambda w: F.split(w, "-")))
        sized = F.when(F.exists(F.coalesce(truth["sizes"], F.array().cast("array<string>")), lambda z: z.rlike(r"(?i)\b(?:XXX?L|\dXL)\b")), F.array(F.lit("xl")))
        cared = F.when(F.size(truth["care"]) > 0, F.array(*map(F.lit, ("c", "max", "maximum", "maximo", "maxima"))))
        none = F.array().cast("array<string>")
        known = F.concat(F.array(*map(F.lit, NEUTRAL)), fact_words, parts, F.coalesce(sized, none), F.coalesce(cared, none))

        def grounded(w: Column) -> Column:
            owned = F.endswith(w, F.lit("'s")) & F.array_contains(known, F.regexp_replace(w, "'s$", ""))
            typed = F.coalesce(F.rlike(w, F.concat(F.lit("(?i)^(?:"), stem, F.lit(")$"))), F.lit(False))
            return F.array_contains(known, w) | owned | typed

        bad = F.array_distinct(F.filter(words(s), lambda w: ~grounded(w)))
        ungrounded = F.when(F.size(bad) > 0, F.array(F.concat(F.lit("words: "), F.array_join(bad, " ")))).otherwise(none)
        return F.array_distinct(F.concat(wrong, numbers, stated, ungrounded))

    return let(_stripped(F.coalesce(sentence, F.lit("")), truth), found)


def accuracy(supported: Column, claims: Column, ungrounded_sentences: Column) -> Column:
    """Supported claims of all claims and sentences with ungrounded words; 1 where nothing is claimed."""
    total = claims + ungrounded_sentences
    return F.when(total > 0, F.round(supported / total, 4)).otherwise(F.lit(1.0))
