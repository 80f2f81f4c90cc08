"""Vocabularies of listing texts, and the rules that read a text by them, as column expressions."""

from __future__ import annotations

import re._parser as parser
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let

Table = list[tuple[str, str]]

# Words of each attribute; a table's order breaks ties.
FIT = [
    ("oversized", r"\boversi[sz]ed?\b"),
    ("slim", r"\bslim(?:[ -]fit)?\b|\bentallad[oa]\b"),
    ("relaxed", r"\brelaxed(?:[ -]fit)?\b|\bholgad[oa]\b|\bboxy\b|\bloose[ -]fit\b"),
    ("athletic", r"\bathletic[ -]fit\b|\bmuscle[ -]fit\b"),
    ("tailored", r"\btailored[ -]fit\b"),
    ("regular", r"\bregular[ -]fit\b|\bfit:? regular\b|\bcorte regular\b|\bpatr[oó]n regular\b|\bclassic[ -]fit\b"),
]
SLEEVE = [
    ("short", r"\bshort[ -]sleeves?d?\b|\bmangas? cortas?\b|\bkurzarm\b"),
    ("long", r"\blong[ -]sleeves?d?\b|\blongsleeve\b|\bmangas? largas?\b|\blangarm\b"),
    ("sleeveless", r"\bsleeveless\b|\bsin mangas\b|\btank top\b|\bde tirantes\b"),
    ("three_quarter", r"3/4[ -]sleeves?|\bthree[ -]quarter\b|\bmanga 3/4"),
]
NECKLINE = [
    ("crew", r"\bcrew[ -]?neck(?:line)?\b|\bround[ -]neck(?:line)?\b|\bcuello redondo\b|\bcuello caja\b"),
    ("v_neck", r"\bv[ -]neck(?:line)?\b|\bcuello (?:de pico|en v|pico)\b"),
    ("scoop", r"\bscoop[ -]neck(?:line)?\b"),
    ("henley", r"\bhenley\b"),
]
PATTERN = [
    ("striped", r"\bstripe[sd]?\b|\brayas\b|\brayad[oa]\b"),
    ("plaid", r"\bplaid\b|\bchecked\b|\bcuadros\b|\btartan\b|\bgingham\b|\bvichy\b"),
    ("graphic", r"\bgraphic\b"),
    ("printed", r"\bprint(?:ed)?\b|\bestampad[oa]\b"),
    ("solid", r"\bsolid colou?r\b|\bliso\b|\blisa\b"),
]
PRODUCT_TYPE = [
    ("overshirt", r"\bover ?shirts?\b|\bsobrecamisas?\b|\bshackets?\b"),
    ("polo", r"\bpolos?\b"),
    ("henley", r"\bhenleys?\b"),
    ("flannel", r"\bflannel\b|\bfranela\b"),
    ("oxford", r"\boxford\b"),
    ("work_shirt", r"\bwork ?shirts?\b"),
    ("t_shirt", r"\bt-?shirts?\b|\btees?\b|\bcamisetas?\b|\bplayeras?\b|\bremeras?\b"),
    ("_dress_shirt", r"\b(?:dress|formal|business) shirts?\b|\bnon-?iron\b.*\bshirts?\b|\bcamisas? de vestir\b"),
    ("_shirt", r"\bshirts?\b|\bcamisas?\b|\bguayaberas?\b"),
]
AUDIENCE = [
    ("women", r"\b(?:women'?s?|woman|mujer|damen|femme)\b"),
    ("men", r"\b(?:men'?s?|man|hombre|herren|homme)\b"),
    ("unisex", r"\bunisex\b"),
    ("kids", r"\b(?:kids?|niñ[oa]s?|boys?|girls?|baby|toddler)\b"),
]
COLORS = [
    ("white", r"\b(?:white|blanc[oa]|snow)\b"),
    ("black", r"\b(?:black|negr[oa])\b"),
    ("navy", r"\b(?:navy|marino)\b"),
    ("blue", r"\b(?:blue|azul|[ií]ndigo|indigo)\b"),
    ("red", r"\b(?:red|roj[oa])\b"),
    ("green", r"\b(?:green|verde|olive|oliva)\b"),
    ("yellow", r"\b(?:yellow|amarill[oa]|mustard|mostaza)\b"),
    ("orange", r"\b(?:orange|naranja)\b"),
    ("pink", r"\b(?:pink|rosa)\b"),
    ("purple", r"\b(?:purple|morad[oa]|lila|lilac|plum|ciruela)\b"),
    ("brown", r"\b(?:brown|marr[oó]n|chocolate|camel)\b"),
    ("beige", r"\b(?:beige|sand|arena|ecru|crudo|cream|crema)\b"),
    ("grey", r"\b(?:gr[ae]y|gris|charcoal)\b"),
    ("khaki", r"\b(?:khaki|caqui)\b"),
]
KNIT = "(?:knit|fabric|cotton|material|cloth|weave)"
TRIM = r"(?![ -](?:collar|cuffs?|neck\w*|trim\w*|hem|waist\w*|band|sleeves?|crew))"
FABRIC_TYPE = [
    ("french_terry", r"\bfrench[ -]terry\b|\bfelpa francesa\b"),
    ("pique", r"\bpiqu[eé](?!\w)"),
    ("interlock", rf"\binterlock[ -]{KNIT}\b|\b{KNIT} interlock\b"),
    ("slub", r"\bslub[ -](?:jersey|knit|fabric|cotton|yarn)\b"),
    ("oxford", r"\boxford (?:cloth|fabric|weave)\b|\btela oxford\b"),
    ("flannel", r"\bflannel (?:fabric|cotton|cloth)\b|\bcotton flannel\b|\btela (?:de )?franela\b"),
    ("twill", r"\btwill (?:fabric|weave|cloth)\b|\bcotton twill\b(?![ -]?tap)|\btela (?:de )?sarga\b"),
    ("poplin", r"\bpoplin\b|\bpopelina\b|\bpopel[ií]n\b"),
    ("mesh", r"\bmesh (?:fabric|knit|material|panels?)\b|\bbreathable mesh\b|\btejido de malla\b"),
    ("rib", rf"\brib(?:bed)?[ -]knit\b{TRIM}|\b1x1 rib\b|\bpunto (?:de )?canal[eé](?!\w)"),
    ("jersey", r"\bjersey[ -](?:knit|fabric|cotton|material)\b|\b(?:cotton|single|slub|cotton-blend|combed cotton) jersey\b|\bpunto (?:de )?jersey\b|\bjersey de algod[oó]n\b|\bpunto liso\b"),
]
TEXTURE = [
    ("brushed", r"\bbrushed[ -](?:cotton|fabric|jersey|fleece|knit|finish)\b|\b(?:algod[oó]n|tejido) (?:perchad|cepillad)[oa]\b"),
    ("waffle", r"\bwaffle[ -](?:knit|weave|texture|fabric)\b|\bpunto gofrado\b"),
    ("ribbed", rf"\bribbed (?:fabric|knit|texture|cotton|tee|t-shirt|tank|top)\b{TRIM}|\btejido acanalado\b"),
    ("textured", r"\btextured (?:fabric|knit|cotton|jersey|weave)\b|\btejido texturizado\b"),
    ("soft", r"\b(?:super[ -]|ultra[ -]|extra[ -])?soft(?:[ -]touch)? (?:cotton|fabric|jersey|knit|material|feel|hand|blend|tri-?blend)\b|\bsoft[ -](?:washed|touch|hand)\b|\b(?:algod[oó]n|tejido) (?:muy |super |ultra )?suave\b|\btacto suave\b"),
]
SHIRT_LENGTH = [
    ("cropped", r"\bcropped (?:tee|t-shirt|shirt|top|fit|length|hem)\b|\bcrop[ -]?top\b|\bcorte crop\b"),
    ("longline", r"\blong[ -]?line (?:tee|t-shirt|shirt|top|fit|length|hem)\b"),
    ("tunic", r"\btunic (?:tee|t-shirt|shirt|top|length)\b|\b(?:camiseta|camisa|blusa)(?: tipo)? t[uú]nica\b"),
    ("regular", r"\bregular[ -]length\b|\blargo regular\b|\blongitud regular\b"),
]
NOUN = "(?:tee|t-shirt|t shirt|shirt|polo|top|style)"
STYLE = [
    ("vintage", rf"\b(?:vintage|retro)[ -]{NOUN}s?\b|\b(?:camiseta|camisa|polo|estilo) (?:vintage|retro)\b"),
    ("streetwear", rf"\bstreetwear(?:[ -]{NOUN}s?)?\b|\bstreet[ -]style\b"),
    ("athletic", r"\bathletic[ -](?:tee|t-shirt|shirt|top|style)s?\b|\b(?:camiseta|camisa|polo) deportiv[oa]\b"),
    ("graphic", r"\bgraphic[ -](?:tee|t-shirt|t shirt|shirt|top)s?\b|\b(?:camiseta|camisa) gr[aá]fica\b"),
    ("minimalist", r"\bminimalist(?:ic)?[ -](?:tee|t-shirt|t shirt|shirt|polo|top|style|design)s?\b|\b(?:camiseta|camisa|estilo|dise[ñn]o) minimalista\b"),
    ("basic", r"\bbasic[ -](?:tee|t-shirt|t shirt|shirt|polo|top)s?\b|\b(?:camiseta|camisa|polo) b[aá]sic[oa]\b"),
    ("casual", r"\bcasual[ -](?:tee|t-shirt|t shirt|shirt|polo|top|fit)s?\b|\b(?:camiseta|camisa|polo) casual\b"),
]
CARE = [
    ("machine_wash", r"\bmachine[ -]wash(?:able)?\b|\blavar? a m[aá]quina\b|\blavado a m[aá]quina\b|\blavable a m[aá]quina\b|\blavable en lavadora\b"),
    ("hand_wash", r"\bhand[ -]wash\b|\blavar a mano\b|\blavado a mano\b"),
    ("wash_cold", r"\bwash(?:ing)?(?: \w+)? (?:in )?cold\b|\bcold (?:water )?wash\b|\bin cold water\b|\bagua fr[ií]a\b"),
    ("do_not_tumble_dry", r"\b(?:do not|don'?t|no) tumble[ -]dry\b|\bno (?:usar |utilizar )?(?:la )?secadora\b"),
    ("tumble_dry", r"(?<!not )(?<!n't )(?<!no )\btumble[ -]dry(?: low)?\b|\bsecar en secadora\b"),
    ("do_not_bleach", r"\b(?:do not|don'?t|no) bleach\b|\bno (?:usar |utilizar )?(?:lej[ií]a|blanqueador)\b|\bno blanquear\b"),
    ("do_not_iron", r"\b(?:do not|don'?t) iron\b|\bno planchar\b"),
    ("iron_low", r"\biron(?:ing)? (?:on )?(?:low|cool|warm)\b|\b(?:cool|warm|low) iron\b|\bplanchar a (?:baja )?temperatura(?: baja| media)?\b"),
    ("dry_clean", r"(?<!not )(?<!n't )\bdry[ -]clean(?:able)?\b|\blimpieza en seco\b"),
]
COLLAR_TYPE = [
    ("button_down", r"\bbutton[ -]down(?: collar)?\b|\bcuello (?:con )?botones\b"),
    ("spread", r"\bspread collar\b|\bcuello italiano\b"),
    ("mandarin", r"\bmandarin collar\b|\bband collar\b|\bcuello mao\b"),
    ("mock_neck", r"\bmock[ -]?neck\b|\bcuello perkins\b|\bmedio cuello\b"),
    ("polo", r"\bpolo collar\b|\bcuello (?:tipo )?polo\b"),
    ("henley", r"\bhenley\b|\bcuello panadero\b"),
    ("v_neck", r"\bv[ -]neck(?:line)?\b|\bcuello (?:de pico|en v|pico)\b"),
    ("crew", r"\bcrew[ -]?neck(?:line)?\b|\bround[ -]neck(?:line)?\b|\bcuello redondo\b|\bcuello caja\b"),
]
# Shirt words of further languages, and other goods.
EXTRA_SHIRT = [
    ("polo", r"\bpolo-?(?:shirts?|hemd(?:en)?)\b"),
    ("henley", r"\bhenley-?shirts?\b"),
    ("t_shirt", r"\btee-?shirts?\b|\bt-?shirts?\b|\bmagliett[ae]\b|\bt-?shirt-?\w+|\bcamisetas?\b|\btees?\b"),
    ("_shirt", r"\bchemises?\b|\b(?:ober)?hemd(?:en)?\b|\bcamici[ae]\b|\bcamisas?\b"),
]
NON_SHIRT = [
    ("hoodie", r"\bhood(?:ie|y)s?\b|\bhooded\b|\bsudaderas? con capucha\b|\bkapuzen\w*|\bfelpe? con cappuccio\b"),
    ("sweatshirt", r"\bsweat-?shirts?\b|\bcrewnecks? sweat|\bsudaderas?\b|\bsweats?\b|\bfelpas?\b|\bmoletons?\b"),
    ("sweater", r"\bsweaters?\b|\bjumpers?\b|\bjers[eé]is?\b|\bsu[eé]teres?\b|\bpull-?overs?\b|\bpulls?\b|\bpullis?\b|\bmagliones?\b|\bcardigans?\b|\bstrickjacke\b"),
    ("jacket", r"\bjackets?\b|\bchaquetas?\b|\bcazadoras?\b|\bvestes?\b|\bjacken?\b|\bgiacc(?:a|he)\b|\bjaquetas?\b|\bblazers?\b|\bbombers?\b"),
    ("coat", r"\bcoats?\b|\babrigos?\b|\bmanteaux?\b|\bm[aä]ntel\b|\bcappott[oi]\b|\bcasacos?\b|\bparkas?\b"),
    ("jeans", r"\bjeans\b|\bvaqueros?\b"),
    ("pants", r"\bpants\b|\btrousers\b|\bpantal[oó]n(?:es)?\b|\bpantalons?\b|\bhosen?\b|\bpantaloni\b|\bcal[çc]as?\b|\bchinos?\b|\bjoggers?\b|\bleggings?\b"),
    ("shorts", r"\bshorts\b|\bbermudas?\b"),
    ("dress", r"\bdress(?:es)?\b|\bvestidos?\b|\brobes?\b|\bkleid(?:er)?\b|\babiti?\b"),
    ("skirt", r"\bskirts?\b|\bfaldas?\b|\bjupes?\b|\bgonnas?\b|\bsaias?\b"),
    ("socks", r"\bsocks?\b|\bcalcetines\b|\bchaussettes\b|\bsocken\b|\bcalzini\b|\bmeias\b"),
    ("underwear", r"\bunderwear\b|\bboxers?\b|\bbriefs\b|\bcalzoncillos?\b|\bbragas?\b|\bbras?\b|\bsujetador(?:es)?\b"),
    ("swimwear", r"\bswim\w*|\bba[ñn]adores?\b|\bbikinis?\b|\bmaillots? de bain\b"),
    ("shoes", r"\bshoes?\b|\bsneakers?\b|\btrainers?\b|\bzapat(?:os|illas)\b|\bchaussures\b|\bschuhe\b|\bscarpe\b|\bsapatos?\b|\bboots?\b|\bbotas?\b|\brunners?\b|\bsandal(?:s|ias)?\b"),
    ("hat", r"\bhats?\b|\bcaps?\b|\bbeanies?\b|\bgorras?\b|\bgorros?\b|\bsombreros?\b|\bm[üu]tzen?\b|\bcappell[oi]\b"),
    ("bag", r"\bbags?\b|\bbolsos?\b|\bmochilas?\b|\bbackpacks?\b|\btote\b|\btasche\b|\bborsa\b"),
    ("accessory", r"\bscar(?:f|ves)\b|\bbufandas?\b|\bbelts?\b|\bcinturones?\b|\bgloves?\b|\bguantes\b|\bwallets?\b|\bcarteras?\b|\bsunglasses\b|\bwatch(?:es)?\b|\bjewel\w*"),
    ("bottle", r"\bbottles?\b|\bbotellas?\b|\bmugs?\b|\btazas?\b"),
]
#: Care facts that another one rules out.
RULED_OUT = {"tumble_dry": "do_not_tumble_dry", "iron_low": "do_not_iron"}
IGNORE_CASE = "(?iu)"
ODD = "\u017f\u0131\u0130\u212a"


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the text, whatever the case; false for null."""
    return F.coalesce(text.rlike(IGNORE_CASE + pattern), F.lit(False))


def _stems(parts) -> set[str]:
    """Lower-case ASCII strings one of which is in whatever the parsed parts of a pattern fit; empty where none can be told."""
    found, run = [], ""
    for op, arg in [*parts, (None, None)]:
        if op is parser.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if len(run) > 1:
            found.append({run})
        run = ""
        if op is parser.SUBPATTERN:
            found.append(_stems(arg[-1]))
        elif op is parser.BRANCH:
            each = [_stems(branch) for branch in arg[1]]
            found.append(set().union(*each) if all(each) else set())
    return max(found, key=lambda words: min(map(len, words), default=0), default=set())


@lru_cache(maxsize=None)
def stems(pattern: str) -> tuple[str, ...]:
    """``_stems`` of a pattern; a text without any of them does not fit, and that is cheap to see."""
    return tuple(sorted(_stems(parser.parse(pattern))))


def _by_stems(text: Column, body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``body(fits)``, where ``fits(pattern)`` is ``matches(text, pattern)``, asked only of texts that have a stem of the pattern."""
    # Beside ASCII letters themselves these four are all that equal one whatever the case.
    odd = reduce(Column.__or__, (F.contains(text, F.lit(letter)) for letter in ODD))
    plain = F.when(odd, F.translate(text, ODD, "siik")).otherwise(text)

    def judged(low: Column) -> Column:
        def fits(pattern: str) -> Column:
            known = [F.contains(low, F.lit(stem)) for stem in stems(pattern)]
            return reduce(Column.__or__, known) & matches(text, pattern) if known else matches(text, pattern)

        return body(fits)

    return let(F.lower(plain), judged)


def all_hits(text: Column, table: Table) -> Column:
    """The table's values whose pattern occurs in the text, in table order; an empty array for none."""
    return _by_stems(text, lambda fits: F.array_compact(F.array(*(F.when(fits(p), F.lit(v)) for v, p in table))))


def first_of(text: Column, table: Table) -> Column:
    """The first value in table order whose pattern occurs in the text; null if none does."""
    return _by_stems(text, lambda fits: F.coalesce(*(F.when(fits(p), F.lit(v)) for v, p in table)))


def only_hit(text: Column, table: Table) -> Column:
    """The one value whose pattern occurs in the text; null if none or several do."""
    return let(all_hits(text, table), lambda hits: F.when(F.size(hits) == 1, hits[0]))


def earliest(text: Column, table: Table) -> Column:
    """The value whose pattern occurs earliest in the text, the first in table order of those that begin there; else null."""

    def places(fits) -> Column:
        return F.array(*(
            F.when(fits(p), F.struct(F.regexp_instr(text, F.lit(IGNORE_CASE + p)).alias("at"), F.lit(i).alias("i"), F.lit(v).alias("value")))
            for i, (v, p) in enumerate(table)
        ))

    return F.array_min(F.array_compact(_by_stems(text, places)))["value"]


def first_hit(sources: list[Column], table: Table) -> Column:
    """The earliest value in the first source that has any."""
    return F.coalesce(*(earliest(text, table) for text in sources))


def color(text: Column) -> Column:
    """The one colour that a name states, where navy is not blue besides; null for none or several."""
    navy = lambda hits: F.when(F.array_contains(hits, "navy"), F.array_remove(hits, "blue")).otherwise(hits)
    return let(let(all_hits(text, COLORS), navy), lambda hits: F.when(F.size(hits) == 1, hits[0]))


def care(text: Column) -> Column:
    """All care facts of a text without those that another one rules out."""
    without = lambda x: lambda h: F.when(F.array_contains(h, x[1]), F.array_remove(h, x[0])).otherwise(h)
    return reduce(lambda h, x: let(h, without(x)), RULED_OUT.items(), all_hits(text, CARE))


def shirt_type(value: Column, sleeve: Column) -> Column:
    """A product type: a style as it is, generic shirts by their sleeve, dress shirts long unless stated short; else null."""
    named = F.when(sleeve == "short", "short_sleeve_shirt").when(sleeve == "long", "long_sleeve_shirt")
    dress = F.when(sleeve == "short", "short_sleeve_shirt").otherwise("long_sleeve_shirt")
    return F.when(value == "_dress_shirt", dress).when(value == "_shirt", named).otherwise(value)


def settled_type(sources: list[Column], sleeve: Column) -> Column:
    """The shirt type of the first source that settles one."""
    return let(sleeve, lambda length: F.coalesce(*(let(first_of(text, PRODUCT_TYPE), lambda value: shirt_type(value, length)) for text in sources)))


def goods_type(sources: list[Column], sleeve: Column) -> Column:
    """(kind, type) by the first source that names a shirt, or else other goods; a shirt word wins within its source, and
    where no source names anything the kind is other without a type."""

    def named(text: Column, length: Column) -> Column:
        goods = let(first_of(text, NON_SHIRT), lambda other: F.when(other.isNotNull(), F.struct(F.lit("other").alias("kind"), other.alias("type"))))
        kind = lambda shirt: F.struct(F.lit("shirt").alias("kind"), F.coalesce(shirt_type(shirt, length), F.lit("unknown")).alias("type"))
        return let(first_of(text, PRODUCT_TYPE + EXTRA_SHIRT), lambda shirt: F.when(shirt.isNotNull(), kind(shirt)).otherwise(goods))

    nothing = F.struct(F.lit("other").alias("kind"), F.lit(None).cast("string").alias("type"))
    return let(sleeve, lambda length: F.coalesce(*(named(text, length) for text in sources), nothing))
