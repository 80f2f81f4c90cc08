"""Values of records: numbers, ratings, conflicting prices, JSON, paths, description coverage, experiment states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, prose_segments, repetition, repetition_factor
from plumbline.functions.vocabulary import matches

#: Largest to least price of one offer before they conflict; gains of an experiment that overfits; share that generalises.
CONFLICT_RATIO = 2.0
OVERFIT_MIN_DEV, OVERFIT_MAX_HIDDEN, GENERALIZES = 5.0, 1.0, 0.5
# What shoppers ask of a description, with the facts that must be known for an answer to count.
INTENTS = {
    "material": (r"\b(?:cotton|polyester|linen|wool|merino|viscose|modal|lyocell|tencel|elastane|spandex|nylon|hemp|bamboo|algod[oó]n|poli[eé]ster|lino|lana)\b", ("primary_material",)),
    "organic_material": (r"\borganic\b|\borg[aá]nic[oa]\b", ("organic",)),
    "composition": (r"\b\d{1,3}\s?%", ("composition",)),
    "fabric": (r"\b(?:jersey|piqu[eé]|pique|oxford|poplin|popelina|twill|flannel|franela|rib|interlock|slub|knit|punto|gsm|oz|g/m)\b", ("fabric_type", "gsm")),
    "stretch": (r"\bstretch(?:y)?\b|\bel[aá]stic[oa]?\b", ("stretch",)),
    "fit": (r"\b(?:slim|regular|relaxed|oversized?|boxy|classic|athletic|loose|tailored|holgad[oa]|ajustad[oa])\b|\bfit\b|\bcorte\b", ("fit",)),
    "neck_or_collar": (r"\b(?:crew|v-neck|neck|neckline|collar|henley|cuello|mock)\b", ("neckline", "collar")),
    "sleeve": (r"\bsleeves?\b|\bmangas?\b|\bsleeveless\b", ("sleeve",)),
    "care": (r"\b(?:wash|washing|washable|tumble|dry|iron|bleach|lavar|lavado|secadora|planchar)\b", ("care",)),
}


def num(text: Column) -> Column:
    """A finite number from text with thousands commas; null for anything else."""
    x = F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) & ~F.lower(F.trim(text)).isin("true", "false"), x)


def rating_of_five(value: Column, best: Column) -> Column:
    """A rating on 0 to 5; null unless its scale is declared and it lies within."""
    return F.when((best > 0) & (value >= 0) & (value <= best), F.round(value / best * 5, 2))


def rating_out_of_range(value: Column, best: Column, worst: Column) -> Column:
    """Whether a rating lies outside its declared scale, or outside 0 to 5 where none is declared."""
    return F.coalesce((value < F.coalesce(worst, F.lit(0.0))) | (value > F.coalesce(best, F.lit(5.0))), F.lit(False))


def prices_conflict(offers: Column, currency: Column, price: Column) -> Column:
    """Whether an offer list (price, currency) names several currencies, prices too far apart, or none around the price."""
    codes = F.array_distinct(F.array_compact(F.transform(offers, lambda o: o.currency)))
    same = F.transform(F.filter(offers, lambda o: F.coalesce((o.currency == currency) & (o.price > 0), F.lit(False))), lambda o: o.price)
    low, high = F.array_min(same), F.array_max(same)
    return F.coalesce(F.size(codes) > 1, F.lit(False)) | F.coalesce(high / low > CONFLICT_RATIO, F.lit(False)) | F.coalesce((price < low) | (price > high), F.lit(False))


def present(json: Column, path: str) -> Column:
    """Whether a JSON record holds more than null, an empty text, list or object at a path such as a.b[1].c."""
    value = F.get_json_object(json, f"$.{path}")
    return F.coalesce(~value.isin("", "[]", "{}"), F.lit(False))


def at_path(json: Column, path: str) -> Column:
    """The value at a path of a JSON record as text; null where the path leads nowhere."""
    return F.get_json_object(json, f"$.{path}")


def model_output(text: Column) -> Column:
    """The JSON object of a model's output without a code fence; null if it is none."""
    bare = F.regexp_replace(text, r"^\s*(?:```(?:json)?)?\s*|\s*(?:```)?\s*$", "")
    whole = F.get_json_object(bare, "$")
    return F.when(F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}")), whole)


def lenient_json(text: Column) -> Column:
    """A script's JSON as it is, or else without comments, CDATA marks, control characters and trailing commas; null if none."""
    marks = F.regexp_replace(text, r"(?m)<!--|-->|<!\[CDATA\[|\]\]>|^\s*//.*$", "")
    plain = F.regexp_replace(F.regexp_replace(marks, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), r",\s*([}\]])", "$1")
    cleaned = F.regexp_extract(plain, r"(?s)^\s*([{\[].*[}\]])\s*$", 1)
    return F.coalesce(F.get_json_object(text, "$"), F.get_json_object(F.nullif(cleaned, F.lit("")), "$"))


def geometric_mean(tokens: Column, low: Column, high: Column) -> Column:
    """The geometric mean of the probabilities of tokens (start, end, p) that overlap a span, four decimals; null for none."""
    logs = F.transform(F.filter(tokens, lambda t: (t.start < high) & (t.end > low) & (t.p > 0)), lambda t: F.ln(t.p))
    return let(logs, lambda x: F.when(F.size(x) > 0, F.round(F.exp(F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x)), 4)))


def description_coverage(text: Column, known: Column) -> Column:
    """(intents, value): what a description answers in prose of what is known (an array of names of facts), and its share of
    all intents, less for repeated phrases."""
    body = F.array_join(prose_segments(text), "\n")
    hits = F.array_sort(
        F.array_compact(F.array(*(F.when(matches(body, p) & F.arrays_overlap(known, F.array(*map(F.lit, facts))), F.lit(k)) for k, (p, facts) in INTENTS.items())))
    )
    return F.struct(hits.alias("intents"), F.round(F.size(hits) / len(INTENTS) * repetition_factor(repetition(text)), 4).alias("value"))


def overfits(dev: Column, hidden: Column) -> Column:
    """Whether a gain on known prompts did not carry over to hidden ones; null where either was not measured."""
    return F.when(dev.isNotNull() & hidden.isNotNull(), (dev >= OVERFIT_MIN_DEV) & (hidden <= OVERFIT_MAX_HIDDEN))


def generalizes(optimised: Column, held_out: Column) -> Column:
    """Whether models that were held out gained at least half as much; null without a gain or a measure."""
    return F.when(optimised > 0, held_out >= GENERALIZES * optimised)


def guardrail(before: Column, afters: Column) -> Column:
    """fail for good once any later accuracy lies below the first, pass if none does, unknown where either is missing."""
    return F.when(before.isNull() | (F.coalesce(F.size(afters), F.lit(0)) <= 0), "unknown").when(F.exists(afters, lambda a: a < before), "fail").otherwise("pass")


def experiment_status(rail: Column, measured: Column, controls: Column, overfit: Column, general: Column) -> Column:
    """rejected, pending, unverified, flagged or reported."""
    flagged = (controls == 0) | F.coalesce(overfit, F.lit(False)) | F.coalesce(~general, F.lit(False))
    return F.when(rail == "fail", "rejected").when(~measured, "pending").when(rail == "unknown", "unverified").when(flagged, "flagged").otherwise("reported")


def readability_es(text: Column) -> Column:
    """Ease of a Spanish text by vowel groups, one decimal; null without words."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")
    n = F.size(w)
    syllables = F.aggregate(w, F.lit(0), lambda a, x: a + F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouáéíóúü]+"))))
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")))
    return F.when(n > 0, F.round(206.84 - 60.0 * syllables / n - 1.02 * n / sentences, 1))
