"""Audits of generated titles, tags and descriptions as column expressions; whether a text is grounded is decided by a function given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import keywords as k
from plumbline.functions.guard import sentences
from plumbline.functions.text import let, norm

#: Characters of a good title, and the length to be nearest to where scores are equal.
TITLE_RANGE, TITLE_AIM = (15, 90), 60
MAX_TAGS = 8
# Properties that complete markup has.
MARKUP_KEYS = ("name", "brand", "material", "color", "size", "audience", "gtin", "additionalProperty", "offers")
# Words of facts that tell nothing by themselves.
GENERIC = "fit corte sleeves sleeve manga mangas neck cuello for para fabric tejido".split()  # noqa: SIM905

Grounded = Callable[[Column], Column]


def fact_words(text: Column) -> Column:
    """Distinct folded words that are no numbers and not generic; empty for null."""
    return F.array_distinct(F.filter(F.split(F.trim(norm(text)), " "), lambda w: (w != "") & ~w.rlike("^[0-9]") & ~w.isin(GENERIC)))


def title_audit(title: Column, grounded: Grounded, brand: Column, kind: Column, material: Column, fit: Column) -> Column:
    """struct(chars, length_ok, brand, kind, material, fit, passes, score) of a title.

    brand must stand whole in the title, ``kind`` is a pattern that it must match, of material and fit any word will do; each is null where it
    is not known. score is the share of what is fulfilled among the known checks and the length. An empty or null title passes nothing.
    """
    text = F.coalesce(title, F.lit(""))
    chars = F.length(F.trim(text))
    any_of = lambda facts: F.when(F.size(fact_words(facts)) > 0, F.arrays_overlap(fact_words(facts), fact_words(text)))
    checks = {
        "brand": F.when(F.trim(norm(brand)) != "", F.contains(norm(text), F.trim(norm(brand)))), "kind": F.when(kind.isNotNull(), F.rlike(F.lower(text), F.lower(kind))),
        "material": any_of(material), "fit": any_of(fit),
    }

    def result(c: Column) -> Column:
        known = F.array_compact(F.array(*(c[name] for name in checks)))
        length_ok = chars.between(*TITLE_RANGE)
        hits = F.size(F.filter(known, lambda x: x)) + length_ok.cast("int")
        return F.struct(
            chars.alias("chars"), length_ok.alias("length_ok"), *(c[name].alias(name) for name in checks), ((text != "") & grounded(text)).alias("passes"),
            F.round(hits / (F.size(known) + 1), 4).alias("score"),
        )

    return let(F.struct(*(c.alias(name) for name, c in checks.items())), result)


def tags_audit(tags: Column, grounded: Grounded, facts: Column, foreign: Column, intents: Column) -> Column:
    """struct(n, duplicates, passing, false, fact_relevance, intent_relevance, language_match, passes, score) of an array of tags.

    Blank and null tags do not count; of tags with equal folded words the first stays. ``facts`` and ``foreign`` are arrays of words of this listing and
    of other languages, ``intents`` an array of stems that shoppers ask for. The shares are null where no tag is left, and the score is then 0.
    """
    given = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")

    def result(kept: Column) -> Column:
        keys = F.transform(kept, norm)
        first = F.filter(kept, lambda t, i: F.array_position(keys, norm(t)) == i + 1)
        judged = F.transform(first, lambda t: F.struct(
            t.alias("tag"), grounded(t).alias("ok"), F.arrays_overlap(plain_words(t), facts).alias("fact"), F.arrays_overlap(k.stems(t), intents).alias("intent"),
            (~F.arrays_overlap(plain_words(t), foreign)).alias("own"),
        ))

        def summed(xs: Column) -> Column:
            n, of = F.size(xs), F.size(kept)
            share = lambda f: F.when(n > 0, F.round(F.size(F.filter(xs, lambda x: x[f])) / n, 4))
            passing = F.transform(F.filter(xs, lambda x: x["ok"]), lambda x: x["tag"])
            false = F.transform(F.filter(xs, lambda x: ~x["ok"]), lambda x: x["tag"])
            score = F.round((share("fact") + share("intent") + share("own")) / 3 * (n / of) * (F.size(passing) / n), 4)
            return F.struct(
                of.alias("n"), (of - n).alias("duplicates"), passing.alias("passing"), false.alias("false"), share("fact").alias("fact_relevance"), share("intent").alias("intent_relevance"),
                share("own").alias("language_match"), ((n > 0) & (F.size(false) == 0)).alias("passes"), F.when(n > 0, score).otherwise(0.0).alias("score"),
            )

        return let(judged, summed)

    return let(given, result)


def plain_words(text: Column) -> Column:
    """Distinct folded words that are no numbers."""
    return F.array_distinct(F.filter(F.split(F.trim(norm(text)), " "), lambda w: (w != "") & ~w.rlike("^[0-9]")))


def readability(text: Column, language: Column) -> Column:
    """Flesch reading ease, for Spanish by the formula of Fernández Huerta; one decimal, null for a text without words."""
    words = F.filter(F.split(F.trim(norm(text)), " "), lambda w: (w != "") & ~w.rlike("^[0-9]"))

    def scored(w: Column) -> Column:
        syllables = F.aggregate(w, F.lit(0), lambda s, x: s + F.greatest(F.lit(1), F.size(F.regexp_extract_all(x, F.lit("([aeiouy]+)"), F.lit(1)))))
        a, b = syllables / F.size(w), F.size(w) / F.greatest(F.lit(1), F.size(sentences(text)))
        return F.when(F.size(w) > 0, F.round(F.when(language == "es", 206.84 - 60 * a - 1.02 * b).otherwise(206.835 - 1.015 * b - 84.6 * a), 1))

    return let(words, scored)


def description_audit(text: Column, grounded: Grounded, language: Column, facts: Column, intents: Column, markup: Column) -> Column:
    """struct(sentences, flagged, passes, fact_coverage, intent_coverage, readability, words, chars, markup_completeness) of a description.

    flagged counts sentences that are not grounded; fact_coverage is the share of the array ``facts`` of words that the text has, null for none;
    ``intents`` is an array of arrays of stems, ``markup`` an array of the properties given or null.
    """
    body = F.coalesce(text, F.lit(""))
    own = F.array_distinct(facts)
    covered = F.when(F.size(own) > 0, F.round(F.size(F.array_intersect(own, plain_words(body))) / F.size(own), 4))

    def result(s: Column) -> Column:
        flagged = F.size(F.filter(s, lambda x: ~grounded(x)))
        return F.struct(
            F.size(s).alias("sentences"), flagged.alias("flagged"), ((body != "") & (flagged == 0)).alias("passes"), covered.alias("fact_coverage"), k.coverage(body, intents).alias("intent_coverage"),
            readability(body, language).alias("readability"), F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")).alias("words"), F.length(body).alias("chars"),
            F.when(markup.isNotNull(), F.round(F.size(F.array_intersect(F.array(*map(F.lit, MARKUP_KEYS)), markup)) / len(MARKUP_KEYS), 4)).alias("markup_completeness"),
        )

    return let(F.filter(sentences(body), lambda x: F.trim(x) != ""), result)
