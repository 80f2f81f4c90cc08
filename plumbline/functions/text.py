"""Text functions as column expressions: folding, words, n-grams, prose, votes, sentences, readability."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that tell prose from keyword lists.
FUNCTION_WORDS = (
    "the a an with and in of for is are to this our it its from on by de con y el la los las en para es un una del al que por"
).split()
# Words that vote for a language.
VOTES = {
    "en": "the and of with is for this that in to are was be by from".split(),
    "es": "el la los las de que y en un una con para por es del se al".split(),
    "de": "der die das und ist mit von zu den dem des ein eine nicht auf für im".split(),
    "fr": "le la les de des et est un une dans que qui pour au sur avec du".split(),
}
#: Share of repeated word 3-grams that a description may have without losing points.
REPEAT_FREE = 0.15


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def all_words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def letter_words(text: Column) -> Column:
    """Lower-case runs of letters of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Lower-case words with accented letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9áéíóúñü]+"), lambda w: w != "")


@lru_cache(maxsize=1)
def _plain_forms() -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one ASCII letter or digit, and what that is."""
    found = {}
    for i in range(128, sys.maxunicode + 1):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            found[chr(i)] = plain.lower()
    return "".join(found), "".join(found.values())


def folded(text: Column) -> Column:
    """Lower case without accents: letters and digits of compatible forms as the plain ones, combining marks dropped."""
    # ASCII texts, as many bytes as characters, have nothing to fold.
    other = F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), *_plain_forms())
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(other)


def norm(text: Column) -> Column:
    """Folded words of ASCII letters and digits, one blank between them and around the whole; for null and empty texts a blank."""
    flat = F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.concat(F.lit(" "), flat, F.lit(" "))


def grams(tokens: Column, n: int) -> Column:
    """All runs of n words, joined by blanks."""

    def cut(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))

    return let(tokens, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(cut(w)))


def repetition(text: Column) -> Column:
    """Share of word 3-grams that repeat an earlier one; 0 for fewer than six."""

    def share(g):
        return F.when(F.size(g) >= 6, F.round(1 - F.size(F.array_distinct(g)) / F.size(g), 3)).otherwise(F.lit(0.0))

    return let(grams(all_words(text), 3), share)


def repetition_factor(share: Column) -> Column:
    """1 up to the free share, then falling to 0 over the next half."""
    return F.when(share <= REPEAT_FREE, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (share - REPEAT_FREE) / 0.5))


def prose_segments(text: Column) -> Column:
    """Segments that read as sentences: they have a function word, or at most four words."""
    known = F.array(*map(F.lit, FUNCTION_WORDS))
    parts = F.split(text, r"[.!?;\n•|]+")

    def reads(segment):
        w = letter_words(segment)
        return (F.size(w) > 0) & ((F.size(w) <= 4) | F.arrays_overlap(w, known))

    return F.filter(parts, reads)


def language_votes(text: Column) -> dict[str, Column]:
    """How many of the text's blank-separated words vote for each language."""
    w = F.split(F.lower(text), " ")

    def votes(known):
        return F.size(F.filter(w, lambda x: x.isin(known)))

    return {lang: votes(known) for lang, known in VOTES.items()}


def sentences(text: Column) -> Column:
    """Parts after a sentence mark and white space; marks stay with their sentence."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def flesch(text: Column) -> Column:
    """Flesch reading ease by vowel groups; null for a text without words."""
    w = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")
    n = F.size(w)
    syllables = F.aggregate(w, F.lit(0), lambda a, x: a + F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouy]+"))))
    count = F.greatest(F.lit(1), F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != "")))
    return F.when(n > 0, 206.835 - 1.015 * n / count - 84.6 * syllables / n)


def language_code(tag: Column) -> Column:
    """The primary subtag of a language tag in lower case; other text as it is in lower case, null if blank."""
    clean = F.trim(tag)
    code = F.regexp_extract(clean, r"^([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]{1,8})*$", 1)
    return F.when(clean != "", F.lower(F.when(code != "", code).otherwise(clean)))
