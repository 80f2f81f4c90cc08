"""Shoppers' keywords: stems of what they ask for, how much of it a text answers, and titles that take up more of it as far as facts allow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.guard import NEUTRAL
from plumbline.functions.text import let, norm

# Words of questions that name nothing wanted.
STOP = """
can could you your recommend recommendation recommendations good great best need needs looking look want wants which what some any suggestions suggest please
would like something that with under ideally around about there does dont won't wont should really also more most well just good-looking find where here them
they their other than into after before busco buscando quiero necesito recomiendas recomienda recomendarias alguna alguno algun cual cuales puedes sugerir
sugerencias mejor mejores para como donde algo tengo sirva sirvan pase quede queden sean tenga tengan otra otro
""".split()  # noqa: SIM905
# Stems of Spanish questions and the English terms that records use.
SPANISH_TERMS = {
    "cambi": "change trend", "tendenc": "trend", "histori": "history", "evoluci": "trend history", "aument": "increased", "subi": "increased", "baj": "decreased",
    "dismin": "decreased", "precio": "price", "visibilidad": "visibility", "menci": "mention", "descripci": "description", "complet": "completeness", "atribut": "attribute",
    "posici": "rank position", "clasific": "rank", "competidor": "competitors", "instantan": "snapshot", "experiment": "experiment",
}
#: Letters of a word that make its stem, and of the shortest keyword.
STEM, SHORTEST = 5, 4
#: Hits that answer an intent; intents of fewer keywords need all of them.
ENOUGH = 2
LONGEST_TITLE = 90


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(norm(text)), " "), lambda w: w != "")


def stems(text: Column) -> Column:
    """The distinct stems of a text's folded words."""
    return F.array_distinct(F.transform(_words(text), lambda w: F.substring(w, 1, STEM)))


def keywords(text: Column) -> Column:
    """The stems of what a question asks for: longer words that are no numbers, no words of asking and no neutral ones."""
    wanted = F.filter(_words(text), lambda w: (F.length(w) >= SHORTEST) & ~w.rlike("^[0-9]") & ~w.isin([*STOP, *NEUTRAL]))
    return F.array_distinct(F.transform(wanted, lambda w: F.substring(w, 1, STEM)))


def coverage(text: Column, intents: Column) -> Column:
    """The share of intents (arrays of keywords) that a text answers, four decimals; null for no intents."""
    answered = lambda have: F.size(F.filter(intents, lambda k: (F.size(k) > 0) & (F.size(F.array_intersect(k, have)) >= F.least(F.lit(ENOUGH), F.size(k)))))
    return F.when(F.size(intents) > 0, F.round(let(stems(text), answered) / F.size(intents), 4))


def holds(text: Column, phrase: Column) -> Column:
    """Whether a text has all words of a phrase already, by stems; numbers aside."""
    wanted = F.filter(stems(phrase), lambda w: ~w.rlike("^[0-9]"))
    return F.size(F.array_except(wanted, stems(text))) == 0


def _grown(first: Column, candidates: Column, trial: Callable[[Column], Column], allowed: Callable[[Column], Column]) -> Column:
    """(text, added): the candidates taken up one after another, each if the text has not got it and the text with it is allowed."""
    start = F.struct(first.alias("text"), F.array().cast("array<string>").alias("added"))

    def step(s: Column, phrase: Column) -> Column:
        more = F.array_append(s["added"], phrase)
        new = F.struct(trial(more).alias("text"), more.alias("added"))
        return F.when(~holds(s["text"], phrase) & allowed(new["text"]), new).otherwise(s)

    return F.aggregate(candidates, start, step)


def boosted_title(title: Column, candidates: Column, grounded: Callable[[Column], Column], longest: int = LONGEST_TITLE) -> Column:
    """(text, added): the title with candidates behind it, in their order, as long as it stays short and grounded as a whole.

    Each step looks at the text that the steps before have made; a candidate that does not fit is passed over, not the later ones. The
    candidates of a title are a short list, and a null title is an empty one.
    """
    bare = F.trim(F.coalesce(title, F.lit("")))
    joint = F.when(F.contains(bare, F.lit(" - ")), F.lit(", ")).otherwise(F.lit(" - "))
    return _grown(bare, candidates, lambda added: F.concat(bare, joint, F.array_join(added, ", ")), lambda text: (F.length(text) <= longest) & grounded(text))


def grounded_in(facts: Column, neutral: list[str]) -> Callable[[Column], Column]:
    """Whether all words of a text are among those of the facts, or neutral ones."""
    return grounded_by(_words(facts), neutral)


def fact_words(facts: Column) -> Column:
    """The words of facts, as ``grounded_by`` takes them; worth a column of its own where many texts are held to them."""
    return F.array_distinct(_words(facts))


def grounded_by(known: Column, neutral: list[str]) -> Callable[[Column], Column]:
    """Whether all words of a text are among the ``known`` ones, an array, or neutral."""
    return lambda text: F.size(F.array_except(F.array_except(_words(text), F.array(*map(F.lit, neutral))), known)) == 0


def search_terms(question: Column) -> Column:
    """The English terms of a question's Spanish stems, wherever they stand in it, each phrase once; empty for null."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(stem)), F.lit(terms)) for stem, terms in SPANISH_TERMS.items()))))


def expanded_question(question: Column) -> Column:
    """The question with its search terms on a line below; as it is where there are none."""
    return let(search_terms(question), lambda terms: F.when(F.size(terms) > 0, F.concat(question, F.lit("\n(search terms: "), F.array_join(terms, " "), F.lit(")"))).otherwise(question))
