"""Quantities with units in texts and fields, and whether what a sentence states is among what records state."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dates; references and identifiers, whose digits are no quantities; units and how texts write them.
DATE = r"\b\d{4}-\d{2}(?:-\d{2}(?:[T ][\d:.]+(?:Z|[+-]\d{2}:?\d{2})?)?)?\b"
NO_QUANTITY = r"[A-Za-z_][\w.]*:[\w./-]+|\b[A-Za-z]+[-_][\w-]*\d[\w-]*|\b\w*[A-Za-z_]\w*\d\w*"
UNITS = {
    "$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD", "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "pounds": "GBP", "%": "%", "percent": "%", "pp": "pp",
}
# Fields that hold no quantities, fields of prices, fields of shares, currencies in a field's name.
SKIPPED_FIELD = r"(^|_)(id|ids|date|at|time|timestamp|url|period|created|updated|version|hash|run)$|^id"
PRICE_FIELD, SHARE_FIELD, CURRENCY_FIELD = "price|cost|amount|spend", "pct|percent", "(?:^|_)(usd|eur|gbp)(?:_|$)"
QUANTITIES = "array<struct<value: double, unit: string>>"
#: Equal within this share of the value.
NEAR = 1e-6


def _written_unit() -> str:
    longest_first = sorted(UNITS, key=len, reverse=True)
    return "|".join(re.sub(r"([$])", r"\\\1", u) for u in longest_first)


#: A quantity begins with a digit or the first letter of a unit; other places are passed over at once.
QUANTITY = rf"(?i)(?=[\d{''.join(sorted({u[0] for u in UNITS}))}])(?:({_written_unit()})\s?)?(\d+(?:[.,]\d+)*)(?:\s?({_written_unit()})(?![A-Za-z]))?"


def _unit(written: Column) -> Column:
    return F.when(written != "", F.try_element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), F.lower(written)))


def _readings(number: Column) -> Column:
    """What a written number may be: with commas between thousands, and, if its one mark is a comma, with a decimal comma."""
    plain = F.replace(number, F.lit(","), F.lit("")).try_cast("double")
    commas = F.length(number) - F.length(F.replace(number, F.lit(","), F.lit("")))
    decimal = F.when((commas == 1) & ~F.contains(number, F.lit(".")), F.replace(number, F.lit(","), F.lit(".")).try_cast("double"))
    return F.transform(F.array_distinct(F.array_compact(F.array(plain, decimal))), lambda v: F.round(v, 6))


def stated(text: Column) -> Column:
    """(value, unit) of the quantities in a text, dates and identifiers aside; a number that can be read in two ways counts twice."""
    left = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), DATE, " "), NO_QUANTITY, " ")
    before, number, after = (F.regexp_extract_all(left, F.lit(QUANTITY), F.lit(i)) for i in (1, 2, 3))
    placed = F.arrays_zip(before.alias("b"), number.alias("n"), after.alias("a"))
    each = lambda x: F.transform(_readings(x["n"]), lambda v: F.struct(v.alias("value"), F.coalesce(_unit(x["a"]), _unit(x["b"])).alias("unit")))
    found = F.array_distinct(F.flatten(F.transform(placed, each))).cast(QUANTITIES)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\d"), found).otherwise(F.array().cast(QUANTITIES))


def of_fields(names: list[str], currency: Column | None = None) -> Column:
    """(value, unit) of numeric columns: the currency in the name, that of the record for prices, % for shares; none for ids and dates."""
    found = []
    for name in names:
        if re.search(SKIPPED_FIELD, name):
            continue
        code = re.search(CURRENCY_FIELD, name, re.I)
        if code:
            unit = F.lit(code.group(1).upper())
        elif currency is not None and re.search(PRICE_FIELD, name, re.I):
            unit = F.coalesce(_unit(currency), F.upper(currency))
        else:
            unit = F.lit("%" if re.search(SHARE_FIELD, name, re.I) else None).cast("string")
        value = F.col(name).cast("double")
        found.append(F.when(value.isNotNull() & ~F.isnan(value), F.struct(F.round(value, 6).alias("value"), unit.alias("unit"))))
    return F.array_compact(F.array(*found)).cast(QUANTITIES)


def supported(said: Column, known: Column) -> Column:
    """Whether every quantity said is among the known ones, with its unit if it has one."""
    close = lambda s, k: (F.abs(s["value"] - k["value"]) <= NEAR * F.greatest(F.lit(1.0), F.abs(s["value"]))) & (s["unit"].isNull() | s["unit"].eqNullSafe(k["unit"]))
    return F.forall(said, lambda s: F.exists(known, lambda k: close(s, k)))
