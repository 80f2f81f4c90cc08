"""What one answer says about the one listing it was asked for, as column expressions: named, cited, its place in lists, brands named instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.functions.text import let, norm
from plumbline.operators.matching import LIST_ITEM, URL

# Words that begin advice and no brand.
TIPS = (
    "wash use air avoid choose look check consider turn dry pre wear buy try select opt read follow hang iron store fold size size-up keep add pick"
).split()
#: Letters of a brand that may stand for the listing by itself, and words of a brand named instead.
BRAND_LETTERS, BRAND_WORDS = 3, 4
#: A position up to which a listing counts as among the first.
TOP = 3


def item_brand(item: Column) -> Column:
    """The brand that a list item seems to name: its bold text or what stands before a mark; empty for advice and lower-case words."""
    bold = F.regexp_extract(item, r"\*\*(.+?)\*\*", 1)
    head = F.when(bold != "", bold).otherwise(F.regexp_extract(item, "^([^:(,]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(head, r"^[\d.)\s*_]+|[*_`]", ""), "^[ .]+|[ .]+$", "")
    words = F.filter(F.split(F.get(F.split(bare, r"\s[-–—:(]\s?|:", 2), F.lit(0)), r"\s+"), lambda w: w != "")
    usable = lambda w: F.when((F.size(w) > 0) & ~F.rtrim(F.lower(w[0]), F.lit(",")).isin(TIPS) & w[0].rlike(r"^\p{Lu}"), F.array_join(F.slice(w, 1, BRAND_WORDS), " "))
    return F.coalesce(let(words, lambda w: F.when(F.size(w) > 0, usable(w))), F.lit(""))


def analysis(text: Column, brand: Column, name: Column, url: Column, site: Column) -> Column:
    """struct(mentioned, cited, position, others) of an answer for its listing; a null text says nothing.

    A line names the listing by its site, by its brand (of a few letters or more), by its name with its brand, or by its address. position is
    the place among the answer's list items, null if it is named in prose only; others are the brands of the items that do not name it.
    """
    text, brand, name, url, site = (F.coalesce(c, F.lit("")) for c in (text, brand, name, url, F.lower(site)))
    # What is looked for is folded once an answer, not once a line.
    wanted = F.struct(norm(brand).alias("brand"), norm(name).alias("name"), norm(site).alias("site"), urls.mention_key(url).alias("key"))

    def addresses(line: Column) -> Column:
        found = F.transform(F.regexp_extract_all(line, F.lit(f"({URL})"), F.lit(1)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))
        return F.when(F.contains(line, F.lit("://")), found).otherwise(F.array().cast("array<string>"))

    def analysed(w: Column) -> Column:
        same = lambda u: (url != "") & (urls.mention_key(u) == w["key"])

        def named(line: Column) -> Column:
            def holds(n: Column) -> Column:
                whole = lambda phrase: (F.trim(phrase) != "") & F.contains(n, phrase)
                return ((F.length(F.trim(w["brand"])) >= BRAND_LETTERS) & whole(w["brand"])) | whole(w["site"]) | (whole(w["name"]) & F.contains(n, w["brand"]))

            return let(norm(line), holds) | F.exists(addresses(line), same)

        def judged(lines: Column) -> Column:
            found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, LIST_ITEM, 1)), lambda x: x != "")
            items = F.transform(found, lambda x: F.struct(x.alias("item"), (named(x) | ((site != "") & F.contains(F.lower(x), site))).alias("ours")))
            cited = (site != "") & F.exists(addresses(text), lambda u: (urls.host(u) == site) | same(u))

            def result(x: Column) -> Column:
                xs = x["items"]
                place = F.array_position(F.transform(xs, lambda x: x["ours"]), True)
                foreign = F.transform(F.filter(xs, lambda x: ~x["ours"]), lambda x: item_brand(x["item"]))
                return F.struct(
                    (x["cited"] | (place > 0) | F.exists(lines, named)).alias("mentioned"), x["cited"].alias("cited"), F.when(place > 0, place.cast("int")).alias("position"),
                    F.filter(foreign, lambda b: (b != "") & (norm(b) != w["brand"])).alias("others"),
                )

            return let(F.struct(items.alias("items"), cited.alias("cited")), result)

        return let(F.split(text, "\n"), judged)

    return let(wanted, analysed)
