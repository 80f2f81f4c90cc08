"""Choice among generated copy: only grounded candidates win, what is not grounded is cut, and verified facts stand in where nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.audits import Grounded, plain_words
from plumbline.functions.guard import sentences
from plumbline.functions.text import let

LONGEST_TITLE = 90


def scored_candidates(candidates: DataFrame, grounded: Grounded) -> DataFrame:
    """``candidates`` with title_ok, kept and removed (sentences that are grounded and those that are not), passed, format_ok and total.

    ``candidates`` has (round, order, title, text, targets) beside its key: targets are the words of verified facts that copy should state. total is the share of
    them in grounded text, four decimals, less one for the title and each sentence that is not grounded. Null texts are empty and not well formed.
    """
    title, text = F.trim(F.coalesce("title", F.lit(""))), F.coalesce("text", F.lit(""))
    parts = let(F.filter(sentences(text), lambda s: F.trim(s) != ""), lambda xs: F.struct(F.filter(xs, lambda s: grounded(s)).alias("kept"), F.filter(xs, lambda s: ~grounded(s)).alias("removed")))
    rows = candidates.withColumns({"title": title, "text": text, "title_ok": grounded(title), "_parts": parts})
    said = plain_words(F.concat_ws(" ", F.when(F.col("title_ok"), F.col("title")), F.array_join("_parts.kept", " ")))
    targets = F.array_distinct("targets")
    covered = F.when(F.size(targets) > 0, F.round(F.size(F.array_intersect(targets, said)) / F.size(targets), 4)).otherwise(0.0)
    bad = F.size("_parts.removed") + (~F.col("title_ok")).cast("int")
    return rows.withColumns({
        "kept": F.col("_parts.kept"), "removed": F.col("_parts.removed"), "passed": bad == 0, "format_ok": (F.col("title") != "") & (F.col("text") != ""), "total": F.round(covered - bad, 4),
    }).drop("_parts")


def selected_copy(scored: DataFrame, key: str) -> DataFrame:
    """(key, round, order, title, text, removed, passed, total, attempts_until, used_fallback): the copy chosen for each key.

    A round of candidates is only asked for where no earlier one gave a grounded, well-formed candidate; so the winner is the best of the first round that has one,
    or else the best of all, cut to its grounded sentences. Ties go to the smaller ``order``. ``scored`` also has fallback_title and facts (an array of sentences), the same
    for all rows of a key: they replace a title that is blank, long or not grounded, and a text of which nothing is left (used_fallback). attempts_until is the last round
    asked for. One aggregate decides; candidates are never gathered.
    """
    eligible = F.col("passed") & F.col("format_ok")
    order = F.struct(~eligible, F.when(eligible, F.col("round")).otherwise(0), -F.col("total"), F.col("round"), F.col("order"))
    kept = ("round", "order", "title", "title_ok", "kept", "removed", "passed", "total", "fallback_title", "facts")
    best = scored.groupBy(key).agg(F.min_by(F.struct(*kept), order).alias("x"), F.coalesce(F.min(F.when(eligible, F.col("round"))), F.max("round")).alias("attempts_until"))
    usable = F.col("x.title_ok") & F.col("x.title").rlike(r"\S") & (F.length("x.title") <= LONGEST_TITLE)
    nothing = F.size("x.kept") == 0
    return best.select(
        key, "x.round", "x.order", F.when(usable, F.col("x.title")).otherwise(F.col("x.fallback_title")).alias("title"), F.array_join(F.when(nothing, F.col("x.facts")).otherwise(F.col("x.kept")), " ").alias("text"),
        F.concat(F.when(F.col("x.title_ok"), F.array().cast("array<string>")).otherwise(F.array("x.title")), F.col("x.removed")).alias("removed"), "x.passed", "x.total", "attempts_until", nothing.alias("used_fallback"),
    )


def preference_pairs(scored: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(key, chosen, rejected, chosen_total, rejected_total): winners that passed against every candidate asked for with a lower total and other copy, as JSON."""
    copy = F.to_json(F.struct("title", "text"))
    won = chosen.where("passed").select(key, F.col("round").alias("w_round"), F.col("order").alias("w_order"), F.col("total").alias("chosen_total"), "attempts_until")
    rows = scored.select(key, "round", "order", "total", copy.alias("copy"))
    winner = rows.join(won, (rows[key] == won[key]) & (F.col("round") == F.col("w_round")) & (F.col("order") == F.col("w_order"))).select(rows[key], F.col("copy").alias("chosen"), "chosen_total", "attempts_until")
    met = rows.where("total is not null").join(winner, key).where("round <= attempts_until and total < chosen_total and copy <> chosen")
    return met.select(key, "chosen", F.col("copy").alias("rejected"), "chosen_total", F.col("total").alias("rejected_total"))


def ungrounded(copy: DataFrame, key: str, grounded: Grounded) -> DataFrame:
    """(key, sentence): what keeps copy (title, text) from being published: its title or sentences that are not grounded, or none (null) for blank copy."""
    blank = ~F.coalesce(F.col("title"), F.lit("")).rlike(r"\S") | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    said = F.concat(F.array(F.coalesce("title", F.lit(""))), F.filter(sentences(F.coalesce("text", F.lit(""))), lambda s: F.trim(s) != ""))
    bad = F.filter(said, lambda s: ~grounded(s))
    return copy.select(key, F.explode(F.concat(bad, F.when(blank, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))).alias("sentence"))
