"""Decisions that depend on earlier decisions: cached results, budgets with refunds, approvals.

Caches and budgets are decided for all keys together in a few rounds of joins and windows, and a busy key is cut by time; approvals
are keyed state, stepped by one function in batch and stream alike.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import materialize


def _next_misses(rows: DataFrame, ttl: int) -> DataFrame:
    """(key, id, next_id): the first request of a key that a result fetched at (at, id) no longer serves.

    It lies in the time slice of ``ttl`` after the request's own, or is the first of a later slice; so one slice of a key is sorted at a time.
    """
    me = F.struct("at", "id")
    targets = rows.select("key", "slice", F.col("at").alias("t"), F.lit(1).alias("target"), me.alias("x"))
    asked = rows.select("key", (F.col("slice") + 1).alias("slice"), (F.col("at") + ttl).alias("t"), F.lit(0).alias("target"), me.alias("x"))
    later = Window.partitionBy("key", "slice").orderBy(F.desc("t"), F.desc("target")).rowsBetween(Window.unboundedPreceding, 0)
    near = targets.unionByName(asked).withColumn("near", F.min(F.when(F.col("target") == 1, F.col("x"))).over(later)).where("target = 0")
    near = near.select("key", F.col("x.id").alias("id"), (F.col("slice") - 1).alias("slice"), "near")
    firsts = rows.groupBy("key", "slice").agg(F.min(me).alias("x"))
    order = Window.partitionBy("key").orderBy("slice")
    one, two = F.lead(F.struct("slice", "x"), 1).over(order), F.lead(F.struct("slice", "x"), 2).over(order)
    far = firsts.select("key", "slice", F.when(one["slice"] == F.col("slice") + 1, two["x"]).otherwise(one["x"]).alias("far"))
    found = near.join(far, ["key", "slice"])
    return found.select("key", "id", F.coalesce("near", "far").getField("id").alias("next_id")).where("next_id is not null")


def result_cache(requests: DataFrame, key: str, at: Column, id_: str, ttl: int) -> DataFrame:
    """(key, id, hit, served_by): whether a request finds the result of an earlier one that is younger than ``ttl``, and whose.

    ``at`` is a time as a whole number, in the unit of ``ttl``. A request that finds none fetches, and its result serves those
    that follow; a hit renews nothing. Requests of one time are taken by id, which is unique within a key. Which requests
    fetch is the chain of next misses from each key's first request; the chain is walked in steps that double.
    """
    rows = requests.select(F.col(key).alias("key"), at.cast("long").alias("at"), F.col(id_).alias("id")).dropna()
    rows = materialize(rows.withColumn("slice", F.floor(F.col("at") / ttl)), "requests")
    jump = materialize(_next_misses(rows, ttl), "next-misses")
    reached = materialize(rows.groupBy("key").agg(F.min(F.struct("at", "id")).getField("id").alias("id")), "misses")
    while jump.limit(1).count():
        step = reached.join(jump, ["key", "id"]).select("key", F.col("next_id").alias("id"))
        reached = materialize(reached.unionByName(step), "misses")
        over = jump.select("key", F.col("id").alias("next_id"), F.col("next_id").alias("after"))
        jump = materialize(jump.join(over, ["key", "next_id"]).select("key", "id", F.col("after").alias("next_id")), "next-misses")
    marked = rows.join(reached.withColumn("miss", F.lit(True)), ["key", "id"], "left").withColumn("x", F.when(F.col("miss"), F.struct("at", "id")))
    until = Window.partitionBy("key", "slice").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.groupBy("key", (F.col("slice") + 1).alias("slice")).agg(F.max("x").alias("before"))
    marked = marked.withColumn("own", F.max("x").over(until)).join(last, ["key", "slice"], "left")
    return marked.select(F.col("key").alias(key), F.col("id").alias(id_), F.col("miss").isNull().alias("hit"), F.coalesce("own", "before").getField("id").alias("served_by"))


def reserved_spend(calls: DataFrame, budget: str, slice_: Column, order: list[str], cost: str, cap: float, per_call: float) -> DataFrame:
    """``calls`` with accepted and left, what their budget had left before them.

    A call is accepted if its cost is at most ``per_call`` and what its budget has left of ``cap``; what it does not use returns, and a
    refused call costs nothing. ``slice_`` cuts a budget's calls in the order of ``order``, so that running sums stay within a slice. Each round
    accepts the calls up to the first that does not fit, and refuses for good the later ones that are dearer than what is left then.
    Costs are not negative; calls without a cost are refused.
    """
    rows = materialize(calls.withColumns({"at": F.struct(slice_.alias("s"), *order), "price": F.col(cost).cast("decimal(28,6)")}), "calls")
    fits = (F.col("price") <= F.lit(per_call).cast("decimal(28,6)")) & (F.col("price") >= 0)
    left = F.lit(cap).cast("decimal(28,6)").alias("left")
    rest = rows.where(fits).select(budget, "at", "price", left)
    decided = []
    while True:
        inside = Window.partitionBy(budget, "at.s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        slices = rest.groupBy(budget, F.col("at.s").alias("s")).agg(F.sum("price").alias("n"))
        before = Window.partitionBy(budget).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        slices = slices.select(budget, "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
        summed = rest.withColumns({"s": F.col("at.s"), "own": F.sum("price").over(inside)}).join(slices, [budget, "s"])
        summed = materialize(summed.select(budget, "at", "price", "left", (F.col("earlier") + F.col("own")).cast("decimal(28,6)").alias("sum")), "spend")
        ok = F.col("sum") <= F.col("left")
        decided.append(summed.where(ok).select(budget, "at", (F.col("left") - F.col("sum") + F.col("price")).alias("left")))
        state = summed.groupBy(budget).agg(F.min(F.when(~ok, F.col("at"))).alias("stop"), F.coalesce(F.max(F.when(ok, F.col("sum"))), F.lit(0)).alias("spent"))
        later = summed.join(state.where("stop is not null"), budget).where("at > stop").withColumn("left", (F.col("left") - F.col("spent")).cast("decimal(28,6)"))
        rest = materialize(later.where("price <= left").select(budget, "at", "price", "left"), "calls-left")
        if not rest.limit(1).count():
            break
    accepted = reduce(DataFrame.unionByName, decided).withColumn("accepted", F.lit(True))
    out = rows.join(accepted, [budget, "at"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return out.select(*calls.columns, "accepted", "left")


#: What a step needs to know of a key: its latest approval, who asked for it, and where it stands.
APPROVAL_STATE = "approval long, requester string, status string"


def approval_step(state: tuple, kind: str, actor: str, event: int) -> tuple[tuple, str]:
    """(state after, outcome) of one event on a key's latest approval.

    request opens an approval unless one is pending, which then serves again; approve and reject decide a pending one, but
    not by who asked for it; use consumes an approved one, once. Everything else is refused and changes nothing.
    """
    approval, requester, status = state
    if kind == "request":
        return (state, "reused") if status == "pending" else ((event, actor, "pending"), "opened")
    if kind in ("approve", "reject") and status == "pending" and actor != requester:
        status = {"approve": "approved", "reject": "rejected"}[kind]
        return (approval, requester, status), status
    if kind == "use" and status == "approved":
        return (approval, requester, "used"), "used"
    return state, "refused"


def _stepped(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    out = []
    for row in rows.sort_values(["at", "event"]).itertuples(index=False):
        state, outcome = approval_step(state, row.kind, row.actor, row.event)
        out.append((row.key, row.event, outcome, state[0], state[2]))
    return pd.DataFrame(out, columns=["key", "event", "outcome", "approval", "status"]).astype({"approval": "Int64"}), state


APPROVALS = "key string, event long, outcome string, approval long, status string"


def approvals(events: DataFrame) -> DataFrame:
    """(key, event, outcome, approval, status) of (key, at, event, kind, actor): what each event did, and the key's latest approval after it.

    A key is one action on one target with one content and owner; its events are stepped in the order of (at, event).
    """
    return events.groupBy("key").applyInPandas(lambda rows: _stepped(rows, (None, None, None))[0], APPROVALS)
