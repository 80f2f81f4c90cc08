"""Streams with state: approvals by key, and events fanned out to subscriptions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.decisions import APPROVAL_STATE, APPROVALS, _stepped


def _approve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows, after = _stepped(pd.concat(list(frames)), state.get if state.exists else (None, None, None))
    state.update(after)
    yield rows


def approval_stream(events: DataFrame) -> DataFrame:
    """The outcomes of a stream of (key, at, event, kind, actor): events of one batch are stepped in order, an event that
    arrives later than newer ones meets the state that these have left."""
    return events.groupBy("key").applyInPandasWithState(_approve, APPROVALS, APPROVAL_STATE, "append", GroupStateTimeout.NoTimeout)


def fan_out(events: DataFrame, subscriptions: DataFrame, life: str = "15 days", late: str = "2 days") -> DataFrame:
    """(subscription, event, type, ts): each event of (event, owner, type, ts) for each active subscription to its type.

    Subscriptions are a stream too, (subscription, owner, types, active, since): they hear of events from ``since`` on, for ``life``. Events
    and subscriptions that come again within the watermark deliver nothing twice, and the join keeps neither longer than they can meet.
    """
    heard = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event", "type"])
    live = subscriptions.withWatermark("since", late).dropDuplicatesWithinWatermark(["subscription"]).where("active")
    e, s = heard.alias("e"), live.alias("s")
    met = (F.col("e.owner") == F.col("s.owner")) & (F.col("e.ts") >= F.col("s.since")) & (F.col("e.ts") < F.col("s.since") + F.expr(f"interval {life}"))
    return e.join(s, met).where(F.array_contains("s.types", F.col("e.type"))).select("s.subscription", "e.event", "e.type", "e.ts")
