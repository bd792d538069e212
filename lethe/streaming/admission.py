"""The same limits on a stream of requests.

Decisions are made in order of arrival within a key. A watermark bounds how long a day's state is kept; requests later
than that are dropped, which is an addition of the streaming form.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.limits import Limits

OUT = "req_id long, day date, pages long, admitted boolean"


def daily_budget_stream(requests: DataFrame, budget: int | None = None, late: str = "1 hour") -> DataFrame:
    """OUT rows of a stream of requests(req_id, ts, pages); the state of a day is the pages used."""

    budget = Limits.of(requests.sparkSession).day_pages if budget is None else budget

    def admit(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values(["ts", "req_id"], kind="stable")
        ok = []
        for pages in pdf["pages"]:
            ok.append(bool(pages == pages and used + pages <= budget))  # null is not equal to itself here
            used += int(pages) if ok[-1] else 0
        yield pd.DataFrame({"req_id": pdf["req_id"], "day": pdf["day"], "pages": pdf["pages"].astype("Int64"), "admitted": ok})
        state.update((used,))
        if key[0] is not None:
            end = pd.Timestamp(key[0]) + pd.Timedelta(days=1)
            state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    rows = requests.withWatermark("ts", late).withColumn("day", F.to_date("ts")).select("req_id", "ts", "day", F.col("pages").cast("long").alias("pages"))
    return rows.groupBy("day").applyInPandasWithState(admit, OUT, "used long", "append", GroupStateTimeout.EventTimeTimeout)


_HOUR, _DAY = 3_600_000, 86_400_000


def rate_limited_stream(requests: DataFrame, per_hour: int | None = None, per_day: int | None = None, late: str = "1 hour") -> DataFrame:
    """(key, ts, req_id, admitted) of a stream of requests(key, ts, req_id), as the batch form gives it for requests that come in order.

    The state of a key is two clocks: requests so far of each hour and each day (UTC) that the watermark has not passed. A
    timer clears what it has.
    """
    limits = Limits.of(requests.sparkSession)
    per_hour, per_day = limits.per_hour if per_hour is None else per_hour, limits.per_day if per_day is None else per_day
    rows = requests.withWatermark("ts", late).select("key", "ts", "req_id", F.unix_millis("ts").alias("ms"))
    fields = {c: rows.schema[c].dataType.simpleString() for c in ("key", "ts", "req_id")}

    def admit(key, batches, state: GroupState):
        hours, days = (dict(zip(*x, strict=True)) for x in (state.get[:2], state.get[2:])) if state.exists else ({}, {})
        if not state.hasTimedOut:
            pdf = pd.concat(list(batches)).sort_values(["ms", "req_id"], kind="stable")
            ok = []
            for ms in pdf["ms"]:
                hour, day = int(ms) // _HOUR, int(ms) // _DAY
                hours[hour], days[day] = hours.get(hour, 0) + 1, days.get(day, 0) + 1
                ok.append(hours[hour] <= per_hour and days[day] <= per_day)
            yield pdf[["key", "ts", "req_id"]].assign(admitted=ok)
        mark = state.getCurrentWatermarkMs()
        hours = {h: n for h, n in hours.items() if (h + 1) * _HOUR > mark}
        days = {d: n for d, n in days.items() if (d + 1) * _DAY > mark}
        if not days:
            state.remove()
            return
        state.update((list(hours), list(hours.values()), list(days), list(days.values())))
        state.setTimeoutTimestamp(max((min(days) + 1) * _DAY, mark + 1))

    out = ", ".join([*(f"{c} {t}" for c, t in fields.items()), "admitted boolean"])
    kept = "hours array<long>, in_hours array<long>, days array<long>, in_days array<long>"
    return rows.where("ts is not null").groupBy("key").applyInPandasWithState(admit, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def hourly_counts(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, key, n) of a stream of requests(key, ts), final once the watermark has passed the hour."""
    rows = requests.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour"), "key").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "key", "n")
