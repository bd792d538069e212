"""Who may use how much: limits a connection and a day's budget of pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.limits import Limits

#: How much more often results may be asked for than documents sent.
REDACT_FACTOR = 4


def rate_limited(requests: DataFrame, per_hour: int | None = None, per_day: int | None = None) -> DataFrame:
    """requests(key, ts, req_id) with admitted: among the first of its clock hour and of its day (aligned windows, by choice).

    A refused request counts as well; the limits are the session's unless given.
    """
    limits = Limits.of(requests.sparkSession)
    per_hour, per_day = limits.per_hour if per_hour is None else per_hour, limits.per_day if per_day is None else per_day
    n = lambda unit: F.row_number().over(Window.partitionBy("key", F.date_trunc(unit, "ts")).orderBy("ts", "req_id"))
    return requests.withColumn("admitted", (n("hour") <= per_hour) & (n("day") <= per_day))


def redaction_limited(requests: DataFrame) -> DataFrame:
    """As rate_limited, for results: REDACT_FACTOR times as many an hour, and no limit a day."""
    per_hour = Limits.of(requests.sparkSession).per_hour * REDACT_FACTOR
    return rate_limited(requests, per_hour, 1 << 31)


def daily_budget(requests: DataFrame, budget: int | None = None) -> DataFrame:
    """(req_id, day, pages, admitted) of requests(req_id, ts, pages) in order of time, then req_id.

    Greedy by UTC day: what does not fit is refused and uses nothing, so that a smaller request may still follow. Null pages
    are refused. Requests that cannot fit are decided where they are; the others are sorted by day and time and read in one pass
    that holds nothing but the pages used, so a day is one ordered stream but never a list.
    """
    budget = Limits.of(requests.sparkSession).day_pages if budget is None else budget
    rows = requests.select("req_id", F.to_date("ts").alias("day"), "ts", F.col("pages").cast("long").alias("pages"))

    def run(batches):
        last, used = None, 0
        for batch in batches:
            days, ok = batch.column(1).to_pylist(), []
            for day, pages in zip(days, batch.column(2).to_pylist(), strict=True):
                if day != last:
                    last, used = day, 0
                ok.append(used + pages <= budget)
                used += pages if ok[-1] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], ["req_id", "day", "pages", "admitted"])

    req = rows.schema["req_id"].dataType.simpleString()
    small = rows.where(F.col("pages") <= budget).repartition("day").sortWithinPartitions("day", "ts", "req_id").select("req_id", "day", "pages")
    out = small.mapInArrow(run, f"req_id {req}, day date, pages long, admitted boolean")
    return out.unionByName(rows.where(F.coalesce(F.col("pages") > budget, F.lit(True))).select("req_id", "day", "pages", F.lit(False).alias("admitted")))
