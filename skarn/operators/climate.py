"""Climate-style aggregates. Column meanings are declared in contracts; the formulas are inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily_extremes(rows: DataFrame, station: str, ts: str, value: str) -> DataFrame:
    """A19 (inferred): tn, tx and tntxm = (tn + tx) / 2 by station and day."""
    out = rows.groupBy(F.col(station).alias("station"), F.to_date(ts).alias("date")).agg(F.min(value).alias("tn"), F.max(value).alias("tx"))
    return out.withColumn("tntxm", (F.col("tn") + F.col("tx")) / 2)


def _dated(value: str, date: str) -> list[Column]:
    """Extremes with their first date; the struct order breaks ties by date."""
    low = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(date).alias("d"))))
    high = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.datediff(date, F.lit("1970-01-01"))).alias("d"))))
    return [low.alias("low"), high.alias("high")]


def _undated(df: DataFrame, keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.col("low.v").alias("tnn"), F.col("low.d").alias("tnn_date"), F.col("high.v").alias("txx"), F.date_sub(F.lit("1970-01-01"), F.col("high.d")).alias("txx_date"), *extra)


def monthly_extremes(rows: DataFrame, station: str, date: str, value: str) -> DataFrame:
    """A20 (inferred): tnn and txx with their first dates, tmm, by station and month."""
    base = rows.select(F.col(station).alias("station"), F.to_date(date).alias("d"), F.col(value).alias("v"))
    out = base.groupBy("station", F.date_format("d", "yyyy-MM").alias("month")).agg(*_dated("v", "d"), F.avg("v").alias("tmm"))
    return _undated(out, ["station", "month"], ["tmm"])


def absolute_records(rows: DataFrame, station: str, date: str, value: str) -> DataFrame:
    """A21 (inferred): records of each station and calendar month with their first dates."""
    base = rows.select(F.col(station).alias("station"), F.to_date(date).alias("d"), F.col(value).alias("v"))
    return _undated(base.groupBy("station", F.month("d").alias("month")).agg(*_dated("v", "d")), ["station", "month"], [])


def baseline(rows: DataFrame, station: str, date: str, value: str, first: int = 1991, last: int = 2020) -> DataFrame:
    """A22 (inferred): count and mean of each station and calendar day over the reference years."""
    years = rows.filter(F.year(date).between(first, last) & F.col(value).isNotNull())
    return years.groupBy(F.col(station).alias("station"), F.month(date).alias("month"), F.dayofmonth(date).alias("day")).agg(F.count(F.lit(1)).alias("sample_count"), F.avg(value).alias("mean"))


def national_indicator(daily: DataFrame, stations: Sequence[str] | None = None) -> DataFrame:
    """A23 (inferred): mean of tntxm over the stations by day; is_fictive where a listed station is missing."""
    rows = daily.filter(F.col("station").isin(list(stations))) if stations else daily
    out = rows.groupBy("date").agg(F.avg("tntxm").alias("indicator"), F.countDistinct("station").alias("stations"))
    return out.withColumn("is_fictive", F.col("stations") < F.lit(len(set(stations)))) if stations else out.withColumn("is_fictive", F.lit(False))


def first_dates(rows: DataFrame, station: str, date: str, value: str) -> DataFrame:
    """First date with a value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(F.col(station).alias("station")).agg(F.min(F.to_date(date)).alias("first_date"))


def rain_by_department(rows: DataFrame, date: str, department: str, value: str, departments: Sequence[str]) -> DataFrame:
    """A25 (inferred): one row a day, a column a department; the list of departments keeps it one pass."""
    return rows.groupBy(F.to_date(date).alias("date")).pivot(department, list(departments)).agg(F.sum(value))


def record_events(rows: DataFrame, keys: Sequence[str], date: str, value: str, highest: bool = True) -> DataFrame:
    """W03 (inferred): rows that beat every earlier value of their keys, with the record they beat.

    Several values of a day count as their extreme; the first value isn't a record.
    """
    sign = 1 if highest else -1
    days = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.to_date(date).alias("date")).agg((F.max if highest else F.min)(value).alias("record_value"))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    best = (F.max if highest else F.min)("record_value").over(w)
    return days.withColumn("previous_record_value", best).filter(sign * F.col("record_value") > sign * F.col("previous_record_value"))


def pressure_change(rows: DataFrame, station: str, ts: str, value: str, hours: int = 3) -> DataFrame:
    """W06 (inferred): value minus the value exactly `hours` before, if there is one."""
    s = F.col(ts).cast("timestamp").cast("long")
    w = Window.partitionBy(station).orderBy(s).rangeBetween(-hours * 3600, -hours * 3600)
    return rows.withColumn("change", F.col(value) - F.last(value, ignorenulls=True).over(w))


def rain_since_midnight(rows: DataFrame, station: str, ts: str, value: str) -> DataFrame:
    """W07 (inferred): running sum since 00 UTC; equal times share a sum."""
    w = Window.partitionBy(station, F.to_date(ts)).orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("since_midnight", F.sum(value).over(w))


def valid_at(facts: DataFrame, ts: str, history: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Facts with the attributes valid at their time; an open end is valid for ever. Bounds are inclusive.

    The equi key keeps it a hash or merge join whose range is a residual condition.
    """
    h = history.withColumnsRenamed({c: f"h_{c}" for c in history.columns})
    on = (facts[key] == h[f"h_{key}"]) & (facts[ts] >= h[f"h_{start}"]) & (h[f"h_{end}"].isNull() | (facts[ts] <= h[f"h_{end}"]))
    return facts.join(h, on, "left").drop(f"h_{key}")


def as_of(facts: DataFrame, ts: str, history: DataFrame, key: str, start: str, value: str) -> DataFrame:
    """The last value that began at or before the fact; one sort over both sides instead of a range join."""
    a = facts.select("*", F.col(ts).alias("__ts"), F.lit(1).alias("__fact"), F.lit(None).cast(history.schema[value].dataType).alias("__v"))
    b = history.select(F.col(key), F.col(start).alias("__ts"), F.lit(0).alias("__fact"), F.col(value).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__ts", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__fact = 1").drop("__ts", "__fact", "__v")


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J15 (inferred): rows of the first source, and those of the second for keys that the first lacks."""
    every = first.withColumn("priority", F.lit(1)).unionByName(second.withColumn("priority", F.lit(2)))
    best = Window.partitionBy(*keys)
    return every.withColumn("__best", F.min("priority").over(best)).filter("priority = __best").drop("__best")


def link_stations(historic: DataFrame, live: DataFrame, historic_id: str, live_id: str, remap: DataFrame | None = None) -> DataFrame:
    """Historic and live rows of a station, ids normalised to 8 digits; remap has (old_id, new_id)."""
    norm = lambda c: F.lpad(F.trim(F.col(c).cast("string")), 8, "0")
    left = historic.withColumn("__id", norm(historic_id))
    if remap is not None:
        r = remap.select(norm("old_id").alias("__id"), norm("new_id").alias("__new"))
        left = left.join(r, "__id", "left").withColumn("__id", F.coalesce("__new", "__id")).drop("__new")
    return left.join(live.withColumn("__id", norm(live_id)), "__id").withColumnRenamed("__id", "station")
