"""Gaps and islands, hysteresis, as-of and interval joins: the shapes that phases, scenes and contexts share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: str | list[str], breaks: Column, out: str = "island") -> DataFrame:
    """Number runs of rows per key; a run begins where ``breaks`` (null counts as true) holds."""
    order = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def changed(col: str, keys: list[str], order: str) -> Column:
    """True where a column differs from the row before, and on the first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.row_number().over(w).eqNullSafe(F.lit(1)) | ~F.col(col).eqNullSafe(F.lag(col).over(w))


def hysteresis(df: DataFrame, keys: list[str], order: str, goal: str, seen: str, hold: Column, out: str = "label") -> DataFrame:
    """A label that follows ``seen`` sluggishly while ``goal`` stays the same.

    Rows with null ``goal`` have no label and end a stretch. In a stretch the first non-null ``seen`` is taken at
    once; later another value is taken when it has been seen ``hold`` rows in a row; null ``seen`` keeps the label.
    This is a closed form over windows: a commit is the stretch's first clear row or any row that is the hold-th or
    later of its run of equal values, and the label is the last commit so far.
    """
    df = islands(df, keys, order, changed(goal, keys, order), "_stretch")
    s = [*keys, "_stretch"]
    df = islands(df, s, order, changed(seen, s, order), "_run")
    place = F.row_number().over(Window.partitionBy(*s, "_run").orderBy(order))
    first = F.row_number().over(Window.partitionBy(*s, F.col(seen).isNull()).orderBy(order))
    commit = F.when(F.col(seen).isNotNull() & ((place >= hold) | (first == 1)), F.col(seen))
    df = df.withColumn("_commit", commit)
    held = F.last("_commit", ignorenulls=True).over(Window.partitionBy(*s).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(F.col(goal).isNotNull(), held)).drop("_stretch", "_run", "_commit")


def runs_with_gaps(series: DataFrame, keys: list[str], frame: str, team: str, max_gap: Column) -> DataFrame:
    """Runs of equal non-null ``team`` over rows by frame: keys, team, start_frame, end_frame, start/end time.

    A run breaks when the team changes, or when a row without a team stood more than ``max_gap`` frames after the
    run's last row; a jump in frame numbers alone does not break it.
    """
    w = Window.partitionBy(*keys).orderBy(frame)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col(team).isNotNull(), F.col(frame))
    df = series.withColumn("_last", F.last(seen, ignorenulls=True).over(so_far)).withColumn("_team", F.last(team, ignorenulls=True).over(so_far)).withColumn("_prev", F.lag(frame).over(w)).withColumn("_prev_team", F.lag(team).over(w))
    idle = F.col("_prev_team").isNull() & (F.col("_prev") - F.col("_last") > max_gap)
    own = df.where(F.col(team).isNotNull())
    own = islands(own, keys, frame, F.col("_team").isNull() | (F.col("_team") != F.col(team)) | F.coalesce(idle, F.lit(False)), "_run")
    return own.groupBy(*keys, "_run").agg(
        F.first(team).alias(team), F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.min("timestamp_s").alias("start_time_s"), F.max("timestamp_s").alias("end_time_s")
    ).drop("_run")


def as_of(points: DataFrame, events: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """For each point the value of the latest event at or before it: a union and one window instead of a range join."""
    both = points.withColumn("_v", F.lit(None).cast(events.schema[value].dataType)).withColumn("_p", F.lit(1)).unionByName(
        events.select(*keys, at, F.col(value).alias("_v"), F.lit(0).alias("_p")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(at, "_p").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_p = 1").drop("_v", "_p")


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: int, closed: bool = True) -> DataFrame:
    """Points joined with the intervals that hold them, by equi-joins on bins of ``width``: an interval is laid out over
    the bins it touches, so no task compares all points of a match with all its intervals."""
    bins = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    joined = points.withColumn("_bin", F.floor(F.col(at) / width)).join(bins, [*keys, "_bin"])
    upper = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    return joined.where((F.col(at) >= F.col(start)) & upper).drop("_bin")
