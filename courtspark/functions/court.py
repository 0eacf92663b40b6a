"""Column functions on the court: 40 m by 20 m, goals at x = 0 and x = 40."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, WIDTH = 40.0, 20.0
ZONES = ("LA", "RL", "RM", "RR", "RA", "KL")


def half_up(x: Column, digits: int) -> Column:
    """Round half up by plain arithmetic, the same in every engine."""
    s = float(10**digits)
    return F.floor(x * s + 0.5).cast("double") / s


def half_of(x: Column) -> Column:
    return F.when(x < LENGTH / 2, "left").otherwise("right")


def zone_of(x: Column, y: Column) -> Column:
    """Zone of a position. The right half is the left one turned by 180 degrees, so one rule serves both; null y is RM."""
    right = x >= LENGTH / 2
    u, v = F.when(right, LENGTH - x).otherwise(x), F.when(right, WIDTH - y).otherwise(y)
    return F.when((u < 7) & v.between(5, 15), "KL").when((u < 12) & (v >= 15), "LA").when((u < 12) & (v <= 5), "RA").when(v > 12, "RL").when(v < 8, "RR").otherwise("RM")


def distance(x0, y0, x1, y1) -> Column:
    dx, dy = x0 - x1, y0 - y1
    return F.sqrt(dx * dx + dy * dy)


def team_bucket(team: Column) -> Column:
    """A, B or U by exact label, as stored rows are counted."""
    return F.when(team.isin("A", "B"), team).otherwise("U")


def report_bucket(team: Column) -> Column:
    """Trimmed and upper-cased; blank, null and UNKNOWN are U; other labels stay themselves."""
    t = F.upper(F.trim(team))
    return F.when(F.coalesce(t, F.lit("")).isin("", "UNKNOWN"), "U").otherwise(t)


def clock(seconds: Column) -> Column:
    """``mm:ss`` with minutes beyond 60; negative times are 00:00."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat(two(F.floor(s / 60).cast("long")), F.lit(":"), two(s % 60))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))
