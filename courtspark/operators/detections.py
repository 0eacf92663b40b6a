"""Projections and filters on detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["match_id", "frame_id"]
#: A game clock, seconds to 59: fixed value.
CLOCK = r"\b\d{1,2}:[0-5]\d\b"
H = [f"h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


def bbox_geometry(df: DataFrame) -> DataFrame:
    x1, y1, x2, y2 = (F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2"))
    w, h = x2 - x1, y2 - y1
    return df.withColumns({"centre_x": (x1 + x2) / 2, "centre_y": (y1 + y2) / 2, "foot_x": (x1 + x2) / 2, "foot_y": y2.cast("double"), "width": w, "height": h, "area": w * h})


def clean_detections(detections: DataFrame, n: int = 20) -> DataFrame:
    """Tracked detections, the ``n`` most confident of a frame (ties: lowest track)."""
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("confidence"), "track_id"))
    return detections.where("track_id <> -1").withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def role_caps(detections: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The most confident of each capped class and frame; other classes pass. A cap of 0 drops its class."""
    cap: Column = F.lit(None).cast("int")
    for name, n in caps.items():
        cap = F.when(F.col("class_name") == name, n).otherwise(cap)
    rank = F.row_number().over(Window.partitionBy(*FRAME, "class_name").orderBy(F.desc("confidence"), "track_id"))
    return detections.withColumn("_rn", rank).where(cap.isNull() | (F.col("_rn") <= cap)).drop("_rn")


def best_ball(balls: DataFrame) -> DataFrame:
    rest = [c for c in balls.columns if c not in FRAME]
    return balls.groupBy(*FRAME).agg(F.max(F.struct("confidence", *[c for c in rest if c != "confidence"])).alias("b")).select(*FRAME, "b.*")


def valid_keypoints(keypoints: DataFrame, least: int = 4) -> DataFrame:
    """Visible keypoints of each frame's most confident court detection, in frames that have enough of them."""
    best = keypoints.groupBy(*FRAME).agg(F.max(F.struct("court_confidence", "court_id")).alias("b")).where("b.court_confidence >= 0.25").select(*FRAME, F.col("b.court_id").alias("court_id"))
    ok = keypoints.join(best, [*FRAME, "court_id"]).where("visibility > 0.5 and x > 0 and y > 0")
    return ok.withColumn("_n", F.count("*").over(Window.partitionBy(*FRAME))).where(F.col("_n") >= least).drop("_n")


def keypoint_correspondences(keypoints: DataFrame, reference: DataFrame) -> DataFrame:
    """Image points with the court points of the same index (a table of two dozen)."""
    return keypoints.join(F.broadcast(reference), "keypoint")


def _mapped(x: Column, y: Column) -> tuple[Column, Column]:
    w = F.col("h31") * x + F.col("h32") * y + F.col("h33")
    return (F.col("h11") * x + F.col("h12") * y + F.col("h13")) / w, (F.col("h21") * x + F.col("h22") * y + F.col("h23")) / w


def project_to_court(positions: DataFrame, calibrations: DataFrame, x: str = "pixel_foot_x", y: str = "pixel_foot_y", margin: float = 2.0) -> DataFrame:
    """Court coordinates through each frame's homography; both null beyond the margin or without one."""
    j = positions.drop("court_x", "court_y").join(calibrations, FRAME, "left")
    cx, cy = _mapped(F.col(x), F.col(y))
    j = j.withColumn("_x", cx).withColumn("_y", cy)
    inside = F.col("_x").between(-margin, 40 + margin) & F.col("_y").between(-margin, 20 + margin)
    return j.withColumn("court_x", F.when(inside, F.col("_x"))).withColumn("court_y", F.when(inside, F.col("_y"))).drop("_x", "_y", *H)


def carry_calibration(frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Every frame with the latest homography at or before it; null before the first."""
    w = Window.partitionBy("match_id").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    j = frames.select(*FRAME).join(calibrations.select(*FRAME, F.struct(*H).alias("_h")), FRAME, "left")
    j = j.withColumn("_h", F.last("_h", ignorenulls=True).over(w))
    return j.select(*FRAME, *[F.col(f"_h.{c}").alias(c) for c in H])


def reprojection_quality(correspondences: DataFrame, calibrations: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Per frame: points, inliers (error up to the threshold), their ratio, mean and median error."""
    mx, my = _mapped(F.col("x"), F.col("y"))
    e = correspondences.join(calibrations, FRAME).withColumn("error", F.sqrt((mx - F.col("ref_x")) * (mx - F.col("ref_x")) + (my - F.col("ref_y")) * (my - F.col("ref_y"))))
    inlier = F.when(F.col("error") <= threshold, F.col("error"))
    return e.groupBy(*FRAME).agg(F.count("*").alias("points"), F.count(inlier).alias("inliers"), (F.count(inlier) / F.count("*")).alias("inlier_ratio"), F.avg(inlier).alias("mean_error"), F.percentile(inlier, 0.5).alias("median_error"))


def parse_scoreboard(texts: DataFrame, text: str = "text") -> DataFrame:
    """Clock and score of a scoreboard's text: numbers after letters first, else the first free numbers; one alone is
    the home score."""
    t = F.col(text)
    time = F.regexp_extract(t, f"({CLOCK})", 1)
    rest = F.regexp_replace(t, r"\d{1,2}:\d{2}", " ")
    named, free = F.regexp_extract_all(rest, F.lit(r"[A-Za-z]+\s*(\d{1,2})\b"), F.lit(1)), F.regexp_extract_all(rest, F.lit(r"\b(\d{1,2})\b"), F.lit(1))
    two = F.when(F.size(named) >= 1, named).otherwise(free)
    return texts.withColumns({"game_time": F.when(time != "", time), "score_home": F.get(two, F.lit(0)).cast("int"), "score_away": F.get(two, F.lit(1)).cast("int")})


def scoreboard_plausible(candidates: DataFrame, text: str = "text") -> DataFrame:
    """Of each frame's readings the first plausible one with a clock, else the first plausible: two free numbers at
    least beside the clock."""
    t = F.col(text)
    free = F.size(F.regexp_extract_all(F.regexp_replace(t, r"\d{1,2}:\d{2}", " "), F.lit(r"\b(\d{1,2})\b"), F.lit(1)))
    ok = candidates.withColumn("has_clock", t.rlike(CLOCK)).where(free >= 2)
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("has_clock"), "ordinal"))
    return ok.withColumn("_rn", rank).where("_rn = 1").drop("_rn")
