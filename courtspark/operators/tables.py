"""Table maintenance: layout of nested states, upserts, catalogue, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tracking(spark: SparkSession, folder: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Tables of a store by name. They lie in folders by match, so a filter on ``match_id`` prunes folders; the schema
    is given, so that ids that look like numbers stay strings and a table without rows can be read."""
    return {n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in schemas.items()}


def write_tracking(df: DataFrame, folder: str, name: str) -> None:
    """Replace the matches in ``df`` only: dynamic partition overwrite, one task a match."""
    df.repartition("match_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(f"{folder}/{name}")


def drop_matches(spark: SparkSession, folder: str, name: str, matches: list[str]) -> None:
    """Remove the folders of some matches of a table."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for m in matches:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/{names.getPartitionPathString('match_id', m)}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rescore_store(spark: SparkSession, folder: str, new: dict[str, DataFrame], matches: list[str], labels: str = "play_event_labels") -> None:
    """Rescore ``matches`` in a store: their rows of each derived table are replaced by those of ``new``, and their
    labels go, since these name events by numbers that a rescoring deals anew.

    Labels go first, so a run that breaks off never leaves a verdict on another event; run again, it ends the same.
    Rows of other matches in ``new`` are left out, a match without new rows loses its old ones, and files of other
    matches are not touched. ``matches`` is what one run rescores.
    """
    drop_matches(spark, folder, labels, matches)
    for name, df in new.items():
        rows = df.where(F.col("match_id").isin(matches))
        write_tracking(rows, folder, name)
        kept = {r["match_id"] for r in rows.select("match_id").distinct().collect()}
        drop_matches(spark, folder, name, [m for m in matches if m not in kept])


def frame_states(frames: DataFrame, players: DataFrame, ball: DataFrame) -> DataFrame:
    """Nested records, one per frame: players as an array by track, ball as a struct or null."""
    cols = [c for c in players.columns if c not in ("match_id", "frame_id")]
    each = players.groupBy("match_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("track_id", *[c for c in cols if c != "track_id"]))).alias("players"))
    one = ball.select("match_id", "frame_id", F.struct(*[c for c in ball.columns if c not in ("match_id", "frame_id")]).alias("ball"))
    return frames.select("match_id", "frame_id", "timestamp_s").join(each, ["match_id", "frame_id"], "left").join(one, ["match_id", "frame_id"], "left")


def frame_counters(states: DataFrame) -> DataFrame:
    players = F.coalesce("players", F.array().cast(states.schema["players"].dataType))
    return states.select("match_id", "frame_id", "timestamp_s", F.size(players).alias("player_count"), F.size(F.filter(players, lambda p: p["on_court"])).alias("on_court_count"))


def explode_players(states: DataFrame) -> DataFrame:
    """Player rows of nested states; velocities and possession are filled by later steps and start at 0 and false."""
    p = states.select("match_id", "frame_id", F.explode("players").alias("p")).select("match_id", "frame_id", "p.*")
    return p.withColumns({"velocity_x": F.lit(0.0), "velocity_y": F.lit(0.0), "has_ball": F.lit(False)})


def explode_ball(states: DataFrame) -> DataFrame:
    return states.where(F.col("ball").isNotNull()).select("match_id", "frame_id", "ball.*")


def upsert_latest(base: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union in which the row of highest ``order`` replaces others of its key; a delta row wins a tie."""
    both = base.withColumn("_d", F.lit(0)).unionByName(delta.withColumn("_d", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_d"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_d")


def apply_labels(log: DataFrame) -> DataFrame:
    """Latest verdict per event; a null verdict clears it."""
    best = F.max_by(F.struct("verdict", "labeled_at"), F.struct("labeled_at", F.coalesce("verdict", F.lit(""))))
    return log.groupBy("match_id", "event_id").agg(best.alias("b")).select("match_id", "event_id", "b.verdict", "b.labeled_at").where("verdict is not null")


def rescore_overwrite(derived: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows of the rescored matches are all replaced by ``new``; others stay."""
    ids = matches.select("match_id").distinct()
    return derived.join(ids, "match_id", "left_anti").unionByName(new.join(ids, "match_id", "left_semi"), allowMissingColumns=True)


def hide_matches(matches: DataFrame, deleted: DataFrame) -> DataFrame:
    return matches.join(deleted, "match_id", "left_anti")


def match_catalog(matches: DataFrame, statuses: DataFrame) -> DataFrame:
    """Stored matches, and stubs for ids that only have a status. A stored match that still reads unknown or
    processing is done."""
    stored = F.col("video_path").isNotNull()
    both = matches.join(statuses, "match_id", "full")
    status = F.when(stored & F.coalesce("status", F.lit("unknown")).isin("unknown", "processing"), "done").otherwise(F.col("status"))
    return both.select("match_id", F.coalesce("video_path", F.lit("")).alias("video_path"), F.coalesce("fps", F.lit(0.0)).alias("fps"), F.coalesce("total_frames", F.lit(0)).alias("total_frames"), status.alias("status"))


def merge_meta(updates: DataFrame, fields: list[str], order: str = "seq") -> DataFrame:
    """Last non-null value of each editable field."""
    return updates.groupBy("match_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; ones that older data lack are null, unknown ones are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def resolve_fps(matches: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames per second: stored, else last frame over last time where both count, else 30."""
    seen = frames.groupBy("match_id").agg(F.max("frame_id").alias("f"), F.max("timestamp_s").alias("t"))
    measured = F.when((F.col("f") > 0) & (F.col("t") > 0), F.col("f") / F.col("t"))
    return matches.join(seen, "match_id", "left").select("match_id", F.coalesce("fps", measured, F.lit(30.0)).alias("fps"))


def stride_sample(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("frame_id") % n == 0)


def even_sample(matches: DataFrame, frames: DataFrame, n: int) -> DataFrame:
    """Frames 0, step, 2 step, ... with step = max(1, total // n)."""
    step = F.greatest(F.lit(1), F.floor(F.col("total_frames") / n).cast("int"))
    return frames.join(matches.select("match_id", step.alias("step")), "match_id").where(F.col("frame_id") % F.col("step") == 0).drop("step")


def cadence_sample(frames: DataFrame, interval: float) -> DataFrame:
    """Greedy sampling by time: a frame is kept if its time reaches the last kept time plus ``interval``.

    Each pick depends on the last, so it is a fold. It runs per match over (time, frame) pairs of one match, the
    unit a video has; the long player rows are not part of it.
    """
    rows = F.array_sort(F.collect_list(F.struct("timestamp_s", "frame_id")))
    kept = frames.groupBy("match_id").agg(rows.alias("rows"))
    start = F.struct(F.lit(float("-inf")).alias("next"), F.array().cast("array<struct<timestamp_s:double,frame_id:int>>").alias("out"))
    fold = F.aggregate(
        "rows", start,
        lambda a, r: F.when(r["timestamp_s"] >= a["next"], F.struct((r["timestamp_s"] + interval).alias("next"), F.concat(a["out"], F.array(r)).alias("out"))).otherwise(a),
        lambda a: a["out"],
    )
    return kept.select("match_id", F.explode(fold).alias("r")).select("match_id", "r.frame_id", "r.timestamp_s")


DETAILS = "struct<goal_x: double, tracks: array<struct<track_id: int, points: array<array<double>>>>>"


def encode_details(details: Column) -> Column:
    return F.to_json(details)


def decode_details(text: Column) -> Column:
    """Nested details of a JSON text; null where it is missing or malformed."""
    return F.from_json(text, DETAILS)


def known_matches(ids: DataFrame, matches: DataFrame) -> DataFrame:
    """Each id with whether it is known: the guard before scoring (must be) and before ingesting (must not be)."""
    return ids.join(matches.select("match_id", F.lit(True).alias("known")).distinct(), "match_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def status_transitions(before: DataFrame, now: DataFrame) -> DataFrame:
    """New or changed statuses among processing, done and failed."""
    old = before.select("match_id", F.col("status").alias("was"))
    return now.where(F.col("status").isin("processing", "done", "failed")).join(old, "match_id", "left").where(~F.col("status").eqNullSafe(F.col("was")))
