"""Frame sequences: which frame a clock shows, what to fetch ahead, and what falls out of the ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frame_at(now_ms: Column, start_ms: Column, start_frame: Column, fps: float, n: int, loop: bool = True) -> Column:
    i = start_frame + F.floor((now_ms - start_ms) / F.lit(1000.0 / fps))
    return (F.pmod(i, F.lit(n)) if loop else F.greatest(F.least(i, F.lit(n - 1)), F.lit(0))).cast("int")


def window_ahead(frame: Column, ahead: int, n: int, loop: bool = True) -> Column:
    """The frames to hold from this one on."""
    every = F.sequence(frame, frame + min(ahead, n - 1))
    return F.transform(every, lambda i: F.pmod(i, F.lit(n))) if loop else F.filter(every, lambda i: i < n)


def evicted(held: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return held.join(wanted, [*keys, "frame"], "left_anti")


def shown(ticks: DataFrame, decoded: DataFrame, keys: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """ticks (keys, ts, frame) get the frame shown: the wanted one if decoded (keys, frame) has it, else the last shown; stalled says which."""
    rows = ticks.join(decoded.select(*keys, "frame").distinct().withColumn("__have", F.lit(True)), [*keys, "frame"], "left")
    order = W.partitionBy(*keys).orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("__have"), F.col("frame")), ignorenulls=True).over(order)
    return rows.withColumn("shown", last).withColumn("stalled", F.col("__have").isNull()).drop("__have")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(frame, path, fps) of a JSON manifest {fps, frames: [...]}; paths are relative to its folder."""
    rows = spark.read.schema("fps double, frames array<string>").json(path, multiLine=True)
    folder = path.rsplit("/", 1)[0]
    return rows.select(F.coalesce("fps", F.lit(24.0)).alias("fps"), F.posexplode("frames").alias("frame", "p")).select("frame", F.when(F.col("p").rlike("^([a-z0-9]+:)?/"), F.col("p")).otherwise(F.concat(F.lit(folder + "/"), "p")).alias("path"), "fps")


def frames_differ(voxels: DataFrame) -> DataFrame:
    """One row: whether frames differ, by an order-free hash of their active voxels."""
    one = voxels.where("active").groupBy("frame").agg(F.sum(F.xxhash64("x", "y", "z", "value").cast("decimal(38,0)")).alias("h"))
    return one.agg((F.count_distinct("h") > 1).alias("differ"), F.count("*").alias("frames"))
