"""Numbering in a total order, moments, seasonal readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestige.functions import macros as m
from vestige.operators.staging import table_in_shared_folder

GATHERED = ("connection", "device", "device_state", "install", "disk")
NEAR_MS = 15_000


def numbered(df: DataFrame, order: list, name: str, paths: list[str] | None = None) -> DataFrame:
    """df with name = its place in the total order, from 1. Rows are dealt by ranges, sorted, and written once with
    their place in their range, to which the counts of the ranges before are added where they are read: rows move once
    and no task sees all. What is written is added to paths, as table_in_shared_folder does."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = table_in_shared_folder(dealt, paths).withColumn("__part", F.shiftright("__at", 33))  # the task's number, then the row's
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = table_in_shared_folder(counts.select("__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__before")), paths)
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1).drop("__part", "__at", "__before")


def moment_anchors(endpoints: DataFrame, tolerance_ms: int = NEAR_MS, paths: list[str] | None = None) -> DataFrame:
    """Islands of endpoints (physical_device_id, moment_kind, moment_utc, device_key, moment_rule) of a device and
    kind that follow one another within the tolerance: moment_id, their first time, number and rules."""
    w = Window.partitionBy("physical_device_id", "moment_kind").orderBy("moment_utc", "device_key")
    gap = F.lag("moment_utc").over(w).isNull() | (m.millis(F.col("moment_utc")) - m.millis(F.lag("moment_utc").over(w)) > tolerance_ms)
    island = F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    clustered = endpoints.withColumn("begins", gap).withColumn("island", island)
    out = clustered.groupBy("physical_device_id", "moment_kind", "island").agg(F.min("moment_utc").alias("moment_utc"), F.count(F.lit(1)).alias("window_count"), F.array_join(F.array_sort(F.collect_set("moment_rule")), "; ").alias("moment_rules"))
    return numbered(out, ["physical_device_id", "moment_kind", "island"], "moment_id", paths).drop("island")


def moment_members(entries: DataFrame, anchors: DataFrame, tolerance_ms: int = NEAR_MS, kept: tuple[str, ...] = ()) -> DataFrame:
    """(entry_id, moment_id, distance_ms, and kept columns of the entry): each gathered entry's nearest anchor of its device within the tolerance;
    ties go to the smaller moment_id. Times go to slots of the tolerance, anchors to the neighbouring ones too, so a
    device with many entries isn't joined with all its anchors."""
    slot = lambda c: F.floor(m.millis(F.col(c)) / F.greatest(F.lit(1), F.lit(tolerance_ms)))
    near = anchors.select("moment_id", "physical_device_id", "moment_utc", F.explode(F.array(*[slot("moment_utc") + k for k in (-1, 0, 1)])).alias("slot"))
    asked = entries.where((F.col("physical_device_id") != "") & (F.col("epoch_default") == "") & F.col("category").isin(*GATHERED) & F.col("sort_utc").isNotNull()).withColumn("slot", slot("sort_utc"))
    distance = F.abs(m.millis(F.col("moment_utc")) - m.millis(F.col("sort_utc")))
    pair = asked.join(near, ["physical_device_id", "slot"]).select("entry_id", "moment_id", distance.alias("distance_ms"), *kept).where(F.col("distance_ms") <= tolerance_ms)
    best = pair.groupBy("entry_id").agg(F.min(F.struct("distance_ms", "moment_id", *kept)).alias("best"))
    return best.select("entry_id", "best.moment_id", "best.distance_ms", *[f"best.{c}" for c in kept])


def seasonal_candidates(local: DataFrame, bias: int, daylight: int) -> DataFrame:
    """local (id, local_text) with both UTC readings of a wall-clock time; UTC is local plus bias minutes."""
    t = m.local_timestamp(F.col("local_text"))
    return local.select("id", (t + F.expr(f"make_dt_interval(0, 0, {bias})")).alias("standard_utc"), (t + F.expr(f"make_dt_interval(0, 0, {bias + daylight})")).alias("daylight_utc"))
