"""When devices were connected and the host was on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestige.functions.macros import millis, seconds
from vestige.operators.asof import as_of, beside
from vestige.operators.case import consolidated, view
from vestige.operators.inventory import Inventory

# Session records by rule; the gap that begins a state anew; how near a departure corroborates.
SESSION_STATES = {
    "System:EventLog:6005": "started", "System:Microsoft-Windows-Kernel-General:12": "started", "System:Microsoft-Windows-Kernel-Power:107": "woke", "System:EventLog:6006": "stopped", "System:Microsoft-Windows-Kernel-General:13": "stopped",
    "System:EventLog:6008": "stopped_unexpectedly", "System:Microsoft-Windows-Kernel-Power:41": "stopped_unexpectedly", "System:Microsoft-Windows-Kernel-Power:42": "slept", "System:User32:1074": "stop_requested", "System:EventLog:6013": "running",
}
GAP_MS, NEAR_SECONDS = 15_000, 120


def supporting_records(windows: DataFrame, changes: DataFrame) -> DataFrame:
    """windows with the number of state changes within each, ends included. A device's changes are numbered in
    order and each window takes a difference of two running counts, so no pair of window and change is formed."""
    inner = changes.select("device_key", F.col("time_utc").alias("t"), F.lit(1).alias("k"), F.lit(0).alias("o"))
    low = windows.select("device_key", F.col("started_utc").alias("t")).where("t is not null").distinct().select("*", F.lit(0).alias("k"), F.lit(-1).alias("o"))
    high = windows.select("device_key", F.coalesce("ended_utc", "ended_before_utc").alias("t")).where("t is not null").distinct().select("*", F.lit(0).alias("k"), F.lit(1).alias("o"))
    running = Window.partitionBy("device_key").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    counted = inner.union(low).union(high).select("device_key", "t", "o", F.sum("k").over(running).alias("c"))
    total = changes.groupBy("device_key").agg(F.count(F.lit(1)).alias("total"))
    before = counted.where("o = -1").select("device_key", F.col("t").alias("started_utc"), F.col("c").alias("before"))
    upto = counted.where("o = 1").select("device_key", F.col("t").alias("until"), F.col("c").alias("upto"))
    w = windows.withColumn("until", F.coalesce("ended_utc", "ended_before_utc"))
    out = w.join(before, ["device_key", "started_utc"], "left").join(upto, ["device_key", "until"], "left").join(total, "device_key", "left")
    return out.select(*windows.columns, (F.coalesce("upto", "total") - F.coalesce("before", F.lit(0))).alias("supporting_records"))


class Presence(Inventory):
    def field(self, role: str) -> DataFrame:
        """(source_id, record_id, <role>): the least value where a record has several."""
        return self.table("event_field").where(F.col("role") == role).groupBy("source_id", "record_id").agg(F.min("value").alias(role))

    @consolidated
    def device_state_change(self) -> DataFrame:
        e = self.event().where("kind in ('connect', 'disconnect') and device_key <> ''").join(self.field("problem_code"), ["source_id", "record_id"], "left").na.fill("", ["problem_code"])
        state = F.when(F.col("kind") == "connect", "arrival").otherwise("departure")
        return e.where("event_id <> 420 or problem_code = '45'").select("device_key", "device_instance_id", "time_utc", state.alias("state"), "channel", "event_id", "rule_id", "meaning", "record_id", "source_id", "problem_code")

    @view
    def disk_departure_candidate(self) -> DataFrame:
        """Disks that were described without capacity, and whether a departure of the same device lies near."""
        e = self.event().where("event_id = 1006 and time_utc is not null and device_key <> ''").join(self.field("capacity"), ["source_id", "record_id"], "left")
        e = e.where(F.trim(F.coalesce("capacity", F.lit(""))).isin("0", "0x0")).select("device_key", "device_instance_id", "time_utc", "channel", "record_id", "source_id", "source_path")
        group = self.device_group().select("device_key", "physical_device_id")
        slot = lambda c: F.floor(seconds(F.col(c)) / NEAR_SECONDS)
        left = self.device_state_change().where("state = 'departure'").join(group, "device_key").select("physical_device_id", seconds(F.col("time_utc")).alias("left_at"), F.explode(F.array(*[slot("time_utc") + k for k in (-1, 0, 1)])).alias("slot"))
        asked = e.select("device_key", "time_utc").distinct().join(group, "device_key").withColumn("slot", slot("time_utc"))
        near = asked.join(left, ["physical_device_id", "slot"]).where(F.abs(F.col("left_at") - seconds(F.col("time_utc"))) <= NEAR_SECONDS).select("device_key", "time_utc", F.lit(True).alias("near")).distinct()
        return e.join(near, ["device_key", "time_utc"], "left").withColumn("corroborated_by_a_recorded_departure", F.coalesce("near", F.lit(False))).drop("near")

    @view
    def session_event(self) -> DataFrame:
        states = F.create_map(*[F.lit(x) for kv in SESSION_STATES.items() for x in kv])
        e = self.event().where("kind = 'session' and time_utc is not null")
        return e.select("time_utc", F.element_at(states, F.col("rule_id")).alias("state"), "channel", "provider", "event_id", "rule_id", "meaning", "record_id", "source_id", "source_path")

    @view
    def host_stopped(self) -> DataFrame:
        return self.session_event().where("state = 'stopped'").select("time_utc", "state", "rule_id", "record_id", "source_id", "source_path")

    @consolidated
    def host_unclean_stop(self) -> DataFrame:
        """Unexpected stops: the boot that reported it, if no clean stop lies between, and the last sign of life
        before that boot."""
        s = self.session_event()
        told = s.where("state = 'stopped_unexpectedly'").select(F.col("time_utc").alias("reported_utc"), "rule_id", "record_id", "source_id", "source_path")
        boot = as_of(told, "reported_utc", s.where("state in ('started', 'woke')"), "time_utc", F.col("time_utc"), []).withColumnRenamed("found", "candidate")
        stop = as_of(told, "reported_utc", s.where("state = 'stopped'"), "time_utc", F.col("time_utc"), [], strict=True).withColumnRenamed("found", "stop")
        told = told.join(boot, "reported_utc", "left").join(stop, "reported_utc", "left")
        told = told.withColumn("boot_associated", F.col("candidate").isNotNull() & (F.col("stop").isNull() | (F.col("stop") <= F.col("candidate")))).withColumn("boot_utc", F.when(F.col("boot_associated"), F.col("candidate")))
        life = as_of(told, "boot_utc", self.table("event"), "time_utc", F.col("time_utc"), [], strict=True).withColumnRenamed("found", "stopped_after_utc")
        return told.join(life, "boot_utc", "left").select("reported_utc", "boot_associated", "boot_utc", F.coalesce("boot_utc", "reported_utc").alias("stopped_before_utc"), "stopped_after_utc", "rule_id", "record_id", "source_id", "source_path")

    @consolidated
    def connection(self) -> DataFrame:
        """Windows in which a device was connected, what ended them, and what bounds those that nothing ended."""
        changes = self.device_state_change()
        w = beside(changes, ["device_key"], "time_utc", ["record_id"], F.struct("state", "time_utc"), "was")
        w = w.where(F.col("was").isNull() | (F.col("was.state") != F.col("state")) | (millis(F.col("time_utc")) - millis(F.col("was.time_utc")) > GAP_MS))
        w = beside(w, ["device_key"], "time_utc", ["record_id"], F.struct("state", "time_utc", "rule_id", "record_id"), "next", ahead=True)
        arrival, gone = F.col("state") == "arrival", F.col("next.state") == "departure"
        w = w.where(arrival | F.col("was").isNull())
        pick = lambda opened, closing: F.when(arrival, opened).otherwise(closing)
        none = F.lit(None)
        w = w.select(
            "device_key", "device_instance_id", pick(F.col("time_utc"), none).alias("started_utc"), pick(F.when(gone, F.col("next.time_utc")), F.col("time_utc")).alias("ended_utc"), pick(F.when(F.col("next.state") == "arrival", F.col("next.time_utc")), none).alias("ended_before_utc"), arrival.alias("start_known"),
            pick(F.col("rule_id"), F.lit("")).alias("opened_by"), pick(F.when(gone, F.col("next.rule_id")), F.col("rule_id")).alias("closed_by"), pick(F.col("record_id"), none).alias("opened_by_record"), pick(F.when(gone, F.col("next.record_id")), F.col("record_id")).alias("closed_by_record"), "source_id",
        )
        open_ = F.col("ended_utc").isNull() & F.col("ended_before_utc").isNull()
        asked = w.where(open_)
        unclean = self.host_unclean_stop()
        clean = as_of(asked, "started_utc", self.host_stopped(), "time_utc", F.col("time_utc"), [], ahead=True, strict=True).withColumnRenamed("found", "clean")
        broken = as_of(asked, "started_utc", unclean, "stopped_after_utc", F.struct("reported_utc", "record_id", "stopped_after_utc", "stopped_before_utc"), [], ahead=True, strict=True).withColumnRenamed("found", "broken")
        undated = unclean.where("not boot_associated").agg(F.max("reported_utc").alias("undated"))
        w = w.join(clean, "started_utc", "left").join(broken, "started_utc", "left").crossJoin(F.broadcast(undated))
        w = w.select(
            *[c for c in w.columns if c not in ("clean", "broken", "undated")], F.col("ended_utc").isNull().alias("open_ended"), (seconds(F.col("ended_utc")) - seconds(F.col("started_utc"))).alias("span_seconds"), F.when(open_, F.col("clean")).alias("host_stopped_utc"),
            F.when(open_, F.col("broken.stopped_after_utc")).alias("host_stopped_after_utc"), F.when(open_, F.col("broken.stopped_before_utc")).alias("host_stopped_before_utc"), F.when(open_, F.coalesce(F.col("undated") > F.col("started_utc"), F.lit(False))).alias("host_stopped_undated"),
        )
        return supporting_records(w, changes)

    @view
    def connection_placing(self) -> DataFrame:
        until = F.coalesce("ended_utc", F.least("host_stopped_utc", "host_stopped_after_utc"))
        return self.connection().where("start_known and started_utc is not null and ended_before_utc is null").withColumn("places_until_utc", until)

    @view
    def connection_endpoint(self) -> DataFrame:
        c = self.connection().join(self.device_group().select("device_key", "physical_device_id"), "device_key")
        end = lambda df, kind, at, rule: df.select("physical_device_id", F.lit(kind).alias("moment_kind"), F.col(at).alias("moment_utc"), "device_key", F.col(rule).alias("moment_rule"))
        return end(c.where("started_utc is not null and start_known"), "arrival", "started_utc", "opened_by").unionByName(end(c.where("ended_utc is not null"), "removal", "ended_utc", "closed_by"))

    def covered(self, asked: DataFrame, at: str) -> DataFrame:
        """asked (with device_key and a time) with covered: whether a placing window of the device holds the time.
        A device's placing windows don't overlap, so the last that began decides."""
        last = as_of(asked, at, self.connection_placing(), "started_utc", F.struct(F.coalesce("places_until_utc", F.lit("9999-12-31").cast("timestamp_ntz")).alias("until")), ["device_key"])
        return asked.join(last, ["device_key", at], "left").withColumn("covered", F.coalesce(F.col("found.until") >= F.col(at), F.lit(False))).drop("found")
