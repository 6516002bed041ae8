"""File and programme use: records of five kinds, and the devices that they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestige.functions import macros as m
from vestige.functions.macros import seconds
from vestige.operators import sentences as say
from vestige.operators.case import consolidated, listed, said, view
from vestige.operators.facts import Facts
from vestige.operators.timeline import numbered

CONFIDENCES = ("confirmed", "strong", "probable", "possible")
SOLE_HOURS = 24
_ORDER = ("artefact", "path", "drive_letter", "recorded_utc", "volume_serial_hex", "volume_label", "removable", "profile", "detail", "recorded_meaning", "recorded_basis", "recorded_local", "source_file", "source_id")


def confidence_rank(column: str = "confidence"):
    return F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col(column))


def confidence_of(rank):
    return F.get(F.array(*map(F.lit, CONFIDENCES)), rank.cast("int") - 1)


class Activity(Facts):
    @view
    def _activity_rows(self) -> DataFrame:
        text, none = F.lit(""), F.lit(None)

        def arm(df, artefact, detail, path, basis, meaning, recorded=none, path_basis=None, letter=text, serial=text, label=text, removable=none, profile=F.col("profile"), at="key_last_write_utc", local=none, source_file=text):  # noqa: B008
            return df.select(
                artefact.alias("artefact"), detail.alias("detail"), path.alias("path"), (F.lit("recorded") if path_basis is None else path_basis).alias("path_basis"), letter.alias("drive_letter"), serial.alias("volume_serial_hex"), label.alias("volume_label"), removable.cast("boolean").alias("removable"), profile.alias("profile"),
                (recorded if at is None else F.col(at)).alias("recorded_utc"), basis.alias("recorded_basis"), meaning.alias("recorded_meaning"), local.cast("string").alias("recorded_local"), "source_id", source_file.alias("source_file"),
            )

        located = lambda c: F.when(m.is_location(F.col(c)), F.col(c))
        key = F.coalesce(F.concat(F.lit(" · "), said("registry_path")), text)
        file = F.coalesce("source_path", text)

        t = self.table("file_target")
        path = F.coalesce(said("path"), located("target_item_path"), located("relative_path"))
        path_basis = F.when(F.col("path") != "", "link_info").when(m.is_location(F.col("target_item_path")), "shell_items").when(m.is_location(F.col("relative_path")), "relative_path").otherwise("none")
        opened = F.col("last_access_utc").isNotNull() | (F.col("source_modified_utc").isNotNull() & F.col("link_context").isin("recent", "office_recent"))
        basis = F.when(opened, "instant").when(F.col("source_modified_utc").isNotNull(), "link_written").when(F.col("target_written_utc").isNotNull(), "target_metadata").otherwise("none")
        recent = F.col("link_context").isin("recent", "office_recent")
        context = F.coalesce(said("link_context"), F.lit(say.UNRECORDED))
        meaning = (
            F.when(F.col("last_access_utc").isNotNull(), say.OPENED).when(F.col("source_modified_utc").isNotNull() & recent, say.column(say.REWRITTEN, context=F.col("link_context"))).when(F.col("source_modified_utc").isNotNull(), say.column(say.WRITTEN, context=context))
            .when(F.col("target_written_utc").isNotNull(), say.TARGET).when(F.col("raw_target_written") == 119600064000000000, say.FAT).otherwise(say.NO_TIME)
        )
        app = F.when((F.col("origin") == "jump_list") & (F.col("app_id") != ""), F.concat(F.lit("app "), "app_id")).otherwise("")
        targets = arm(
            t.where(path.isNotNull() | (F.col("drive_letter") != "")), F.col("origin"), app, path, basis, meaning, F.coalesce("last_access_utc", "source_modified_utc", "target_written_utc"), path_basis, F.col("drive_letter"), F.col("volume_serial_hex"), F.col("volume_label"), F.col("removable"), at=None,
            source_file=F.col("source_file"),
        )
        bags = arm(self.shell_bag().where("path <> ''"), F.lit("shell_bag"), F.concat(F.col("hive"), F.lit(" bag, depth "), F.col("depth").cast("string"), key), F.col("path"), F.lit("instant"), F.lit(say.BAG), letter=F.col("drive_letter"), local=F.col("modified_local"), source_file=file)
        shown = F.when(F.col("letter_from_name"), F.concat(F.lit(" · "), F.col("drive_letter"), F.lit(": read from the name the shell displayed"))).otherwise("")
        lists = arm(
            self.mru_entry().where("path <> '' or name <> ''"), F.lit("mru"), F.concat(F.col("source_list"), key, shown), F.coalesce(said("path"), F.col("name")), F.when(F.col("position") == 0, "instant").otherwise("not_after_bound"), F.when(F.col("position") == 0, say.LISTED_FIRST).otherwise(say.column(say.LISTED, position=F.col("position"))), letter=F.col("drive_letter"), label=F.col("volume_label"),
            local=F.col("modified_local"), source_file=file,
        )
        dated = lambda c: F.when(F.col(c).isNotNull(), "instant").otherwise("none")
        launches = F.when(F.col("run_count") > 0, F.concat(F.lit("; launched "), F.col("run_count").cast("string"), F.lit(" time(s)"))).otherwise("; no launch recorded")
        focus = F.when(F.col("focus_count") > 0, F.concat(F.lit("; focused "), F.col("focus_count").cast("string"), F.lit(" time(s) for "), F.round("focus_seconds", 1).cast("string"), F.lit("s"))).otherwise("")
        assists = arm(self.user_assist().where("not bookkeeping and name <> ''"), F.lit("user_assist"), F.concat(F.coalesce(said("category_name"), F.col("category")), launches, focus), F.col("name"), dated("last_executed_utc"), F.when(F.col("last_executed_utc").isNotNull(), say.LAUNCHED).otherwise(say.NOT_LAUNCHED), letter=F.col("drive_letter"), at="last_executed_utc", source_file=file)
        r = self.table("prefetch_run").join(self._run_times().select("source_file", "last_run_utc"), "source_file", "left").join(self.prefetch_run_volume().select("source_file", F.col("volume_serial_hex").alias("serial")), "source_file", "left")
        rooted = F.startswith("executable_path", F.lit("\\"))
        package = F.when((F.col("executable_path") != "") & ~rooted, F.concat(F.lit("; package "), "executable_path")).otherwise("")
        runs = F.concat(F.lit("ran "), F.col("run_count").cast("string"), F.lit(" time(s); "), F.col("times_recorded").cast("string"), F.lit(" execution(s) still recorded"), package)
        prefetch = arm(r, F.lit("prefetch"), runs, F.when(rooted, F.col("executable_path")).otherwise(F.col("executable")), dated("last_run_utc"), F.when(F.col("last_run_utc").isNotNull(), say.EXECUTED).otherwise(say.NOT_EXECUTED), serial=F.coalesce("serial", text), profile=text, at="last_run_utc", source_file=F.col("source_file"))
        return targets.unionByName(bags).unionByName(lists).unionByName(assists).unionByName(prefetch)

    @view
    def file_activity(self) -> DataFrame:
        """Every record of use: where, when, and what its time stands for (recorded_basis)."""
        rows = numbered(self._activity_rows(), [F.col(c).asc_nulls_last() for c in _ORDER], "activity_id", self._written)
        return rows.withColumn("recorded_places", F.col("recorded_basis").isin("instant", "link_written")).withColumn("recorded_bounds_only", F.col("recorded_basis") == "not_after_bound")

    @view
    def letter_activity(self) -> DataFrame:
        return self.file_activity().where("drive_letter <> ''").select("drive_letter", "artefact", "detail", "path", "path_basis", "profile", "recorded_utc", "recorded_local", "recorded_basis", "recorded_meaning")

    @view
    def removable_volume(self) -> DataFrame:
        instant = F.col("recorded_basis") == "instant"
        at = F.when(instant, F.col("recorded_utc"))
        return self.file_activity().where("removable").groupBy("volume_serial_hex", "volume_label", "drive_letter").agg(
            F.count(F.lit(1)).alias("target_count"), F.count_distinct("path").alias("distinct_paths"), F.count_distinct("profile").alias("profiles"), F.min(at).alias("first_interaction_utc"), F.max(at).alias("last_interaction_utc"), F.count_if(~instant).alias("undated_records")
        )

    @view
    def removable_device(self) -> DataFrame:
        has = lambda fact: self._held().where(F.col("fact") == fact).select("physical_device_id")
        return self.device_group().select("device_key", "physical_device_id").join(has("storage_identity"), "physical_device_id", "left_semi").join(has("usb_attached"), "physical_device_id", "left_semi")

    @view
    def removable_letter(self) -> DataFrame:
        linked = self.device_volume_link().where("drive_letter <> ''").join(self.removable_device().select("device_key"), "device_key", "left_semi").select("drive_letter")
        return self.table("file_target").where("removable and drive_letter <> ''").select("drive_letter").union(linked).distinct()

    @consolidated
    def sole_connected_device(self) -> DataFrame:
        """Records on removable media made while exactly one removable device was connected, at most SOLE_HOURS after
        it arrived: activity_id, device_key, device_instance_id, started_utc, connected_devices.

        Arrivals and departures are swept along time: the running number of connected devices, and the running sums
        of their numbers and arrivals, which where there is one device are its own. Days are swept apart and take over
        the sums of the days before."""
        limit = F.col("started_utc") + F.expr(f"INTERVAL {SOLE_HOURS} HOURS")
        w = self.connection_placing().join(self.removable_device().select("device_key"), "device_key", "left_semi").select("device_key", "device_instance_id", "started_utc", F.least(F.coalesce("places_until_utc", limit), limit).alias("until")).where("until >= started_utc")
        # Windows of a device that touch are one.
        order = Window.partitionBy("device_key").orderBy("started_utc")
        w = w.withColumn("begins", F.coalesce(F.col("started_utc") > F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
        w = w.withColumn("island", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        w = w.groupBy("device_key", "island").agg(F.min("device_instance_id").alias("device_instance_id"), F.min("started_utc").alias("started_utc"), F.max("until").alias("until"))
        w = w.withColumn("number", F.xxhash64("device_key").cast("decimal(20,0)")).withColumn("arrived", F.unix_micros(F.col("started_utc").cast("timestamp")).cast("decimal(20,0)"))

        a = self.file_activity().where("recorded_utc is not null and recorded_places")
        letters = self.removable_letter().withColumn("by_letter", F.lit(True))
        serials = self.serial_letter().select("volume_serial_hex").distinct().withColumn("by_serial", F.lit(True))
        a = a.join(letters, "drive_letter", "left").join(serials, "volume_serial_hex", "left").where("removable or by_letter or by_serial").select("activity_id", F.col("recorded_utc").alias("t"))

        zero = F.lit(0).cast("decimal(20,0)")
        step = lambda sign, at, o: w.select(F.col(at).alias("t"), F.lit(o).alias("o"), F.lit(sign).alias("n"), (F.col("number") * sign).alias("number"), (F.col("arrived") * sign).alias("arrived"), F.lit(None).cast("long").alias("activity_id"))
        rows = step(1, "started_utc", 0).unionByName(step(-1, "until", 2)).unionByName(a.select("t", F.lit(1).alias("o"), F.lit(0).alias("n"), zero.alias("number"), zero.alias("arrived"), "activity_id")).withColumn("day", F.to_date("t"))
        sums = ("n", "number", "arrived")
        before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        carried = rows.groupBy("day").agg(*[F.sum(c).alias(c) for c in sums]).select("day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
        within = Window.partitionBy("day").orderBy("t", "o", "activity_id").rowsBetween(Window.unboundedPreceding, 0)
        swept = rows.select("day", "activity_id", *[F.sum(c).over(within).alias(c) for c in sums]).where("activity_id is not null").join(F.broadcast(carried), "day")
        alone = swept.where("n + n_before = 1").select("activity_id", (F.col("number") + F.col("number_before")).cast("decimal(38,0)").alias("number"), (F.col("arrived") + F.col("arrived_before")).cast("decimal(38,0)").alias("arrived"))
        return alone.join(w.select(F.col("number").cast("decimal(38,0)").alias("number"), F.col("arrived").cast("decimal(38,0)").alias("arrived"), "device_key", "device_instance_id", "started_utc"), ["number", "arrived"]).select("activity_id", "device_key", "device_instance_id", "started_utc", F.lit(1).cast("long").alias("connected_devices"))

    @view
    def activity_label_device(self) -> DataFrame:
        labelled = self.device_volume_link().where("route = 'portable_device_label'").select(F.upper("volume_label").alias("label"), "device_key").distinct()
        one = labelled.groupBy("label").agg(F.min("device_key").alias("device_key"), F.count(F.lit(1)).alias("devices"))
        return self.file_activity().where("volume_label <> ''").select("activity_id", F.upper("volume_label").alias("label")).join(one, "label").select("activity_id", "device_key", "devices")

    @view
    def letter_contradicted(self) -> DataFrame:
        linked = self.device_volume_link().where("drive_letter <> ''").select("drive_letter", "device_key").distinct()
        a = self.file_activity().where("drive_letter <> ''").select("activity_id", "drive_letter").join(self.activity_label_device().where("devices = 1"), "activity_id")
        return a.join(linked, "drive_letter", "left_semi").join(linked, ["drive_letter", "device_key"], "left_anti").select("activity_id", F.col("device_key").alias("label_device_key"))

    @consolidated
    def file_attribution(self) -> DataFrame:
        """Every route from a record to a device, nothing collapsed. Whether a connection window covers a record is
        looked up once for each record and device."""
        a = self.file_activity().select("activity_id", "artefact", "path", "drive_letter", "volume_serial_hex", "volume_label", "profile", "recorded_utc", "recorded_places", "recorded_basis", "source_id", "source_file")
        links = self.device_volume_link().select("device_key", "device_instance_id", "drive_letter", F.upper("volume_label").alias("label"), "route")
        hop = ["via_letter", "via_label", "via_route", "several", "arrived"]  # what only some routes go by
        blank = {c: F.lit(None).cast("boolean" if c == "several" else "timestamp_ntz" if c == "arrived" else "string") for c in hop}
        row = lambda df, route, contradicted, rule: df.select(*a.columns, "device_key", "device_instance_id", route.alias("route"), contradicted.alias("contradicted"), F.lit(rule).alias("rule"), *[(F.col(c) if c in df.columns else blank[c]).alias(c) for c in hop])
        no = F.lit(False)
        e = self.table("emd_volume").where("device_key <> '' and volume_serial_decimal <> ''").select(F.lpad(F.hex(F.col("volume_serial_decimal").cast("long")), 8, "0").alias("serial"), "device_key", "device_instance_id")
        by_serial = row(a.where("volume_serial_hex <> ''").withColumn("serial", F.upper(F.replace("volume_serial_hex", F.lit("-"), F.lit("")))).join(e, "serial"), F.lit("volume_serial_emdmgmt"), no, "serial")
        named = links.where("route = 'portable_device_label'").select("label", "device_key", "device_instance_id")
        by_label = row(a.where("volume_label <> ''").withColumn("label", F.upper("volume_label")).join(named, "label"), F.lit("volume_label_unique"), no, "label")
        lettered = links.where("drive_letter <> ''").select("drive_letter", "device_key", "device_instance_id", "route")
        x = self.letter_contradicted().select("activity_id", F.lit(True).alias("against"))
        by_letter = row(a.where("drive_letter <> ''").join(lettered, "drive_letter").join(x, "activity_id", "left"), F.concat(F.lit("drive_letter_"), "route"), F.coalesce("against", no), "letter")
        p = self.prefetch_device_link().select("source_file", "volume_serial_hex", "device_key", "device_instance_id", "letter_contradicted", F.col("drive_letter").alias("via_letter"), F.col("volume_label").alias("via_label"), F.col("volume_route").alias("via_route"), F.col("serial_reaches_several_letters").alias("several"))
        by_run = row(a.where("artefact = 'prefetch' and volume_serial_hex <> ''").join(p, ["source_file", "volume_serial_hex"]), F.lit("volume_serial_prefetch"), F.col("letter_contradicted"), "prefetch")
        by_sole = row(a.join(self.sole_connected_device().select("activity_id", "device_key", "device_instance_id", F.col("started_utc").alias("arrived")), "activity_id"), F.lit("sole_connected_device"), no, "sole")
        out = by_serial.unionByName(by_label).unionByName(by_letter).unionByName(by_run).unionByName(by_sole)
        out = self.covered(out, "recorded_utc")
        placed = F.col("covered") & F.col("recorded_places")
        confidence = (
            F.when(F.col("rule") == "serial", "confirmed").when(F.col("rule") == "sole", "probable").when(F.col("contradicted"), "possible")
            .when(F.col("rule") == "prefetch", F.when(F.col("covered"), "strong").otherwise("probable")).otherwise(F.when(placed, "probable").otherwise("possible"))
        )
        basis, rule = F.col("recorded_basis"), F.col("rule")
        by_time = lambda bound, target, covered, alone: F.when(basis == "not_after_bound", bound).when(basis == "target_metadata", target).when(F.col("covered"), covered).otherwise(alone)
        empty = F.lit("")
        by_prefetch = F.concat(
            say.column(say.PREFETCH, letter=F.col("via_letter"), route=F.col("via_route")), F.when(F.col("contradicted"), say.column(say.PREFETCH_AGAINST, label=F.col("via_label"))).otherwise(empty),
            F.when(F.col("covered"), say.PREFETCH_COVERED).otherwise(say.PREFETCH_ALONE), F.when(F.col("several"), say.PREFETCH_SEVERAL).otherwise(empty),
        )
        detail = (
            F.when(rule == "serial", say.SERIAL).when(rule == "label", by_time(say.LABEL_BOUND, say.LABEL_TARGET, say.LABEL_COVERED, say.LABEL)).when((rule == "letter") & F.col("contradicted"), say.LETTER_AGAINST)
            .when(rule == "letter", by_time(say.LETTER_BOUND, say.LETTER_TARGET, say.LETTER_COVERED, say.LETTER)).when(rule == "prefetch", by_prefetch)
            .otherwise(say.column(say.SOLE, arrived=F.date_format("arrived", "yyyy-MM-dd HH:mm:ss"), seconds=seconds(F.col("recorded_utc")) - seconds(F.col("arrived"))))
        )
        return out.withColumns({"confidence": confidence, "detail": detail}).drop("rule", "covered", "recorded_places", "recorded_basis", "source_file", *hop)

    @view
    def file_attribution_summary(self) -> DataFrame:
        f = self.file_attribution().groupBy("activity_id").agg(F.count_distinct("device_key").alias("candidate_devices"), F.count("route").alias("routes"), F.min(confidence_rank()).alias("best"), listed("device_instance_id", "; ").alias("devices"), listed("route", "; ").alias("routes_used"))
        a = self.file_activity().select("activity_id", "artefact", "path", "drive_letter", "volume_serial_hex", "volume_label", "recorded_utc")
        out = a.join(f, "activity_id", "left").na.fill(0, ["candidate_devices", "routes"])
        return out.withColumn("best_confidence", F.coalesce(confidence_of(F.col("best")), F.lit("unattributed"))).drop("best")

    @consolidated
    def attributed(self) -> DataFrame:
        """One device a record: the one that alone is reached best, contradicted routes last (activity_id, candidates,
        best_candidates, device_key, confidence)."""
        rank = confidence_rank()
        each = self.file_attribution().groupBy("activity_id", "device_key").agg(F.min(rank).alias("rank"), F.min(F.when(F.col("contradicted"), 5).otherwise(rank)).alias("contest"))
        best = each.groupBy("activity_id").agg(F.min("contest").alias("best"), F.count(F.lit(1)).alias("candidates"))
        top = each.join(best, "activity_id").where("contest = best").groupBy("activity_id").agg(F.max("candidates").alias("candidates"), F.count(F.lit(1)).alias("best_candidates"), F.min("device_key").alias("device_key"), F.min("rank").alias("rank"))
        return top.select("activity_id", "candidates", "best_candidates", "device_key", confidence_of(F.col("rank")).alias("confidence"))
