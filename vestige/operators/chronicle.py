"""The timeline, the moments that its entries gather round, and the report's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestige.functions import macros as m
from vestige.operators import sentences as say
from vestige.operators import timeline
from vestige.operators.activity import Activity, confidence_of, confidence_rank
from vestige.operators.case import consolidated, listed, listed_by, said, view, with_source
from vestige.operators.timeline import numbered

SHOWN_TIER = 2
#: Items of a finding that the report shows.
MOST_ITEMS = 200
_FIELDS = {
    "friendly_name": "friendly_name", "device_description": "device_desc", "bus_reported_description": "bus_reported_desc", "manufacturer": "mfg", "serial": "serial", "device_class": "class", "driver_service": "service", "hardware_id": "hardware_id", "compatible_ids": "compatible_ids", "container_id": "container_id",
    "location": "location_information",
}
_ENTRY_ORDER = ("sort_utc", "category", "event", "device_key", "path", "time_utc", "time_utc_alt", "time_local", "time_basis", "meaning", "drive_letter", "profile", "confidence", "artefact", "detail", "record_id", "source_id", "source_path")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _after(mark: str, column: str, end: str = "") -> Column:
    """mark and the value, nothing where that is empty."""
    return F.coalesce(_text(mark, said(column), end), F.lit(""))


class Chronicle(Activity):
    # -------------------------------------------------------------- timeline

    def _arms(self) -> list[DataFrame]:
        text, no_time, no_record = F.lit(""), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("long")

        def arm(df, category, event, at, meaning, detail, artefact, local=text, device=text, letter=text, path=text, profile=text, confidence=F.lit("confirmed"), record=no_record, source_path=F.col("source_path")):  # noqa: B008
            lit = lambda x: F.lit(x) if isinstance(x, str) else x
            values = {"category": lit(category), "event": lit(event), "meaning": lit(meaning), "recorded": no_time if at is None else F.col(at), "time_local": local, "device_key": device, "drive_letter": letter, "path": path, "profile": profile, "confidence": confidence, "artefact": lit(artefact), "detail": detail, "record_id": record.cast("long")}
            return df.select(*[v.alias(k) for k, v in values.items()], "source_id", F.coalesce(source_path, text).alias("source_path"))

        key, letter, profile = F.col("device_key"), F.col("drive_letter"), F.col("profile")
        source = self.table("source")
        e = self.event().where("time_utc is not null and kind not in ('connect', 'disconnect')")
        blank = self.disk_departure_candidate().select("record_id", "source_id", F.lit(True).alias("without")).distinct()
        e = e.join(blank, ["record_id", "source_id"], "left")
        what = F.when(F.col("without"), say.NO_CAPACITY).otherwise(F.coalesce(said("meaning"), say.column(say.RECORDED, channel=F.col("channel"))))
        arms = [arm(e, F.when(F.col("kind").isin("session", "logon"), F.col("kind")).otherwise("device"), F.col("kind"), "time_utc", what, _text(F.col("channel"), " event ", F.col("event_id"), _after(" (", "rule_id", ")")), "windows_event_log", device=key, record=F.col("record_id"))]
        c = with_source(self.connection(), source, source_path="path")
        ending = (
            F.when(F.col("ended_before_utc").isNotNull(), say.column(say.SUPERSEDED, at=F.col("ended_before_utc"))).when(F.col("host_stopped_utc").isNotNull(), say.column(say.SHUT_DOWN, at=F.col("host_stopped_utc")))
            .when(F.col("host_stopped_after_utc").isNotNull(), say.column(say.BROKE_OFF, after=F.col("host_stopped_after_utc"), before=F.col("host_stopped_before_utc"))).when(F.col("host_stopped_undated"), say.UNDATED).when(F.col("open_ended"), say.OPEN)
            .otherwise(say.column(say.ENDED, seconds=F.col("span_seconds")))
        )
        arms.append(arm(c.where("started_utc is not null"), "connection", "device_connected", "started_utc", say.CONNECTED, F.concat(say.column(say.OPENED_BY, opened_by=F.col("opened_by"), records=F.col("supporting_records")), ending), "connection_window", device=key, record=F.col("opened_by_record")))
        unknown = F.when(F.col("start_known"), "").otherwise("; no arrival was recorded before it, so the device was already connected when the evidence begins")
        arms.append(arm(c.where("ended_utc is not null"), "connection", "device_removed", "ended_utc", say.REMOVED, _text("closed by ", F.col("closed_by"), unknown), "connection_window", device=key, record=F.col("closed_by_record")))
        s = self.table("setup_section").where("start_local <> '' and device_key <> ''")
        arms.append(arm(s, "install", _text("setupapi.", F.col("kind")), None, say.SECTION, _text(F.col("operation"), _after(" — exit ", "exit_status"), _after("; ", "problem")), "setupapi_log", local=F.col("start_local"), device=key, record=F.col("line_number"), source_path=F.col("source_file")))
        for event, column, means in (("first_install_date", "first_install_date_utc", say.FIRST_INSTALL), ("driver_install_date", "install_date_utc", say.DRIVER_INSTALL), ("last_arrival_date", "last_arrival_date_utc", say.ARRIVAL), ("last_removal_date", "last_removal_date_utc", say.REMOVAL)):
            arms.append(arm(self.device_lifecycle().where(f"{column} is not null"), "device_state", event, column, means, _text("control set ", F.col("control_set")), "registry_devnode", device=key))
        arms.append(arm(self.devnode().where("device_key <> '' and key_last_write_utc is not null"), "device_state", "registry_key_written", "key_last_write_utc", say.KEY_WRITTEN, F.col("registry_key"), "registry_devnode", device=key))

        named = self.attributed().select("activity_id", F.col("device_key").alias("reached"), "candidates", "best_candidates", F.col("confidence").alias("sure"))
        one = F.when(F.col("best_candidates") == 1, F.col("reached")).otherwise("")
        rivals = F.when(F.col("best_candidates") > 1, _text("; ", F.col("best_candidates"), " devices reached with equal confidence, so none is named")).when(F.col("candidates") > 1, _text("; ", F.col("candidates"), " candidate devices, and this is the one the strongest route reached")).otherwise("")
        sure = F.coalesce("sure", F.lit("unattributed"))
        a = self.file_activity().where("recorded_utc is not null and artefact <> 'prefetch'").join(named, "activity_id", "left")
        kind, basis = F.col("artefact"), F.col("recorded_basis")
        what = (
            F.when(kind == "user_assist", "program_launched").when((basis == "not_after_bound") & (kind == "mru"), "file_listed_no_later_than").when(basis == "not_after_bound", "record_no_later_than").when(kind == "shell_bag", "shell_bag_key_written").when(kind == "mru", "mru_key_written")
            .when(basis == "target_metadata", "target_file_written").when(basis == "link_written", "shortcut_written").when(kind.isin("shell_link", "jump_list"), "file_opened").otherwise("file_listed")
        )
        arms.append(arm(a, F.when(kind == "user_assist", "execution").otherwise("file"), what, "recorded_utc", F.col("recorded_meaning"), _text(F.col("detail"), rivals), kind, device=one, letter=letter, path=F.col("path"), profile=profile, confidence=sure, source_path=F.col("source_file")))
        runs = self.table("prefetch_run").select("source_file", F.when(F.startswith("executable_path", F.lit("\\")), F.col("executable_path")).otherwise(F.col("executable")).alias("path"), "run_count", "times_recorded")
        x = self.table("prefetch_execution").where("time_utc is not null").join(runs, "source_file").join(self.file_activity().where("artefact = 'prefetch'").select("source_file", "activity_id").join(named, "activity_id", "left"), "source_file", "left")
        slot = _text("slot ", F.col("slot"), " of ", F.col("times_recorded"), " recorded; Windows counts ", F.col("run_count"), " execution(s) of this programme in total", rivals)
        arms.append(arm(x, "execution", "program_executed", "time_utc", F.when(F.col("slot") == 1, say.RUN_LATEST).otherwise(say.RUN_EARLIER), slot, "prefetch", device=one, path=F.col("path"), confidence=sure, source_path=F.col("source_file")))

        where = _after(" · ", "registry_path")
        item = lambda df, path, artefact, detail, local, source_path, means=say.ITEM: arm(df, "file", "shell_item_modified", None, means, detail, artefact, local=F.col(local), letter=letter, path=path, profile=profile, confidence=F.lit("unattributed"), source_path=source_path)
        arms.append(item(self.shell_bag().where("modified_local <> '' and path <> ''"), F.col("path"), "shell_bag", _text(F.col("hive"), " bag, depth ", F.col("depth"), where), "modified_local", F.col("source_path")))
        arms.append(item(self.mru_entry().where("modified_local <> ''"), F.coalesce(said("path"), F.col("name")), "mru", _text(F.col("source_list"), where), "modified_local", F.col("source_path")))
        app = F.when((F.col("origin") == "jump_list") & (F.col("app_id") != ""), F.concat(F.lit("app "), "app_id")).otherwise("")
        arms.append(item(self.table("file_target").where("target_item_modified_local <> ''"), F.coalesce(said("target_item_path"), F.col("path")), F.col("origin"), app, "target_item_modified_local", F.col("source_file"), say.LINK_ITEM))
        p = with_source(self.table("mount_point").where("key_last_write_utc is not null"), source, source_path="path")
        arms.append(arm(p, "volume", "mount_point_written", "key_last_write_utc", say.MOUNT_POINT, _text(F.col("kind"), _after(" ", "volume_guid"), _after(" ", "remote_path"), where), "registry_mount_points", letter=letter, profile=profile))
        disk = _text("disk ", F.col("disk_number"), _after(" ", "model"), _after(" (", "style", ")"))
        arms.append(arm(self.disk().where("time_utc is not null"), "disk", "disk_layout_recorded", "time_utc", say.LAYOUT, disk, "disk_layout", device=key, record=F.col("record_id")))
        return arms

    @view
    def timeline(self) -> DataFrame:
        """Every dated statement in one order. Local times are read in the host's zone, with the seasonal reading as
        an alternative; a clock's default isn't converted. Entries get their device before they are numbered, so the
        numbered table is the one that is written."""
        e = reduce(DataFrame.unionByName, self._arms())
        zone = self.host_time_zone().orderBy("control_set", "key_name", "source_id").limit(1).agg(*[F.first(c).alias(c) for c in ("standard_offset_minutes", "daylight_offset_minutes", "observes_daylight_saving")])
        e = e.crossJoin(F.broadcast(zone)).withColumn("local", m.local_timestamp(F.col("time_local"))).withColumn("default", m.epoch_default_local(F.col("local")))
        known, usual = F.col("recorded").isNotNull(), F.col("default") == ""
        shifted = lambda c: F.col("local") + F.expr(f"make_dt_interval(0, 0, {c})")
        e = e.withColumn("time_utc", F.when(known, F.col("recorded")).when(usual, shifted("standard_offset_minutes"))).withColumn("time_utc_alt", F.when(~known & usual & F.col("observes_daylight_saving"), shifted("daylight_offset_minutes")))
        basis = F.when(known, "recorded_utc").when(~usual, "local_wall_clock, a default no clock ever left").when(F.col("standard_offset_minutes").isNull(), "local_wall_clock, no host time zone recovered").when(F.col("observes_daylight_saving"), "standard_time / daylight_time").otherwise("standard_time")
        default = F.when(known, m.epoch_default_name(F.col("recorded"))).otherwise(F.coalesce(said("default"), m.epoch_default_name(F.col("time_utc"))))
        e = e.withColumns({"time_basis": basis, "epoch_default": default, "sort_utc": F.coalesce("time_utc", "local"), "time_ambiguous": F.col("time_utc_alt").isNotNull()}).drop("recorded", "local", "default", *zone.columns)
        named = self.device_group().select("device_key", "physical_device_id").join(self.device_label(), "physical_device_id", "left")
        columns = [c for c in e.columns if c != "device_key"]
        e = e.join(named, "device_key", "left").na.fill("", ["physical_device_id", "device_label"])
        e = timeline.numbered(e, [F.col(c).asc_nulls_last() for c in _ENTRY_ORDER], "entry_id", self._written)
        return e.select("physical_device_id", "device_key", *columns, "entry_id", "device_label")

    @view
    def timeline_significant(self) -> DataFrame:
        c = self._classes().where(F.col("tier") <= SHOWN_TIER).select("physical_device_id", F.col("category").alias("device_category"), "tier", "score")
        return self.timeline().join(c, "physical_device_id")

    @view
    def timeline_moment_anchor(self) -> DataFrame:
        return timeline.moment_anchors(self.connection_endpoint(), paths=self._written)

    @consolidated
    def _gathered(self) -> DataFrame:
        """timeline_moment_member with what moments tell of their entries, so that no entry is looked up again."""
        return timeline.moment_members(self.timeline(), self.timeline_moment_anchor(), kept=("category", "event", "artefact", "device_key", "device_label", "source_id", "source_path"))

    @view
    def timeline_moment_member(self) -> DataFrame:
        return self._gathered().select("entry_id", "moment_id", "distance_ms")

    @view
    def timeline_moment_support(self) -> DataFrame:
        return self._gathered().groupBy("moment_id", "category", "event").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("device_key").alias("identities"), listed("artefact", ", ").alias("artefacts"))

    @view
    def timeline_moment(self) -> DataFrame:
        """Anchors with two members or more, and what evidences them."""
        linked = F.when(F.col("category") == "connection", F.col("entry_id"))
        best = lambda c: F.coalesce(F.min_by(c, linked), F.min_by(c, "entry_id")).alias(c)
        each = self._gathered().groupBy("moment_id").agg(
            F.min("entry_id").alias("entry_id"), F.count(F.lit(1)).alias("member_count"), F.count_distinct("device_key").alias("identity_count"), F.count_distinct("source_id").alias("source_count"), F.max("device_label").alias("device_label"),
            F.bool_or(F.col("event") == "first_install_date").alias("first_install_recorded"), F.bool_or(F.col("artefact") == "setupapi_log").alias("setupapi_recorded"), best("source_id"), best("source_path"),
        ).where("member_count >= 2")
        several = F.when(F.col("identities") > 1, _text(" across ", F.col("identities"), " identities")).otherwise("")
        support = self.timeline_moment_support().groupBy("moment_id").agg(listed_by(_text(F.col("records"), " ", F.col("event"), several), "; ", -F.col("records"), F.col("event")).alias("supporting"))
        return self.timeline_moment_anchor().drop("window_count").join(each, "moment_id").join(support, "moment_id", "left")

    def _of_several(self) -> DataFrame:
        """moment_id of timeline_moment."""
        return self.timeline_moment_member().groupBy("moment_id").agg(F.count(F.lit(1)).alias("members")).where("members >= 2").select("moment_id")

    @view
    def report_timeline(self) -> DataFrame:
        """Moments of the devices that matter, and their entries that no moment shows."""
        columns = ["time_utc_alt", "time_local", "time_basis", "time_ambiguous", "epoch_default", "category", "event", "meaning", "device_key", "physical_device_id", "device_label", "drive_letter", "path", "profile", "confidence", "artefact", "detail", "source_id", "source_path"]
        shown = self._classes().where(F.col("tier") <= SHOWN_TIER).select("physical_device_id", "tier")
        arrival, empty = F.col("moment_kind") == "arrival", F.lit("")
        said_of = {"time_utc_alt": F.lit(None).cast("timestamp_ntz"), "time_basis": F.lit("recorded_utc"), "time_ambiguous": F.lit(False), "category": F.lit("connection"), "event": F.when(arrival, "device_connected").otherwise("device_removed"), "confidence": F.lit("confirmed"), "artefact": F.lit("connection_window")}
        across = F.when(F.col("identity_count") > 1, say.column(say.MOMENT_ACROSS, identities=F.col("identity_count"))).otherwise("")
        said_of |= {"meaning": F.concat(F.when(arrival, say.MOMENT_ARRIVAL).otherwise(say.MOMENT_REMOVAL), say.column(say.MOMENT, records=F.col("member_count")), across)}
        said_of |= {"detail": _text("opened by ", F.col("moment_rules"))} | {c: F.col(c) for c in ("physical_device_id", "device_label", "source_id", "source_path")}
        moments = self.timeline_moment().join(shown, "physical_device_id").select(
            F.lit("moment").alias("row_kind"), "moment_id", "entry_id", F.col("moment_utc").alias("sort_utc"), F.col("moment_utc").alias("time_utc"), *[said_of.get(c, empty).alias(c) for c in columns], "member_count", "supporting", (F.col("first_install_recorded") & arrival).alias("first_install_recorded"), "tier"
        )
        inside = self.timeline_moment_member().join(self._of_several(), "moment_id", "left_semi").select("entry_id")
        zero = F.lit(0).cast("long")
        alone = self.timeline_significant().join(inside, "entry_id", "left_anti").select(
            F.lit("entry").alias("row_kind"), zero.alias("moment_id"), "entry_id", "sort_utc", "time_utc", *columns, zero.alias("member_count"), empty.alias("supporting"), F.lit(False).alias("first_install_recorded"), "tier"
        )
        return moments.unionByName(alone)

    @view
    def report_timeline_member(self) -> DataFrame:
        return self.timeline_moment_member().join(self._of_several(), "moment_id", "left_semi").join(self.timeline(), "entry_id")

    # ---------------------------------------------------------------- report

    @view
    def report_summary(self) -> DataFrame:
        """One row: each source is summed by itself and the sums stand side by side."""
        n, tier = lambda c: F.count_if(c), F.col("tier")
        state, usual = F.col("state"), F.col("epoch_default") == ""
        count = F.count(F.lit(1))
        parts = [
            self._classified().agg(count.alias("devices"), *[n(tier == k).alias(f"tier_{k}") for k in (1, 2, 3)], n(F.col("review_required")).alias("review_required")), self.device().agg(count.alias("identities")),
            self.connection().agg(count.alias("connections"), n(F.coalesce("host_stopped_utc", "host_stopped_after_utc").isNotNull()).alias("connections_ended_by_shutdown")), self.file_activity().agg(count.alias("file_records")),
            self.file_attribution().agg(F.count_distinct("activity_id").alias("attributed_records")), self.removable_volume().agg(count.alias("removable_volumes")),
            self.timeline().agg(
                count.alias("timeline_entries"), n(F.col("time_basis") != "recorded_utc").alias("wall_clock_entries"), n(F.col("time_ambiguous")).alias("ambiguous_entries"), n(~usual).alias("epoch_default_entries"), F.min(F.when(usual, F.col("sort_utc"))).alias("earliest_utc"),
                F.max(F.when(usual, F.col("sort_utc"))).alias("latest_utc"),
            ),
            self.session_event().agg(n(state == "started").alias("host_starts"), n(state.isin("stopped", "stopped_unexpectedly")).alias("host_stops"), n(state == "stopped_unexpectedly").alias("host_stops_unexpected")), self.source().agg(count.alias("sources")),
            self.warning().agg(n(F.col("severity") == "failed").alias("failed_sources"), n(F.col("severity") == "absent").alias("absent_artefacts")),
        ]
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)

    @view
    def report_finding(self) -> DataFrame:
        """Headlines, each only where there is something to say: finding_id, rank, kind, headline, detail, basis. The
        lists in a detail grow with a host's devices and programmes."""
        n, line = F.col("n"), "\n"
        s = lambda column, one="", more="s": F.when(column == 1, one).otherwise(more)
        told = lambda detail: [F.count(F.lit(1)).alias("n"), detail.alias("detail")]
        d, f, p = self._classified(), self.file_attribution_summary(), self.prefetch_device_link()
        row = lambda df, rank, kind, basis, *words: df.where("n > 0").select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), _text(*words).alias("headline"), F.coalesce("detail", F.lit("")).alias("detail"), F.lit(basis).alias("basis"))
        name = F.coalesce(said("friendly_name"), said("device_desc"), F.col("physical_device_id"))
        serial = F.when(F.col("serial") != "", _text(" (serial ", F.col("serial"), ")")).otherwise(" (no serial recorded)")
        by_id = lambda value: listed_by(value, line, F.col("physical_device_id"))
        odd = _text(F.coalesce(said("friendly_name"), F.col("physical_device_id")), " — ", F.col("classification_reason"))
        programmes = listed(_text(F.col("executable"), " (", F.col("drive_letter"), ":)"), line)
        carried = lambda df, did, sentence: (df.agg(F.count_distinct("executable").alias("n"), F.count_distinct("device_key").alias("devices"), _text(programmes, line, sentence).alias("detail")), n, " programme", s(n), did, F.col("devices"), " removable device", s(F.col("devices")))
        ran, read = carried(p.where("ran_from"), " ran from a volume carried by ", say.RAN), carried(p.where("not ran_from"), " read files from a volume carried by ", say.READ)
        launch = F.when(F.col("run_count") > 0, _text(" — launched ", F.col("run_count"), " time(s)")).otherwise(" — no launch recorded")
        focus = F.when(F.col("focus_count") > 0, _text(", in the foreground for ", F.round("focus_seconds", 1), "s")).otherwise("")
        launched = listed_by(_text(F.col("drive_letter"), ":  ", F.col("name"), launch, focus), line, F.col("drive_letter"), F.col("name"))
        reached = self.file_attribution().agg(F.count_distinct("activity_id").alias("n"), F.count_distinct("device_key").alias("devices"), say.column(say.STRONGEST, best=F.coalesce(confidence_of(F.min(confidence_rank())), F.lit("none"))).alias("detail"))
        no_window = self.connection().agg(F.count(F.lit(1)).alias("n")).select((F.col("n") == 0).cast("long").alias("n"), F.lit(say.NO_WINDOW).alias("detail"))
        parts = [
            row(d.where("category = 'PotentialOffensiveDevice'").agg(*told(by_id(odd))), 0, "offensive", "devices.csv, category PotentialOffensiveDevice", n, " device", s(n), " present", s(n, "s", ""), " interfaces that do not match ", s(n, "its", "their"), " apparent purpose"),
            row(d.where("category = 'Storage' and tier = 1").agg(*told(by_id(F.concat(name, serial)))), 1, "storage", "devices.csv, category Storage", n, " storage device", s(n), " ", s(n, "was", "were"), " attached to this host"),
            row(ran[0], 1, "execution", "prefetch-runs.csv, ran_from_removable", *ran[1:]), row(read[0], 1, "execution_read", "prefetch-files-removable.csv", *read[1:]),
            row(self.table("user_assist").where("not bookkeeping and drive_letter <> ''").agg(*told(_text(launched, line, say.BY_USER))), 1, "user_launched", "user-assist.csv, drive_letter", n, " programme", s(n, " was", "s were"), " launched from a drive letter by a user"),
            row(d.where("category = 'MobileDevice'").agg(*told(by_id(name))), 2, "mobile", "devices.csv, category MobileDevice", n, " mobile device", s(n), " ", s(n, "was", "were"), " attached to this host"),
            row(reached, 3, "file_activity", "file-attribution.csv", n, " file record", s(n), " reached a device, across ", F.col("devices"), " device", s(F.col("devices"))),
            row(f.where("candidate_devices = 0").agg(*told(F.lit(say.NO_DEVICE))), 4, "unattributed", "file-attribution-summary.csv, candidate_devices = 0", n, " file record", s(n), " reached no device at all"),
            row(f.where("candidate_devices > 1").agg(*told(F.lit(say.CONTESTED))), 5, "contested", "file-attribution-summary.csv, candidate_devices > 1", n, " file record", s(n), " reached more than one candidate device"),
            row(d.where("review_required").agg(*told(F.lit(say.REVIEW))), 6, "review", "devices.csv, review_required", n, " device", s(n), " ", s(n, "needs", "need"), " a closer look"), row(no_window, 7, "no_connections", "connections.csv, empty", "no connection window could be derived"),
            row(d.where(f"identity_not_unique and tier <= {SHOWN_TIER}").agg(*told(F.lit(say.ALIKE))), 8, "identity", "devices.csv, identity_not_unique", n, " device", s(n), " cannot be told apart from another of the same model"),
        ]
        return reduce(DataFrame.unionByName, parts).withColumn("finding_id", F.row_number().over(Window.orderBy("rank", "kind")))  # a dozen rows

    def finding_items(self, most: int = MOST_ITEMS) -> DataFrame:
        """What the findings list, as rows: kind, place, item, items, left_out. At most `most` a finding, in the
        order of its detail, beside how many there are and how many are left out; a host's devices and programmes
        then meet in no one string or task."""
        d = self._classified()
        name = F.coalesce(said("friendly_name"), said("device_desc"), F.col("physical_device_id"))
        serial = F.when(F.col("serial") != "", _text(" (serial ", F.col("serial"), ")")).otherwise(" (no serial recorded)")
        odd = _text(F.coalesce(said("friendly_name"), F.col("physical_device_id")), " — ", F.col("classification_reason"))
        of = lambda df, kind, item, order: df.select(F.lit(kind).alias("kind"), order.alias("by"), item.alias("item"))
        programme, p = _text(F.col("executable"), " (", F.col("drive_letter"), ":)"), self.prefetch_device_link()
        launched = self.table("user_assist").where("not bookkeeping and drive_letter <> ''")
        key = F.col("physical_device_id")
        rows = reduce(DataFrame.unionByName, [
            of(d.where("category = 'PotentialOffensiveDevice'"), "offensive", odd, key), of(d.where("category = 'Storage' and tier = 1"), "storage", F.concat(name, serial), key), of(d.where("category = 'MobileDevice'"), "mobile", name, key),
            of(d.where("review_required"), "review", _text(name, " — ", F.col("review_reason")), key), of(d.where(f"identity_not_unique and tier <= {SHOWN_TIER}"), "identity", name, key),
            of(p.where("ran_from"), "execution", programme, programme).distinct(), of(p.where("not ran_from"), "execution_read", programme, programme).distinct(),
            of(launched, "user_launched", _text(F.col("drive_letter"), ":  ", F.col("name")), _text(F.col("drive_letter"), ":", F.col("name"))),
        ])
        placed = numbered(rows, ["kind", "by", "item"], "n", self._written)
        first = placed.groupBy("kind").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("items"))
        placed = placed.join(F.broadcast(first), "kind").withColumn("place", F.col("n") - F.col("first") + 1).where(F.col("place") <= most)
        return placed.select("kind", "place", "item", "items", F.greatest(F.col("items") - most, F.lit(0)).alias("left_out"))

    @view
    def report_coverage(self) -> DataFrame:
        bad = lambda k: F.count_if(F.col("severity") == k).alias(k)
        s = self.source().groupBy("artefact").agg(F.count(F.lit(1)).alias("sources"), F.sum("size_bytes").alias("bytes"), F.count_if("replayed").alias("replayed"), F.count_if(~F.col("replayed")).alias("not_replayed"))
        return s.join(self.warning().groupBy("artefact").agg(bad("failed"), bad("malformed")), "artefact", "left").na.fill(0, ["failed", "malformed"])

    @view
    def report_limitation(self) -> DataFrame:
        w = self.warning().where(F.col("severity").isin("failed", "absent", "malformed", "truncated", "partial")).select("severity", "artefact", "path", "message")
        return w.crossJoin(F.broadcast(w.agg(F.count(F.lit(1)).alias("total"))))

    @view
    def report_prefetch(self) -> DataFrame:
        columns = ["executable", "drive_letter", "volume_label", "volume_serial_hex", "volume_route", "volume_confidence", "letter_contradicted", "ran_from"]
        link = self.prefetch_device_link().join(self.device_group().select("device_key", "physical_device_id"), "device_key").select("physical_device_id", "source_file", *columns).distinct()
        at = F.col("time_utc")
        runs = self.table("prefetch_execution").where("time_utc is not null").groupBy("source_file").agg(
            F.count(F.lit(1)).alias("times_recorded"), F.min(at).alias("first_run_utc"), F.max(at).alias("last_run_utc"), listed_by(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), "\n", -F.unix_micros(at.cast("timestamp"))).alias("execution_times")
        )
        inside = F.when((F.col("device_path") != "") & F.startswith("path", "device_path"), F.expr("substring(path, length(device_path) + 1)")).otherwise(F.col("path"))
        loaded = self.prefetch_file_on_removable().groupBy("source_file", "volume_serial_hex").agg(F.count(F.lit(1)).alias("files_loaded"), listed_by(inside, "\n", F.col("path")).alias("files"))
        out = link.join(with_source(self.table("prefetch_run").select("source_file", "run_count", "parse_warnings", "source_id"), self.table("source"), source_path="path", source_sha256="sha256"), "source_file")
        out = out.join(runs, "source_file", "left").join(loaded, ["source_file", "volume_serial_hex"], "left").join(self.device_label(), "physical_device_id", "left").join(self._classes().select("physical_device_id", "tier"), "physical_device_id", "left")
        out = out.na.fill(0, ["times_recorded", "files_loaded"]).na.fill("", ["execution_times", "files", "source_path", "source_sha256"]).na.fill(3, ["tier"])
        return out.withColumn("device_label", F.coalesce("device_label", "physical_device_id"))

    @view
    def report_device_field(self) -> DataFrame:
        """Eleven attributes as rows: the value of the best identity, and how many there are."""
        d = self.devnode().join(self.device_group().select("device_key", "physical_device_id", "preference"), "device_key")
        real = lambda c: m.is_real_container(F.col(c)) if c == "container_id" else F.col(c) != ""
        cells = F.array(*[F.when(real(c), F.struct(F.lit(name).alias("field"), F.col(c).alias("value"), F.lit(k).alias("ordinal"))) for k, (name, c) in enumerate(_FIELDS.items(), 1)])
        at = ["registry_key", "source_id", "source_path", "source_sha256"]
        long = d.select("physical_device_id", "preference", *at, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).select("physical_device_id", "preference", *at, "x.*")
        best = Window.partitionBy("physical_device_id", "field").orderBy("preference", F.desc("value"), "registry_key", "source_id")
        spread = long.groupBy("physical_device_id", "field").agg(F.count_distinct("value").alias("distinct_values"))
        made_up = self.device_identity().where("serial_is_generated").select("physical_device_id", F.col("serial").alias("value"), F.lit("serial").alias("field"), F.lit("generated by Windows, not read from the device").alias("note")).distinct()
        out = long.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "preference").join(spread, ["physical_device_id", "field"]).join(made_up, ["physical_device_id", "field", "value"], "left")
        return out.na.fill("", ["note", "source_path", "source_sha256"]).withColumnRenamed("registry_key", "locator")

    @view
    def report_device_source(self) -> DataFrame:
        e = self.device_evidence().join(self.device_group().select("device_key", "physical_device_id"), "device_key")
        e = e.join(self.table("source").select(F.col("id").alias("source_id"), "artefact", F.col("path").alias("known"), "sha256"), "source_id", "left")
        e = e.select("physical_device_id", "evidence", F.coalesce("artefact", F.lit("")).alias("artefact"), F.coalesce("known", "source_path", F.lit("")).alias("source_path"), F.coalesce("sha256", F.lit("")).alias("sha256"))
        return e.groupBy(*e.columns).agg(F.count(F.lit(1)).alias("records"))

    @view
    def report_device(self) -> DataFrame:
        group = self.device_group().select("device_key", "physical_device_id")
        of = lambda df: df.join(group, "device_key").groupBy("physical_device_id")
        count = F.count(F.lit(1))
        parts = [
            of(self.device_volume_link()).agg(listed(said("drive_letter"), ", ").alias("linked_drive_letters"), listed(said("volume_label"), ", ").alias("volume_labels"), count.alias("volume_links")),
            of(self.connection()).agg(count.alias("connection_windows"), F.count_if("open_ended").alias("open_ended_windows"), F.count_if(~F.col("start_known")).alias("unknown_start_windows"), F.min("started_utc").alias("first_started_utc"), F.max("ended_utc").alias("last_ended_utc")),
            of(self.file_attribution()).agg(
                F.count_distinct("activity_id").alias("file_records"), F.count_distinct("path").alias("file_paths"), F.count_distinct(said("drive_letter")).alias("file_letters"), F.min("recorded_utc").alias("first_file_utc"), F.max("recorded_utc").alias("last_file_utc"), confidence_of(F.min(confidence_rank())).alias("file_confidence")
            ),
        ]
        out = reduce(lambda a, b: a.join(b, "physical_device_id", "left"), parts, self._classified())
        out = self._with_fact_evidence(out)
        return out.na.fill("", ["linked_drive_letters", "volume_labels"]).na.fill(0, ["volume_links", "connection_windows", "open_ended_windows", "unknown_start_windows", "file_records", "file_paths", "file_letters"]).na.fill("unattributed", ["file_confidence"])

    @view
    def report_file_activity(self) -> DataFrame:
        """Each record with each device that it reaches, by the best route."""
        f = self.file_attribution().join(self.device_group().select("device_key", "physical_device_id"), "device_key").select("physical_device_id", "activity_id", "route", "confidence", "contradicted", F.col("detail").alias("reason"), confidence_rank().cast("int").alias("confidence_rank"))
        order = F.struct("confidence_rank", "contradicted", (F.col("route") == "sole_connected_device").alias("last"), "route", "reason")
        best = f.groupBy("physical_device_id", "activity_id").agg(F.min_by(F.struct("confidence", "confidence_rank", "route", "reason"), order).alias("b")).select("physical_device_id", "activity_id", "b.*")
        spread = f.groupBy("activity_id").agg(F.count_distinct("physical_device_id").alias("candidate_devices"))
        a = with_source(self.file_activity().select("activity_id", "artefact", "detail", "path", "drive_letter", "volume_label", "profile", "recorded_utc", "recorded_meaning", "source_id"), self.table("source"), source_path="path", source_sha256="sha256")
        out = best.join(spread, "activity_id").join(a, "activity_id").join(self._classes().select("physical_device_id", "tier", "score"), "physical_device_id").join(self.device_label(), "physical_device_id", "left")
        return out.withColumn("device_label", F.coalesce("device_label", "physical_device_id")).withColumn("epoch_default", m.epoch_default_name(F.col("recorded_utc"))).na.fill("", ["source_path", "source_sha256"])

    @view
    def report_file_unattributed(self) -> DataFrame:
        a = self.file_activity().join(self.file_attribution().select("activity_id").distinct(), "activity_id", "left_anti")
        nothing = F.concat("drive_letter", "volume_serial_hex", "volume_label") == ""
        reason = (
            F.when(nothing, "the record carries no drive letter, volume serial or label, so there is nothing to match a device on").when(F.col("drive_letter") == "", "the record carries no drive letter, and its volume serial and label match no device in this evidence")
            .otherwise(_text("drive letter ", F.col("drive_letter"), " is linked to no USB device in this evidence"))
        )
        out = with_source(a.select("activity_id", "artefact", "detail", "path", "drive_letter", "profile", "recorded_utc", "recorded_meaning", reason.alias("reason"), m.epoch_default_name(F.col("recorded_utc")).alias("epoch_default"), "source_id"), self.table("source"), source_path="path", source_sha256="sha256")
        return out.na.fill("", ["source_path", "source_sha256"])
