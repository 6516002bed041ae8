"""Volumes, the devices that carried them, and what prefetch files say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.functions import macros as m
from vestige.operators.case import consolidated, listed_by, view, with_source
from vestige.operators.presence import Presence

ON_DISK = ("USBSTOR", "SCSI", "STORAGE")


def _basename(path: str):
    return F.upper(F.substring_index(path, "\\", -1))


class Volumes(Presence):
    @view
    def volume(self) -> DataFrame:
        v = with_source(self.table("mount_entry"), self.table("source"), source_path="path")
        return v.withColumnRenamed("kind", "mount_kind")

    @consolidated
    def device_volume_link(self) -> DataFrame:
        """Volumes with the device that carries them, by four routes. A disk's two signatures are two rows of an
        equi-join."""
        v = self.volume().select("value_name", "drive_letter", "target_kind", F.lower("partition_guid").alias("guid"), "disk_signature", "partition_offset", "source_id", "device_key", "device_instance_id")
        disks = self.table("disk_layout").where("device_key <> ''").select("source_id", "record_id", "device_key", "device_instance_id", "disk_number", "disk_signature", "boot_record_signature")
        parts = self.table("disk_partition").select("source_id", "record_id", "partition_guid", "partition_name", "starting_offset")
        whole = disks.join(parts, ["source_id", "record_id"])
        text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
        row = lambda df, kind, volume, letter, label, route, confidence, detail: df.select(
            "device_key", "device_instance_id", F.lit(kind).alias("volume_kind"), volume.alias("volume_id"), letter.alias("drive_letter"), label.alias("volume_label"), F.lit(route).alias("route"), F.lit(confidence).alias("confidence"), detail.alias("detail"), "source_id",
        )
        mount = lambda df, route, confidence, detail: row(df, "mount_point", F.col("value_name"), F.col("drive_letter"), F.lit(""), route, confidence, detail)
        named = v.drop("device_key", "device_instance_id")
        by_path = mount(v.where("target_kind = 'device_path' and device_key <> ''"), "mounted_devices_device_path", "confirmed", F.lit("the MountedDevices value holds the device instance path"))
        by_guid = named.where("target_kind = 'gpt_partition_guid' and guid <> ''").join(whole.drop("source_id", "disk_signature").withColumn("guid", F.lower("partition_guid")), "guid")
        by_guid = mount(by_guid, "gpt_partition_guid", "strong", text("partition ", F.col("partition_name"), " on disk ", F.col("disk_number"), " carries the identifier MountedDevices stores for this volume"))
        signed = whole.drop("source_id").select("device_key", "device_instance_id", "disk_number", F.col("starting_offset").alias("partition_offset"), F.explode(F.array_distinct(F.array("disk_signature", "boot_record_signature"))).alias("disk_signature"))
        by_signature = named.where("target_kind = 'mbr_disk_signature' and disk_signature <> 0").join(signed, ["disk_signature", "partition_offset"])
        by_signature = mount(by_signature, "mbr_disk_signature", "strong", text("disk signature and partition offset both match disk ", F.col("disk_number")))
        p = self.table("portable_device").where("device_key <> '' and friendly_name <> ''")
        one = p.groupBy("friendly_name").agg(F.count_distinct("device_key").alias("devices")).where("devices = 1").select("friendly_name")
        by_label = p.join(one, "friendly_name").where(m.identity_enumerator(F.col("device_instance_id")).isin(*ON_DISK))
        by_label = row(by_label, "volume_label", F.col("friendly_name"), F.lit(""), F.col("friendly_name"), "portable_device_label", "possible", F.lit("the label is unique among the portable devices recorded on this host"))
        return by_path.unionByName(by_guid).unionByName(by_signature).unionByName(by_label)

    @view
    def ambiguous_label(self) -> DataFrame:
        p = self.table("portable_device").where("device_key <> '' and friendly_name <> ''").select("friendly_name", "device_key", "device_instance_id").distinct()
        return p.groupBy(F.col("friendly_name").alias("volume_label")).agg(F.count(F.lit(1)).alias("device_count"), listed_by(F.col("device_instance_id"), "; ", F.col("device_instance_id")).alias("devices")).where("device_count > 1")

    @view
    def serial_letter(self) -> DataFrame:
        s = self.table("file_target").where("removable and volume_serial_hex <> '' and drive_letter <> ''").select("volume_serial_hex", "drive_letter", "volume_label").distinct()
        return s.join(s.groupBy("volume_serial_hex").agg(F.count(F.lit(1)).alias("serial_letters")), "volume_serial_hex")

    # -------------------------------------------------------------- prefetch

    @view
    def _self_load(self) -> DataFrame:
        """Volumes of a run on which a loaded file bears the programme's name, exactly (1) or as a beginning (2)."""
        f = self.table("prefetch_file").select("source_file", "path", _basename("path").alias("base"))
        r = self.table("prefetch_run").where("executable <> ''").select("source_file", "executable")
        v = self.table("prefetch_volume").select("source_file", "device_path", "volume_serial_hex", "created_utc")
        own = f.join(r, "source_file").where(F.startswith("base", F.upper("executable"))).join(v, "source_file").where(F.startswith(F.upper("path"), F.upper("device_path")))
        own = own.select("source_file", "executable", "device_path", "volume_serial_hex", "created_utc", F.when(F.col("base") == F.upper("executable"), 1).otherwise(2).alias("rank")).distinct()
        best = own.groupBy("source_file").agg(F.min("rank").alias("best"), F.collect_set(F.struct("rank", "device_path")).alias("all"))
        best = best.select("source_file", "best", F.size(F.filter("all", lambda x: x.rank == F.col("best"))).cast("long").alias("best_candidates"))
        return own.join(best, "source_file")

    @view
    def prefetch_run_volume(self) -> DataFrame:
        """The volume that a run came from, where one stands out."""
        columns = ["source_file", "device_path", "volume_serial_hex", "created_utc"]
        picked = self._self_load().where("rank = best and best_candidates = 1").select(*columns).distinct()
        bare = self.table("prefetch_run").where("volume_count = 1 and file_count = 0").select("source_file").join(self.table("prefetch_volume"), "source_file").join(picked, "source_file", "left_anti").select(*columns)
        return picked.withColumn("basis", F.lit("the prefetch file lists its own executable on this volume")).unionByName(bare.withColumn("basis", F.lit("the prefetch file named exactly one volume and listed no files")))

    @view
    def prefetch_run_volume_candidate(self) -> DataFrame:
        c = self._self_load().select("source_file", "executable", "device_path", "volume_serial_hex", "rank", "best", "best_candidates").distinct()
        c = c.join(self.prefetch_run_volume().select("source_file", F.col("device_path").alias("resolved")), "source_file", "left")
        chosen = F.coalesce(F.col("resolved") == F.col("device_path"), F.lit(False))
        outcome = F.when(chosen, "this is the volume the record was resolved to").when(F.col("resolved").isNotNull(), "a weaker match than the volume this record was resolved to").otherwise("the record was not resolved to any volume: more than one volume matched equally well")
        precision = F.when(F.col("rank") == 1, "exact name").otherwise("truncated header prefix")
        return c.select("source_file", "executable", "device_path", "volume_serial_hex", precision.alias("match_precision"), (F.col("rank") == F.col("best")).alias("is_best_match"), "best_candidates", chosen.alias("chosen"), outcome.alias("outcome"))

    @consolidated
    def prefetch_device_link(self) -> DataFrame:
        """Runs with the devices that their volumes' serials lead to, by way of a drive letter."""
        links = self.device_volume_link()
        lettered = links.where("drive_letter <> ''").select("device_key", "device_instance_id", "drive_letter", F.col("route").alias("volume_route"), F.col("confidence"))
        labelled = links.where("route = 'portable_device_label'").select(F.upper("volume_label").alias("upper_label"), F.col("device_key").alias("named")).distinct()
        v = self.table("prefetch_volume").where("volume_serial_hex <> ''").select("volume_serial_hex", "source_file", "executable", "source_id")
        out = v.join(self.serial_letter(), "volume_serial_hex").join(lettered, "drive_letter")
        out = out.join(self.prefetch_run_volume().select("source_file", "volume_serial_hex", F.lit(True).alias("own")).distinct(), ["source_file", "volume_serial_hex"], "left")
        # The label's devices other than the letter's contradict it.
        against = out.where("volume_label <> ''").select("volume_label", "device_key").distinct().withColumn("upper_label", F.upper("volume_label")).join(labelled, "upper_label").where("named <> device_key").select("volume_label", "device_key", "named")
        out = out.join(against, ["volume_label", "device_key"], "left")
        return out.select(
            "device_key", "device_instance_id", "volume_serial_hex", "drive_letter", "volume_label", "volume_route", F.when(F.col("named").isNotNull(), "possible").otherwise(F.col("confidence")).alias("volume_confidence"), F.col("named").isNotNull().alias("letter_contradicted"),
            (F.col("serial_letters") > 1).alias("serial_reaches_several_letters"), F.coalesce("named", F.lit("")).alias("label_device_key"), F.coalesce("own", F.lit(False)).alias("ran_from"), "source_file", "executable", "source_id",
        ).distinct()

    @view
    def _run_times(self) -> DataFrame:
        return self.table("prefetch_execution").groupBy("source_file").agg(F.min("time_utc").alias("first_run_utc"), F.max("time_utc").alias("last_run_utc"))

    @view
    def prefetch_run(self) -> DataFrame:
        r = self.table("prefetch_run").join(self._run_times(), "source_file", "left")
        r = r.join(self.prefetch_run_volume().select("source_file", F.col("volume_serial_hex").alias("ran_from_serial"), F.col("device_path").alias("ran_from_volume")), "source_file", "left")
        removable = self.serial_letter().select(F.col("volume_serial_hex").alias("ran_from_serial"), F.col("drive_letter").alias("removable_letter"), F.col("volume_label").alias("removable_label"), F.lit(True).alias("ran_from_removable")).distinct()
        return r.join(removable, "ran_from_serial", "left").na.fill("", ["ran_from_serial", "ran_from_volume", "removable_letter", "removable_label"]).na.fill(False, ["ran_from_removable"])

    @view
    def prefetch_execution(self) -> DataFrame:
        return self.table("prefetch_execution").join(self.table("prefetch_run").select("source_file", "run_count", "times_recorded"), "source_file")

    @view
    def prefetch_volume(self) -> DataFrame:
        v = self.table("prefetch_volume").join(self.serial_letter().withColumn("matches_removable_volume", F.lit(True)), "volume_serial_hex", "left")
        v = v.na.fill(False, ["matches_removable_volume"]).na.fill("", ["drive_letter", "volume_label"])
        return v.groupBy("volume_serial_hex", "device_path", "created_utc", "matches_removable_volume", "drive_letter", "volume_label").agg(F.count_distinct("source_file").alias("executables"))

    @view
    def prefetch_file(self) -> DataFrame:
        f = self.table("prefetch_file").alias("f")
        v = self.table("prefetch_volume").select("source_file", "device_path", "volume_serial_hex").alias("v")
        out = f.join(v, (F.col("f.source_file") == F.col("v.source_file")) & F.startswith(F.upper("f.path"), F.upper("v.device_path")), "left")
        return out.select("executable", "path", F.coalesce("device_path", F.lit("")).alias("device_path"), F.coalesce("volume_serial_hex", F.lit("")).alias("volume_serial_hex"), "source_id", "f.source_file")

    @view
    def prefetch_file_on_removable(self) -> DataFrame:
        return self.prefetch_file().join(self.serial_letter().drop("serial_letters"), "volume_serial_hex")
