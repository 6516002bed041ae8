"""Sources that built-in expressions decode: install logs, mount targets, key names, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vestige.functions.macros import device_key, rot13

_GUID = r"\{[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}"


def setup_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of device-install logs: source_file, line_number, operation, target, device_key, start_local,
    end_local, exit_status, parent_device, driver_inf, class_guid, problem, complete.

    A section runs from its `>>>  [operation - target]` line to the next such line; its number is a running count of
    those lines within the file. Of repeated details the first counts. A section without an end stays."""
    return sections_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))


def sections_of(logs: DataFrame) -> DataFrame:
    """The sections of the logs (path, value)."""
    lines = logs.select(F.col("path").alias("source_file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    header = F.col("line").rlike(r"^>>>\s+\[.* - .*\]")
    w = Window.partitionBy("source_file").orderBy("at")
    numbered = lines.withColumn("section", F.sum(header.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("section > 0")

    def first(pattern: str) -> Column:
        hit = F.regexp_extract("line", pattern, 1)
        return F.coalesce(F.min(F.when(hit != "", F.struct("at", hit.alias("hit")))).getField("hit"), F.lit(""))

    stamp = r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d{3})"
    out = numbered.groupBy("source_file", "section").agg(
        F.min("at").alias("line_number"), first(r"^>>>\s+\[(.*?) - .*\]").alias("operation"), first(r"^>>>\s+\[.*? - (.*)\]").alias("target"), first(r">>>\s+Section start " + stamp).alias("start_local"),
        first(r"<<<\s+Section end " + stamp).alias("end_local"), first(r"<<<\s+\[Exit status: (.*)\]").alias("exit_status"), first(r"(?i)Parent Device[^:=]*[:=]\s*(\S.*)$").alias("parent_device"), first(r"(?i)\b(\w+\.inf)\b").alias("driver_inf"),
        first(rf"(?i)class[^{{]*({_GUID})").alias("class_guid"), first(r"(?i)problem:?\s+(0x[0-9a-f]+|\d+)").alias("problem"),
    )
    return out.withColumn("device_key", device_key(F.col("target"))).withColumn("complete", F.col("exit_status") != "").drop("section")


def usb_sections(sections: DataFrame) -> DataFrame:
    """Those whose target or parent is a USB device."""
    usb = lambda c: F.upper(F.col(c)).rlike(r"^(\\\\\?\\)?(USB|USBSTOR|WPDBUSENUM|SWD\\WPDBUSENUM)[\\#]")
    return sections.where(usb("target") | usb("parent_device"))


def mounted(values: DataFrame) -> DataFrame:
    """Mount values (value_name, hex) with kind, drive_letter, volume_guid and what the bytes say: target_kind
    (gpt_partition_guid, mbr_disk_signature, volume_guid_offset, device_path or unknown), partition_guid,
    disk_signature, partition_offset, target_volume_guid, target_offset_hex, device_path, device_key."""
    name, raw = F.col("value_name"), F.unhex("hex")
    size = F.length(raw)
    # The beginnings, in UTF-16, of a device path and of a volume's name; other bytes needn't be text.
    worded = F.upper("hex").rlike("^(5F003F003F005F00|5C003F003F005C00|7B00)") & (size % 2 == 0)
    wide = F.when(worded, F.decode(raw, "UTF-16LE")).otherwise("")
    reverse = lambda at, n: F.concat(*[F.substring(F.upper("hex"), 2 * (at + n - 1 - k) + 1, 2) for k in range(n)])
    number = lambda at, n: F.conv(reverse(at, n), 16, 10).cast("decimal(20,0)").cast("long")
    gpt = F.upper("hex").startswith("444D494F3A49443A") & (size == 24)
    path = (size > 12) & wide.rlike(r"^(_\?\?_|\\\?\?\\)")
    guid = F.lower(F.concat(F.lit("{"), reverse(8, 4), F.lit("-"), reverse(12, 2), F.lit("-"), reverse(14, 2), F.lit("-"), F.substring("hex", 33, 4), F.lit("-"), F.substring("hex", 37, 12), F.lit("}")))
    mbr = (size == 12) & ~gpt
    volume = wide.rlike(rf"^{_GUID}#[0-9A-Fa-f]+$")
    kind = F.when(gpt, "gpt_partition_guid").when(mbr, "mbr_disk_signature").when(volume, "volume_guid_offset").when(path, "device_path").otherwise("unknown")
    return values.select(
        "*", F.when(name.rlike(r"^\\DosDevices\\[A-Za-z]:$"), "drive_letter").when(name.rlike(rf"^\\\?\?\\Volume{_GUID}$"), "volume_guid").when(name.rlike(rf"^#{_GUID}$"), "no_mount_point").otherwise("other").alias("kind"),
        F.upper(F.regexp_extract(name, r"^\\DosDevices\\([A-Za-z]):$", 1)).alias("drive_letter"), F.lower(F.regexp_extract(name, f"({_GUID})$", 1)).alias("volume_guid"), kind.alias("target_kind"), F.when(gpt, guid).otherwise("").alias("partition_guid"),
        F.when(mbr, number(0, 4)).alias("disk_signature"), F.when(mbr, number(4, 8)).alias("partition_offset"), F.when(volume, F.lower(F.substring_index(wide, "#", 1))).otherwise("").alias("target_volume_guid"), F.when(volume, F.substring_index(wide, "#", -1)).otherwise("").alias("target_offset_hex"), F.when(path, wide).otherwise("").alias("device_path"), F.when(path, device_key(wide)).otherwise("").alias("device_key"),
    )


def emd_keys(keys: DataFrame) -> DataFrame:
    """Key names `..._label_serial` with volume_label (after the last #) and volume_serial_decimal."""
    return keys.select("*", F.regexp_extract("key_name", r"^(.*)_([0-9]+)$", 2).alias("volume_serial_decimal"), F.substring_index(F.regexp_extract("key_name", r"^(.*)_([0-9]+)$", 1), "#", -1).alias("volume_label"))


def mount_points(keys: DataFrame) -> DataFrame:
    """Key names with kind (volume_guid, drive_letter, remote or other), drive_letter, volume_guid, remote_path."""
    k = F.col("key_name")
    kind = F.when(k.rlike(f"^{_GUID}$"), "volume_guid").when(k.rlike("^[A-Za-z]$"), "drive_letter").when(k.startswith("##"), "remote").otherwise("other")
    return keys.select("*", kind.alias("kind"), F.when(kind == "drive_letter", F.upper(k)).otherwise("").alias("drive_letter"), F.when(kind == "volume_guid", F.lower(k)).otherwise("").alias("volume_guid"), F.when(kind == "remote", F.translate(k, "#", "\\")).otherwise("").alias("remote_path"))


def launch_records(values: DataFrame) -> DataFrame:
    """Launch values (value_name, hex) with name (ROT13), bookkeeping, drive_letter, run_count, focus_count,
    focus_seconds and warnings. Values under 72 bytes give no counts."""
    name = rot13(F.col("value_name"))
    whole = F.length("hex") >= 144
    number = lambda at: F.conv(F.concat(*[F.substring("hex", 2 * (at + 3 - k) + 1, 2) for k in range(4)]), 16, 10).cast("long")
    return values.select(
        "*", name.alias("name"), name.startswith("UEME_CTL").alias("bookkeeping"), F.upper(F.regexp_extract(name, r"^([A-Za-z]):", 1)).alias("drive_letter"), F.when(whole, number(4)).alias("run_count"), F.when(whole, number(8)).alias("focus_count"),
        F.when(whole, number(12) / 1000).alias("focus_seconds"), F.when(whole, "").otherwise("short value: counts not decoded").alias("warnings"),
    )


def drive_captions(items: DataFrame) -> DataFrame:
    """Names of the form "LABEL (E:)" with drive_letter and volume_label; stock captions aren't labels."""
    stock = ("local disk", "removable disk", "usb drive", "cd drive", "dvd drive", "dvd rw drive", "bd-re drive", "network drive")
    label = F.regexp_extract("name", r"^(.*?)\s*\(([A-Za-z]):\)$", 1)
    return items.select("*", F.upper(F.regexp_extract("name", r"\(([A-Za-z]):\)$", 1)).alias("drive_letter"), F.when(F.lower(label).isin(*stock), "").otherwise(label).alias("volume_label"))
