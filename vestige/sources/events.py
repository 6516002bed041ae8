"""Which events are read, what they mean, and the disks that some of them describe."""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vestige.functions import macros as m
from vestige.sources import evtx
from vestige.sources.binary import decoded, layout, mbr_signature
from vestige.sources.catalogue import RULES, Rule, extracted
from vestige.sources.ranged import log_chunks

# Events that were considered and are left out, with the reason; channels that are read when asked for.
EXCLUDED = {
    ("Microsoft-Windows-Ntfs/Operational", 10): "cached run statistics", ("Microsoft-Windows-Ntfs/Operational", 142): "free space sampling", ("Microsoft-Windows-Ntfs/Operational", 145): "latency histogram", ("Microsoft-Windows-Ntfs/Operational", 158): "volume statistics", ("System", 98): "corruption state without a device identity", ("System", 15): "hive resize", ("Security", 4907): "audit policy change",
    ("Security", 4663): "object access that names no device", ("Security", 4656): "handle request that names no device",
}
OPT_IN = ("Security",)
# An identity of an enumerator of the bus, or a path that holds one under another.
_ON_USB = re.compile(r"^(USBSTOR|USB|USBPRINT|USBHUB3|WPDBUSENUM|USBVIDEO|USBAUDIO)(\\|$)|(\\|_\?\?_)(USBSTOR|USB|USBPRINT|USBHUB3|WPDBUSENUM|USBVIDEO|USBAUDIO)[\\#]")
# Problem codes of departed devices; what a problem code and a bus type say.
GONE = ("45", "24")
PROBLEMS = {"21": "CM_PROB_WILL_BE_REMOVED", "22": "CM_PROB_DISABLED", "24": "CM_PROB_DEVICE_NOT_THERE", "28": "CM_PROB_FAILED_INSTALL", "43": "CM_PROB_FAILED_POST_START", "45": "CM_PROB_DEVICE_DISCONNECTED", "47": "CM_PROB_HELD_FOR_EJECT"}
BUSES = {"1": "SCSI", "2": "ATAPI", "3": "ATA", "4": "1394", "7": "USB", "8": "RAID", "9": "iSCSI", "10": "SAS", "11": "SATA", "12": "SD", "13": "MMC", "14": "virtual", "15": "file-backed virtual", "17": "NVMe"}


def channel_of(path: str) -> str:
    return os.path.basename(path).rsplit(".", 1)[0].replace("%4", "/")


def wanted(path: str, opted: tuple[str, ...] = ()) -> bool:
    """Whether any rule reads the log's channel, and it was asked for if it must be."""
    channel = channel_of(path).lower()
    return any(channel == r.channel.lower() for r in RULES) and (channel not in [o.lower() for o in OPT_IN] or channel in [o.lower() for o in opted])


@lru_cache(4096)
def rule_for(channel: str, provider: str, event: int) -> Rule | None:
    """The rule of this provider, else the one of any."""
    fits = [r for r in RULES if r.channel.lower() == channel.lower() and r.event == event and r.provider.lower() in ("", provider.lower())]
    return max(fits, key=lambda r: len(r.provider), default=None)


def catalogue(spark: SparkSession) -> DataFrame:
    """What is read and what isn't, as rows."""
    read = [(r.channel, r.provider, r.event, r.id, r.kind, r.meaning, "") for r in RULES]
    return spark.createDataFrame(read + [(c, "", e, "", "", "", why) for (c, e), why in EXCLUDED.items()], "channel string, provider string, event_id int, rule_id string, kind string, meaning string, excluded string")


def places(spark: SparkSession) -> DataFrame:
    """The rules' candidate paths in their order: rule_id, place, path, name, role."""
    rows = [(r.id, k + 1, ".".join(path), name, role) for r in RULES for k, (path, name, role) in enumerate(r.places)]
    return spark.createDataFrame(rows, "rule_id string, place int, path string, name string, role string")


def _usb(role: str, value: str) -> bool:
    value = value.strip().upper()
    if role in ("device_instance_id", "parent_instance_id"):
        return bool(_ON_USB.search(value))
    return (role, value) in (("bus_type", "7"), ("vendor", "USB"))


EVENT = "channel string, record_id long, event_id long, provider string, raw_file_time long, rule_id string, kind string, meaning string, device_instance_id string, outcome string, fields array<struct<name:string,role:string,value:string,path:string>>"


def judged(number: int, raw: int, fields: list[evtx.Field] | None) -> dict:
    """One record: outcome `kept`, or why it isn't (`unreadable`, `excluded: ...`, `no rule`, `no usb device`)."""
    out = {"record_id": number, "raw_file_time": raw if raw < 1 << 63 else None, "fields": []}
    if fields is None:
        return out | {"outcome": "unreadable"}
    system = {p.removeprefix("Event.System."): v for p, v in fields if p.startswith("Event.System.")}
    channel, provider = system.get("Channel", ""), system.get("Provider@Name", "")
    told = system.get("EventID", "0") or "0"
    if not told.isdecimal() or len(told) > 9:
        return out | {"channel": channel, "provider": provider, "outcome": "unreadable"}
    event = int(told)
    out |= {"channel": channel, "event_id": event, "provider": provider}
    if (rule := rule_for(channel, provider, event)) is None:
        why = next((w for (c, e), w in EXCLUDED.items() if c.lower() == channel.lower() and e == event), None)
        return out | {"outcome": f"excluded: {why}" if why else "no rule"}
    kept = extracted(rule, fields)
    passes = {"any": True, "usb": any(_usb(f["role"], f["value"]) for f in kept), "miniport": any(f["name"] == "MiniportName" and f["value"].strip().upper() == "USBSTOR" for f in kept)}[rule.gate]
    if not passes:
        return out | {"outcome": "no usb device"}
    kind = rule.kind
    if event == 420:
        kind = "disconnect" if any(f["role"] == "problem_code" and f["value"].strip() in GONE for f in kept) else "fault"
    device = next((f["value"].strip("\0 ") for f in kept if f["role"] == "device_instance_id"), "")
    return out | {"outcome": "kept", "rule_id": rule.id, "kind": kind, "meaning": rule.meaning, "device_instance_id": device, "fields": kept}


def logs(spark: SparkSession, path: str, opted: tuple[str, ...] = ()) -> DataFrame:
    """path, at, chunk and note of the event logs below path whose channels are read. A log that none reads isn't
    opened: its name is filtered before its content is asked for."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.evtx").load(path)
    return log_chunks(spark, [n for n in (r.path for r in f.select("path").collect()) if wanted(n, opted)])


def scanned(chunks: DataFrame) -> DataFrame:
    """Every record of the chunks with its outcome, place and note; chunks are dealt over all tasks before they are
    decoded. What a chunk holds never ends the job: where its decoder fails, the chunk is an outcome of its own."""
    names = StructType.fromDDL(EVENT).fieldNames()

    def each(batches):
        for b in batches:
            rows = []
            for path, at, chunk, note in zip(b["path"], b["at"], b["chunk"], b["note"]):
                if chunk is None:
                    rows.append((path, at, note, {"outcome": "unreadable chunk" if at == at and at is not None else "unreadable log"}))
                    continue
                try:
                    rows += [(path, at, None, judged(*r)) for r in evtx.records(bytes(chunk))]
                except (struct.error, IndexError, ValueError, OverflowError, RecursionError) as e:
                    rows.append((path, at, f"{type(e).__name__}: {e}", {"outcome": "unreadable chunk"}))
            yield pd.DataFrame([(p, None if at is None or at != at else int(at), note, *(r.get(n) for n in names)) for p, at, note, r in rows], columns=["path", "at", "note", *names]).astype(object)

    return chunks.repartition("path", "at").mapInPandas(each, f"path string, at long, note string, {EVENT}")


def event_table(found: DataFrame) -> DataFrame:
    """The kept records as the event table."""
    e = found.where("outcome = 'kept'").drop("outcome", "fields", "at", "note").withColumnRenamed("path", "source_file")
    return e.withColumn("time_utc", m.filetime(F.col("raw_file_time"))).withColumn("device_key", m.device_key(F.col("device_instance_id")))


def field_table(found: DataFrame) -> DataFrame:
    """The kept records' fields as the event_field table."""
    return found.where("outcome = 'kept'").select(F.col("path").alias("source_file"), "record_id", F.explode("fields").alias("f")).select("source_file", "record_id", "f.*")


def outcomes(found: DataFrame) -> DataFrame:
    """How many records of each log were kept, and why the others weren't."""
    return found.groupBy("path", "outcome").agg(F.count(F.lit(1)).alias("records"))


def disks(found: DataFrame) -> DataFrame:
    """Disks from records that carry a boot record or a drive layout, decoded."""
    value = lambda role: F.get(F.filter("fields", lambda f: f.role == role), F.lit(0)).value
    d = found.where("outcome = 'kept'").select(
        F.col("path").alias("source_file"), "record_id", m.filetime(F.col("raw_file_time")).alias("time_utc"), "device_instance_id", *[value(r).alias(n) for r, n in (("disk_number", "disk_number"), ("product", "model"), ("vendor", "manufacturer"), ("serial", "serial_number"), ("bus_type", "bus_type"), ("capacity", "capacity"))],
        value("boot_record").alias("boot"), value("disk_layout").alias("layout"),
    ).where("boot <> '' or layout <> ''")

    def signatures(b: bytes) -> dict:
        boot, _, raw = bytes(b).partition(b"|")
        signature = mbr_signature(bytes.fromhex(boot.decode()))
        return (layout(bytes.fromhex(raw.decode())) if raw else {"partitions": [], "warnings": ""}) | {"boot_record_signature": signature}

    schema = "style string, disk_guid string, disk_signature long, boot_record_signature long, partition_count int, partitions array<struct<number:int,starting_offset:long,length_bytes:long,type:string,guid:string,name:string>>, warnings string"
    both = F.concat(F.coalesce("boot", F.lit("")), F.lit("|"), F.coalesce("layout", F.lit(""))).cast("binary")
    key = F.concat("source_file", F.lit("#"), F.col("record_id").cast("string"))
    read = decoded(d.select(key.alias("path"), both.alias("content")), signatures, schema).withColumnRenamed("path", "key")
    return d.withColumn("key", key).join(read, "key").drop("key", "boot", "layout").withColumn("device_key", m.device_key(F.col("device_instance_id")))
