"""A collection's files as a case.

load() finds the artefacts, decodes each once, and gives the evidence tables with the ledger: sources with their
digests, an observation for each stored value, a warning for each problem. Everything is a plan over decoded rows, so
the tables are made by all tasks; ids are places in a total order, the same however the work was split.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property

import pandas as pd
from pyarrow.fs import LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.functions import macros as m
from vestige.operators.full import Case
from vestige.operators.rules import RuleSet
from vestige.operators.staging import table_in_shared_folder
from vestige.operators.timeline import numbered, seasonal_candidates
from vestige.sources import binary, events, evidence, jumplists, listing, prefetch, registry, text
from vestige.sources.hive import replayed
from vestige.sources.ranged import digested, log_chunks, where

HIVES = ("SYSTEM", "SOFTWARE", "NTUSER", "USRCLASS")
# What the categories of launches hold.
CATEGORIES = {"{CEBFF5CD-ACE2-4F4F-9178-9926F41749EA}": "an executable file", "{F4E57C4B-2036-45F0-A9AB-443BCFE33D9F}": "a shortcut file"}
#: Changed sources that a manifest names; it counts all.
MOST_CHANGED = 1000
#: The evidence tables of a case.
TABLES = (
    "source", "observation", "warning", "devnode", "host_time_zone", "host_prefetch_setting", "mount_entry", "portable_device", "emd_volume", "mount_point", "shell_bag", "mru_entry", "user_assist",
    "event", "event_field", "disk_layout", "disk_partition", "setup_section", "file_target", "prefetch_run", "prefetch_execution", "prefetch_volume", "prefetch_file",
)
_VALUES = {"DeviceDesc": "device_desc", "FriendlyName": "friendly_name", "Mfg": "mfg", "Class": "class", "ClassGUID": "class_guid", "Service": "service", "ContainerID": "container_id", "ParentIdPrefix": "parent_id_prefix", "HardwareID": "hardware_id", "CompatibleIDs": "compatible_ids", "LocationInformation": "location_information", "BusReportedDeviceDesc": "bus_reported_desc"}
_DATES = {"raw_install_date": "install_date_utc", "raw_first_install_date": "first_install_date_utc", "raw_last_arrival_date": "last_arrival_date_utc", "raw_last_removal_date": "last_removal_date_utc"}
OBSERVED = ("kind", "field", "raw", "value", "summary", "raw_timestamp", "time_utc", "registry_key", "registry_value", "control_set", "event_record_id", "channel", "line_number", "byte_offset")
_TYPES = {"raw_timestamp": "long", "time_utc": "timestamp_ntz", "event_record_id": "long", "line_number": "int", "byte_offset": "long"}


def plain(column: str) -> Column:
    """A path as the collection's listing has it, without the scheme of local files."""
    return F.regexp_replace(column, "^file:/+", "/")


def filled(df: DataFrame) -> DataFrame:
    """df with empty texts instead of null ones."""
    return df.fillna("", [f.name for f in df.schema if f.dataType.simpleString() == "string"])


def united(parts: Iterable[DataFrame]) -> DataFrame:
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first


def device(raw: Column) -> Column:
    """An identity as it is written, without what a device path adds."""
    bare = F.trim(F.regexp_replace(raw, "\x00", ""))
    parts = F.split(F.regexp_replace(bare, r"^.*(_\?\?_|\\\?\?\\)", ""), "#")
    parts = F.when(F.element_at(parts, -1).startswith("{"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(~bare.rlike(r"_\?\?_|\\\?\?\\") | (F.size(parts) < 2), bare).otherwise(F.array_join(parts, "\\"))


class Collection:
    """The evidence tables of what was found, by name."""

    def __init__(self, spark: SparkSession, found: evidence.Found, opted: tuple[str, ...] = ()):
        self.spark, self.opted, self.written = spark, opted, []
        self.artefacts, self.problems = found.tables(spark)
        self._paths: dict[str, list[str]] = {}
        for kind, path, *_ in found.artefacts:
            self._paths.setdefault(kind, []).append(path)
        self._logs = [p for p in self._paths.get("EVTX", []) if events.wanted(p, opted)]

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return getattr(self, name)

    def _staged(self, df: DataFrame) -> DataFrame:
        return table_in_shared_folder(df, self.written)

    def _files(self, paths: list[str]) -> DataFrame:
        """path and content. Characters of the names that patterns use are taken as they are."""
        if not paths:
            return self.spark.createDataFrame([], "path string, content binary")
        named = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]
        read = self.spark.read.format("binaryFile").load(named)
        # URIs of local files come back without their slashes.
        return read.select((F.regexp_replace("path", "^file:/+", "file:///") if paths[0].startswith("file:") else plain("path")).alias("path"), "content")

    # ------------------------------------------------------------------ ledger

    @cached_property
    def _sources(self) -> DataFrame:
        """The artefacts that are read, each with its digest and place. A log that no rule reads isn't."""
        left = F.col("kind") != "EVTX"
        read = self.artefacts.where(left).unionByName(self.artefacts.where(~left).where(F.col("path").isin(self._logs))) if self._logs else self.artefacts.where(left)
        return self._staged(numbered(digested(read.repartition("path")), ["path"], "sequence"))

    @cached_property
    def _known(self) -> DataFrame:
        """path, source_id, profile, context, modified_at of each source."""
        n = F.col("sequence").cast("string")
        return self._sources.select("path", F.concat(F.lit("src-"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)).alias("source_id"), "profile", "context", "modified_at", F.col("kind").alias("artefact"))

    def _of_source(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.join(self._known.select("path", "source_id", *more), "path")

    @cached_property
    def source(self) -> DataFrame:
        replays = self._hives.select("path", "replayed", "replay_logs", "replay_note")
        s = self._sources.join(self._known.select("path", F.col("source_id").alias("id")), "path").join(replays, "path", "left")
        return s.select(
            "id", F.col("sequence").cast("long").alias("sequence"), "path", F.lit("").alias("staged_path"), F.col("kind").alias("artefact"), "size_bytes", F.coalesce("sha256", F.lit("")).alias("sha256"), F.lit(None).cast("timestamp_ntz").alias("read_at"), "replayed",
            F.coalesce("replay_logs", F.lit("")).alias("replay_logs"), F.coalesce("replay_note", F.lit("")).alias("replay_note"), "modified_at", F.lit(None).cast("boolean").alias("verified"), F.lit("").alias("verify_note"),
        )

    def verified(self, source: DataFrame) -> DataFrame:
        """source (as read from the case) with what a second reading of every file found."""
        again = digested(source.select("path").repartition("path")).select("path", F.col("sha256").alias("again"), "problem")
        same = F.coalesce(F.col("again") == F.col("sha256"), F.lit(False))
        note = F.when(same, "").when(F.col("problem").isNotNull(), F.col("problem")).otherwise("the file's digest is another than at the first reading")
        return source.join(again, "path").withColumns({"verified": same, "verify_note": note}).select(*source.columns)

    def event_selection(self) -> dict:
        """What was read of event logs: files, bytes, channels, and records by what became of them."""
        logs = self.artefacts.where("kind = 'EVTX'").select("path")
        skipped = [r.path for r in logs.where(~F.col("path").isin(self._logs)).collect()] if self._logs else [r.path for r in logs.collect()]
        size = self._sources.where("kind = 'EVTX'").agg(F.sum("size_bytes")).first()[0]
        outcomes = {r.outcome: r.n for r in self._scanned.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"files_read": len(self._logs), "files_skipped": len(skipped), "bytes_read": size or 0, "channels_read": sorted({events.channel_of(p) for p in self._logs}), "channels_skipped": sorted({events.channel_of(p) for p in skipped}), "records": outcomes}

    def account(self, source: DataFrame) -> dict:
        """The manifest's account of the evidence: sources by artefact, those that a second reading found changed,
        and the selection of events."""
        again = self.verified(source)
        by = again.groupBy("artefact").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"), F.count_if(~F.col("verified")).alias("changed")).collect()
        changed = again.where(~F.col("verified")).select("path", "verify_note").orderBy("path").limit(MOST_CHANGED).collect()
        return {
            "sources": {r.artefact: {"files": r.n, "bytes": r.b or 0, "changed": r.changed} for r in by},
            "changed": [{"path": r.path, "note": r.verify_note} for r in changed],
            "event_selection": self.event_selection(),
        }

    @cached_property
    def observation(self) -> DataFrame:
        """One row for each stored value, numbered by source, kind and place."""
        rows = united(self._observations())
        order = ["source_id", "kind", "registry_key", "registry_value", "event_record_id", "channel", "line_number", "field", "raw", "value", "summary", "raw_timestamp"]
        n = F.col("place").cast("string")
        return numbered(rows, [F.col(c).asc_nulls_first() for c in order], "place").select(F.concat(F.lit("obs-"), F.when(F.length(n) < 8, F.lpad(n, 8, "0")).otherwise(n)).alias("id"), "source_id", *OBSERVED)

    def _observations(self) -> Iterable[DataFrame]:
        def told(df: DataFrame, kind: Column, **columns: Column | str) -> DataFrame:
            given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
            return df.select("source_id", *[(kind if c == "kind" else given.get(c, F.lit("" if c not in _TYPES else None))).cast(_TYPES.get(c, "string")).alias(c) for c in OBSERVED])

        text_of = lambda *parts: F.concat(*[F.lit(p) if k % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for k, p in enumerate(parts)])
        some = lambda *columns: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns], F.lit(""))
        d = self.devnode
        stored = d.select("source_id", "registry_key", "control_set", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("value")) for name, c in _VALUES.items()])).alias("v")).where("v.value <> ''")
        yield told(stored, F.lit("devnode.value"), field="v.name", raw="v.value", registry_key="registry_key", registry_value="v.name", control_set="control_set")
        yield told(d.where("raw_key_last_write <> 0"), F.lit("devnode.key_last_write"), field=F.lit("LastWriteTime"), raw_timestamp="raw_key_last_write", time_utc="key_last_write_utc", registry_key="registry_key", control_set="control_set")
        dates = d.select("source_id", "registry_key", "control_set", F.explode(F.array(*[F.struct(F.lit(raw.removeprefix("raw_")).alias("name"), F.col(raw).alias("raw"), F.col(utc).alias("utc")) for raw, utc in _DATES.items()])).alias("v")).where("v.raw is not null")
        yield told(dates, F.lit("devnode.property"), field="v.name", raw="v.raw", raw_timestamp="v.raw", time_utc="v.utc", registry_key="registry_key", control_set="control_set")
        zone = text_of("bias=", "bias_minutes", " standard=", "standard_bias_minutes", " daylight=", "daylight_bias_minutes", " active=", "active_bias_minutes")
        yield told(self.host_time_zone, F.lit("host.time_zone"), field="key_name", value="standard_name", summary=zone, registry_key="registry_key", control_set="control_set")
        yield told(self.host_prefetch_setting.where("value_found"), F.lit("host.prefetch_setting"), field=F.lit("EnablePrefetcher"), raw="raw_value", value="description", registry_key="registry_key", registry_value=F.lit("EnablePrefetcher"), control_set="control_set")
        mounts = self.mount_entry
        signed = F.when(F.col("target_kind") == "mbr_disk_signature", F.concat(F.lit("disk_signature="), F.lower(F.lpad(F.hex("disk_signature"), 8, "0")), F.lit(" offset="), F.col("partition_offset").cast("string")))
        volume = F.when(F.col("target_volume_guid") != "", F.concat("target_volume_guid", F.lit("#"), "target_offset_hex"))
        target = F.coalesce(F.when(F.col("device_path") != "", F.col("device_path")), F.when(F.col("partition_guid") != "", F.col("partition_guid")), volume, signed, F.lit(""))
        yield told(mounts, F.concat(F.lit("mounted_device."), "target_kind"), field="value_name", raw="raw", value=target, registry_key=F.lit("MountedDevices"), registry_value="value_name")
        held = F.when(F.col("device_instance_id") != "", F.col("device_instance_id")).when(F.col("volume_guid") != "", F.concat("volume_guid", F.lit("#"), "volume_offset_hex")).otherwise("")
        yield told(self.portable_device, F.lit("portable_device"), field=F.lit("FriendlyName"), raw="friendly_name", value=held, registry_key="registry_path", registry_value=F.lit("FriendlyName"))
        yield told(self.emd_volume, F.lit("emdmgmt.volume"), field=F.lit("key_name"), raw="key_name", value="volume_serial_decimal", summary=text_of("volume label ", "volume_label"), registry_key="registry_path")
        point = dict(field=F.lit("key_name"), raw="key_name", summary=text_of("profile ", "profile"), raw_timestamp="raw_key_last_write", time_utc="key_last_write_utc", registry_key="registry_path")
        yield told(self.mount_point, F.concat(F.lit("mount_point."), "kind"), value=some("volume_guid", "drive_letter", "remote_path"), **point)
        used = dict(field="profile", raw_timestamp="raw_key_last_write", time_utc="key_last_write_utc", registry_key="registry_path")
        yield told(self.shell_bag, F.lit("shell_bag"), value="path", summary=text_of("kind=", "kind", "; depth=", "depth"), **used)
        yield told(self.mru_entry, F.concat(F.lit("mru."), "kind"), value=some("path", "name"), summary=text_of("list=", "source_list", "; kind=", "kind", "; mru_position=", "position"), registry_value="value_name", **used)
        launch = text_of("category=", "category", "; run_count=", "run_count", "; focus_count=", "focus_count")
        yield told(self.user_assist, F.lit("user_assist"), field="profile", value="name", summary=launch, raw_timestamp="raw_last_executed", time_utc="last_executed_utc", registry_key="registry_path", registry_value="value_name")
        fields = self.event_field.groupBy("source_id", "record_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("="), "value"))), "; ").alias("said"))
        yield told(self.event.join(fields, ["source_id", "record_id"], "left"), F.concat(F.lit("event."), "kind"), field="rule_id", value="device_instance_id", summary=F.coalesce("said", F.lit("")), raw_timestamp="raw_file_time", time_utc="time_utc", event_record_id="record_id", channel="channel")
        disk = text_of("style=", "style", "; partitions=", "partition_count", "; ", "warnings")
        yield told(self.disk_layout, F.lit("disk.layout"), field="disk_number", value="device_instance_id", summary=disk, time_utc="time_utc", event_record_id="record_id", channel=F.lit("Microsoft-Windows-Partition/Diagnostic"))
        yield told(self.setup_section, F.concat(F.lit("setupapi."), "kind"), field=F.lit("section_target"), raw="target", value="device_instance_id", summary=text_of("operation=", "operation", "; start_local=", "start_local"), line_number="line_number")
        link = text_of("drive_type=", "drive_type", "; serial=", "volume_serial_hex", "; label=", "volume_label")
        links, jumps = (self.file_target.where(F.col("origin") == o) for o in ("shell_link", "jump_list"))
        yield told(links, F.lit("shell_link"), field="profile", value="path", summary=link, raw_timestamp="raw_target_written", time_utc="target_written_utc")
        yield told(jumps, F.lit("jump_list_entry"), field="profile", value="path", summary=F.concat(text_of("app_id=", "app_id", "; mru_position=", "mru_position", "; "), link), raw_timestamp="raw_last_access", time_utc="last_access_utc", registry_value="stream_name")
        run = text_of("version=", "format_version", " run_count=", "run_count", " times=", "times_recorded", " volumes=", "volume_count", " files=", "file_count")
        first = self.prefetch_execution.where("slot = 1").select("source_id", "time_utc")
        yield told(self.prefetch_run.join(first, "source_id", "left"), F.lit("prefetch.run"), field="executable", value="executable_path", summary=run, time_utc="time_utc")
        yield told(self.prefetch_volume, F.lit("prefetch.volume"), field="executable", raw="device_path", value="volume_serial_hex", time_utc="created_utc")

    @cached_property
    def warning(self) -> DataFrame:
        """What is missing, was refused, couldn't be read, or could be read in part."""
        columns = ["source_id", "artefact", "path", "severity", "message"]
        of = lambda df, severity: self._of_source(df.where("problem is not null"), "artefact").select("source_id", "artefact", "path", F.lit(severity).alias("severity"), F.col("problem").alias("message"))
        parts = [self.problems.select(F.lit(None).cast("string").alias("source_id"), "artefact", "path", "severity", "message"), of(self._sources.select("path", "problem"), "failed"), of(self._unread, "malformed")]
        # Readers of files pass over those without a byte.
        parts.append(of(self._sources.where("size_bytes = 0").select("path", F.lit("the file is empty").alias("problem")), "malformed"))
        beside = self._of_source(self._hives.select("path", F.explode("unused").alias("log")), "artefact")
        parts.append(beside.select("source_id", F.lit("TRANSACTION_LOG").alias("artefact"), F.col("log.path").alias("path"), F.lit("absent").alias("severity"), F.concat(F.lit("the log beside "), F.element_at(F.split("path", "/"), -1), F.lit(" was not applied: "), "log.state").alias("message")))
        bad = self._scanned.groupBy("path").agg(F.count_if(F.col("outcome") == "unreadable chunk").alias("bad"), F.count_distinct("at").alias("chunks"), F.max(F.when(F.col("outcome") == "unreadable log", F.col("note"))).alias("whole"))
        bad = self._of_source(bad, "artefact")
        parts.append(bad.where("whole is not null").select("source_id", "artefact", "path", F.lit("failed").alias("severity"), F.col("whole").alias("message")))
        lost = F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("chunks").cast("string"), F.lit(" chunks could not be parsed; records they hold are not in this result"))
        parts.append(bad.where("bad > 0").select("source_id", "artefact", "path", F.lit("malformed").alias("severity"), lost.alias("message")))
        records = self._of_source(self._scanned.where("outcome = 'unreadable'").groupBy("path").agg(F.count(F.lit(1)).alias("n")), "artefact")
        parts.append(records.select("source_id", "artefact", "path", F.lit("partial").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" records could not be decoded")).alias("message")))
        return united(p.select(*columns) for p in parts).withColumn("recorded_at", F.lit(None).cast("timestamp_ntz"))

    # ------------------------------------------------------------------- hives

    @cached_property
    def _hives(self) -> DataFrame:
        """path, artefact, content after replay, and what became of the logs: replayed, replay_logs, replay_note and
        the logs that gave nothing. A hive has two logs at most, so they meet it in one row."""
        hives = self.artefacts.where(F.col("kind").isin(*HIVES)).select("path", F.col("kind").alias("artefact"), "logs")
        paths = [p for k in HIVES for p in self._paths.get(k, [])]
        beside = hives.select("path", F.explode("logs").alias("log"))
        names = [r.log for r in beside.select("log").collect()]
        content = self._files(names).select(F.col("path").alias("log"), F.col("content").alias("bytes"))
        logs = beside.join(content, "log").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("log", "bytes"))).alias("logs"))

        def each(batches):
            for b in batches:
                rows = []
                for path, artefact, content, logs in zip(b["path"], b["artefact"], b["content"], b["logs"]):
                    held = {r["log"]: bytes(r["bytes"]) for r in (logs if logs is not None else ())}
                    try:
                        whole, state = replayed(bytes(content), held) if held else (bytes(content), {})
                        problem = None
                    except Exception as e:  # a hive that no log fits is still read as it is
                        whole, state, problem = bytes(content), {}, f"its logs weren't replayed: {e}"
                    applied = sorted(p.rsplit("/", 1)[-1] for p, s in state.items() if s == "applied")
                    note = problem or "; ".join(f"{p.rsplit('/', 1)[-1]}: {s}" for p, s in sorted(state.items()))
                    rows.append((path, artefact, whole, bool(applied), "; ".join(applied), note, [{"path": p, "state": s} for p, s in sorted(state.items()) if s != "applied"]))
                yield pd.DataFrame(rows, columns=["path", "artefact", "content", "replayed", "replay_logs", "replay_note", "unused"]).astype(object)

        joined = self._files(paths).join(hives.select("path", "artefact"), "path").join(logs, "path", "left").select("path", "artefact", "content", "logs")
        return self._staged(joined.mapInPandas(each, "path string, artefact string, content binary, replayed boolean, replay_logs string, replay_note string, unused array<struct<path:string,state:string>>"))

    def _read(self, kinds: tuple[str, ...], reader, schema: str) -> DataFrame:
        """The reader's rows of the hives of these kinds with path, and the files' problems."""
        return self._staged(registry.rows_of(self._hives.where(F.col("artefact").isin(*kinds)), reader, schema))

    def _rows(self, rows: DataFrame, *more: str) -> DataFrame:
        return self._of_source(rows.where("problem is null").drop("problem"), *more)

    @cached_property
    def _devnodes(self) -> DataFrame:
        return self._read(("SYSTEM",), registry.devnodes, registry.DEVNODE)

    @cached_property
    def _unread(self) -> DataFrame:
        """path and problem of the files whose decoder gave up."""
        of = [self._devnodes, self._targets, self._runs, self._bags, self._lists, self._launches]
        return united(d.where("problem is not null").select("path", "problem") for d in of).distinct()

    @cached_property
    def devnode(self) -> DataFrame:
        d = self._rows(self._devnodes)
        times = {"key_last_write_utc": m.filetime(F.col("raw_key_last_write")), **{utc: m.filetime(F.col(raw)) for raw, utc in _DATES.items()}}
        d = filled(d.withColumn("device_key", m.device_key(F.col("normalised_instance_id"))).withColumns(times)).withColumn("device_instance_id", F.col("normalised_instance_id"))
        return d.drop("path")

    @cached_property
    def host_time_zone(self) -> DataFrame:
        return filled(self._rows(self._read(("SYSTEM",), registry.time_zone, registry.ZONE)).drop("path"))

    @cached_property
    def host_prefetch_setting(self) -> DataFrame:
        return self._rows(self._read(("SYSTEM",), registry.prefetch_setting, registry.PREFETCH_SETTING)).drop("path")

    @cached_property
    def mount_entry(self) -> DataFrame:
        e = text.mounted(self._rows(self._read(("SYSTEM",), registry.mounted_devices, registry.MOUNTED)))
        own = F.when(F.col("device_path") != "", device(F.col("device_path"))).otherwise("")
        e = e.withColumn("device_instance_id", own).withColumn("raw", F.lower("hex"))
        return filled(e.drop("path", "hex")).fillna(0, ["disk_signature", "partition_offset"])

    def _keys(self, kinds: tuple[str, ...], where: str, *more: str) -> DataFrame:
        k = self._rows(self._read(kinds, registry.subkeys_of(where), registry.KEYS), *more)
        return filled(k.withColumn("key_last_write_utc", m.filetime(F.col("raw_key_last_write"))))

    @staticmethod
    def _named_device() -> Column:
        """The identity in a key's name that holds a device path."""
        name = F.col("key_name")
        return F.when(F.upper(name).contains("_??_"), device(F.regexp_extract(name, r"(?i)(_\?\?_.*)$", 1))).otherwise("")

    @cached_property
    def portable_device(self) -> DataFrame:
        k = self._keys(("SOFTWARE",), registry.PORTABLE)
        form = r"(?i)^SWD#WPDBUSENUM#(\{[0-9a-f-]+\})#([0-9A-F]+)$"
        volume = F.lower(F.regexp_extract("key_name", form, 1))
        k = k.withColumns({"volume_guid": volume, "volume_offset_hex": F.regexp_extract("key_name", form, 2), "device_instance_id": F.when(volume == "", self._named_device()).otherwise("")})
        return k.select("source_id", "registry_path", "key_name", "friendly_name", "device_instance_id", m.device_key(F.col("device_instance_id")).alias("device_key"), "volume_guid", "volume_offset_hex")

    @cached_property
    def emd_volume(self) -> DataFrame:
        k = text.emd_keys(self._keys(("SOFTWARE",), registry.EMDMGMT)).withColumn("device_instance_id", self._named_device())
        return k.select("source_id", "registry_path", "key_name", "volume_label", "volume_serial_decimal", "device_instance_id", m.device_key(F.col("device_instance_id")).alias("device_key"))

    @cached_property
    def mount_point(self) -> DataFrame:
        k = text.mount_points(self._keys(("NTUSER",), registry.MOUNT_POINTS, "profile"))
        return k.select("source_id", "profile", "registry_path", "key_name", "kind", "drive_letter", "volume_guid", "remote_path", "raw_key_last_write", "key_last_write_utc")

    @cached_property
    def _bags(self) -> DataFrame:
        return self._read(("NTUSER", "USRCLASS"), registry.shell_bags, registry.BAG)

    @cached_property
    def _lists(self) -> DataFrame:
        return self._read(("NTUSER",), registry.mru_lists, registry.MRU)

    @cached_property
    def _launches(self) -> DataFrame:
        return self._read(("NTUSER",), registry.user_assist, registry.LAUNCHES)

    def _used(self, rows: DataFrame) -> DataFrame:
        d = self._rows(rows, "profile").drop("path").withColumnRenamed("path_text", "path")
        return filled(d.withColumn("key_last_write_utc", m.filetime(F.col("raw_key_last_write"))))

    @cached_property
    def shell_bag(self) -> DataFrame:
        return self._used(self._bags).withColumns({"raw_created": F.lit(None).cast("long"), "raw_accessed": F.lit(None).cast("long")})

    @cached_property
    def mru_entry(self) -> DataFrame:
        return self._used(self._lists)

    @cached_property
    def user_assist(self) -> DataFrame:
        d = text.launch_records(self._rows(self._launches, "profile"))
        name = F.lit("")
        for guid, what in CATEGORIES.items():
            name = F.when(F.upper("category") == guid, what).otherwise(name)
        d = d.withColumns({"category_name": name, "last_executed_utc": m.filetime(F.col("raw_last_executed")), "raw": F.lower("hex"), "focus_seconds": F.col("focus_seconds").cast("double")})
        return filled(d.drop("path", "hex"))

    # ------------------------------------------------------------------ events

    @cached_property
    def _scanned(self) -> DataFrame:
        return self._staged(events.scanned(log_chunks(self.spark, self._logs)))

    @cached_property
    def event(self) -> DataFrame:
        e = events.event_table(self._scanned).withColumnRenamed("source_file", "path")
        return filled(self._of_source(e).withColumnRenamed("path", "source_file"))

    @cached_property
    def event_field(self) -> DataFrame:
        f = events.field_table(self._scanned)
        ids = self._known.select(F.col("path").alias("source_file"), "source_id")
        return filled(f.join(ids, "source_file"))

    @cached_property
    def _disks(self) -> DataFrame:
        ids = self._known.select(F.col("path").alias("source_file"), "source_id")
        return self._staged(events.disks(self._scanned).join(ids, "source_file"))

    @cached_property
    def disk_layout(self) -> DataFrame:
        return filled(self._disks.drop("partitions")).fillna(0, ["disk_signature", "boot_record_signature", "partition_count"])

    @cached_property
    def disk_partition(self) -> DataFrame:
        p = self._disks.select("source_id", "record_id", "device_key", "disk_number", "style", F.explode("partitions").alias("p"))
        gpt = F.col("style") == "GPT"
        return filled(
            p.select(
                "source_id", "record_id", "device_key", "disk_number", F.col("p.number").alias("partition_number"), F.col("p.starting_offset").alias("starting_offset"), F.col("p.length_bytes").alias("length_bytes"), F.col("p.guid").alias("partition_guid"),
                F.when(gpt, F.col("p.type")).otherwise("").alias("type_guid"), F.col("p.name").alias("partition_name"), F.when(~gpt, F.conv("p.type", 16, 10).cast("int")).alias("mbr_type"),
            )
        )

    # ------------------------------------------------------------------- files

    @cached_property
    def setup_section(self) -> DataFrame:
        """Sections of the install logs that name a device of the bus, with the readings of their local times: under
        standard time and, where the host observes it, under daylight time as well."""
        paths = self._paths.get("SETUPAPI", []) + self._paths.get("SETUPAPI_ROTATED", [])
        s = text.sections_of(self._files(paths).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("value"))).transform(text.usb_sections)
        s = self._of_source(s.withColumnRenamed("source_file", "path"))
        kind = F.when(F.contains("operation", F.lit("Device Install")), "install").when(F.contains("operation", F.lit("Delete Device")), "delete").otherwise("other")
        zone = self.host_time_zone
        observes = (F.col("daylight_bias_minutes") != 0) & (F.coalesce("standard_start_month", F.lit(0)) != 0) & (F.coalesce("daylight_start_month", F.lit(0)) != 0) & ~F.coalesce("dynamic_daylight_disabled", F.lit(False))
        host = zone.select((F.col("bias_minutes") + F.col("standard_bias_minutes")).alias("bias"), F.when(observes, F.col("daylight_bias_minutes")).otherwise(0).alias("daylight")).orderBy("bias", "daylight").first()
        s = s.withColumns({"kind": kind, "device_instance_id": device(F.col("target"))}).withColumn("device_key", m.device_key(F.col("device_instance_id")))
        none = F.lit(None).cast("timestamp_ntz")
        if host is None:
            s = s.withColumns({"start_utc": none, "start_utc_alt": none, "start_basis": F.lit(""), "time_ambiguous": F.lit(False)})
        else:
            two = bool(host.daylight)
            s = seasonal_candidates(s.select("*", F.struct(*s.columns).alias("id"), F.col("start_local").alias("local_text")), host.bias, host.daylight).select("id.*", F.col("standard_utc").alias("start_utc"), (F.col("daylight_utc") if two else none).alias("start_utc_alt"))
            s = s.withColumn("start_basis", F.when(F.col("start_utc").isNotNull(), "standard_time").otherwise("")).withColumn("time_ambiguous", F.col("start_utc_alt").isNotNull())
        return filled(s.withColumnRenamed("path", "source_file").drop("complete"))

    @cached_property
    def _targets(self) -> DataFrame:
        """Rows of links and jump lists with path and problem."""
        extra = "origin string, app_id string, stream_name string, entry_number long, mru_position int, access_count long, destlist_ranking_value double, pinned boolean, raw_last_access long, destlist_present boolean, recorded_path string"

        def read(content: bytes, path: str):
            if path.lower().endswith(".lnk"):
                got = binary.link(content)
                if got.get("warnings") == "not a shell link":
                    raise ValueError("not a shell link")
                yield {"origin": "shell_link", "app_id": "", "stream_name": "", "destlist_present": False} | got
            else:
                yield from jumplists.entries(content, path)

        return self._staged(registry.rows_of(self._files(self._paths.get("LNK", []) + self._paths.get("JUMPLIST", [])), read, f"{binary.LINK}, {extra}"))

    @cached_property
    def file_target(self) -> DataFrame:
        t = self._rows(self._targets, "profile", "context", "modified_at")
        target = F.when(F.coalesce("target_path", F.lit("")) != "", F.col("target_path")).otherwise(F.coalesce("recorded_path", F.lit("")))
        letter = F.upper(F.regexp_extract(target, r"^([A-Za-z]):", 1))
        link = F.col("origin") == "shell_link"
        t = t.withColumns({
            "source_file": F.col("path"), "of": target, "drive_letter": letter, "volume_present": F.col("drive_type").isNotNull(), "removable": F.coalesce("removable", F.lit(False)), "raw_target_written": F.coalesce("raw_written", F.lit(0)), "target_written_utc": m.filetime(F.col("raw_written")),
            "raw_target_accessed": F.coalesce("raw_accessed", F.lit(0)), "target_accessed_utc": m.filetime(F.col("raw_accessed")), "target_created_utc": m.filetime(F.col("raw_created")), "last_access_utc": m.filetime(F.col("raw_last_access")), "source_modified_utc": F.when(link, F.col("modified_at")),
            "link_context": F.when(link, F.col("context")).otherwise(""), "parse_warnings": F.coalesce("warnings", F.lit("")),
        })
        return filled(t.drop("path", "target_path", "raw_written", "raw_accessed", "raw_created", "warnings", "context", "modified_at", "recorded_path").withColumnRenamed("of", "path"))

    @cached_property
    def _runs(self) -> DataFrame:
        return self._staged(registry.rows_of(self._files(self._paths.get("PREFETCH", [])), prefetch.run, prefetch.RUN))

    @cached_property
    def _programs(self) -> DataFrame:
        return self._rows(self._runs).withColumnRenamed("path", "source_file")

    @cached_property
    def prefetch_run(self) -> DataFrame:
        return filled(self._programs.drop("raw_run_times", "files", "volumes"))

    @cached_property
    def prefetch_execution(self) -> DataFrame:
        e = self._programs.select("source_id", "source_file", "executable", F.posexplode("raw_run_times").alias("slot", "raw"))
        return e.select("source_id", "source_file", "executable", (F.col("slot") + 1).alias("slot"), m.filetime(F.col("raw")).alias("time_utc"))

    @cached_property
    def prefetch_volume(self) -> DataFrame:
        v = self._programs.select("source_id", "source_file", "executable", F.explode("volumes").alias("v")).select("source_id", "source_file", "executable", "v.*")
        return filled(v.withColumn("created_utc", m.filetime(F.col("raw_created"))).drop("raw_created"))

    @cached_property
    def prefetch_file(self) -> DataFrame:
        return self._programs.select("source_id", "source_file", "executable", F.explode("files").alias("path"))


def load(spark: SparkSession, root: str, opted: tuple[str, ...] = (), rules: RuleSet | None = None, profile: str = "general") -> Case:
    """The case of the collection in the folder root, a path of this machine or a URI of a file system that Arrow
    opens and Spark reads. opted: channels that are read only when asked for. Tables are
    decoded when a view first asks for them, written once, and deleted when the case is closed."""
    here = isinstance(where(root)[0], LocalFileSystem) and "://" not in root
    made = Collection(spark, evidence.locate(root) if here else listing.located(spark, root), opted)
    ruled = (rules or RuleSet()).tables(spark, profile)
    case = Case(lambda name: ruled[name] if name in ruled else table_in_shared_folder(made.table(name), case._written))
    made.written = case._written
    case.collection = made
    return case
