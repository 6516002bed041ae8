"""Provenance projections, devices, the links between their identities, disks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.functions import macros as m
from vestige.operators.case import Views, consolidated, listed, listed_by, said, view, with_source
from vestige.operators.components import connected_components
from vestige.operators.timeline import numbered

# Enumerators whose serials may be compared, and the least lengths.
COMPARED = ("USB", "USBSTOR", "SCSI", "WPDBUSENUM")
LEAST_SERIAL, LEAST_PREFIX = 5, 20
#: Identities of a key that meet in one block, where all its pairs are asked for.
A_BLOCK = 1_000
#: Rows of attributes that count as not known where a view takes the first known one.
_PREFERRED = ("serial", "friendly_name", "device_desc", "bus_reported_desc", "mfg", "class", "class_guid", "service", "hardware_id")
_SUMMED = ("event_count", "connect_events", "disconnect_events", "install_events", "fault_events", "setup_sections", "evidence_count")


class Inventory(Views):
    # ------------------------------------------------------------ provenance

    @view
    def source(self) -> DataFrame:
        return self.table("source").withColumnsRenamed({"id": "source_id", "sequence": "read_order", "path": "source_path"})

    @view
    def observation(self) -> DataFrame:
        return with_source(self.table("observation"), self.table("source"), artefact="artefact", source_path="path", source_sha256="sha256").withColumnRenamed("id", "observation_id")

    @view
    def warning(self) -> DataFrame:
        w = with_source(self.table("warning"), self.table("source"), of_source="path")
        return w.select("severity", "artefact", F.coalesce("path", "of_source").alias("path"), "message", "source_id", "recorded_at")

    @view
    def parse_warning(self) -> DataFrame:
        """Decoders' remarks, cut at semicolons, by what they say when numbers are left out."""
        carried = {"shell_bag": ("shell_bag", "warnings"), "mru_entry": ("mru_entry", "warnings"), "user_assist": ("user_assist", "warnings"), "disk_layout": ("disk_layout", "warnings"), "file_record": ("file_target", "parse_warnings"), "prefetch": ("prefetch_run", "parse_warnings")}
        parts = [self.table(t).where(F.col(c) != "").select(F.lit(artefact).alias("artefact"), "source_id", F.explode(F.split(c, ";")).alias("message")) for artefact, (t, c) in carried.items()]
        each = parts[0]
        for p in parts[1:]:
            each = each.unionByName(p)
        each = each.withColumn("message", F.trim("message")).where("message <> ''").withColumn("reason", F.regexp_replace("message", "[0-9]+", "#"))
        return each.groupBy("artefact", "reason").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source_id").alias("source_files"), F.min("message").alias("example"))

    @view
    def devnode(self) -> DataFrame:
        k = F.col("normalised_instance_id")
        d = self.table("devnode").withColumns({"serial_is_generated": m.is_generated_serial(k), "serial": m.device_serial(k), "serial_recorded": m.device_serial_recorded(k), "serial_rule": m.device_serial_rule(k)})
        return with_source(d, self.table("source"), source_path="path", source_sha256="sha256", replayed="replayed")

    @view
    def event(self) -> DataFrame:
        return with_source(self.table("event"), self.table("source"), source_path="path", source_sha256="sha256")

    @view
    def shell_bag(self) -> DataFrame:
        return with_source(self.table("shell_bag"), self.table("source"), source_path="path", source_sha256="sha256")

    @view
    def mru_entry(self) -> DataFrame:
        return with_source(self.table("mru_entry"), self.table("source"), source_path="path", source_sha256="sha256")

    @view
    def user_assist(self) -> DataFrame:
        return with_source(self.table("user_assist"), self.table("source"), source_path="path", source_sha256="sha256")

    @view
    def file_target(self) -> DataFrame:
        return with_source(self.table("file_target"), self.table("source"), source_path="path", source_sha256="sha256")

    @view
    def host_prefetch_setting(self) -> DataFrame:
        return self.table("host_prefetch_setting").select("registry_key", "control_set", "value_found", "raw_value", "description", "source_id")

    @view
    def host_time_zone(self) -> DataFrame:
        standard = F.col("bias_minutes") + F.col("standard_bias_minutes")
        seasonal = (F.col("daylight_bias_minutes") != 0) & (F.coalesce("standard_start_month", F.lit(0)) != 0) & (F.coalesce("daylight_start_month", F.lit(0)) != 0) & ~F.coalesce("dynamic_daylight_disabled", F.lit(False))
        return self.table("host_time_zone").select("*", standard.alias("standard_offset_minutes"), (standard + F.col("daylight_bias_minutes")).alias("daylight_offset_minutes"), seasonal.alias("observes_daylight_saving"))

    # --------------------------------------------------------------- devices

    @view
    def device_evidence(self) -> DataFrame:
        """Every record that names a device: what it is and when it was made, if that is known."""
        undated = F.lit(None).cast("timestamp_ntz")
        of = lambda df, name, evidence, path, at: df.where("device_key <> ''").select("device_key", F.col(name).alias("device_instance_id"), evidence.alias("evidence"), "source_id", path.alias("source_path"), at.alias("observed_utc"))
        parts = [
            of(self.devnode(), "normalised_instance_id", F.lit("registry.devnode"), F.col("source_path"), F.col("key_last_write_utc")),
            of(self.event(), "device_instance_id", F.concat(F.lit("event."), "kind"), F.col("source_path"), F.col("time_utc")),
            of(self.table("setup_section"), "device_instance_id", F.concat(F.lit("setupapi."), "kind"), F.col("source_file"), F.col("start_utc")),
            of(self.table("portable_device"), "device_instance_id", F.lit("registry.portable_device"), F.col("registry_path"), undated),
            of(self.table("mount_entry"), "device_instance_id", F.lit("registry.mounted_devices"), F.concat(F.lit("MountedDevices\\"), "value_name"), undated),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @consolidated
    def device(self) -> DataFrame:
        """One row per identity. Each source is summed by itself before they meet, so no join multiplies rows."""
        of = self.device_evidence().groupBy("device_key").agg(
            F.max("device_instance_id").alias("named"), F.count(F.lit(1)).alias("evidence_count"), F.count_distinct("evidence").alias("evidence_kinds"), F.min("observed_utc").alias("first_seen_utc"), F.max("observed_utc").alias("last_seen_utc"),
            F.bool_or(F.col("evidence") == "registry.devnode").alias("in_registry"), listed("evidence", "; ").alias("evidence_sources"),
        )
        texts = ["friendly_name", "device_desc", "bus_reported_desc", "mfg", "class", "class_guid", "service", "container_id", "hardware_id", "location_information"]
        dates = ["first_install_date_utc", "install_date_utc", "last_arrival_date_utc", "last_removal_date_utc", "key_last_write_utc"]
        nodes = self.devnode().where("device_key <> ''").groupBy("device_key").agg(
            F.max("normalised_instance_id").alias("node_id"), F.max("enumerator").alias("node_enumerator"), F.max(said("serial")).alias("node_serial"), F.bool_and("serial_is_generated").alias("node_generated"), F.count_distinct("control_set").alias("control_sets"),
            *[F.max(said(c)).alias(c) for c in texts], *[F.max(c).alias(c) for c in dates],
        )
        kind = lambda k: F.col("kind") == k
        events = self.table("event").where("device_key <> ''").groupBy("device_key").agg(
            F.count(F.lit(1)).alias("event_count"), *[F.count_if(kind(k)).alias(f"{k}_events") for k in ("connect", "disconnect", "install", "fault")], F.count_distinct("channel").alias("event_channels"),
            F.min(F.when(kind("connect"), F.col("time_utc"))).alias("first_connect_utc"), F.max(F.when(kind("disconnect"), F.col("time_utc"))).alias("last_disconnect_utc"), F.min("time_utc").alias("first_event_utc"), F.max("time_utc").alias("last_event_utc"),
        )
        setup = self.table("setup_section").where("device_key <> ''").groupBy("device_key").agg(F.count(F.lit(1)).alias("setup_sections"), F.min("start_local").alias("first_setup_local"), F.max("start_local").alias("last_setup_local"))
        letters = self.table("mount_entry").where("device_key <> '' and drive_letter <> ''").groupBy("device_key").agg(listed("drive_letter", ",").alias("current_drive_letters"))
        portable = self.table("portable_device").where("device_key <> '' and friendly_name <> ''").groupBy("device_key").agg(listed("friendly_name", "; ").alias("portable_names"))
        out = of
        for part in (nodes, events, setup, letters, portable):
            out = out.join(part, "device_key", "left")
        counts = ["control_sets", "event_count", "connect_events", "disconnect_events", "install_events", "fault_events", "event_channels", "setup_sections"]
        return out.select(
            "device_key", F.coalesce("node_id", "named").alias("device_instance_id"), F.coalesce("node_enumerator", F.substring_index("device_key", "\\", 1)).alias("enumerator"), F.coalesce("node_serial", m.device_serial(F.col("named")), F.lit("")).alias("serial"),
            F.coalesce("node_generated", m.is_generated_serial(F.col("named"))).alias("serial_is_generated"), *[F.coalesce(c, F.lit("")).alias(c) for c in (*texts, "portable_names", "current_drive_letters", "first_setup_local", "last_setup_local")],
            *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], *dates, "in_registry", "first_connect_utc", "last_disconnect_utc", "first_event_utc", "last_event_utc", "first_seen_utc", "last_seen_utc", "evidence_count", "evidence_kinds", "evidence_sources",
        )

    @view
    def device_lifecycle(self) -> DataFrame:
        dates = ["first_install_date_utc", "install_date_utc", "last_arrival_date_utc", "last_removal_date_utc"]
        any_ = F.coalesce(*dates).isNotNull()
        caveat = F.lit("most recent event of each kind only; not a connection history")
        return self.devnode().where((F.col("device_key") != "") & any_).select("device_key", F.col("normalised_instance_id").alias("device_instance_id"), "control_set", *dates, "key_last_write_utc", caveat.alias("caveat"), "source_id", "source_path")

    @view
    def disk(self) -> DataFrame:
        """Disk records with their partitions in order."""
        typed = F.concat(F.lit("type "), F.lower(F.lpad(F.hex("mbr_type"), 2, "0")), F.lit(" at offset "), F.col("starting_offset").cast("string"))
        named = F.concat(F.coalesce(F.concat(said("partition_name"), F.lit(" ")), F.lit("")), "partition_guid")
        text = F.when(F.col("partition_guid") != "", named).otherwise(typed)
        partitions = self.table("disk_partition").groupBy("source_id", "record_id").agg(F.count("partition_number").alias("partitions_decoded"), listed_by(text, "; ", F.col("partition_number")).alias("partitions"))
        out = self.table("disk_layout").join(partitions, ["source_id", "record_id"], "left").na.fill(0, ["partitions_decoded"])
        return with_source(out, self.table("source"), source_path="path")

    # ----------------------------------------------------------------- links

    def _compared(self) -> tuple[DataFrame, DataFrame]:
        """What identities are compared by, and those with a serial of their own."""
        d = self.device().select(
            "device_key", F.upper("enumerator").alias("enumerator"), F.upper("serial").alias("serial"), "serial_is_generated", F.lower("container_id").alias("container_id"), m.device_vid_pid(F.col("device_key")).alias("vid_pid"),
            m.has_instance_id(F.col("device_key")).alias("whole"), F.upper(F.get(F.split("device_key", r"\\"), F.lit(1))).alias("product"),
        )
        return d, d.where("serial <> '' and not serial_is_generated")

    def _across(self, real: DataFrame) -> DataFrame:
        """Identities whose serials are compared across enumerators, and whether the serial is shared: more than one
        product of an enumerator or more than one vendor and product id has it."""
        by = real.groupBy("serial", "enumerator").agg(F.count_distinct("product").alias("products"), F.min(said("vid_pid")).alias("least"), F.max(said("vid_pid")).alias("most"))
        shared = by.groupBy("serial").agg(F.coalesce((F.max("products") > 1) | (F.min("least") < F.max("most")), F.lit(False)).alias("shared"))
        return real.where(F.col("enumerator").isin(*COMPARED) & (F.length("serial") >= LEAST_SERIAL)).join(shared, "serial")

    @view
    def _nodes(self) -> DataFrame:
        return self.devnode().where("device_key <> ''").groupBy("device_key").agg(
            *[F.upper(F.max(said(c))).alias(c) for c in ("parent_id_prefix", "instance_id", "device_id")], F.lower(F.max(said("service"))).alias("service"), F.upper(F.max("enumerator")).alias("enumerator"), F.upper(F.concat_ws("|", F.collect_set("hardware_id"))).alias("hardware_ids"),
        )

    def _kin(self) -> tuple[DataFrame, DataFrame]:
        """Parents and children by prefix: every beginning of an instance id that ends before an ampersand, and the
        whole of it."""
        n = self._nodes()
        at = F.expr("transform(sequence(1, size(split(instance_id, '&'))), k -> substring_index(instance_id, '&', k))")
        child = n.where("instance_id is not null").select(F.col("device_key").alias("child"), F.explode(F.array_distinct(at)).alias("parent_id_prefix"))
        parent = n.where("parent_id_prefix is not null and enumerator in ('USB', 'HID') and not startswith(device_id, 'ROOT_HUB') and not startswith(coalesce(service, ''), 'usbhub')").select(F.col("device_key").alias("parent"), "parent_id_prefix")
        return parent, child

    def _declared(self, d: DataFrame) -> DataFrame:
        """(partial, full, matches): identities without an instance that are hardware ids of others."""
        declared = self._nodes().select(F.col("device_key").alias("full"), F.explode(F.array_distinct(F.split("hardware_ids", r"\|"))).alias("partial"))
        part = d.where(~F.col("whole")).select(F.col("device_key").alias("partial")).join(declared, "partial")
        return part.join(part.groupBy("partial").agg(F.count(F.lit(1)).alias("matches")), "partial")

    @consolidated
    def _grouping_star(self) -> DataFrame:
        """left_key, right_key, method, precedence: the asserted links with an edge an identity and key, to the key's
        least identity. Components and methods are those of all pairs: a key's pairs connect all that has it, across
        enumerators as soon as there are two, parents with children as soon as there are both."""
        d, real = self._compared()

        def star(df: DataFrame, on: list[str], method: str, precedence: int, connects: Column | None = None) -> DataFrame:
            centre = df.groupBy(*on).agg(F.min("device_key").alias("left_key"), F.max("device_key").alias("last"), *([connects.alias("connects")] if connects is not None else []))
            centre = centre.where("left_key < last").where("connects" if connects is not None else "true").drop("last", "connects")
            return df.join(centre, on).where("device_key <> left_key").select("left_key", F.col("device_key").alias("right_key"), F.lit(method).alias("method"), F.lit(precedence).alias("precedence"))

        parent, child = self._kin()
        kin = parent.select("parent_id_prefix", F.col("parent").alias("device_key"), F.lit(True).alias("leads")).union(child.select("parent_id_prefix", F.col("child").alias("device_key"), F.lit(False).alias("leads")))
        both = F.bool_or("leads") & F.bool_or(~F.col("leads"))
        parts = [
            star(d.where(m.is_real_container(F.col("container_id"))), ["container_id"], "container_id", 1),
            star(self._across(real).where("not shared"), ["serial"], "serial_across_enumerators", 2, F.min("enumerator") < F.max("enumerator")),
            star(real.where("vid_pid <> ''"), ["serial", "vid_pid"], "vid_pid_and_serial", 3),
            star(kin, ["parent_id_prefix"], "parent_id_prefix", 4, both),
            self._declared(d).where("matches = 1 and partial <> full").select(F.least("partial", "full").alias("left_key"), F.greatest("partial", "full").alias("right_key"), F.lit("hardware_id_unique").alias("method"), F.lit(5).alias("precedence")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    def _paired(self, df: DataFrame, on: list[str]) -> DataFrame:
        """Each two identities of a key, as a and b. A key of many identities is dealt over blocks: each of its rows
        is in one block as a, in all as b, so its pairs are many tasks' and only they stream out."""
        size = df.groupBy(*on).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select(*on, F.ceil(F.col("members") / A_BLOCK).cast("int").alias("blocks"))
        dealt = df.join(size, on)
        a = dealt.withColumn("block", F.pmod(F.xxhash64("device_key"), F.col("blocks")).cast("int")).drop("blocks")
        b = dealt.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
        return a.alias("a").join(b.alias("b"), [*on, "block"]).where("a.device_key < b.device_key")

    @view
    def device_link(self) -> DataFrame:
        """Pairs of identities that may be one device: device_key, other_device_key, method, precedence,
        asserts_same_device, reason.

        Every arm is an equi-join without repeated rows: prefixes are cut out of the longer side, hardware ids
        exploded. A container or serial with many identities is a list of all its pairs by what the view promises, so
        pairs are neither written nor moved; grouping reads _grouping_star, facts read _shared_serials, which grow
        with the identities."""
        return reduce(DataFrame.unionByName, self._links(*self._compared()))

    def _links(self, d: DataFrame, real: DataFrame, *carry: str) -> list[DataFrame]:
        """The arms of device_link. Those that pair identities, the first three, carry these columns of both sides
        along: name and other_name."""
        pair, sides = self._paired, [x for c in carry for x in (F.col(f"a.{c}").alias(c), F.col(f"b.{c}").alias(f"other_{c}"))]
        row = lambda df, a, b, method, precedence, asserts, reason: df.select(F.expr(a).alias("device_key"), F.expr(b).alias("other_device_key"), method.alias("method"), precedence.cast("int").alias("precedence"), asserts.alias("asserts_same_device"), reason.alias("reason"), *(sides if a == "a.device_key" else []))
        say = lambda *parts: F.concat(*[F.lit(p) if not isinstance(p, str) or not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts])

        container = pair(d.where(m.is_real_container(F.col("container_id"))), ["container_id"])
        out = [row(container, "a.device_key", "b.device_key", F.lit("container_id"), F.lit(1), F.lit(True), say("both identities carry ContainerID ", "$container_id"))]

        across = pair(self._across(real), ["serial"]).where("a.enumerator <> b.enumerator")
        both = ("both report serial ", "$serial", " (", "$a.enumerator", " and ", "$b.enumerator", ")")
        conflict = F.col("a.shared")
        out.append(
            row(
                across, "a.device_key", "b.device_key", F.when(conflict, "serial_across_enumerators_shared").otherwise("serial_across_enumerators"), F.when(conflict, 6).otherwise(2), ~conflict,
                F.when(conflict, say(*both, ", and this host uses that serial on more than one product — a candidate, not an assertion that they are the same device")).otherwise(say(*both, ", and no other product on this host reports it")),
            )
        )
        out.append(row(pair(real.where("vid_pid <> ''"), ["serial", "vid_pid"]), "a.device_key", "b.device_key", F.lit("vid_pid_and_serial"), F.lit(3), F.lit(True), say("both are ", "$vid_pid", " reporting serial ", "$serial")))

        parent, child = self._kin()
        kin = parent.join(child, "parent_id_prefix").where("parent <> child")
        out.append(row(kin, "least(parent, child)", "greatest(parent, child)", F.lit("parent_id_prefix"), F.lit(4), F.lit(True), say("ParentIdPrefix ", "$parent_id_prefix", " of ", "$parent", " leads the instance id of ", "$child")))

        part, one = self._declared(d), F.col("matches") == 1
        out.append(
            row(
                part, "least(partial, full)", "greatest(partial, full)", F.when(one, "hardware_id_unique").otherwise("hardware_id_ambiguous"), F.lit(5), one,
                F.when(one, say("$partial", " is a hardware id declared by exactly one devnode")).otherwise(say("$partial", " is a hardware id declared by ", "$matches", " devnodes, so it does not identify one of them")),
            )
        )

        long = real.where(F.length("serial") >= LEAST_PREFIX).select("device_key", "enumerator", "serial")
        cut = long.where(F.length("serial") > LEAST_PREFIX).select(F.col("device_key").alias("longer"), F.col("enumerator").alias("e"), F.expr(f"explode(transform(sequence({LEAST_PREFIX}, length(serial) - 1), k -> left(serial, k)))").alias("serial"))
        near = long.join(cut, "serial").where("enumerator <> e")
        out.append(
            row(near, "least(device_key, longer)", "greatest(device_key, longer)", F.lit("serial_prefix_candidate"), F.lit(6), F.lit(False), say("serial ", "$serial", " is a prefix of the other identity's longer serial — a candidate, not an assertion that they are the same device"))
        )
        return out

    def _candidates(self) -> list[DataFrame]:
        """Links that assert nothing, with the devices on either side: by shared serials, which are pairs and have
        their devices from before they pair, and the others, which are about as many as identities."""
        of = lambda key, name: self.device_group().select(F.col("device_key").alias(key), F.col("physical_device_id").alias(name))
        d, real = self._compared()
        known = of("device_key", "physical_device_id")
        arms = [a.where("not asserts_same_device") for a in self._links(d.join(known, "device_key"), real.join(known, "device_key"), "physical_device_id")[1:2]]
        few = reduce(DataFrame.unionByName, [a.where("not asserts_same_device") for a in self._links(d, real)[3:]])
        few = few.join(known, "device_key").join(of("other_device_key", "other_physical_device_id"), "other_device_key")
        columns = ["device_key", "other_device_key", "method", "physical_device_id", "other_physical_device_id", "reason"]
        return [a.select(*columns) for a in (*arms, few)]

    @view
    def device_grouping_edge(self) -> DataFrame:
        same = self.device_link().where("asserts_same_device")
        return same.select(F.col("device_key").alias("from_key"), F.col("other_device_key").alias("to_key")).union(same.select("other_device_key", "device_key")).distinct()

    @consolidated
    def device_group(self) -> DataFrame:
        """device_key, physical_device_id, identity_count, preference: identities by connected components of the
        asserted links; the preferred identity names the device."""
        d = self.device().select("device_key", "serial", "serial_is_generated", "enumerator")
        found = d.join(connected_components(d.select("device_key"), self._grouping_star()), "device_key")
        real = F.when((F.col("serial") != "") & ~F.col("serial_is_generated"), 0).otherwise(1)
        order = [real, F.when(m.has_instance_id(F.col("device_key")), 0).otherwise(1), m.identity_rank(F.col("enumerator")), F.col("device_key")]
        # Places in one order of all identities, less the component's first: no task orders a whole component.
        placed = numbered(found.select("device_key", "component", *[o.alias(f"o{k}") for k, o in enumerate(order)]), ["component", "o0", "o1", "o2", "o3"], "place", self._written)
        best = placed.groupBy("component").agg(F.min_by("device_key", "place").alias("physical_device_id"), F.min("place").alias("first"), F.count(F.lit(1)).alias("identity_count"))
        return placed.join(best, "component").select("device_key", "physical_device_id", "identity_count", (F.col("place") - F.col("first") + 1).cast("long").alias("preference"))

    @view
    def device_identity(self) -> DataFrame:
        return self.device().join(self.device_group().select("device_key", "physical_device_id", F.col("preference").alias("identity_preference")), "device_key")

    @view
    def device_candidate_link(self) -> DataFrame:
        """Links that assert nothing, with the devices on either side."""
        out = reduce(DataFrame.unionByName, self._candidates())
        return out.select("device_key", "other_device_key", "method", (F.col("physical_device_id") == F.col("other_physical_device_id")).alias("already_grouped"), "physical_device_id", "other_physical_device_id", "reason")

    @consolidated
    def _shared_serials(self) -> DataFrame:
        """(physical_device_id, serial, enumerator, first, last): the devices with a serial that candidate links go by,
        and their least and greatest identity of each enumerator. It grows with the identities, not their pairs."""
        _, real = self._compared()
        shared = self._across(real).where("shared").join(self.device_group().select("device_key", "physical_device_id"), "device_key")
        return shared.groupBy("physical_device_id", "serial", "enumerator").agg(F.min("device_key").alias("first"), F.max("device_key").alias("last"))

    @consolidated
    def physical_device(self) -> DataFrame:
        """One row per device: sums over its identities and the first known value by preference."""
        member = self.device_identity()
        group = self.device_group().select("device_key", "physical_device_id")
        first = lambda c, known: F.coalesce(F.min_by(F.when(known, F.col(c)), F.when(known, F.col("identity_preference"))), F.lit("")).alias(c)
        out = member.groupBy("physical_device_id").agg(
            F.count(F.lit(1)).alias("identity_count"), listed_by(F.col("device_key"), "; ", F.col("identity_preference")).alias("identities"), listed("enumerator", ", ").alias("enumerators"), F.min_by("device_instance_id", "identity_preference").alias("device_instance_id"),
            (~F.bool_or((F.col("serial") != "") & ~F.col("serial_is_generated"))).alias("identity_not_unique"), *[first(c, F.col(c) != "") for c in _PREFERRED], first("container_id", m.is_real_container(F.col("container_id"))), F.bool_or("in_registry").alias("in_registry"),
            F.min("first_install_date_utc").alias("first_install_date_utc"), *[F.max(c).alias(c) for c in ("install_date_utc", "last_arrival_date_utc", "last_removal_date_utc", "last_disconnect_utc", "last_seen_utc")], *[F.min(c).alias(c) for c in ("first_connect_utc", "first_seen_utc")], *[F.sum(c).alias(c) for c in _SUMMED],
        )
        of = lambda df, value, separator, name: df.join(group, "device_key").groupBy("physical_device_id").agg(listed(value, separator).alias(name))
        methods = self._grouping_star().select(F.col("left_key").alias("device_key"), "method", "precedence").join(group, "device_key").select("physical_device_id", "method", "precedence").distinct().groupBy("physical_device_id").agg(listed_by(F.col("method"), "; ", F.col("precedence"), F.col("method")).alias("grouping_methods"))
        lists = [methods, of(self.table("mount_entry").where("drive_letter <> ''"), "drive_letter", ",", "current_drive_letters"), of(self.table("portable_device").where("friendly_name <> ''"), "friendly_name", "; ", "portable_names"), of(self.device_evidence(), "evidence", "; ", "evidence_sources")]
        for part in lists:
            out = out.join(part, "physical_device_id", "left")
        return out.na.fill("single_identity", ["grouping_methods"]).na.fill("", ["current_drive_letters", "portable_names"])
