"""Facts about devices, and the rules that classify them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.functions import macros as m
from vestige.operators.case import consolidated, listed, listed_by, said, view
from vestige.operators.inventory import A_BLOCK
from vestige.operators.rules import DEFAULT_CATEGORY, DEFAULT_RELEVANCE, DEFAULT_TIER
from vestige.operators.staging import long_rows
from vestige.operators.volumes import Volumes

# What an interface is known by, in the words of the evidence. Each entry: fact, setup classes or
# services or USB classes or parts of compatible ids that tell it, and the sentence; {0} is the column that told.
_NET, _PORTS, _CDROM = "{4d36e972-e325-11ce-bfc1-08002be10318}", "{4d36e978-e325-11ce-bfc1-08002be10318}", "{4d36e965-e325-11ce-bfc1-08002be10318}"
INTERFACES = [
    ("storage_identity", "enumerator", ["USBSTOR", "SCSI"], "enumerator {enumerator} on {device_key}"),
    ("storage_identity", "usb", ["08"], "USB base class 08 (mass storage) in the compatible ids of {device_key}"),
    ("storage_identity", "service", ["usbstor", "disk"], "service {service}"),
    ("optical_identity", "class", [_CDROM], "CDROM setup class on {device_key}"),
    ("optical_identity", "text", ["CDROM"], "compatible id names a CD-ROM"),
    ("mtp_interface", "text", ["MS_COMP_MTP"], "MTP compatible id on {device_key}"),
    ("mtp_interface", "service", ["wudfwpdmtp", "wpdusb"], "service {service}"),
    ("apple_mobile_service", "service", ["usbaapl", "usbaapl64", "applemobiledevice"], "service {service}"),
    ("network_interface", "class", [_NET], "Net setup class on {device_key}"),
    ("network_interface", "network", [], "network compatible id on {device_key}"),
    ("serial_interface", "class", [_PORTS], "Ports setup class on {device_key}"),
    ("serial_interface", "service", ["usbser", "ftdibus", "silabser"], "service {service}"),
    ("serial_interface", "modem", [], "USB communications class with the abstract control subclass"),
    ("hid_interface", "usb", ["03"], "USB base class 03 (HID) on {device_key}"),
    ("hid_interface", "class", ["{745a17a0-74d3-11d0-b6fe-00a0c90f57da}", "{4d36e96b-e325-11ce-bfc1-08002be10318}", "{4d36e96f-e325-11ce-bfc1-08002be10318}"], "setup class {class_guid}"),
    ("printer_interface", "usb", ["07"], "USB base class 07 (printer)"),
    ("printer_interface", "class", ["{4d36e979-e325-11ce-bfc1-08002be10318}", "{1ed2bbf9-11f0-4084-b21f-ad83a8e6dcdc}"], "setup class {class_guid}"),
    ("imaging_interface", "usb", ["06"], "USB base class 06 (still image)"),
    ("imaging_interface", "class", ["{6bdd1fc6-810f-11d0-bec7-08002be2092f}"], "Image setup class on {device_key}"),
    ("audio_interface", "usb", ["01"], "USB base class 01 (audio)"),
    ("video_interface", "usb", ["0E"], "USB base class 0E (video)"),
    ("video_interface", "service", ["usbvideo"], "service {service}"),
    ("smartcard_interface", "usb", ["0B"], "USB base class 0B (smart card)"),
    ("smartcard_interface", "class", ["{50dd5230-ba8a-11d1-bf5d-0000f805f530}"], "SmartCardReader setup class"),
    ("biometric_interface", "class", ["{53d29ef7-377c-4d14-864b-eb3a85769359}"], "Biometric setup class on {device_key}"),
    ("hub_interface", "usb", ["09"], "USB base class 09 (hub)"),
    ("hub_interface", "hub", [], "service {service}"),
    ("internal_hub", "root", [], "the device id is {device_id}"),
    ("wireless_interface", "usb", ["E0"], "USB base class E0 (wireless)"),
    ("wireless_interface", "class", ["{e0cbf06c-cd8b-4647-bb8a-263b43f0f974}"], "Bluetooth setup class on {device_key}"),
    ("vendor_specific_interface", "usb", ["FF"], "USB base class FF (vendor specific) on {device_key}"),
    ("display_interface", "class", ["{4d36e968-e325-11ce-bfc1-08002be10318}", "{4d36e96e-e325-11ce-bfc1-08002be10318}"], "setup class {class_guid}"),
]
#: The facts that count as interfaces; software enumerators; fixed buses; facts that lift a review.
COUNTED = (
    "storage_identity", "hid_interface", "printer_interface", "imaging_interface", "audio_interface", "video_interface", "network_interface", "serial_interface", "smartcard_interface", "hub_interface", "wireless_interface", "mtp_interface", "optical_identity", "vendor_specific_interface", "biometric_interface",
    "display_interface",
)
SOFTWARE = ("SWD", "SWC", "ROOT", "STORAGE", "BTH", "MBFW", "COMPUTER")
FIXED_BUSES = ("SCSI", "IDE", "ATA", "NVME", "PCI", "RAID")
#: The facts that other devices tell, by the column of _beside_peers that has their evidence.
_BY_PEERS = {"unresolved_identity_link": "linked_to", "duplicate_serial": "repeated_by"}
#: What the evidence of a candidate link says before and after the other device's name.
_LINK = ("a candidate link to ", " was not acted on")
NOT_REVIEWED = ("software_device", "internal_bus", "usb_attachment_not_observed")


def _tells(how: str, values: list[str]):
    ids, has = F.col("compatible_ids"), lambda part: m.has_text(F.col("compatible_ids"), part)
    usb = lambda code: m.has_usb_class(ids, code)
    return {
        "enumerator": lambda: F.col("enumerator").isin(*values), "service": lambda: F.col("service").isin(*values), "class": lambda: F.col("class_guid").isin(*values), "usb": lambda: usb(values[0]), "text": lambda: has(values[0]),
        "network": lambda: has("MS_COMP_RNDIS") | has("MS_COMP_MBIM") | has("MS_COMP_NCM") | (usb("02") & has("SUBCLASS_06")), "modem": lambda: usb("02") & has("SUBCLASS_02"), "hub": lambda: F.startswith("service", F.lit("usbhub")), "root": lambda: F.startswith("device_id", F.lit("ROOT_HUB")),
    }[how]()


def _sentence(template: str):
    parts = template.replace("}", "{").split("{")
    return F.concat(*[F.col(p) if k % 2 else F.lit(p) for k, p in enumerate(parts)], F.lit(""))


def _joined(told):
    """The evidence that told (names, before, after) stands for, in one text: the words between two names separate
    them, so no text a name is made."""
    return F.concat(told["before"], F.call_function("array_join", told["names"], F.concat(told["after"], F.lit("; "), told["before"])), told["after"])


class Facts(Volumes):
    @view
    def device_attribute(self) -> DataFrame:
        d = self.devnode().where("device_key <> ''").join(self.device_group().select("device_key", "physical_device_id"), "device_key")
        of = lambda f, c: f(F.coalesce(c, F.lit(""))).alias(c)
        return d.select("physical_device_id", "device_key", F.upper("enumerator").alias("enumerator"), F.upper("device_id").alias("device_id"), of(F.upper, "compatible_ids"), of(F.lower, "class_guid"), of(F.lower, "service"), of(F.upper, "hardware_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("device_desc", "bus_reported_desc")])

    @consolidated
    def _fact_rows(self) -> DataFrame:
        """(physical_device_id, fact, evidence) of the facts that a device's own evidence tells; those that other
        devices tell come from _peers. What attributes tell comes from one pass over them. Facts are written before
        attribution, so what rests on it comes with Case.second_pass."""
        a = self.device_attribute()
        told = F.array(*[F.when(_tells(how, values), F.struct(F.lit(fact).alias("fact"), _sentence(say).alias("evidence"))) for fact, how, values, say in INTERFACES])
        out = [a.select("physical_device_id", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("x")).select("physical_device_id", "x.fact", "x.evidence")]
        group = self.device_group().select("device_key", "physical_device_id")
        bus = F.substring_index("device_key", "\\", 1)
        say = lambda *parts: F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("'") else F.col(p).cast("string") for p in parts])
        row = lambda df, fact, evidence: out.append(df.select("physical_device_id", F.lit(fact).alias("fact"), evidence.alias("evidence")))

        row(self.device().select("device_key", F.upper("enumerator").alias("enumerator")).where("enumerator in ('USBSTOR', 'SCSI')").join(group, "device_key"), "storage_identity", say("'enumerator ", "enumerator", "' on ", "device_key"))
        row(self.device_volume_link().join(group, "device_key").select("physical_device_id", "volume_id", "confidence").distinct(), "mounted_volume", say("'volume ", "volume_id", "' linked at ", "confidence"))
        p = self.physical_device()
        row(p.where("identity_not_unique"), "no_serial", F.lit("no identity in this device reported a serial"))
        row(p.where("not in_registry"), "partial_artefacts", F.lit("no registry key for this device is in this collection"))
        kinds = group.groupBy("physical_device_id").agg(
            F.bool_or(m.device_vid_pid(F.col("device_key")) != "").alias("with_ids"), F.bool_or(~bus.isin(*SOFTWARE)).alias("hardware"), F.bool_or(F.col("device_key").contains("WPDBUSENUM")).alias("portable")
        )
        row(kinds.where("not with_ids"), "no_vid_pid", F.lit("no identity in this device carries a vendor and product id"))
        row(kinds.where("not hardware and not portable"), "software_device", F.lit("every identity in this device is a software-enumerated node"))
        c = self.connection().join(group, "device_key")
        row(c.where("start_known and not open_ended and span_seconds < 60").select("physical_device_id", "span_seconds").distinct(), "short_lived_connection", say("'a connection lasting ", "span_seconds", "' second(s)"))
        row(c.groupBy("physical_device_id").agg(F.count(F.lit(1)).alias("windows")).where("windows >= 3"), "repeated_connection", say("windows", "' connection windows"))
        row(group.where(bus.isin("USB", "USBSTOR")), "usb_attached", say("'identity ", "device_key", "' is enumerated on the USB bus"))
        row(a.where(F.startswith("compatible_ids", F.lit("USB\\"))).select("physical_device_id", "device_key").distinct(), "usb_attached", say("'a USB compatible id on ", "device_key"))
        row(a.join(F.broadcast(self.table("rule_setup_class")), "class_guid").select("physical_device_id", "class_name").distinct(), "known_class", say("'setup class ", "class_name"))
        found = out[0]
        for o in out[1:]:
            found = found.unionByName(o)
        return found

    # Two facts quote every other device of a serial. A serial's devices are listed once; who has a fact follows from
    # sums of the list's, and a device's evidence is its list without itself, made where it is read and never moved.

    @consolidated
    def _peers(self) -> DataFrame:
        """One row for each device of a shared or repeated serial: physical_device_id, shared (the serial of its
        candidate links, null for none), own (its enumerators there and the least identity of each), repeated (the
        serial that devices report, in upper case, null where it alone does), serial, further (devices that links by
        other ways or serials lead to), linked (whether it has a link to another device)."""
        s = self._shared_serials()
        # The greatest identity of a serial and enumerator, and of its other devices.
        top = s.groupBy("serial", "enumerator").agg(F.max(F.struct("last", "physical_device_id")).alias("top"))
        second = s.join(top, ["serial", "enumerator"]).where("physical_device_id <> top.physical_device_id").groupBy("serial", "enumerator").agg(F.max("last").alias("second"))
        tops = top.join(second, ["serial", "enumerator"], "left").groupBy("serial").agg(F.collect_list(F.struct("enumerator", "top", "second")).alias("tops"))
        reach = F.exists("tops", lambda t: (t.enumerator != F.col("enumerator")) & F.coalesce(F.when(t.top.physical_device_id == F.col("physical_device_id"), t.second).otherwise(t.top.last) > F.col("first"), F.lit(False)))
        of = s.join(tops, "serial").groupBy("physical_device_id", "serial").agg(F.bool_or(reach).alias("linked"), F.collect_list(F.struct("enumerator", "first")).alias("own")).where("linked")
        several = of.groupBy("physical_device_id").agg(F.count(F.lit(1)).alias("serials"), F.min("serial").alias("shared"))
        of = of.join(several, "physical_device_id")
        # A device with further such serials has their devices here.
        rest = of.where("serial <> shared").select("physical_device_id", "serial", F.explode("own").alias("o"))
        others = s.select("serial", F.col("physical_device_id").alias("other"), F.col("enumerator").alias("e"), "last")
        rest = rest.join(others, "serial").where("e <> o.enumerator and last > o.first and other <> physical_device_id").select("physical_device_id", "other")
        few = self._candidates()[-1].where("physical_device_id <> other_physical_device_id").select("physical_device_id", F.col("other_physical_device_id").alias("other"))
        further = few.union(rest).groupBy("physical_device_id").agg(F.collect_set("other").alias("further"))
        known = self.physical_device().where("serial <> ''").select("physical_device_id", "serial", F.upper("serial").alias("repeated"))
        known = known.join(known.groupBy("repeated").agg(F.count(F.lit(1)).alias("devices")).where("devices > 1"), "repeated").drop("devices")
        out = of.where("serial = shared").select("physical_device_id", "shared", "own").join(known, "physical_device_id", "full").join(further, "physical_device_id", "full")
        return out.withColumn("linked", F.col("shared").isNotNull() | F.col("further").isNotNull())

    def _beside_peers(self, df: DataFrame) -> DataFrame:
        """df with linked_to and repeated_by, the evidence of the two facts, null for none: the other devices' names
        in the evidence's order, and what is said before and after each. A list is dealt over blocks of its devices,
        and this is the last join: what it makes streams out. A device takes the whole list of an enumerator wherever
        its own identity comes before all of them, so names are looked at singly only where some are left out. What is
        made of a long list is a text of megabytes in each row, which writers must expect."""
        long_rows(df.sparkSession)
        blocks, me = F.ceil(F.col("members") / A_BLOCK).cast("int"), F.col("physical_device_id")
        peers = self._peers().select("physical_device_id", F.struct("shared", "repeated").alias("__of"), F.col("own").alias("__own"), F.col("serial").alias("__serial"), F.col("further").alias("__further"))
        pairs = peers.groupBy("__of").agg(F.count(F.lit(1)).alias("members")).select("__of", blocks.alias("__blocks"), F.col("__of.shared").alias("shared"), F.col("__of.repeated").alias("repeated")).where("shared is not null or repeated is not null")
        quoted = lambda other: F.concat(F.lit(_LINK[0]), other, F.lit(_LINK[1]))
        members = F.sort_array(F.collect_list(F.struct(quoted(me).alias("text"), me.alias("name"), "last")))
        links = self._shared_serials().groupBy(F.col("serial").alias("shared"), "enumerator").agg(F.min("last").alias("low"), F.max("last").alias("high"), F.transform(members, lambda x: F.struct(x["name"].alias("name"), x["last"].alias("last"))).alias("members"))
        links = links.groupBy("shared").agg(F.collect_list(F.struct("enumerator", "low", "high", "members")).alias("__links"))
        twins = self._peers().where("repeated is not null").groupBy("repeated").agg(F.sort_array(F.collect_list("physical_device_id")).alias("__twins"))
        lists = pairs.join(links, "shared", "left").join(twins, "repeated", "left").select("__of", "__links", "__twins", F.explode(F.expr("sequence(0, __blocks - 1)")).alias("__block"))
        dealt = peers.join(pairs.select("__of", "__blocks"), "__of", "left")
        # Devices without a list are spread, too.
        out = df.join(dealt, "physical_device_id", "left").withColumn("__block", F.pmod(F.xxhash64(me), F.coalesce("__blocks", F.lit(1 << 16))).cast("int")).join(lists, ["__of", "__block"], "left")
        none = F.array().cast("array<string>")
        first = lambda k: F.array_min(F.transform(F.filter("__own", lambda o: o["enumerator"] != k["enumerator"]), lambda o: o["first"]))
        some = lambda k: F.transform(F.filter(k["members"], lambda x: x["last"] > first(k)), lambda x: x["name"])
        reached = F.transform("__links", lambda k: F.when(first(k) < k["low"], k["members"]["name"]).when(first(k) < k["high"], some(k)).otherwise(none))
        by_serial, further = F.col("__own").isNotNull(), F.col("__further").isNotNull()
        out = out.withColumn("__lists", F.filter(F.concat(F.when(by_serial, reached).otherwise(F.array().cast("array<array<string>>")), F.array(F.coalesce("__further", none))), lambda x: F.size(x) > 0))
        mixed = F.sort_array(F.transform(F.array_distinct(F.flatten("__lists")), lambda x: F.struct(quoted(x).alias("text"), x.alias("name"))))["name"]
        near = F.array_remove(F.when(~further & (F.size("__lists") == 1), F.get("__lists", F.lit(0))).otherwise(mixed), me)
        told = lambda names, before, after: F.struct(names.alias("names"), before.alias("before"), F.lit(after).alias("after"))
        linked_to = F.when(by_serial | further, told(near, F.lit(_LINK[0]), _LINK[1]))
        repeated_by = F.when(F.col("__twins").isNotNull(), told(F.array_remove("__twins", me), F.concat(F.lit("serial "), "__serial", F.lit(" is also reported by ")), ""))
        return out.select(*df.columns, linked_to.alias("linked_to"), repeated_by.alias("repeated_by"))

    def _peer_facts(self) -> DataFrame:
        """(physical_device_id, fact, told): the facts that other devices tell, with what _beside_peers says of them."""
        told = self._beside_peers(self._peers().select("physical_device_id"))
        both = F.array(*[F.struct(F.lit(fact).alias("fact"), F.col(c).alias("told")) for fact, c in _BY_PEERS.items()])
        return told.select("physical_device_id", F.explode(both).alias("x")).select("physical_device_id", "x.fact", "x.told").where("told is not null")

    @view
    def device_fact_evidence(self) -> DataFrame:
        """(physical_device_id, fact, evidence)."""
        told = self._peer_facts().select("physical_device_id", "fact", "told.before", "told.after", F.explode("told.names").alias("name"))
        return self._fact_rows().unionByName(told.select("physical_device_id", "fact", F.concat("before", "name", "after").alias("evidence")))

    @view
    def _first_facts(self) -> DataFrame:
        """(physical_device_id, fact) of what is evidenced, derived facts left out."""
        p = self._peers()
        return self._fact_rows().select("physical_device_id", "fact").union(p.where("linked").select("physical_device_id", F.lit("unresolved_identity_link"))).union(p.where("repeated is not null").select("physical_device_id", F.lit("duplicate_serial"))).distinct()

    @view
    def device_derived_fact(self) -> DataFrame:
        """Facts that follow from which facts a device has: one row a device decides most of them."""
        e = self._first_facts()
        buses = self.device_group().groupBy("physical_device_id").agg(F.min(F.when(F.substring_index("device_key", "\\", 1).isin(*FIXED_BUSES), F.substring_index("device_key", "\\", 1))).alias("fixed_bus"))
        has = buses.join(e.groupBy("physical_device_id").agg(F.array_sort(F.collect_set("fact")).alias("facts")), "physical_device_id", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))
        has = has.withColumn("interfaces", F.filter("facts", lambda f: f.isin(*COUNTED)))
        of = lambda fact: F.array_contains("facts", fact)
        n, only = F.size("interfaces"), lambda f: F.col("interfaces") == F.array(F.lit(f))
        many = F.concat(F.lit("exposes "), n.cast("string"), F.lit(" interface classes: "), F.array_join("interfaces", ", "))
        beside = F.filter("facts", lambda f: f.isin("storage_identity", "network_interface"))
        no_usb = of("storage_identity") & ~of("usb_attached")
        fact = lambda cond, name, evidence: F.when(cond, F.array(F.struct(F.lit(name).alias("fact"), evidence.alias("evidence")))).otherwise(F.array().cast("array<struct<fact:string,evidence:string>>"))
        mixed = F.when(of("hid_interface"), F.transform(beside, lambda f: F.struct(F.when(of("hub_interface"), "mixed_interfaces_behind_hub").otherwise("hid_with_storage_or_network").alias("fact"), F.concat(F.lit("a human interface alongside "), f, F.when(of("hub_interface"), ", behind a hub").otherwise("")).alias("evidence")))).otherwise(
            F.array().cast("array<struct<fact:string,evidence:string>>")
        )
        every = F.concat(
            fact(n > 1, "multiple_interfaces", many), fact(only("hid_interface"), "hid_only", F.lit("a human interface and nothing else")), fact(only("audio_interface"), "audio_only", F.lit("an audio interface and nothing else")), mixed,
            fact(no_usb & F.col("fixed_bus").isNotNull(), "internal_bus", F.concat(F.lit("storage enumerated on "), "fixed_bus", F.lit(", a fixed bus, and on no USB bus"))),
            fact(no_usb & F.col("fixed_bus").isNull(), "usb_attachment_not_observed", F.lit("storage with no USB enumeration in this collection, and no fixed-bus enumeration either")),
            fact(~of("known_class") & (n == 0), "unknown_class", F.lit("no recognised setup class and no USB base class")),
        )
        out = has.select("physical_device_id", F.explode(every).alias("x")).select("physical_device_id", "x.fact", "x.evidence")
        ran = self.prefetch_device_link().where("ran_from and not letter_contradicted").join(self.device_group().select("device_key", "physical_device_id"), "device_key").groupBy("physical_device_id").agg(F.count_distinct("executable").alias("n"), F.min("executable").alias("least"))
        return out.unionByName(ran.select("physical_device_id", F.lit("executable_run_from_removable").alias("fact"), F.concat(F.col("n").cast("string"), F.lit(" programme(s) ran from a volume this device carried, including "), "least").alias("evidence")))

    @consolidated
    def _own_facts(self) -> DataFrame:
        """device_fact without the facts that other devices tell."""
        every = self._fact_rows().unionByName(self.device_derived_fact())
        return every.groupBy("physical_device_id", "fact").agg(listed("evidence", "; ").alias("evidence"), F.count(F.lit(1)).alias("evidence_count"))

    @view
    def _held(self) -> DataFrame:
        """(physical_device_id, fact): which facts a device has, once each. What decides by facts reads this."""
        return self._own_facts().select("physical_device_id", "fact").union(self._first_facts().where(F.col("fact").isin(*_BY_PEERS)))

    @view
    def device_fact(self) -> DataFrame:
        peers = self._peer_facts().select("physical_device_id", "fact", _joined(F.col("told")).alias("evidence"), F.size("told.names").cast("long").alias("evidence_count"))
        return self._own_facts().unionByName(peers)

    # ----------------------------------------------------------------- rules

    @view
    def device_rule_match(self) -> DataFrame:
        """Rules of which a device has every fact that must hold and none that mustn't: one join with the conditions
        and one grouping decide both."""
        c = self.table("rule_condition")
        needed = c.where("not negate").groupBy("rule_id").agg(F.count(F.lit(1)).alias("needed"))
        held = self._held().join(F.broadcast(c), "fact").groupBy("physical_device_id", "rule_id").agg(F.count_if(~F.col("negate")).alias("met"), F.count_if("negate").alias("against"))
        return held.join(F.broadcast(needed), "rule_id").where("met = needed and against = 0").join(F.broadcast(self.table("rule")), "rule_id").select("physical_device_id", "rule_id", "category", "tier", "priority", "note")

    @consolidated
    def _classes(self) -> DataFrame:
        """device_classification with told, its own facts' evidence (fact, text), in the place of fact_evidence."""
        best = F.struct(-F.col("priority"), F.col("rule_id"))
        won = self.device_rule_match().groupBy("physical_device_id").agg(*[F.min_by(c, best).alias(c) for c in ("rule_id", "category", "tier", "note")], listed_by(F.col("rule_id"), "; ", -F.col("priority"), F.col("rule_id")).alias("matched_rules"), F.count(F.lit(1)).alias("rules_matched"))
        f, own = self._held(), self._own_facts()
        weighed = f.join(F.broadcast(self.table("rule_indicator").select("fact", "weight", "profile")), "fact")
        shown = F.concat("fact", F.lit(" "), F.when(F.col("weight") >= 0, "+").otherwise(""), F.round("weight", 1).cast("string"))
        score = weighed.groupBy("physical_device_id").agg(F.sum("weight").alias("raw"), listed_by(shown, ", ", -F.abs("weight"), F.col("fact")).alias("score_reason"))
        facts = f.groupBy("physical_device_id").agg(listed("fact", ", ").alias("facts"), F.collect_set("fact").alias("set"))
        told = own.groupBy("physical_device_id").agg(F.collect_list(F.struct("fact", F.concat("fact", F.lit(" ("), "evidence", F.lit(")")).alias("text"))).alias("told"))
        unless = self.table("rule_review_exception").groupBy("fact").agg(F.collect_set("unless_fact").alias("unless"))
        asked = f.join(F.broadcast(self.table("rule_review_fact").join(unless, "fact", "left")), "fact").join(facts.select("physical_device_id", "set"), "physical_device_id")
        asked = asked.where(~F.arrays_overlap("set", F.array(*map(F.lit, NOT_REVIEWED))) & ~F.coalesce(F.arrays_overlap("set", "unless"), F.lit(False)))
        review = asked.groupBy("physical_device_id").agg(listed_by(F.col("note"), " ", F.col("fact")).alias("review_reason"))
        profile = F.broadcast(self.table("rule_indicator").agg(F.max("profile").alias("profile")))
        out = self.physical_device().select("physical_device_id")
        for part in (won, score, facts.drop("set"), told, review):
            out = out.join(part, "physical_device_id", "left")
        out = out.join(F.broadcast(self.table("rule_category").select("category", "relevance")), "category", "left").crossJoin(profile)
        zero, text = F.lit(0.0), F.lit("")
        reason = F.concat(F.when(F.col("rule_id").isNull(), "no rule matched").otherwise(F.concat(F.lit("matched "), "rule_id", F.coalesce(F.concat(F.lit(" — "), said("note")), text))), F.lit("; facts: "), F.coalesce("facts", F.lit("none derived")))
        return out.select(
            "physical_device_id", F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("category"), F.coalesce("tier", F.lit(DEFAULT_TIER)).alias("tier"), F.coalesce("relevance", F.lit(DEFAULT_RELEVANCE)).alias("relevance"), F.coalesce(F.greatest(zero, F.least(F.lit(100.0), F.round("raw"))), zero).alias("score"),
            F.coalesce(F.round("raw", 1), zero).alias("raw_score"), "profile", F.coalesce("rule_id", text).alias("rule_id"), F.coalesce("matched_rules", text).alias("matched_rules"), F.coalesce("rules_matched", F.lit(0)).alias("rules_matched"), reason.alias("classification_reason"),
            F.coalesce("score_reason", text).alias("score_reason"), F.col("review_reason").isNotNull().alias("review_required"), F.coalesce("review_reason", text).alias("review_reason"), F.coalesce("facts", text).alias("facts"), "told",
        )

    def _with_fact_evidence(self, df: DataFrame) -> DataFrame:
        """df with fact_evidence, in the order of facts, in the place of told."""
        by_peers = [F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(fact).alias("fact"), F.concat(F.lit(fact + " ("), _joined(F.col(c)), F.lit(")")).alias("text")))) for fact, c in _BY_PEERS.items()]
        none = F.array().cast("array<struct<fact:string,text:string>>")
        every = F.sort_array(F.concat(*[F.coalesce(x, none) for x in (F.col("told"), *by_peers)]))
        out = self._beside_peers(df)
        return out.select(*[F.array_join(F.transform(every, lambda x: x.text), "; ").alias("fact_evidence") if c == "told" else F.col(c) for c in df.columns])

    @view
    def device_classification(self) -> DataFrame:
        return self._with_fact_evidence(self._classes())

    @view
    def device_label(self) -> DataFrame:
        """A name for each device: the best known of four, with the serial where several share it."""
        d = self.devnode().select("device_key", said(F.when(m.is_drive_path(F.col("friendly_name")), "").otherwise(F.col("friendly_name"))).alias("friendly"), said(m.device_id_product(F.col("device_id"))).alias("product"), said("device_desc").alias("desc"), said("bus_reported_desc").alias("bus"), F.when(F.coalesce("serial_is_generated", F.lit(True)), "").otherwise(F.col("serial")).alias("serial"))
        n = self.device_group().select("device_key", "physical_device_id", "preference").join(d, "device_key", "left")
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("preference", c)))
        n = n.withColumn("serial", said("serial"))
        picked = n.groupBy("physical_device_id").agg(F.coalesce(*[first(c) for c in ("friendly", "product", "desc", "bus")], F.col("physical_device_id")).alias("base"), first("serial").alias("serial"))
        shared = picked.groupBy("base").agg(F.count(F.lit(1)).alias("devices"))
        label = F.when((F.col("devices") > 1) & F.col("serial").isNotNull(), F.concat("base", F.lit(" · "), "serial")).otherwise(F.col("base"))
        return picked.join(shared, "base").select("physical_device_id", label.alias("device_label"))

    @consolidated
    def _classified(self) -> DataFrame:
        """device_classified with told in the place of fact_evidence; what needs no evidence reads this."""
        out = self.physical_device().join(self._classes(), "physical_device_id").join(self.device_label(), "physical_device_id", "left")
        return out.withColumn("device_label", F.coalesce("device_label", "friendly_name", "physical_device_id"))

    @view
    def device_classified(self) -> DataFrame:
        return self._with_fact_evidence(self._classified())

    @view
    def rule(self) -> DataFrame:
        text = F.concat(F.when(F.col("negate"), "NOT ").otherwise(""), F.col("fact"))
        told = self.table("rule_condition").groupBy("rule_id").agg(listed_by(text, " AND ", F.col("fact")).alias("conditions"))
        return self.table("rule").join(told, "rule_id", "left").join(self.table("rule_category").select("category", "relevance"), "category", "left")

    @view
    def rule_indicator(self) -> DataFrame:
        times = F.round(F.when(F.col("base_weight") == 0, 1.0).otherwise(F.col("weight") / F.col("base_weight")), 3)
        return self.table("rule_indicator").withColumn("profile_multiplier", times)
