"""Queries against their SQL, views on small scenarios, and properties of their plans."""

from __future__ import annotations

import random
import struct
import time
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

import __spark_entry__ as entry
from vestige.functions import macros as m
from vestige.operators import facts, inventory, timeline
from vestige.operators.asof import as_of, beside
from vestige.operators.components import connected_components
from vestige.operators.full import Case
from vestige.operators.rules import RuleSet
from vestige.operators.staging import table_in_shared_folder
from vestige.plans import model, registry
from vestige.plans.registry import ORACLE_SQL, QUERIES, case_of
from vestige.sources import binary, sinks, text
from vestige.streaming.connections import activity_sessions

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
T0 = datetime(2024, 1, 2, 8, 0, 0)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    result = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(map(rounded, r)) for r in df.select(*columns).collect()) == Counter(tuple(map(rounded, r)) for r in result.fetchall())


@pytest.mark.parametrize("name", model.TABLES)
def test_model_tables_are_the_same_in_both_engines(spark, duck, name):
    result = duck.execute(model.with_parts(f"SELECT * FROM {name}", {k: v.replace("@events@", "events").replace("@documents@", "documents") for k, v in model.TABLES.items()}))
    got = model.table(spark, SF, name)
    assert got.columns == [c[0] for c in result.description]
    assert Counter(map(str, map(tuple, got.collect()))) == Counter(map(str, result.fetchall()))


@pytest.mark.parametrize("name", ["device_link", "device_volume_link", "disk_departure_candidate", "device_rule_match", "file_attribution_summary", "timeline_moment_member", "report_device"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cases_are_kept_and_closed(spark, tmp_path):
    assert case_of(spark, SF) is case_of(spark, SF)
    c = Case(lambda name: model.table(spark, SF, name))
    c.device()
    assert c._written
    c.close()
    assert not c._written and not c._made


# ------------------------------------------------------------------ scenarios


@pytest.fixture(scope="module")
def case(spark):
    """Builds a case of the rows given, by table; columns left out are empty texts or null."""
    schemas, rules = {}, RuleSet().tables(spark)

    def build(**tables):
        def of(name):
            if name in rules:
                return rules[name]
            if name not in schemas:
                schemas[name] = StructType([StructField(f.name, f.dataType) for f in model.table(spark, SF, name).schema])
            rows = [tuple(r.get(f.name, "" if f.dataType.simpleString() == "string" else None) for f in schemas[name]) for r in tables.get(name, [])]
            return spark.createDataFrame(rows, schemas[name])

        return Case(of)

    return build


def at(**delta):
    return T0 + timedelta(**delta)


def change(record, key, kind, event_id=1, **delta):
    return {"record_id": record, "device_key": key, "device_instance_id": key, "kind": kind, "event_id": event_id, "time_utc": at(**delta), "rule_id": kind, "source_id": "s", "channel": "c"}


def session(record, rule, **delta):
    return {"record_id": record, "kind": "session", "rule_id": rule, "event_id": 6000, "time_utc": at(**delta), "source_id": "s", "channel": "System"}


STARTED, STOPPED, UNCLEAN = "System:EventLog:6005", "System:EventLog:6006", "System:EventLog:6008"
STICK = "USBSTOR\\DISK&VEN_Q&PROD_Z\\Q7741&0"


def test_repeated_records_are_one_window(case):
    (row,) = case(event=[change(k, "D", kind, seconds=s) for k, (s, kind) in enumerate([(0, "connect"), (2, "connect"), (6, "connect"), (640, "disconnect")])]).connection().collect()
    assert (row.started_utc, row.ended_utc, row.supporting_records, row.start_known, row.open_ended, row.span_seconds) == (T0, at(seconds=640), 4, True, False, 640)


def test_open_superseded_and_unknown_windows(case):
    rows = [(0, "A", "connect"), (0, "B", "connect"), (100, "B", "connect"), (50, "C", "disconnect"), (70, "C", "disconnect")]
    got = {(r.device_key, r.start_known, r.ended_utc is None, r.ended_before_utc is None) for r in case(event=[change(k, d, kind, seconds=s) for k, (s, d, kind) in enumerate(rows)]).connection().collect()}
    assert got == {("A", True, True, True), ("B", True, True, False), ("B", True, True, True), ("C", False, False, True)}


def test_windows_span_days(case):
    c = case(event=[change(1, "D", "connect", hours=1), change(2, "D", "disconnect", days=9), change(3, "D", "connect", days=9, hours=2), change(4, "D", "disconnect", days=30)])
    assert [(r.started_utc, r.ended_utc) for r in c.connection().orderBy("started_utc").collect()] == [(at(hours=1), at(days=9)), (at(days=9, hours=2), at(days=30))]


def test_other_removal_problems_do_not_close(case):
    events = [change(1, "D", "connect"), change(2, "D", "disconnect", 420, seconds=99), change(3, "D", "disconnect", 420, seconds=199)]
    fields = [{"source_id": "s", "record_id": k, "role": "problem_code", "value": v} for k, v in ((2, "10"), (3, "45"))]
    assert [r.record_id for r in case(event=events, event_field=fields).device_state_change().orderBy("record_id").collect()] == [1, 3]


def test_stops_bound_open_windows(case):
    here = change(0, "D", "connect")
    clean = case(event=[here, session(1, STOPPED, hours=1), session(2, STOPPED, hours=2)]).connection_placing().first()
    assert clean.places_until_utc == at(hours=1)
    c = case(event=[here, change(1, "", "fault", hours=1), session(2, STARTED, hours=30), session(3, UNCLEAN, hours=31)])
    (stop,) = c.host_unclean_stop().collect()
    assert (stop.boot_associated, stop.stopped_after_utc, stop.stopped_before_utc) == (True, at(hours=1), at(hours=30))
    assert c.connection_placing().first().places_until_utc == at(hours=1)
    between = case(event=[here, session(2, STARTED, hours=30), session(4, STOPPED, hours=30, minutes=5), session(3, UNCLEAN, hours=31)]).host_unclean_stop().first()
    assert (between.boot_associated, between.stopped_before_utc) == (False, at(hours=31))
    undated = case(event=[here, session(3, UNCLEAN, hours=3)]).connection().first()
    assert undated.host_stopped_undated and undated.host_stopped_after_utc is None
    assert case(event=[here]).connection_placing().first().places_until_utc is None


def use(k, letter="E:", label="", removable=True, **delta):
    return {"source_file": f"l{k}", "source_id": "s", "origin": "shell_link", "path": f"{letter}\\f{k}", "drive_letter": letter, "volume_label": label, "removable": removable, "last_access_utc": at(**delta), "raw_target_written": 0}


def test_sole_connected_is_silent_on_two_and_after_a_day(case):
    other = STICK.replace("Q7741", "Q7742")
    events = [change(0, STICK, "connect"), change(1, other, "connect", hours=5), change(2, other, "disconnect", hours=6)]
    c = case(event=events, file_target=[use(h, hours=h) for h in (1, 5, 23, 25)] + [use(6, removable=False, hours=2)])
    path = {r.activity_id: r.path for r in c.file_activity().collect()}
    assert {(path[r.activity_id], r.device_key) for r in c.sole_connected_device().collect()} == {("E:\\f1", STICK), ("E:\\f23", STICK), ("E:\\f6", STICK)}  # f6: its letter is a removable one's


def test_a_label_of_another_device_caps_the_letter(case):
    other = STICK.replace("Q7741", "Q7742")
    mounts = [{"value_name": "E:", "drive_letter": "E:", "target_kind": "device_path", "device_key": STICK, "device_instance_id": STICK, "source_id": "s"}]
    labels = [{"friendly_name": "ATLAS", "device_key": other, "device_instance_id": other, "source_id": "s"}]
    c = case(mount_entry=mounts, portable_device=labels, event=[change(0, STICK, "connect")], file_target=[use(1, label="atlas", minutes=5), use(2, minutes=6)])
    got = {(r.path, r.route, r.device_key == STICK, r.confidence, r.contradicted) for r in c.file_attribution().where("route <> 'sole_connected_device'").collect()}
    assert got == {("E:\\f1", "volume_label_unique", False, "possible", False), ("E:\\f1", "drive_letter_mounted_devices_device_path", True, "possible", True), ("E:\\f2", "drive_letter_mounted_devices_device_path", True, "probable", False)}
    summary = {r.path: (r.candidate_devices, r.best_confidence) for r in c.file_attribution_summary().collect()}
    assert summary == {"E:\\f1": (2, "probable"), "E:\\f2": (1, "probable")}


def test_tied_devices_leave_a_record_unnamed(case):
    other = STICK.replace("Q7741", "Q7742")
    mounts = [{"value_name": k, "drive_letter": "E:", "target_kind": "device_path", "device_key": k, "device_instance_id": k, "source_id": "s"} for k in (STICK, other)]
    c = case(mount_entry=mounts, file_target=[use(1, removable=False, hours=1)])
    assert [(r.candidates, r.best_candidates) for r in c.attributed().collect()] == [(2, 2)]
    (entry_,) = c.timeline().where("event = 'file_opened'").collect()
    assert entry_.device_key == "" and "equal confidence" in entry_.detail


def node(enumerator, device_id, instance_id, **more):
    whole = f"{enumerator}\\{device_id}\\{instance_id}"
    return {"enumerator": enumerator, "device_id": device_id, "instance_id": instance_id, "normalised_instance_id": whole, "device_key": whole.upper(), "source_id": "s", "control_set": "1", **more}


def test_parents_and_hardware_ids(case):
    nodes = [
        node("USB", "VID_0001&PID_0001", "7&AB", parent_id_prefix="8&CD"), node("HID", "X", "8&CD&0"), node("HID", "Y", "8&CD"), node("HID", "Z", "8&CDE&0"), node("PCI", "P", "1&1", parent_id_prefix="8&CDE"),
        node("USB", "ROOT_HUB30", "4&R", parent_id_prefix="8&CDE"), node("USB", "VID_0002&PID_0002", "9&H", parent_id_prefix="8&CDE", service="USBHUB3"), node("USBSTOR", "D1", "1&0", hardware_id="USB\\HW1|USB\\HW2"), node("USBSTOR", "D2", "2&0", hardware_id="usb\\hw2"),
    ]
    setup = [{"device_key": k, "device_instance_id": k, "kind": "install", "source_id": "s"} for k in ("USB\\HW1", "USB\\HW2")]
    got = {(r.method, r.device_key, r.other_device_key) for r in case(devnode=nodes, setup_section=setup).device_link().collect()}
    usb = "USB\\VID_0001&PID_0001\\7&AB"
    assert got == {
        ("parent_id_prefix", "HID\\X\\8&CD&0", usb), ("parent_id_prefix", "HID\\Y\\8&CD", usb), ("hardware_id_unique", "USBSTOR\\D1\\1&0", "USB\\HW1") if "USBSTOR" < "USB\\" else ("hardware_id_unique", "USB\\HW1", "USBSTOR\\D1\\1&0"),
        ("hardware_id_ambiguous", *sorted(("USB\\HW2", "USBSTOR\\D1\\1&0"))), ("hardware_id_ambiguous", *sorted(("USB\\HW2", "USBSTOR\\D2\\2&0"))),
    }


def test_a_serial_on_two_products_asserts_nothing(case):
    nodes = [node("USB", "VID_0001&PID_0001", "SER12345"), node("SCSI", "VID_0002&PID_0002", "SER12345"), node("USB", "VID_0003&PID_0003", "LONE98765"), node("USBSTOR", "DISK", "LONE98765&0"), node("USB", "VID_0004&PID_0004", "ABC"), node("USBSTOR", "DISK", "ABC&0")]
    got = {(r.method, r.precedence, r.asserts_same_device) for r in case(devnode=nodes).device_link().collect()}
    assert got == {("serial_across_enumerators_shared", 6, False), ("serial_across_enumerators", 2, True)}
    groups = Counter(r.physical_device_id for r in case(devnode=nodes).device_group().collect())
    assert sorted(groups.values()) == [1, 1, 1, 1, 2]


def tempfile_roots(spark):
    return [Path(d.toString()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]


def alike(n):
    """n sticks and n of their USB nodes on one serial, which asserts nothing, and two devices of another."""
    usb = [node("USB", f"VID_0001&PID_{k:04d}", "SAME12345") for k in range(n)]
    sticks = [node("USBSTOR", f"DISK&PROD_{k}", "SAME12345&0") for k in range(n)]
    return [*usb, *sticks, node("USB", "VID_0009&PID_0001", "OTHER1234"), node("USBSTOR", "DISK&PROD_X", "OTHER1234&0"), node("USBSTOR", "DISK&PROD_Y", "OTHER1234&0"), node("USBSTOR", "DISK&PROD_L", "LONE98765&0")]


def test_a_written_tables_shuffle_files_go_with_the_write(spark, tmp_path):
    kept = lambda: spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    before, held = kept(), lambda: {f for d in tempfile_roots(spark) for f in d.rglob("shuffle_*.data")}
    there = held()
    table_in_shared_folder(spark.range(100_000).repartition(3, "id").groupBy((F.col("id") % 999).alias("k")).count())
    for _ in range(50):
        if not held() - there:
            break
        time.sleep(0.1)
    assert not held() - there and kept() == before


def test_devices_of_one_serial_are_written_once_each(case):
    n = 40
    c = case(devnode=alike(n))
    assert c.device_link().count() == n * n + 2
    assert c.device_classified().count() == 2 * n + 4
    assert max(c.device().sparkSession.read.parquet(path).count() for path in c._written) < n * n
    written = sum(c.device().sparkSession.read.parquet(path).count() for path in c._written)
    assert written < 20 * n * len(("identities", "facts"))


@pytest.mark.parametrize("block", [1_000, 3])
def test_evidence_names_every_other_device_of_a_serial(case, monkeypatch, block):
    monkeypatch.setattr(inventory, "A_BLOCK", block)
    monkeypatch.setattr(facts, "A_BLOCK", block)
    c = case(devnode=alike(7))
    links = [(r.device_key, r.other_device_key) for r in c.device_link().collect()]
    assert len(links) == len(set(links)) == 7 * 7 + 2
    serial = {r.physical_device_id: r.serial for r in c.physical_device().collect()}
    near = {(r.physical_device_id, r.other_physical_device_id) for r in c.device_candidate_link().where("not already_grouped").collect()}
    want = Counter()
    want.update(("unresolved_identity_link", a, f"a candidate link to {b} was not acted on") for a, b in near)
    want.update(("duplicate_serial", a, f"serial {serial[a]} is also reported by {b}") for a in serial for b in serial if a != b and serial[a] == serial[b])
    told = [(r.fact, r.physical_device_id, r.evidence) for r in c.device_fact_evidence().collect() if r.fact in ("unresolved_identity_link", "duplicate_serial")]
    assert Counter(told) == want and len(near) == 7 * 7 + 2
    held = {(r.fact, r.physical_device_id): (r.evidence, r.evidence_count) for r in c.device_fact().collect()}
    quoted = {r.physical_device_id: r.fact_evidence for r in c.device_classification().collect()}
    for fact, device in {k[:2] for k in want}:
        each = sorted(e for f, d, e in want if (f, d) == (fact, device))
        assert held[fact, device] == ("; ".join(each), len(each))
        assert f"{fact} ({'; '.join(each)})" in quoted[device]
    assert Counter(k[0] for k in held)["duplicate_serial"] == 2 * 7 + 3


def test_writers_look_at_long_rows_often(case, tmp_path):
    """Rows of texts that grow with a serial: a row group ends near its size, not after 100 to 10,000 rows."""
    case(devnode=alike(60)).device_classification().coalesce(1).write.option("parquet.block.size", 1 << 16).parquet(f"{tmp_path}/out")
    file = pq.ParquetFile(next((tmp_path / "out").glob("*.parquet"))).metadata
    groups = [file.row_group(k) for k in range(file.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 124 and max(g.num_rows for g in groups) < 100


def test_names_that_a_device_reaches_in_part(case):
    """Keys that don't begin with their enumerators, so that a device comes before some of a list only."""
    made = [(f"K{k}\\P{k}\\SAME12345", ("USB", "USBSTOR", "SCSI")[k % 3]) for k in range(9)]
    nodes = [{**node(e, f"VID_0001&PID_{k:04d}" if e == "USB" else f"DISK&PROD_{k}", "SAME12345" if e == "USB" else "SAME12345&0"), "device_key": key} for k, (key, e) in enumerate(made)]
    c = case(devnode=nodes)
    near = {(r.physical_device_id, r.other_physical_device_id) for r in c.device_candidate_link().where("not already_grouped").collect()}
    assert len(near) == 27
    want = {a: "; ".join(sorted(f"a candidate link to {b} was not acted on" for x, b in near if x == a)) for a, _ in near}
    assert {r.physical_device_id: r.evidence for r in c.device_fact().where("fact = 'unresolved_identity_link'").collect()} == want
    # Names, not a text each, are what is made for a device.
    assert dict(c._beside_peers(c.physical_device().select("physical_device_id")).dtypes)["linked_to"].startswith("struct<names:array<string>")


def test_events_are_summed_by_user_once_a_case(spark, monkeypatch):
    read = []
    monkeypatch.setattr(registry, "table_in_shared_folder", lambda df, paths=None: read.append(df.inputFiles()) or table_in_shared_folder(df, paths))
    c = registry.case_of(spark, f"{SF}/.")
    for name in ("mount_entry", "emd_volume", "disk_layout"):
        assert Counter(c.table(name).collect()) == Counter(model.table(spark, SF, name).collect())
    assert sum(any("events.parquet" in f for f in files) for files in read) == 1


def test_a_long_serials_beginning_is_a_candidate(case):
    nodes = [node("USB", "VID_0001&PID_0001", "A" * 20), node("SCSI", "DISK", "A" * 20 + "7"), node("SCSI", "DISK", "A" * 19)]
    got = case(devnode=nodes).device_candidate_link().collect()
    assert [(r.method, r.already_grouped) for r in got] == [("serial_prefix_candidate", False)]


def test_components_of_a_long_chain(spark):
    keys = spark.createDataFrame([(f"k{n:03d}",) for n in range(60)] + [("lone",)], "device_key string")
    edges = spark.createDataFrame([(f"k{n + 1:03d}", f"k{n:03d}") for n in range(59)], "left_key string, right_key string")
    got = {r.device_key: r.component for r in connected_components(keys, edges).collect()}
    assert got == {**{f"k{n:03d}": "k000" for n in range(60)}, "lone": "lone"}


def test_run_volume_ties_abstain(case):
    runs = [{"source_file": k, "executable": "DIG.EXE", "volume_count": 2, "file_count": 2} for k in ("a", "b")] + [{"source_file": "c", "executable": "DIG.EXE", "volume_count": 1, "file_count": 0}]
    volumes = [{"source_file": k, "device_path": v, "volume_serial_hex": v[1:]} for k, v in (("a", "\\V1"), ("a", "\\V2"), ("b", "\\V1"), ("b", "\\V2"), ("c", "\\V9"))]
    files = [{"source_file": k, "path": p} for k, p in (("a", "\\V1\\X\\DIG.EXE"), ("a", "\\V2\\DIG.EXE"), ("b", "\\v1\\dig.exe"), ("b", "\\V2\\DIG.EXE.MUI"))]
    c = case(prefetch_run=runs, prefetch_volume=volumes, prefetch_file=files)
    assert {(r.source_file, r.device_path) for r in c.prefetch_run_volume().collect()} == {("b", "\\V1"), ("c", "\\V9")}
    assert {(r.source_file, r.device_path, r.chosen) for r in c.prefetch_run_volume_candidate().collect()} == {("a", "\\V1", False), ("a", "\\V2", False), ("b", "\\V1", True), ("b", "\\V2", False)}


def test_facts_and_classification(case):
    usb = lambda name, **more: node("USB", f"VID_{name:04d}&PID_0001", f"SERIAL{name}", **more)
    nodes = [
        usb(1, compatible_ids="USB\\CLASS_08", service="USBSTOR"), usb(2, compatible_ids="usb\\class_03|USB\\CLASS_08"), usb(3, compatible_ids="USB\\CLASS_03|USB\\CLASS_09|USB\\CLASS_02&SUBCLASS_06"), usb(4, compatible_ids="USB\\MS_COMP_MTP"),
        node("SCSI", "DISK", "FIXED00001"), usb(6), node("SWD", "RADIO", "X"), usb(8, compatible_ids="USB\\Class_0e"),
    ]
    c = case(devnode=nodes)
    got = {r.physical_device_id.split("\\")[1][4:8]: r for r in c.device_classification().collect()}
    assert {d: (r.category, r.tier) for d, r in got.items()} == {
        "0001": ("Storage", 1), "0002": ("PotentialOffensiveDevice", 1), "0003": ("Network", 1), "0004": ("MobileDevice", 1), "": ("Storage", 3), "0006": ("Unknown", 3), "O": ("OtherPeripheral", 3), "0008": ("AudioVideoCapture", 2),
    }
    assert got[""].score >= 0 and "internal_bus" in got[""].facts and not got[""].review_required
    assert "unknown_class" in got["0006"].facts and got["0006"].review_required
    assert "mixed_interfaces_behind_hub" in got["0003"].facts and "hid_with_storage_or_network" in got["0002"].facts
    other = {r.physical_device_id: r for r in c.with_rules(RuleSet().tables(c.device().sparkSession, "exfiltration")).device_classification().collect()}
    stick = got["0001"]
    assert other[stick.physical_device_id].category == stick.category and other[stick.physical_device_id].raw_score == stick.raw_score + 10


def test_rule_sets_are_validated():
    base = RuleSet().data
    RuleSet().validate()
    for change_ in (
        {"rules": [{"id": "r", "category": "Nowhere", "priority": 1, "conditions": [{"fact": "a"}]}]}, {"rules": [{"id": "r", "category": "Storage", "priority": 1, "conditions": [{"fact": "a", "negate": True}]}]}, {"profiles": {"p": {"nothing": 2}}},
        {"categories": base["categories"] + base["categories"][:1]},
    ):
        with pytest.raises(ValueError):
            RuleSet(base | change_).validate()
    with pytest.raises(ValueError):
        RuleSet.from_json('{"categories": [], "categories": []}')
    with pytest.raises(ValueError):
        RuleSet().rows("no such profile")


def test_moments_gather_the_nearest_entries(case):
    near = [change(1, STICK, "connect"), change(2, STICK, "disconnect", hours=1), change(3, STICK, "connect", hours=1, seconds=20), change(4, STICK, "fault", seconds=9), change(5, STICK, "fault", hours=1, seconds=11), change(6, STICK, "fault", minutes=30)]
    c = case(event=near)
    kind = {r.moment_id: (r.moment_kind, r.moment_utc) for r in c.timeline_moment_anchor().collect()}
    entries = {r.entry_id: (r.event, r.sort_utc) for r in c.timeline().collect()}
    got = {(entries[r.entry_id], kind[r.moment_id][0], r.distance_ms) for r in c.timeline_moment_member().collect() if entries[r.entry_id][0] == "fault"}
    assert got == {(("fault", at(seconds=9)), "arrival", 9000), (("fault", at(hours=1, seconds=11)), "arrival", 9000)}
    assert {(r.moment_kind, r.member_count) for r in c.timeline_moment().collect()} == {("arrival", 2)}


def test_moments_look_no_entry_up_again(spark):
    plan = case_of(spark, SF).timeline_moment()._jdf.queryExecution().executedPlan().toString()
    assert "Join [entry_id" not in plan and "Join [moment_id" in plan


def test_local_times_are_read_in_the_hosts_zone(case):
    zone = [{"control_set": "1", "key_name": "z", "source_id": "s", "bias_minutes": 300, "standard_bias_minutes": 0, "daylight_bias_minutes": -60, "standard_start_month": 11, "daylight_start_month": 3, "dynamic_daylight_disabled": False}]
    setup = [{"device_key": STICK, "device_instance_id": STICK, "kind": "install", "operation": "o", "source_id": "s", "line_number": k, "start_local": t} for k, t in enumerate(["2024/01/02 03:04:05.25", "1980-01-01 07:00:00", "odd"])]
    got = {r.record_id: (r.time_utc, r.time_utc_alt, r.epoch_default, r.time_ambiguous) for r in case(setup_section=setup, host_time_zone=zone).timeline().collect()}
    assert got == {0: (datetime(2024, 1, 2, 8, 4, 5, 250000), datetime(2024, 1, 2, 7, 4, 5, 250000), "", True), 1: (None, None, "the FAT epoch, 1980-01-01", False), 2: (None, None, "", False)}


# ------------------------------------------------------------------ look-ups, functions


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_equals_brute_force(spark, ahead, strict):
    rng = random.Random(3)
    when = lambda: T0 + timedelta(hours=rng.randrange(0, 400))
    facts = [(rng.choice("ab"), when(), k) for k in range(60)]
    asked = [(rng.choice("abc"), when()) for _ in range(80)]
    f = spark.createDataFrame(facts, "k string, t timestamp_ntz, v int")
    got = {(r.k, r.q): r.found for r in as_of(spark.createDataFrame(asked, "k string, q timestamp_ntz"), "q", f, "t", F.col("v"), ["k"], ahead, strict).collect()}
    for k, q in asked:
        fits = [(t, v) for key, t, v in facts if key == k and ((t > q if strict else t >= q) if ahead else (t < q if strict else t <= q))]
        want = None if not fits else min(fits)[1] if ahead else max(fits)[1]
        assert got[k, q] == want


def test_beside_equals_the_whole_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), T0 + timedelta(hours=rng.randrange(0, 300)), k) for k in range(80)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int")
    got = {r.i: (r.before, r.after) for r in beside(beside(df, ["k"], "t", ["i"], F.col("i"), "before"), ["k"], "t", ["i"], F.col("i"), "after", ahead=True).collect()}
    for key in "ab":
        order = [i for _, i in sorted((t, i) for k, t, i in rows if k == key)]
        for before, i, after in zip([None, *order], order, [*order[1:], None]):
            assert got[i] == (before, after)


def test_identity_keys(spark):
    raw = ["USBSTOR\\Disk&Ven_X\\S1&0", "_??_USBSTOR#Disk&Ven_X#S1&0#{53f56307-b6bf-11d0-94f2-00a0c91efb8b}", "\\??\\usbstor#disk&ven_x#s1&0#{53f56307-b6bf-11d0-94f2-00a0c91efb8b}", " USBSTOR\\DISK&VEN_X\\S1&0\x00"]
    df = spark.createDataFrame([(r,) for r in raw], "r string").select(m.device_key(F.col("r")).alias("k"), "r")
    assert {r.k for r in df.collect()} == {"USBSTOR\\DISK&VEN_X\\S1&0"}
    k = spark.createDataFrame([("USBSTOR\\D\\S1&0",), ("USB\\D\\S1&0",), ("USB\\D\\5&1",), ("USB\\D",)], "k string").select(m.device_serial(F.col("k")).alias("s"))
    assert [r.s for r in k.collect()] == ["S1", "S1&0", "", ""]
    one = spark.range(1).select(
        m.is_location(F.lit(None).cast("string")).alias("l"), m.device_vid_pid(F.lit("usb\\vid_1234&pid_abcd")).alias("v"), m.device_vid_pid(F.lit("x VID_12ab&PID_CDef")).alias("w"), m.identity_rank(F.lit("usbstor")).alias("r"), m.has_usb_class(F.lit("usb\\class_0E"), "0e").alias("u"),
        m.device_id_product(F.lit("Disk&Ven_A_B&Prod_C__D&Rev_1")).alias("p"), m.device_id_product(F.lit("Disk&Ven_A")).alias("q"),
    ).first()
    assert tuple(one) == (False, "", "VID_12AB&PID_CDEF", 1, True, "A B C D", "")


def test_times(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024/01/02 03:04:05.678901",), ("nonsense",), ("",), ("2024",)], "t string").select(m.local_timestamp(F.col("t")).alias("u"))
    assert [r.u for r in df.collect()] == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 678901), None, None, None]
    ft = spark.createDataFrame([(0,), (119600064000000000,), (116444736000000000,)], "f long").select(m.filetime(F.col("f")).alias("u"))
    assert [r.u for r in ft.collect()] == [None, None, datetime(1970, 1, 1)]
    e = spark.createDataFrame([(datetime(1980, 1, 1, 13),), (datetime(1980, 1, 1, 15),), (datetime(2000, 1, 20),), (None,)], "u timestamp_ntz").select(m.epoch_default_name(F.col("u")).alias("n"))
    assert [r.n for r in e.collect()] == ["the FAT epoch, 1980-01-01", "", m.RUNNING_ON, ""]


def test_numbering_is_the_total_order(spark):
    rows = [(k * 7919 % 1000,) for k in range(1000)]
    got = timeline.numbered(spark.createDataFrame(rows, "x int"), ["x"], "n").collect()
    assert {(r.x, r.n) for r in got} == {(x, x + 1) for x in range(1000)}


# ------------------------------------------------------------------ sources, sinks, streams


def test_numbered_rows_move_once(spark):
    written = []
    got = timeline.numbered(spark.range(1_000).select((F.col("id") * 7 % 1_000).alias("x"), F.lit("text").alias("text")), [F.desc("x")], "n", written)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and len(written) == 2
    assert all(r.n == 1_000 - r.x for r in got.collect())


def test_setup_log(spark, tmp_path):
    (tmp_path / "setup.log").write_text(
        "[Device Install Log]\n>>>  [Device Install (Hardware initiated) - USB\\VID_1234&PID_5678\\S1]\n>>>  Section start 2024/01/02 03:04:05.678\n     dvi: Class GUID {36fc9e60-c465-11cf-8056-444553540000}\n     inf: usbstor.inf\n     inf: other.inf\n"
        "<<<  Section end 2024/01/02 03:04:06.000\n<<<  [Exit status: SUCCESS]\n\n>>>  [Delete Device - PCI\\VEN_1]\n>>>  Section start 2024/01/02 03:05:05.678\n"
    )
    a, b = text.setup_sections(spark, str(tmp_path)).orderBy("line_number").collect()
    assert (a.operation, a.device_key, a.start_local, a.end_local, a.exit_status, a.driver_inf, a.class_guid, a.complete) == ("Device Install (Hardware initiated)", "USB\\VID_1234&PID_5678\\S1", "2024/01/02 03:04:05.678", "2024/01/02 03:04:06.000", "SUCCESS", "usbstor.inf", "{36fc9e60-c465-11cf-8056-444553540000}", True)
    assert not b.complete and [r.target for r in text.usb_sections(text.setup_sections(spark, str(tmp_path))).collect()] == [a.target]


def test_mounted_values(spark):
    path = "_??_USBSTOR#Disk#S1&0#{53f56307-b6bf-11d0-94f2-00a0c91efb8b}".encode("utf-16-le").hex()
    gpt = (b"DMIO:ID:" + bytes.fromhex("00112233445566778899aabbccddeeff")).hex()
    rows = [("\\DosDevices\\E:", struct.pack("<IQ", 0x1234ABCD, 1048576).hex()), ("\\??\\Volume{01dc0f73-0000-0000-0000-000000000000}", path), ("x", gpt), ("#{01dc0f73-0000-0000-0000-000000000000}", "00")]
    a, b, c, d = text.mounted(spark.createDataFrame(rows, "value_name string, hex string").coalesce(1)).collect()
    assert (a.kind, a.drive_letter, a.target_kind, a.disk_signature, a.partition_offset) == ("drive_letter", "E", "mbr_disk_signature", 0x1234ABCD, 1048576)
    assert (b.kind, b.volume_guid, b.target_kind, b.device_key) == ("volume_guid", "{01dc0f73-0000-0000-0000-000000000000}", "device_path", "USBSTOR\\DISK\\S1&0")
    assert (c.target_kind, c.partition_guid) == ("gpt_partition_guid", "{33221100-5544-7766-8899-aabbccddeeff}")
    assert (d.kind, d.target_kind) == ("no_mount_point", "unknown")


def test_names(spark):
    e = text.emd_keys(spark.createDataFrame([("_??_USBSTOR#D#S#LABEL_123",), ("odd",)], "key_name string")).collect()
    assert [(r.volume_label, r.volume_serial_decimal) for r in e] == [("LABEL", "123"), ("", "")]
    p = text.mount_points(spark.createDataFrame([("E",), ("##srv#share",), ("{01dc0f73-0000-0000-0000-000000000000}",)], "key_name string")).collect()
    assert [(r.kind, r.remote_path) for r in p] == [("drive_letter", ""), ("remote", "\\\\srv\\share"), ("volume_guid", "")]
    u = text.launch_records(spark.createDataFrame([("R:\\FCNQR.RKR", "00"), ("HRZR_PGYFRFFVBA", "00000000" + "05000000" + "02000000" + "e8030000" + "00" * 56)], "value_name string, hex string").coalesce(1)).collect()
    assert (u[0].name, u[0].drive_letter, u[0].run_count, u[0].warnings != "") == ("E:\\SPADE.EXE", "E", None, True)
    assert (u[1].bookkeeping, u[1].run_count, u[1].focus_count, u[1].focus_seconds) == (True, 5, 2, 1.0)
    c = text.drive_captions(spark.createDataFrame([("SURVEY26 (E:)",), ("Local Disk (C:)",), ("notes.odt",)], "name string")).collect()
    assert [(r.drive_letter, r.volume_label) for r in c] == [("E", "SURVEY26"), ("C", ""), ("", "")]


def link_bytes() -> bytes:
    head = struct.pack("<I16sIIQQQI", 76, bytes.fromhex("0114020000000000c000000000000046"), 2 | 8 | 128, 0, 1, 2, 3, 99).ljust(76, b"\0")
    volume = struct.pack("<IIII", 25, 2, 0x1234ABCD, 16) + b"SURVEY26\0"
    path = b"E:\\notes.odt\0"
    info = struct.pack("<7I", 28 + len(volume) + len(path) + 1, 28, 1, 28, 28 + len(volume), 0, 28 + len(volume) + len(path)) + volume + path + b"\0"
    return head + info + struct.pack("<H", 3) + "abc".encode("utf-16-le") + struct.pack("<II8s16s", 96, 0xA0000003, b"", b"HOST").ljust(96, b"\0")


def test_links_and_bad_files(spark, tmp_path):
    for name, content in (("a.lnk", link_bytes()), ("b.lnk", link_bytes()[:90]), ("c.lnk", b"x")):
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in binary.links(spark, str(tmp_path)).collect()}
    a = got["a.lnk"]
    assert (a.target_path, a.removable, a.volume_serial_hex, a.volume_label, a.relative_path, a.machine_id, a.target_size_bytes) == ("E:\\notes.odt", True, "1234-ABCD", "SURVEY26", "abc", "HOST", 99)
    assert got["b.lnk"].warnings and got["c.lnk"].warnings == "not a shell link"
    found = binary.files(spark, str(tmp_path), "*.lnk")
    assert binary.verified(found, spark, str(tmp_path)).where("verified").count() == 3


def test_layouts():
    slot = lambda kind, length: struct.pack("<iiqqIi", 0, 0, 1048576, length, 1, 0) + bytes([kind]) + b"\0" * 111
    got = binary.layout(struct.pack("<III", 0, 2, 0xABCD).ljust(48, b"\0") + slot(7, 5000) + slot(0, 0))
    assert (got["style"], got["disk_signature"], len(got["partitions"]), got["partitions"][0]["type"]) == ("MBR", 0xABCD, 1, "07")
    assert binary.layout(b"")["warnings"] and binary.layout(struct.pack("<II", 1, 9).ljust(60, b"\0"))["warnings"]
    sector = bytearray(512)
    sector[440:444], sector[510:] = struct.pack("<I", 77), b"\x55\xaa"
    assert binary.mbr_signature(bytes(sector)) == 77 and binary.mbr_signature(b"\0" * 512) is None


def test_exports_are_deterministic(spark, tmp_path):
    df = spark.createDataFrame([(k % 5, bytes([65 + k % 3, 200 if k % 2 else 66])) for k in range(50)], "a long, b binary")
    first, second = (sinks.export(sinks.clean_text(df.repartition(n)), sinks.Export("view", ("a",), "csv"), str(tmp_path / str(n))) for n in (2, 5))
    assert first["rows"] == 50 and [f["sha256"] for f in first["files"]] == [f["sha256"] for f in second["files"]]
    sinks.manifest(spark, [first], {"run": "x"}, str(tmp_path))
    with pytest.raises(ValueError):
        sinks.export(df, sinks.Export("other", ("z",)), str(tmp_path))


def test_a_run_writes_everything(spark, tmp_path):
    import json

    c = case_of(spark, SF)
    names = ["data/devices", "data/connections", "provenance/observations", "classification/rules"]
    assert len(sinks.EXPORTS) == 36 and all(hasattr(Case, v) for v, _ in sinks.EXPORTS.values())
    for name, (view, order) in sinks.EXPORTS.items():
        assert set(order) <= set(getattr(c, view)().columns), name
    folder = sinks.claimed(spark, str(tmp_path / "out"), "one")
    with pytest.raises(FileExistsError):
        sinks.claimed(spark, str(tmp_path / "out"), "one")
    with pytest.raises(ValueError):
        sinks.claimed(spark, str(tmp_path / "out"), "../x")
    at_ = datetime(2025, 1, 2, 3, 4, 5)
    assert [sinks.claimed(spark, str(tmp_path / "out"), now=at_).rsplit("/", 1)[1] for _ in range(2)] == ["20250102T030405Z", "20250102T030405Z-2"]
    done = sinks.export_case(c, folder, names)
    assert [d["rows"] for d in done] == [c.device_classified().count(), c.connection().count(), 1000, 25]
    saved = sinks.save_case(c, ["event", "devnode"], f"{folder}/case")
    assert {s_["name"] for s_ in saved} == {"event", "devnode", *sinks.CONSOLIDATED}
    assert sinks.read_case(spark, f"{folder}/case").table("event").count() == 1000
    page = sinks.report(c, "a <case>", 5)
    assert "a &lt;case&gt;" in page and "<script" not in page and "5 of " in page
    assert any("storage.identity" in line for line in sinks.rule_lines())
    sinks.manifest(spark, done, {"run": "x"}, folder)
    assert {o["name"] for o in json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])["outputs"]} == set(names)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(0, "D", "arrival"), (5, "D", "departure"), (100, "D", "arrival"), (90_000, "E", "arrival")]
    c = spark.createDataFrame([(k, T0 + timedelta(seconds=s), d, state) for k, (s, d, state) in enumerate(rows)], "record_id long, time_utc timestamp_ntz, device_key string, state string")
    c.write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in activity_sessions(c).where("device_key = 'D'").collect()}
    q = activity_sessions(spark.readStream.schema(c.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sessions_seen").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.table("sessions_seen").collect()} == want
    finally:
        q.stop()


def test_stars_connect_what_all_pairs_connect(spark):
    from collections import defaultdict

    case = case_of(spark, "/root/testdata/sf0.01")

    def parts(edges):
        parent = {}

        def top(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[top(a)] = top(b)
        out = defaultdict(set)
        for x in list(parent):
            out[top(x)].add(x)
        return {frozenset(s) for s in out.values()}

    stars = [(r.left_key, r.right_key, r.method) for r in case._grouping_star().collect()]
    pairs = [(r.device_key, r.other_device_key, r.method) for r in case.device_link().where("asserts_same_device").collect()]
    assert parts((a, b) for a, b, _ in stars) == parts((a, b) for a, b, _ in pairs) and stars
    for method in {m for _, _, m in pairs}:
        assert parts((a, b) for a, b, m in stars if m == method) == parts((a, b) for a, b, m in pairs if m == method)


def test_a_container_of_many_identities_has_an_edge_each(spark):
    from vestige.operators.full import Case

    n = 5000
    nodes = spark.range(n).selectExpr("'src-1' AS source_id", "'ControlSet001' AS control_set", "'USB' AS enumerator", "concat('VID_0001&PID_', lpad(hex(id % 65536), 4, '0')) AS device_id", "concat('7&', hex(id), '&0') AS instance_id")
    key = "concat(enumerator, chr(92), device_id, chr(92), instance_id)"
    nodes = nodes.selectExpr("*", f"{key} AS normalised_instance_id", f"upper({key}) AS device_key", "'{aaaaaaaa-0000-0000-0000-000000000001}' AS container_id")
    of = case_of(spark, "/root/testdata/sf0.001")
    like = of.table("devnode").limit(0)
    case = Case(lambda name: like.unionByName(nodes, allowMissingColumns=True) if name == "devnode" else of.table(name).limit(0))
    assert case._grouping_star().count() == n - 1
    (row,) = case.device_group().groupBy("physical_device_id").agg(F.count(F.lit(1)).alias("n"), F.max("preference").alias("last"), F.count_distinct("preference").alias("places")).collect()
    assert (row.n, row.last, row.places) == (n, n, n)
    case.close()


def test_reasons_quote_the_rules_notes(spark):
    case = case_of(spark, "/root/testdata/sf0.01")
    won = {r.rule_id: r.classification_reason for r in case.device_classification().collect()}
    assert won["storage.identity"].startswith("matched storage.identity — A USBSTOR or SCSI disk identity, or USB base class 08.; facts: ")
    reviews = {r.review_reason for r in case.device_classification().where("review_required").collect()}
    assert "The serial is shared with another physical device." in {s.strip() + "." for r in reviews for s in r.split(".") if s}
    assert case.rule().where("rule_id = 'mobile.apple'").first().note == "The Apple mobile device service names the device whatever else it exposes."


def test_a_second_pass_adds_the_fact_of_attribution(spark):
    case = case_of(spark, "/root/testdata/sf0.01")
    after = case.second_pass()
    first = {(r.physical_device_id, r.fact): r.evidence for r in case.device_fact().collect()}
    second = {(r.physical_device_id, r.fact): r.evidence for r in after.device_fact().collect()}
    group = {r.device_key: r.physical_device_id for r in case.device_group().collect()}
    reached = {group[r.device_key] for r in case.file_attribution().select("device_key").distinct().collect()}
    assert not any(f == "file_activity" for _, f in first) and {d for d, f in second if f == "file_activity"} == reached
    assert {k: v for k, v in second.items() if k[1] != "file_activity"} == first
    scores = [{r.physical_device_id: r.raw_score for r in c.device_classification().collect()} for c in (case, after)]
    assert {d for d in scores[0] if scores[1][d] != scores[0][d]} == reached and all(scores[1][d] == scores[0][d] + 20 for d in reached)
