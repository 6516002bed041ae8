"""A collection from its files to the report: every decoder, the ledger, and files made to mislead."""

from __future__ import annotations

import hashlib
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_sources import BINARY, DWORD, NOON, SYSTEM, Xml, an_event, compound, dest, file_item, link_bytes, made_hive, prefetch_file, text_value, wide
from vestige.sources import loading, ranged
from vestige.sources.evtx import CHUNK, HEAD

STICK = "USBSTOR\\Disk&Ven_Q&Prod_R\\SER123456&0"
_EXPLORER = ["Software", "Microsoft", "Windows", "CurrentVersion", "Explorer"]


def nested(path: list[str], content: dict) -> dict:
    for name in reversed(path):
        content = {name: content}
    return content


def system_hive() -> bytes:
    enum = {
        "USB": {"VID_0781&PID_5567": {"SER123456": {"Service": text_value("USBSTOR"), "ContainerID": text_value("{11111111-2222-3333-4444-555555555555}"), "CompatibleIDs": text_value("USB\\Class_08&SubClass_06&Prot_50")}}},
        "USBSTOR": {"Disk&Ven_Q&Prod_R": {"SER123456&0": {"FriendlyName": text_value("Q R USB Device"), "ContainerID": text_value("{11111111-2222-3333-4444-555555555555}"), "ClassGUID": text_value("{4d36e967-e325-11ce-bfc1-08002be10318}")}}},
    }
    path = "_??_USBSTOR#Disk&Ven_Q&Prod_R#SER123456&0#{53f56307-b6bf-11d0-94f2-00a0c91efb8b}".encode("utf-16-le")
    return made_hive({"Select": {"Current": (DWORD, struct.pack("<I", 1))}, "ControlSet001": {"Enum": enum, "Control": SYSTEM["ControlSet002"]["Control"]}, "MountedDevices": {"\\DosDevices\\E:": (BINARY, path)}})


def user_hive() -> bytes:
    launch = struct.pack("<IIII", 0, 5, 2, 1000).ljust(60, b"\0") + struct.pack("<Q", NOON) + b"\0" * 4
    return made_hive(
        nested(
            _EXPLORER,
            {
                "MountPoints2": {"E": {}, "##host#share": {}},
                "RecentDocs": {"MRUListEx": (BINARY, struct.pack("<2I", 0, 0xFFFFFFFF)), "0": (BINARY, "ATLAS (E:)\0".encode("utf-16-le") + file_item("A", "ATLAS.lnk") + b"\0\0")},
                "UserAssist": {"{CEBFF5CD-ACE2-4F4F-9178-9926F41749EA}": {"Count": {"R:\\gbby.rkr": (BINARY, launch), "short": (BINARY, b"x")}}},
            },
        )
    )


def log(*chunks: bytes) -> bytes:
    return b"ElfFile\0".ljust(HEAD, b"\0") + b"".join(chunks)


SETUP = """[Device Install Log]
>>>  [Device Install (Hardware initiated) - USB\\VID_0781&PID_5567\\SER123456]
>>>  Section start 2024/01/17 20:00:01.500
     dvi:      Class GUID  - {4D36E967-E325-11CE-BFC1-08002BE10318}
<<<  Section end 2024/01/17 20:00:02.000
<<<  [Exit status: SUCCESS]
>>>  [Device Install - PCI\\VEN_1]
>>>  Section start 2024/01/17 20:00:03.500
"""


def collection(root) -> None:
    volume = root / "uploads" / "auto" / "C%3A"
    later = NOON + 600 * 10_000_000
    volumes = Xml()
    an_event(volumes, 1, "Microsoft-Windows-StorageVolume/Operational", "P", 1001, {"DiskInstancePath": wide(STICK), "DiskNumber": (8, struct.pack("<I", 1))}, NOON)
    an_event(volumes, 2, "Microsoft-Windows-StorageVolume/Operational", "P", 1002, {"DiskInstancePath": wide(STICK), "DiskNumber": (8, struct.pack("<I", 1))}, later)
    boots = Xml()
    an_event(boots, 9, "System", "EventLog", 6005, {"A": wide("b")}, NOON - 10_000_000)
    folded = {"5.automaticDestinations-ms": compound({"1": link_bytes("E:\\a"), "DestList": struct.pack("<II", 3, 1).ljust(32, b"\0") + dest(1, "E:\\a", True, 3)})}
    recent = "Users/ann/AppData/Roaming/Microsoft/Windows/Recent"
    files = {
        "Windows/System32/config/SYSTEM": system_hive(),
        "Windows/System32/config/SYSTEM.LOG1": b"\0" * 512,
        "Windows/System32/config/SOFTWARE": made_hive(nested(["Microsoft"], {"Windows Portable Devices": {"Devices": {"SWD#WPDBUSENUM#_??_USBSTOR#DISK&VEN_Q&PROD_R#SER123456&0#{53F56307-B6BF-11D0-94F2-00A0C91EFB8B}": {"FriendlyName": text_value("ATLAS")}}}, "Windows NT": {"CurrentVersion": {"EMDMgmt": {"_??_USBSTOR#Disk&Ven_Q&Prod_R#SER123456&0#{53f56307-b6bf-11d0-94f2-00a0c91efb8b}ATLAS_305441741": {}}}}})),
        "Users/ann/NTUSER.DAT": user_hive(),
        f"{recent}/notes.lnk": link_bytes("E:\\notes.txt"),
        **{f"{recent}/AutomaticDestinations/{n}": b for n, b in folded.items()},
        "Windows/INF/setupapi.dev.log": SETUP.encode(),
        "Windows/Prefetch/SPADE.EXE-1.pf": prefetch_file(),
        "Windows/System32/winevt/Logs/Microsoft-Windows-StorageVolume%4Operational.evtx": log(volumes.chunk()),
        "Windows/System32/winevt/Logs/System.evtx": log(boots.chunk()),
        "Windows/System32/winevt/Logs/Security.evtx": b"never opened",
    }
    for name, content in files.items():
        (volume / name).parent.mkdir(parents=True, exist_ok=True)
        (volume / name).write_bytes(content)


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("evidence")
    collection(root)
    out = loading.load(spark, str(root))
    out.root = root
    yield out
    out.close()


def test_sources_have_places_and_digests(case):
    rows = {r.source_path.rsplit("/", 1)[1]: r for r in case.source().collect()}
    assert len(rows) == 9 and "Security.evtx" not in rows
    ordered = sorted(rows.values(), key=lambda r: r.source_path)
    assert [r.source_id for r in ordered] == [f"src-{k + 1:04d}" for k in range(9)] and [r.read_order for r in ordered] == list(range(1, 10))
    hive = rows["SYSTEM"]
    assert hive.sha256 == hashlib.sha256(system_hive()).hexdigest() and hive.size_bytes == len(system_hive())
    assert hive.replayed is False and hive.replay_note == "SYSTEM.LOG1: empty" and rows["notes.lnk"].replayed is None


def test_a_second_reading_finds_what_has_changed(spark, tmp_path):
    collection(tmp_path)
    made = loading.load(spark, str(tmp_path))
    source = made.table("source")
    assert source.count() == 9
    link = next(tmp_path.rglob("notes.lnk"))
    link.write_bytes(link_bytes("E:\\other"))
    next(tmp_path.rglob("setupapi.dev.log")).unlink()
    got = {r.path.rsplit("/", 1)[1]: r for r in made.collection.verified(source).collect()}
    assert {n for n, r in got.items() if not r.verified} == {"notes.lnk", "setupapi.dev.log"}
    assert "another" in got["notes.lnk"].verify_note and "unreadable" in got["setupapi.dev.log"].verify_note
    made.close()


def test_every_table_has_its_rows(case):
    counts = {t: case.table(t).count() for t in loading.TABLES}
    assert all(counts[t] for t in loading.TABLES if t not in ("shell_bag", "disk_layout", "disk_partition")), counts
    (mount,) = case.table("mount_entry").collect()
    assert (mount.target_kind, mount.drive_letter, mount.device_instance_id, mount.device_key) == ("device_path", "E", STICK, STICK.upper())
    (emd,) = case.table("emd_volume").collect()
    assert (emd.volume_serial_decimal, emd.device_key) == ("305441741", STICK.upper())
    (wpd,) = case.table("portable_device").collect()
    assert (wpd.friendly_name, wpd.device_key) == ("ATLAS", STICK.upper())
    (section,) = case.table("setup_section").collect()
    assert (section.kind, section.device_instance_id, section.start_utc, section.start_utc_alt, section.time_ambiguous) == ("install", "USB\\VID_0781&PID_5567\\SER123456", datetime(2024, 1, 17, 19, 0, 1, 500000), datetime(2024, 1, 17, 18, 0, 1, 500000), True)
    targets = {r.origin: r for r in case.table("file_target").collect()}
    assert targets["shell_link"].link_context == "recent" and targets["shell_link"].source_modified_utc and targets["shell_link"].drive_letter == "E" and targets["shell_link"].profile == "ann"
    assert (targets["jump_list"].access_count, targets["jump_list"].pinned, targets["jump_list"].app_id) == (3, True, "5")
    launches = {r.name: r for r in case.table("user_assist").collect()}
    assert launches["E:\\tool.exe"].run_count == 5 and launches["E:\\tool.exe"].category_name == "an executable file"


def test_observations_are_numbered_and_resolve(case):
    rows = case.observation().collect()
    assert sorted(r.observation_id for r in rows) == [f"obs-{k + 1:08d}" for k in range(len(rows))]
    assert all(r.source_path and r.source_sha256 for r in rows)
    kinds = {r.kind for r in rows}
    assert kinds >= {"devnode.value", "devnode.key_last_write", "host.time_zone", "host.prefetch_setting", "mounted_device.device_path", "portable_device", "emdmgmt.volume", "mount_point.drive_letter", "mount_point.remote", "mru.recent_doc", "user_assist", "event.connect", "event.disconnect", "event.session", "setupapi.install", "shell_link", "jump_list_entry", "prefetch.run", "prefetch.volume"}
    (named,) = [r for r in rows if r.kind == "devnode.value" and r.field == "FriendlyName"]
    assert named.raw == "Q R USB Device" and named.registry_key.endswith(STICK) and named.control_set == "ControlSet001"


def test_a_folder_becomes_a_report(case):
    (device,) = case.physical_device().collect()
    windows = case.connection().where("started_utc is not null and ended_utc is not null").collect()
    assert any(w.device_key == STICK.upper() and w.started_utc == datetime(2024, 1, 17, 21, 20) and w.ended_utc == datetime(2024, 1, 17, 21, 30) for w in windows)
    assert any(r.drive_letter == "E" and r.device_key == STICK.upper() for r in case.device_volume_link().collect())
    attributed = {r.path for r in case.file_attribution().where(F.col("device_key") == STICK.upper()).collect()}
    assert {"E:\\notes.txt", "E:\\a", "E:\\tool.exe"} <= attributed
    assert case.device_classification().first().category == "USB mass storage" or case.device_classification().first().category
    (summary,) = case.report_summary().collect()
    assert summary.asDict() and case.timeline().count() > 5 and case.report_device().count() == 1
    assert {r.severity for r in case.warning().collect()} >= {"absent"}


@pytest.fixture
def hostile(tmp_path):
    collection(tmp_path)
    volume = tmp_path / "uploads" / "auto" / "C%3A"
    strange = Xml()
    an_event(strange, 1, "System", "EventLog", 6005, {"A": wide("b")})
    odd_id = Xml()
    system = ("System", {}, [("Provider", {"Name": "EventLog"}, []), ("EventID", {}, ["0x3e9"]), ("Channel", {}, ["System"])])
    odd_id.record(7, NOON, ("Event", {}, [system]), [])
    cut = bytearray(strange.chunk())
    struct.pack_into("<I", cut, 48, 0xFFFFFFF0)
    files = {
        "Windows/System32/config/SYSTEM": system_hive()[:6000],
        "Windows/System32/config/SOFTWARE": b"regf" + b"\xff" * 5000,
        "Users/ann/NTUSER.DAT": b"",
        "Users/ann/NTUSER.DAT.LOG1": b"regf" + b"\xfe" * 600,
        "Users/ann/AppData/Roaming/Microsoft/Windows/Recent/bad.lnk": link_bytes("E:\\x")[:80],
        "Users/ann/AppData/Roaming/Microsoft/Windows/Recent/[odd] {name}*?.lnk": link_bytes("E:\\odd"),
        "Users/ann/AppData/Roaming/Microsoft/Windows/Recent/AutomaticDestinations/6.automaticDestinations-ms": bytes.fromhex("d0cf11e0a1b11ae1") + b"\xff" * 2000,
        "Windows/Prefetch/BAD.pf": b"MAM\x04" + b"\xff" * 40,
        "Windows/INF/setupapi.dev.log": b">>>  [Device Install - USB\\X]\n\xff\xfe\x00broken",
        "Windows/System32/winevt/Logs/System.evtx": log(odd_id.chunk(), bytes(cut), b"ElfChnk\0" + b"\xff" * (CHUNK - 8), strange.chunk()) + b"ElfChnk\0" + b"\0" * 100,
        "Windows/System32/winevt/Logs/Microsoft-Windows-StorageVolume%4Operational.evtx": b"no log",
    }
    for name, content in files.items():
        (volume / name).parent.mkdir(parents=True, exist_ok=True)
        (volume / name).write_bytes(content)
    return tmp_path


def test_hostile_files_warn_and_never_abort(spark, hostile):
    case = loading.load(spark, str(hostile))
    for name in loading.TABLES:
        case.table(name).count()
    said = {(r.artefact, (r.path or "").rsplit("/", 1)[-1]): r for r in case.warning().collect()}
    for at in (("SYSTEM", "SYSTEM"), ("NTUSER", "NTUSER.DAT"), ("EVTX", "Microsoft-Windows-StorageVolume%4Operational.evtx"), ("EVTX", "System.evtx"), ("PREFETCH", "BAD.pf"), ("JUMPLIST", "6.automaticDestinations-ms")):
        assert at in said, (at, sorted(said))
    assert said["EVTX", "Microsoft-Windows-StorageVolume%4Operational.evtx"].message == "not an event log"
    assert any(r.path.endswith("[odd] {name}*?.lnk") for r in case.source().withColumnRenamed("source_path", "path").collect())
    assert "E:\\odd" in {r.path for r in case.table("file_target").collect()}
    assert [r.record_id for r in case.table("event").collect()] == [1, 1] or {r.record_id for r in case.table("event").collect()} == {1}
    assert case.report_summary().count() == 1
    case.close()


def test_a_log_beyond_two_gigabytes_is_read_by_ranges(spark, tmp_path):
    x = Xml()
    an_event(x, 5, "System", "EventLog", 6005, {"A": wide("b")})
    path = tmp_path / "System.evtx"
    places = [HEAD, HEAD + 1000 * CHUNK, HEAD + 40_000 * CHUNK]
    with path.open("wb") as f:  # sparse
        f.write(b"ElfFile\0")
        for at in places:
            f.seek(at)
            f.write(x.chunk())
    assert path.stat().st_size > 1 << 31
    chunks = ranged.log_chunks(spark, [str(path)])
    assert chunks.rdd.getNumPartitions() == len(ranged.ranges("p", path.stat().st_size)) > 150
    assert sorted(r.at for r in chunks.select("at").collect()) == places
    sizes = [r.end - r.begin for r in ranged._Reader([str(path)]).partitions()]
    assert sizes == sorted(sizes, reverse=True) and max(sizes) <= ranged.RANGE


def test_the_command_line_writes_a_run(spark, tmp_path, capsys):
    import json

    from vestige.__main__ import main

    collection(tmp_path / "in")
    folder = main(["--evidence", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--run-id", "one", "--exports", "data/devices,provenance/observations"])
    assert folder.endswith("/one")
    said = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json").collect()))
    outputs = {o["name"]: o for o in said["outputs"]}
    assert outputs["data/devices"]["rows"] == 1 and outputs["case/devnode"]["rows"] == 2 and len(outputs) == 2 + len(loading.TABLES) + 7 + 4
    evidence = said["about"]["evidence"]
    assert evidence["sources"]["SYSTEM"] == {"files": 1, "bytes": len(system_hive()), "changed": 0} and evidence["changed"] == []
    assert evidence["event_selection"]["files_read"] == 2 and evidence["event_selection"]["channels_skipped"] == ["Security"] and evidence["event_selection"]["records"] == {"kept": 3}
    assert set(said["about"]["timings"]) == {"exports", "case", "report", "verification"}
    with pytest.raises(ValueError):
        main(["--evidence", str(tmp_path / "in"), "--output", str(tmp_path / "in" / "out")])
    with pytest.raises(SystemExit):
        main(["--evidence", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--exports", "data/nothing"])
    capsys.readouterr()
    main(["--list-sources"])
    assert "System:EventLog:6005: session: the event log service started" in capsys.readouterr().out
    main(["--list-rules"])
    assert "storage.identity: Storage if storage_identity" in capsys.readouterr().out


@pytest.mark.parametrize("layout", ["", "uploads/auto/C%3A", "D"])
def test_discovery_by_listing_is_that_by_walking(spark, tmp_path, layout):
    import shutil

    from vestige.sources import evidence, listing

    collection(tmp_path / "made")
    root = tmp_path / "in"
    shutil.copytree(tmp_path / "made" / "uploads" / "auto" / "C%3A", root / layout, dirs_exist_ok=True)
    volume = root / layout
    (tmp_path / "out.lnk").write_text("x")
    desktop = volume / "Users/ann/Desktop"
    desktop.mkdir()
    (desktop / "escape.lnk").symlink_to(tmp_path / "out.lnk")
    (desktop / "_hidden.LNK").write_text("")
    (volume / "Users/bob").mkdir()
    for name in ("NTUSER.DAT", "ntuser.dat"):
        (volume / "Users/bob" / name).write_text("x")
    (volume / "Program Files" / "deep").mkdir(parents=True)
    (volume / "Program Files" / "deep" / "never.lnk").write_text("x")
    walked, found = evidence.locate(str(root)), listing.located(spark, f"file://{root}")
    here = lambda rows: sorted((k, p.removeprefix("file://"), v.removeprefix("file://"), d, u, c, [x.removeprefix("file://") for x in logs]) for k, p, v, d, u, c, logs in rows)
    assert here(found.artefacts) == here(walked.artefacts) and len(found.artefacts) == 11
    assert [f[0] for f in found.failures] == ["LNK"] == [f[0] for f in walked.failures] and len(found.collisions) == len(walked.collisions) == 1
    assert not found.missing
    listing_rows = {r.below for r in listing.listed(spark, str(root)).collect()}
    assert not any("never" in r for r in listing_rows)
    case = loading.load(spark, f"file://{root}")
    assert case.table("source").count() == 10 and case.table("devnode").count() == 2 and case.table("event").count() == 3
    case.close()


def test_no_folder_and_no_volume(spark, tmp_path):
    from vestige.sources import listing

    with pytest.raises(ValueError):
        listing.located(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError):
        listing.located(spark, f"file://{tmp_path}/nothing")
