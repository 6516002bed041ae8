"""Decoders on files that are built here."""

from __future__ import annotations

import struct
from datetime import datetime

import pytest

from vestige.sources import binary, hive, registry, shellitems
from vestige.sources.hive import BINARY, DWORD, MULTI, SZ

NOON = 133_500_000_000_000_000  # 2024-01-17 21:20:00


def text_value(t: str) -> tuple[int, bytes]:
    return SZ, (t + "\0").encode("utf-16-le")


def made_hive(tree: dict, written: int = NOON) -> bytes:
    """A hive of nested dicts: a dict is a key, a tuple a value (type, data)."""
    cells = bytearray(32)  # the bin's header

    def put(body: bytes) -> int:
        size = -(-(len(body) + 4) // 8) * 8
        at = len(cells)
        cells.extend(struct.pack("<i", -size) + body.ljust(size - 4, b"\0"))
        return at

    def key(name: str, content: dict) -> int:
        subs = [key(n, c) for n, c in content.items() if isinstance(c, dict)]
        values = []
        for n, c in content.items():
            if isinstance(c, tuple):
                kind, data = c
                raw = n.encode("latin-1")
                if len(data) <= 4:
                    size, where = len(data) | 0x80000000, int.from_bytes(data.ljust(4, b"\0"), "little")
                elif len(data) > 16344:
                    parts = [put(data[k : k + 16344]) for k in range(0, len(data), 16344)]
                    size, where = len(data), put(b"db" + struct.pack("<HI", len(parts), put(struct.pack(f"<{len(parts)}I", *parts))))
                else:
                    size, where = len(data), put(data)
                values.append(put(b"vk" + struct.pack("<HIIIHH", len(raw), size, where, kind, 1, 0) + raw))
        half = len(subs) // 2
        lists = [put(b"lh" + struct.pack("<H", len(part)) + b"".join(struct.pack("<II", s, 0) for s in part)) for part in (subs[:half], subs[half:]) if part]
        sub_list = 0 if not subs else lists[0] if len(lists) == 1 else put(b"ri" + struct.pack("<H2I", 2, *lists))
        value_list = put(struct.pack(f"<{len(values)}I", *values)) if values else 0
        raw = name.encode("latin-1")
        return put(b"nk" + struct.pack("<HQIIIIIIIIIIIIIIIHH", 0x20, written, 0, 0, len(subs), 0, sub_list, 0, len(values), value_list, 0, 0, 0, 0, 0, 0, 0, len(raw), 0) + raw)

    root = key("ROOT", tree)
    cells.extend(bytes(-len(cells) % 4096))
    cells[:12] = b"hbin" + struct.pack("<II", 0, len(cells))
    head = bytearray(4096)
    head[:4] = b"regf"
    struct.pack_into("<II", head, 4, 7, 7)
    struct.pack_into("<II", head, 36, root, len(cells))
    return bytes(head + cells)


DATES = {"{83da6326-97a6-4088-9453-a1923f573b29}": {f"{0x64 + k:04X}": {"": (BINARY, struct.pack("<Q", NOON + k * 10_000_000))} for k in range(4)}, "{other}": {"zz": {}, "0005": {"": (BINARY, b"x" * 9)}}}
SYSTEM = {
    "Select": {"Current": (DWORD, struct.pack("<I", 2))},
    "ControlSet001": {"Enum": {"USB": {"VID_1&PID_2": {"S1": {"Service": text_value("USBSTOR"), "HardwareID": (MULTI, "USB\\A\0USB\\B\0\0".encode("utf-16-le")), "ContainerID": text_value("{c}"), "Properties": DATES}, "S2": {}}}, "PCI": {"X": {"Y": {}}}}},
    "ControlSet002": {
        "Enum": {"USBSTOR": {"Disk&Ven_Q": {"Z&0": {"FriendlyName": text_value("Q " + "é" * 3), "Large": (BINARY, bytes(range(256)) * 100)}}}},
        "Control": {
            "TimeZoneInformation": {"TimeZoneKeyName": text_value("Nowhere"), "Bias": (DWORD, struct.pack("<i", -60)), "DaylightBias": (DWORD, struct.pack("<i", -60)), "StandardStart": (BINARY, struct.pack("<HH", 0, 10)), "DaylightStart": (BINARY, struct.pack("<HH", 0, 3))},
            "Session Manager": {"Memory Management": {"PrefetchParameters": {"EnablePrefetcher": (DWORD, struct.pack("<I", 3))}}},
        },
    },
    "MountedDevices": {"\\DosDevices\\E:": (BINARY, struct.pack("<IQ", 77, 1048576))},
}


def test_hives(spark, tmp_path):
    h = hive.Hive(made_hive(SYSTEM))
    assert registry.control_sets(h) == (["ControlSet001", "ControlSet002"], "ControlSet002")
    assert h.root.at("controlset002\\enum\\usbstor\\Disk&Ven_Q\\Z&0").raw("large") == bytes(range(256)) * 100
    (tmp_path / "SYSTEM").write_bytes(made_hive(SYSTEM))
    (tmp_path / "BROKEN").write_bytes(made_hive(SYSTEM)[:5000])
    (tmp_path / "TEXT").write_bytes(b"no hive")
    rows = registry.devnode_table(binary.files(spark, str(tmp_path))).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows if r.problem) == ["BROKEN", "TEXT"]
    got = {r.device_key: r for r in rows if not r.problem}
    assert set(got) == {"USB\\VID_1&PID_2\\S1", "USB\\VID_1&PID_2\\S2", "USBSTOR\\DISK&VEN_Q\\Z&0"}
    one = got["USB\\VID_1&PID_2\\S1"]
    assert (one.service, one.hardware_id, one.container_id, one.control_set, one.friendly_name) == ("USBSTOR", "USB\\A|USB\\B", "{c}", "ControlSet001", "")
    assert (one.install_date_utc, one.last_removal_date_utc, one.key_last_write_utc) == (datetime(2024, 1, 17, 21, 20), datetime(2024, 1, 17, 21, 20, 3), datetime(2024, 1, 17, 21, 20))
    assert got["USBSTOR\\DISK&VEN_Q\\Z&0"].friendly_name == "Q ééé" and got["USB\\VID_1&PID_2\\S2"].install_date_utc is None
    (zone,) = registry.time_zone(made_hive(SYSTEM))
    assert (zone["key_name"], zone["bias_minutes"], zone["daylight_bias_minutes"], zone["standard_start_month"], zone["dynamic_daylight_disabled"]) == ("Nowhere", -60, -60, 10, False)
    assert [(r["raw_value"], r["value_found"]) for r in registry.prefetch_setting(made_hive(SYSTEM))] == [(3, True)]
    assert [r["value_found"] for r in registry.prefetch_setting(made_hive({"ControlSet001": {}}))] == [False]
    assert [r["value_name"] for r in registry.mounted_devices(made_hive(SYSTEM))] == ["\\DosDevices\\E:"]


def test_logs_are_replayed_in_order():
    old, new = made_hive({"A": {"v": (DWORD, b"\1\0\0\0")}}), made_hive({"A": {"v": (DWORD, b"\2\0\0\0")}})
    page = next(k for k in range(4096, len(old), 512) if old[k : k + 512] != new[k : k + 512])

    def log(*entries):
        out = bytearray(old[:512])
        for sequence, at, data in entries:
            body = struct.pack("<II", at - 4096, len(data)) + data
            head = b"HvLE" + struct.pack("<IIIIIQ", 40 + len(body), 0, sequence, len(old) - 4096, 1, hive.marvin(body))
            out += head + struct.pack("<Q", hive.marvin(head)) + body
        return bytes(out)

    good = log((7, page, new[page : page + 512]))
    found, state = hive.replayed(old, {"LOG1": good, "LOG2": bytes(600), "LOG3": b"junk", "LOG4": log((3, page, b"old")), "LOG5": old[:512] + b"DIRT"})
    assert state == {"LOG1": "applied", "LOG2": "empty", "LOG3": "unreadable", "LOG4": "superseded", "LOG5": "unsupported"}
    h = hive.Hive(found)
    assert h.root.at("A").number("v") == 2 and not h.dirty
    assert hive.replayed(old, {"LOG1": log((9, page, new[page : page + 512]))})[1] == {"LOG1": "superseded"}  # entries between are missing
    torn = bytearray(log((7, page, new[page : page + 512]), (8, page, old[page : page + 512])))
    torn[-1] ^= 1  # the second entry's last page
    found, state = hive.replayed(old, {"LOG1": bytes(torn)})
    assert state == {"LOG1": "applied"} and hive.Hive(found).root.at("A").number("v") == 2
    torn[512 + 12] ^= 1  # the first entry's sequence: its head's hash doesn't hold, so the log has no entry
    assert hive.replayed(old, {"LOG1": bytes(torn)}) == (old, {"LOG1": "empty"})


def test_marvin_hashes():
    # The published values for this seed.
    for data, value in (("", 0x30ED35C100CD3C7D), ("af", 0x48E73FC77D75DDC1), ("e70f", 0xB5F6E1FC485DBFF8), ("37f495", 0xF0B07C789B8CF7E8), ("8642dc59", 0x7008F2E87E9CF556)):
        assert hive.marvin(bytes.fromhex(data), 0x004FB61A001BDBCC) == value


def file_item(name: str, long: str) -> bytes:
    day, clock = (2024 - 1980) << 9 | 3 << 5 | 4, 5 << 11 | 6 << 5 | 4
    fixed = b"\x32\0" + struct.pack("<IIH", 10, clock << 16 | day, 0) + name.encode() + b"\0"
    fixed += b"\0" * (len(fixed) % 2)
    block = struct.pack("<HHIII", 0, 9, 0xBEEF0004, clock << 16 | day, 0) + b"\0" * 4 + struct.pack("<Q", 5 << 48 | 1234) + b"\0" * 10 + long.encode("utf-16-le") + b"\0\0"
    body = fixed + block + struct.pack("<H", len(fixed) + 2)
    return struct.pack("<H", len(body) + 2) + body


DRIVE = struct.pack("<H", 25) + b"\x2fG:\\".ljust(23, b"\0")
PC = struct.pack("<H", 20) + b"\x1f\x50" + bytes.fromhex("e04fd020ea3a6910a2d808002b30309d")


def test_shell_items():
    found, warnings = shellitems.items(PC + DRIVE + file_item("LONGNA~1", "long name.txt") + b"\0\0rest")
    assert not warnings and [i["kind"] for i in found] == ["root_folder", "volume", "file_entry"]
    assert shellitems.path_of(found) == ("This PC\\G:\\long name.txt", False)
    f = found[2]
    assert (f["modified_local"], f["created_local"], f["accessed_local"], f["mft_entry"], f["mft_sequence"]) == ("2024-03-04 05:06:08", "2024-03-04 05:06:08", "", 1234, 5)
    assert found[1]["drive_letter"] == "G"
    assert shellitems.items(struct.pack("<H", 99) + b"x")[1] and shellitems.item(b"\x31")["warnings"] and shellitems.item(b"\x41")["warnings"]
    assert [shellitems.item(bytes([k]) + b"\0" * 20)["kind"] for k in (0x61, 0x71, 0x46, 0x2E, 0x00)] == ["uri", "control_panel", "network", "volume", "unknown"]


def test_bags_and_lists():
    top = {"MRUListEx": (BINARY, struct.pack("<3I", 1, 0, 0xFFFFFFFF)), "0": (BINARY, DRIVE), "0": (BINARY, DRIVE)}
    bags = {**top, "1": (BINARY, PC)}
    tree: dict = {**bags}
    tree_key = {"Software": {"Microsoft": {"Windows": {"Shell": {"BagMRU": {**{k: v for k, v in tree.items()}}}}}}}
    bag = tree_key["Software"]["Microsoft"]["Windows"]["Shell"]["BagMRU"]
    # A key and a value may share a name; the builder's dicts can't, so the subkeys get a nested hive of their own.
    rows = list(registry.shell_bags(two_kinds(bag, {"0": two_kinds({"0": (BINARY, file_item("A", "deep"))}, {"0": {}, "7": {}}, raw=True), "1": {}})))
    got = {r["registry_path"].rsplit("BagMRU", 1)[1]: r for r in rows}
    assert (got["\\0"]["path_text"], got["\\0"]["drive_letter"], got["\\0"]["mru_position"], got["\\1"]["mru_position"], got["\\1"]["path_text"]) == ("G:", "G", 1, 0, "This PC")
    assert (got["\\0\\0"]["path_text"], got["\\0\\0"]["drive_letter"], got["\\0\\0"]["depth"], got["\\0\\0"]["mft_entry"]) == ("G:\\deep", "G", 1, 1234)
    assert got["\\0\\7"]["path_has_gap"] and got["\\0\\7"]["warnings"] and got["\\0\\7"]["path_text"] == "G:"
    explorer = {"RecentDocs": {"MRUListEx": (BINARY, struct.pack("<2I", 5, 0xFFFFFFFF)), "5": (BINARY, "ATLAS (F:)\0".encode("utf-16-le") + file_item("A", "ATLAS.lnk") + b"\0\0"), "6": (BINARY, "DVD-RAM Drive (D:)\0".encode("utf-16-le") + b"\0\0")}, "ComDlg32": {"OpenSavePidlMRU": {"txt": {"0": (BINARY, PC + DRIVE + file_item("N", "notes.txt") + b"\0\0")}}, "LastVisitedPidlMRU": {"0": (BINARY, "edit.exe\0".encode("utf-16-le") + DRIVE + b"\0\0")}}}
    lists = {(r["kind"], r["value_name"]): r for r in registry.mru_lists(made_hive({"Software": {"Microsoft": {"Windows": {"CurrentVersion": {"Explorer": explorer}}}}}))}
    a = lists["recent_doc", "5"]
    assert (a["name"], a["drive_letter"], a["letter_from_name"], a["volume_label"], a["position"], a["modified_local"]) == ("ATLAS (F:)", "F", True, "ATLAS", 0, "2024-03-04 05:06:08")
    assert (lists["recent_doc", "6"]["volume_label"], lists["recent_doc", "6"]["position"]) == ("", -1)
    assert (lists["open_save", "0"]["name"], lists["open_save", "0"]["path_text"], lists["open_save", "0"]["drive_letter"]) == ("notes.txt", "This PC\\G:\\notes.txt", "G")
    assert (lists["last_visited", "0"]["name"], lists["last_visited", "0"]["path_text"]) == ("edit.exe", "G:")


class Both(dict):
    """A key whose subkeys may have its values' names."""


def two_kinds(values: dict, subs: dict, raw: bool = False):
    content = Both()
    for n, v in values.items():
        content[n] = v
    for n, s in subs.items():
        content[Name(n)] = s
    return content if raw else made_hive({"Software": {"Microsoft": {"Windows": {"Shell": {"BagMRU": content}}}}})


class Name(str):
    """A name that isn't equal to the same name."""

    def __hash__(self):
        return id(self)

    def __eq__(self, other):
        return self is other


def test_key_lists(spark, tmp_path):
    tree = {"Microsoft": {"Windows Portable Devices": {"Devices": {"SWD#WPDBUSENUM#X": {"FriendlyName": text_value("ATLAS")}}}}}
    (tmp_path / "SOFTWARE").write_bytes(made_hive(tree))
    (row,) = registry.rows_of(binary.files(spark, str(tmp_path)), registry.subkeys_of(registry.PORTABLE), registry.KEYS).collect()
    assert (row.key_name, row.friendly_name, row.problem) == ("SWD#WPDBUSENUM#X", "ATLAS", None)
    data = struct.pack("<IIII", 0, 5, 2, 1000).ljust(60, b"\0") + struct.pack("<Q", NOON) + b"\0" * 4
    tree = {"Software": {"Microsoft": {"Windows": {"CurrentVersion": {"Explorer": {"UserAssist": {"{CAT}": {"Count": {"HRZR": (BINARY, data), "X": (BINARY, b"short")}}}}}}}}}
    got = {r["value_name"]: r["raw_last_executed"] for r in registry.user_assist(made_hive(tree))}
    assert got == {"HRZR": NOON, "X": None}


@pytest.mark.parametrize("content", [b"", b"regf", b"x" * 5000])
def test_no_hive(content):
    with pytest.raises((ValueError, struct.error)):
        hive.Hive(content)


# ------------------------------------------------------------------ prefetch, jump lists, discovery


def packed_bits(codes: list[tuple[int, int]]) -> bytes:
    bits = "".join(f"{code:0{n}b}" for code, n in codes)
    bits += "0" * (-len(bits) % 16) + "0" * 16  # the decoder reads one unit ahead
    return b"".join(struct.pack("<H", int(bits[k : k + 16], 2)) for k in range(0, len(bits), 16))


def folded(data: bytes) -> bytes:
    """Every symbol has a code of nine bits, its own number; runs of one byte become matches."""
    out = b""
    for block in (data[k : k + 65536] for k in range(0, len(data), 65536)):
        codes, at = [], 0
        while at < len(block):
            run = 0
            while 0 < at and run < 17 and at + run < len(block) and block[at + run] == block[at - 1]:
                run += 1
            if run >= 3:
                codes.append((256 + run - 3, 9))  # an offset of one has no bits
                at += run
            else:
                codes.append((block[at], 9))
                at += 1
        out += bytes([0x99]) * 256 + packed_bits(codes)
    return b"MAM\x04" + struct.pack("<I", len(data)) + out


def prefetch_file(version=30, name="SPADE.EXE", metrics=304) -> bytes:
    names = "".join(f"{n}\0" for n in ("\\VOLUME{a}\\X\\SPADE.EXE", "\\VOLUME{b}\\NTDLL.DLL")).encode("utf-16-le")
    device = "\\VOLUME{a}".encode("utf-16-le")
    entry = 96
    block = struct.pack("<IIQI", 2 * entry, 10, NOON, 0x1234ABCD).ljust(entry, b"\0") + struct.pack("<IIQI", 2 * entry, 4, NOON, 1).ljust(entry, b"\0") + device
    b = bytearray(struct.pack("<I4s8s60sI", version, b"SCCA", b"", name.encode("utf-16-le"), 0xBEEF).ljust(304, b"\0"))
    struct.pack_into("<9I", b, 84, metrics, 0, 0, 0, 304, len(names), 304 + len(names), 2, len(block))
    struct.pack_into("<8Q", b, 128, NOON, NOON - 5, 0, 0, 0, 0, 0, 0)
    struct.pack_into("<I", b, 208 if metrics == 304 else 200, 42)
    return bytes(b) + names + block


def test_prefetch(spark, tmp_path):
    from vestige.sources import prefetch

    data = bytes(range(256)) * 3 + b"z" * 500 + bytes(range(200)) * 400
    assert prefetch.unfolded(folded(data)) == data
    for k, content in enumerate((prefetch_file(), folded(prefetch_file()), prefetch_file(metrics=296), prefetch_file(version=99), b"MAM\x04" + b"\0" * 400, b"x")):
        (tmp_path / f"{k}.pf").write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in registry.rows_of(binary.files(spark, str(tmp_path), "*.pf"), prefetch.run, prefetch.RUN).collect()}
    for name in ("0.pf", "1.pf", "2.pf"):
        r = got[name]
        assert (r.executable, r.executable_path, r.run_count, r.times_recorded, list(r.raw_run_times), r.volume_count, r.file_count) == ("SPADE.EXE", "\\VOLUME{a}\\X\\SPADE.EXE", 42, 2, [NOON, NOON - 5], 1, 2)
        assert (r.volumes[0].device_path, r.volumes[0].volume_serial_hex) == ("\\VOLUME{a}", "1234-ABCD") and "volume 2" in r.parse_warnings
    assert "99" in got["3.pf"].parse_warnings and got["4.pf"].problem and got["5.pf"].problem


def link_bytes(name: str) -> bytes:
    head = struct.pack("<I16sIIQQQI", 76, bytes.fromhex("0114020000000000c000000000000046"), 2, 0, 1, 2, 3, 99).ljust(76, b"\0")
    path = name.encode() + b"\0"
    return head + struct.pack("<7I", 28 + len(path) + 1, 28, 2, 0, 28, 0, 28 + len(path)) + path + b"\0"


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of version 3; every stream lies in the small one."""
    small, container, starts = [], b"", {}
    for name, data in streams.items():
        starts[name] = len(small)
        count = -(-len(data) // 64)
        small += [*range(len(small) + 1, len(small) + count), 0xFFFFFFFE]
        container += data.ljust(64 * count, b"\0")
    names = ["Root Entry", *streams]
    entry = lambda n, kind, start, size: n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, kind).ljust(52, b"\0") + struct.pack("<IQ", start, size)
    sectors = lambda b: -(-len(b) // 512)
    small_table = struct.pack(f"<{len(small)}I", *small)
    directory_size = -(-len(names) * 128 // 512)
    layout = {"fat": 0, "dir": 1, "small": 1 + directory_size, "data": 1 + directory_size + sectors(small_table)}
    directory = entry(names[0], 5, layout["data"], len(container)) + b"".join(entry(n, 2, starts[n], len(streams[n])) for n in streams)
    fat = [0xFFFFFFFD]
    for n in (directory_size, sectors(small_table), sectors(container)):
        fat += [*range(len(fat) + 1, len(fat) + n), 0xFFFFFFFE]
    head = bytearray(512)
    head[:8] = bytes.fromhex("d0cf11e0a1b11ae1")
    struct.pack_into("<HHHHH", head, 24, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<IIIIIIII", head, 44, 1, layout["dir"], 0, 4096, layout["small"], sectors(small_table), 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *([0xFFFFFFFF] * 108))
    pad = lambda b, fill=b"\0": b.ljust(512 * sectors(b), fill)
    return bytes(head) + pad(struct.pack(f"<{len(fat)}I", *fat), b"\xff") + pad(directory) + pad(small_table, b"\xff") + pad(container)


def dest(number: int, path: str, pinned: bool, count: int) -> bytes:
    b = bytearray(0x80)
    b[0x48:0x4D] = b"HOST1"
    struct.pack_into("<IIfQi", b, 0x58, number, 0, 1.5, NOON + number, 0 if pinned else -1)
    struct.pack_into("<I", b, 0x74, count)
    return bytes(b) + struct.pack("<H", len(path)) + path.encode("utf-16-le") + b"\0" * 4


def test_jump_lists():
    from vestige.sources import jumplists

    listed = struct.pack("<II", 4, 2).ljust(32, b"\0") + dest(10, "E:\\b.txt", True, 3) + dest(1, "E:\\a.txt", False, 9)
    b = compound({"1": link_bytes("E:\\a.txt"), "a": link_bytes("E:\\b.txt"), "2": link_bytes("E:\\c.txt"), "DestList": listed, "other": b"x"})
    rows = list(jumplists.entries(b, "/x/5F7B.automaticDestinations-ms"))
    assert [(r["stream_name"], r["target_path"], r.get("mru_position"), r.get("pinned"), r.get("access_count"), r["destlist_present"]) for r in rows] == [("2", "E:\\c.txt", None, None, None, False), ("a", "E:\\b.txt", 1, True, 3, True), ("1", "E:\\a.txt", 2, False, 9, True)]
    assert {r["app_id"] for r in rows} == {"5f7b"} and rows[1]["machine_id"] == "HOST1" and rows[1]["raw_last_access"] == NOON + 10
    old = struct.pack("<II", 1, 1).ljust(32, b"\0") + dest(1, "E:\\a.txt", True, 9)
    (row,) = jumplists.entries(compound({"1": link_bytes("E:\\a.txt"), "DestList": old}), "x.automaticDestinations-ms")
    assert row["access_count"] is None and row["pinned"] is None and "legacy" in row["warnings"]
    custom = list(jumplists.entries(b"head" + link_bytes("E:\\a.txt") + b"gap" + link_bytes("E:\\b.txt"), "y.customDestinations-ms"))
    assert [(r["stream_name"], r["target_path"]) for r in custom] == [("link_0", "E:\\a.txt"), ("link_1", "E:\\b.txt")]
    with pytest.raises(ValueError):
        list(jumplists.entries(b"nothing", "x.automaticDestinations-ms"))


def test_discovery(spark, tmp_path):
    from vestige.sources import evidence

    v = tmp_path / "in" / "uploads" / "auto" / "C%3A"
    for f in ("Windows/System32/config/system", "Windows/System32/config/SYSTEM.LOG1", "Users/ann/ntuser.dat", "Users/ann/NTUSER.DAT.LOG2", "Users/ann/AppData/Roaming/Microsoft/Windows/Recent/AutomaticDestinations/5f.automaticDestinations-ms", "Users/ann/Desktop/a.LNK", "Windows/INF/setupapi.dev.log", "Windows/INF/setupapi.dev.2024.log", "Windows/Prefetch/A.pf", "Windows/Prefetch/b.txt", "Users/bob/NTUSER.DAT", "Users/bob/ntuser.dat"):
        (v / f).parent.mkdir(parents=True, exist_ok=True)
        (v / f).write_text("x")
    (tmp_path / "out.lnk").write_text("x")
    (v / "Users/ann/Desktop/escape.lnk").symlink_to(tmp_path / "out.lnk")
    found = evidence.locate(str(tmp_path / "in"))
    got = {(a[0], a[1].rsplit("/", 1)[1], a[3], a[4], a[5], len(a[6])) for a in found.artefacts}
    assert got == {("SYSTEM", "system", "C", "", "", 1), ("NTUSER", "ntuser.dat", "C", "ann", "", 1), ("JUMPLIST", "5f.automaticDestinations-ms", "C", "ann", "recent", 0), ("LNK", "a.LNK", "C", "ann", "desktop", 0), ("SETUPAPI", "setupapi.dev.log", "C", "", "", 0), ("SETUPAPI_ROTATED", "setupapi.dev.2024.log", "C", "", "", 0), ("PREFETCH", "A.pf", "C", "", "", 0)}
    assert [f[0] for f in found.failures] == ["LNK"] and len(found.collisions) == 1 and {m.split(" ")[0] for m in found.missing} == {"SOFTWARE", "EVTX"}
    artefacts, problems = found.tables(spark)
    assert artefacts.count() == 7 and problems.where("severity = 'failed'").count() == 1
    assert [evidence.letter_of(x) for x in ("C", "d:", "%5C%5C.%5CE%3A", "data")] == ["C", "D", "E", ""]
    with pytest.raises(ValueError):
        evidence.locate(str(tmp_path / "in" / "uploads"))
    with pytest.raises(ValueError):
        evidence.Boundary(str(tmp_path / "in")).refuse_write(str(v / "new"))
    evidence.Boundary(str(tmp_path / "in")).refuse_write(str(tmp_path / "elsewhere"))


def test_links_with_items_wide_paths_and_shares():
    head = lambda flags: struct.pack("<I16sIIQQQI", 76, bytes.fromhex("0114020000000000c000000000000046"), flags, 0, 1, 2, 3, 99).ljust(76, b"\0")
    listed = PC + DRIVE + file_item("N", "notes.txt") + b"\0\0"
    wide = "G:\\é.txt\0".encode("utf-16-le")
    info = struct.pack("<9I", 36 + 1 + len(wide) + 2, 36, 1, 0, 36, 0, 36, 37, 37 + len(wide)) + b"\0" + wide + b"\0\0"
    got = binary.link(head(3) + struct.pack("<H", len(listed)) + listed + info)
    assert (got["target_item_path"], got["target_item_modified_local"], got["mft_entry"], got["target_path"]) == ("This PC\\G:\\notes.txt", "2024-03-04 05:06:08", 1234, "G:\\é.txt")
    share = struct.pack("<5I", 40, 2, 20, 0, 0) + b"\\\\srv\\files\0".ljust(20, b"\0")
    info = struct.pack("<7I", 28 + len(share) + 5, 28, 2, 0, 0, 28, 28 + len(share)) + share + b"a.b\0\0"
    got = binary.link(head(2) + info)
    assert (got["network_path"], got["target_path"], got["removable"]) == ("\\\\srv\\files", "\\\\srv\\files\\a.b", False)


# ------------------------------------------------------------------ event logs


class Xml:
    """Binary XML with one template a record, its names and values in place."""

    def __init__(self):
        self.b = bytearray(512)

    def name(self, text: str) -> None:
        at = len(self.b) + 4
        self.b += struct.pack("<I", at) + struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def element(self, name: str, attributes: dict[str, int | str], content: list) -> None:
        """content: numbers of values, texts, or (name, attributes, content)."""
        self.b += bytes([0x41 if attributes else 0x01]) + struct.pack("<HI", 0xFFFF, 0)
        self.name(name)
        if attributes:
            at = len(self.b)
            self.b += b"\0\0\0\0"
            for k, v in attributes.items():
                self.b += b"\x06"
                self.name(k)
                self.leaf(v)
            struct.pack_into("<I", self.b, at, len(self.b) - at - 4)
        if not content:
            self.b += b"\x03"
            return
        self.b += b"\x02"
        for c in content:
            self.element(*c) if isinstance(c, tuple) else self.leaf(c)
        self.b += b"\x04"

    def leaf(self, v: int | str) -> None:
        self.b += b"\x05\x01" + struct.pack("<H", len(v)) + v.encode("utf-16-le") if isinstance(v, str) else b"\x0e" + struct.pack("<HB", v, 1)

    def record(self, number: int, raw: int, tree: tuple, values: list[tuple[int, bytes]]) -> None:
        begin = len(self.b)
        self.b += b"**\0\0" + struct.pack("<IQQ", 0, number, raw) + b"\x0f\1\1\0" + b"\x0c\1" + struct.pack("<I", 0)
        where = len(self.b) + 4
        self.b += struct.pack("<I", where) + struct.pack("<I16sI", 0, b"", 0)
        at = len(self.b)
        self.b += b"\x0f\1\1\0"
        self.element(*tree)
        self.b += b"\0"
        struct.pack_into("<I", self.b, where + 20, len(self.b) - at)
        self.b += struct.pack("<I", len(values)) + b"".join(struct.pack("<HBB", len(v), k, 0) for k, v in values) + b"".join(v for _, v in values)
        size = len(self.b) - begin + 4
        self.b += struct.pack("<I", size)
        struct.pack_into("<I", self.b, begin + 4, size)

    def chunk(self) -> bytes:
        self.b[:8] = b"ElfChnk\0"
        struct.pack_into("<I", self.b, 48, len(self.b))
        return bytes(self.b).ljust(65536, b"\0")


def wide(t: str) -> tuple[int, bytes]:
    return 1, t.encode("utf-16-le")


def an_event(x: Xml, number: int, channel: str, provider: str, event: int, data: dict[str, tuple[int, bytes]], raw=NOON) -> None:
    system = ("System", {}, [("Provider", {"Name": provider}, []), ("EventID", {}, [0]), ("Channel", {}, [channel]), ("EventRecordID", {}, [1])])
    tree = ("Event", {"xmlns": "urn:x"}, [system, ("EventData", {}, [("Data", {"Name": k}, [n + 2]) for n, k in enumerate(data)])])
    x.record(number, raw, tree, [(6, struct.pack("<H", event)), (10, struct.pack("<Q", number)), *data.values()])


def test_event_logs(spark, tmp_path):
    from vestige.sources import events, evtx

    partition = "Microsoft-Windows-Partition/Diagnostic"
    slot = struct.pack("<iiqqIi", 0, 0, 1048576, 5000, 1, 0) + bytes([7]) + b"\0" * 111
    table = struct.pack("<III", 0, 1, 0xABCD).ljust(48, b"\0") + slot
    sector = bytearray(512)
    sector[440:444], sector[510:] = struct.pack("<I", 77), b"\x55\xaa"
    x = Xml()
    an_event(x, 1, partition, "P", 1006, {"ParentId": wide("USB\\VID_1&PID_2\\S1"), "Capacity": (10, struct.pack("<Q", 512000)), "DiskNumber": (8, struct.pack("<I", 3)), "BusType": (8, struct.pack("<I", 7)), "Mbr": (14, bytes(sector)), "PartitionTable": (14, table)})
    an_event(x, 2, partition, "P", 1006, {"ParentId": wide("PCI\\VEN_1"), "BusType": (8, struct.pack("<I", 17))})
    an_event(x, 3, partition, "P", 9999, {"A": wide("b")})
    y = Xml()
    an_event(y, 4, "System", "EventLog", 6005, {"Flag": (13, b"\1\0\0\0"), "Guid": (15, bytes(range(16))), "Sid": (19, bytes([1, 1, 0, 0, 0, 0, 0, 5]) + struct.pack("<I", 18)), "List": (0x81, "a\0b\0".encode("utf-16-le")), "Hex": (20, b"\x10\0\0\0"), "Time": (17, struct.pack("<Q", NOON)), "None": (0, b"")})
    an_event(y, 5, "System", "Else", 6005, {})
    an_event(y, 6, "System", "Microsoft-Windows-Ntfs", 98, {})
    z = Xml()
    for n, code in ((7, "45"), (8, "10")):
        an_event(z, n, "Microsoft-Windows-Kernel-PnP/Configuration", "K", 420, {"DeviceInstanceId": wide("USBSTOR\\DISK&VEN_Q\\Z&0"), "Problem": (8, struct.pack("<I", int(code)))})
    broken = bytearray(z.chunk())
    broken[512 + 28] = 0x7E  # a token of the first record that there isn't
    head = b"ElfFile\0".ljust(4096, b"\0")
    for name, content in (("Microsoft-Windows-Partition%4Diagnostic.evtx", head + x.chunk() + b"junk".ljust(65536, b"\0")), ("System.evtx", head + y.chunk()), ("Microsoft-Windows-Kernel-PnP%4Configuration.evtx", head + z.chunk()), ("Security.evtx", b"not opened"), ("Application.evtx", b"not opened"), ("Microsoft-Windows-Ntfs%4Operational.evtx", b"no log")):
        (tmp_path / name).write_bytes(content)
    fields = dict(next(iter(evtx.records(y.chunk())))[2])
    assert fields["Event.EventData.Flag"] == "true" and fields["Event.EventData.Guid"] == "{03020100-0504-0706-0809-0a0b0c0d0e0f}" and fields["Event.EventData.Sid"] == "S-1-5-18" and fields["Event.EventData.List"] == "a, b" and fields["Event.EventData.Hex"] == "0x10"
    assert fields["Event.EventData.Time"].startswith("2024-01-17 21:20:00") and fields["Event.System.Provider@Name"] == "EventLog" and fields["Event.System.EventID"] == "6005" and "Event.EventData.None" not in fields
    assert [f is None for _, _, f in evtx.records(bytes(broken))] == [True, False]

    found = events.scanned(events.logs(spark, str(tmp_path))).cache()
    got = {r.record_id: r for r in found.collect() if r.record_id}
    assert {k: (r.outcome, r.kind) for k, r in got.items()} == {1: ("kept", "inventory"), 2: ("no usb device", None), 3: ("no rule", None), 4: ("kept", "session"), 5: ("no rule", None), 6: ("excluded: corruption state without a device identity", None), 7: ("kept", "disconnect"), 8: ("kept", "fault")}
    assert got[4].rule_id == "System:EventLog:6005" and got[7].device_instance_id == "USBSTOR\\DISK&VEN_Q\\Z&0"
    e = {r.record_id: r for r in events.event_table(found).collect()}
    assert (e[1].time_utc, e[1].device_key) == (datetime(2024, 1, 17, 21, 20), "USB\\VID_1&PID_2\\S1") and set(e) == {1, 4, 7, 8}
    assert {(r.role, r.value) for r in events.field_table(found).where("record_id = 7").collect()} == {("device_instance_id", "USBSTOR\\DISK&VEN_Q\\Z&0"), ("problem_code", "45")}
    counts = {(r.path.rsplit("/", 1)[1], r.outcome): r.records for r in events.outcomes(found).collect()}
    assert counts["Microsoft-Windows-Ntfs%4Operational.evtx", "unreadable log"] == 1 and not any(k[0].startswith(("Security", "Application")) for k in counts)
    (disk,) = events.disks(found).collect()
    assert (disk.disk_number, disk.capacity, disk.style, disk.disk_signature, disk.boot_record_signature, len(disk.partitions), disk.device_key) == ("3", "512000", "MBR", 0xABCD, 77, 1, "USB\\VID_1&PID_2\\S1")
    assert events.wanted("x/Security.evtx", ("Security",)) and not events.wanted("x/Security.evtx")
    listed = events.catalogue(spark)
    assert (listed.where("excluded = ''").count(), listed.where("excluded <> ''").count()) == (40, 9)
