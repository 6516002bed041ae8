"""What hives say of devices, volumes and their users, as rows of the evidence tables.

A hive is decoded on an executor; each reader gives rows of one table. What a file doesn't hold gives no row; a file
that can't be read gives one of the problems' rows."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vestige.functions import macros as m
from vestige.sources.hive import Hive, Key, shown
from vestige.sources.shellitems import item, items, path_of

# The enumerators that are walked; the property set of a device's dates; where bags and lists lie.
ENUMERATORS = ("USB", "USBSTOR", "USBPRINT", "SCSI", "STORAGE", "HID", "WPDBUSENUM", "SWD", "BTHENUM", "BTHLEDEVICE")
_DATES = "{83da6326-97a6-4088-9453-a1923f573b29}"
_DATE_IDS = {100: "raw_install_date", 101: "raw_first_install_date", 102: "raw_last_arrival_date", 103: "raw_last_removal_date"}
_TEXTS = {"device_desc": "DeviceDesc", "friendly_name": "FriendlyName", "mfg": "Mfg", "class": "Class", "class_guid": "ClassGUID", "service": "Service", "container_id": "ContainerID", "parent_id_prefix": "ParentIdPrefix", "hardware_id": "HardwareID", "compatible_ids": "CompatibleIDs", "location_information": "LocationInformation", "bus_reported_desc": "BusReportedDeviceDesc"}
BAGS = {"UsrClass": ("Local Settings\\Software\\Microsoft\\Windows\\Shell\\BagMRU",), "NTUSER": ("Software\\Microsoft\\Windows\\Shell\\BagMRU", "Software\\Microsoft\\Windows\\ShellNoRoam\\BagMRU")}
_EXPLORER = "Software\\Microsoft\\Windows\\CurrentVersion\\Explorer"
DEEPEST = 64
CAPTIONS = ("local disk", "removable disk", "usb drive", "network drive", "floppy disk drive", "cd drive", "cd-rw drive", "dvd drive", "dvd rw drive", "dvd-ram drive", "bd-rom drive", "blu-ray drive")
PREFETCH = {0: "prefetching was disabled", 1: "application launches", 2: "boot only", 3: "application launches and boot"}


def rows_of(files: DataFrame, read: Callable[[bytes, str], Iterator[dict]], schema: str) -> DataFrame:
    """path and the reader's rows of each file (path, content); a file that can't be read gives one row whose only
    field is `problem`, which is null elsewhere."""
    names = StructType.fromDDL(schema).fieldNames()

    def each(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = []
                try:
                    rows += [(path, None, *(row.get(n) for n in names)) for row in read(bytes(content), path)]
                except (struct.error, IndexError, ValueError, UnicodeError, RecursionError) as e:
                    rows.append((path, f"not decoded: {e}", *([None] * len(names))))
                yield pd.DataFrame(rows, columns=["path", "problem", *names]).astype(object)

    return files.select("path", "content").mapInPandas(each, f"path string, problem string, {schema}")


def control_sets(hive: Hive) -> tuple[list[str], str]:
    """All control sets, and the one that is current (the only one, where the hive doesn't say)."""
    names = [k.name for k in hive.root.subkeys if re.fullmatch(r"(?i)ControlSet\d{3}", k.name)]
    select = hive.root.sub("Select")
    current = select.number("Current") if select else None
    return names, f"ControlSet{current:03d}" if current else names[0] if len(names) == 1 else ""


def properties(instance: Key) -> Iterator[tuple[str, int, bytes]]:
    """(set, id, data) of a device's stored properties."""
    for group in (p.subkeys for p in [instance.sub("Properties")] if p):
        for one in group:
            for key in one.subkeys:
                if re.fullmatch(r"[0-9a-fA-F]{1,8}", key.name):
                    for _, (_, data) in key.named_values():
                        if data:
                            yield one.name.lower(), int(key.name, 16), data


DEVNODE = "control_set string, enumerator string, device_id string, instance_id string, normalised_instance_id string, registry_key string, raw_key_last_write long, " + ", ".join(f"{c} string" for c in _TEXTS) + ", " + ", ".join(f"{c} long" for c in _DATE_IDS.values())


def devnodes(content: bytes, path: str = "") -> Iterator[dict]:
    """A row for each device instance below Enum of each control set."""
    hive = Hive(content)
    for control_set in control_sets(hive)[0]:
        for enumerator in ENUMERATORS:
            key = hive.root.at(f"{control_set}\\Enum\\{enumerator}")
            for device in key.subkeys if key else ():
                for instance in device.subkeys:
                    dates = {_DATE_IDS[i]: int.from_bytes(data[:8], "little") for s, i, data in properties(instance) if s == _DATES and i in _DATE_IDS and len(data) >= 8}
                    whole = f"{enumerator}\\{device.name}\\{instance.name}"
                    yield {
                        "control_set": control_set, "enumerator": enumerator, "device_id": device.name, "instance_id": instance.name, "normalised_instance_id": whole, "registry_key": f"{control_set}\\Enum\\{whole}", "raw_key_last_write": instance.written,
                        **{c: instance.text(v) for c, v in _TEXTS.items()}, **dates,
                    }


def devnode_table(files: DataFrame) -> DataFrame:
    """devnode rows with keys and times."""
    d = rows_of(files, devnodes, DEVNODE)
    times = {c.replace("raw_", "") + "_utc": m.filetime(F.col(c)) for c in ("raw_key_last_write", *_DATE_IDS.values())}
    return d.withColumn("device_key", m.device_key(F.col("normalised_instance_id"))).withColumns(times)


ZONE = "registry_key string, control_set string, key_name string, standard_name string, daylight_name string, bias_minutes int, standard_bias_minutes int, daylight_bias_minutes int, active_bias_minutes int, standard_start_month int, daylight_start_month int, dynamic_daylight_disabled boolean"


def time_zone(content: bytes, path: str = "") -> Iterator[dict]:
    hive = Hive(content)
    current = control_sets(hive)[1]
    if key := hive.root.at(f"{current}\\Control\\TimeZoneInformation"):
        signed = lambda n: struct.unpack("<i", struct.pack("<I", (key.number(n) or 0) & 0xFFFFFFFF))[0]
        month = lambda n: struct.unpack_from("<H", key.raw(n), 2)[0] if len(key.raw(n)) >= 4 else 0
        yield {
            "registry_key": f"{current}\\Control\\TimeZoneInformation", "control_set": current, "key_name": key.text("TimeZoneKeyName"), "standard_name": key.text("StandardName"), "daylight_name": key.text("DaylightName"), "bias_minutes": signed("Bias"), "standard_bias_minutes": signed("StandardBias"),
            "daylight_bias_minutes": signed("DaylightBias"), "active_bias_minutes": signed("ActiveTimeBias"), "standard_start_month": month("StandardStart"), "daylight_start_month": month("DaylightStart"), "dynamic_daylight_disabled": bool(key.number("DynamicDaylightTimeDisabled")),
        }


PREFETCH_SETTING = "registry_key string, control_set string, value_found boolean, raw_value long, description string"


def prefetch_setting(content: bytes, path: str = "") -> Iterator[dict]:
    hive = Hive(content)
    current = control_sets(hive)[1]
    where = f"{current}\\Control\\Session Manager\\Memory Management\\PrefetchParameters"
    value = key.number("EnablePrefetcher") if (key := hive.root.at(where)) else None
    yield {"registry_key": where, "control_set": current, "value_found": value is not None, "raw_value": value, "description": "not set" if value is None else PREFETCH.get(value, "unrecognised")}


MOUNTED = "value_name string, hex string"


def mounted_devices(content: bytes, path: str = "") -> Iterator[dict]:
    """The values of MountedDevices; sources.text.mounted reads them."""
    if key := Hive(content).root.sub("MountedDevices"):
        yield from ({"value_name": name, "hex": data.hex()} for name, (_, data) in key.named_values())


KEYS = "registry_path string, key_name string, friendly_name string, raw_key_last_write long"


def subkeys_of(where: str) -> Callable[[bytes, str], Iterator[dict]]:
    """A reader of the keys below a key: portable devices, EMDMgmt, MountPoints2."""

    def read(content: bytes, path: str = "") -> Iterator[dict]:
        if key := Hive(content).root.at(where):
            yield from ({"registry_path": f"{where}\\{k.name}", "key_name": k.name, "friendly_name": k.text("FriendlyName"), "raw_key_last_write": k.written} for k in key.subkeys)

    return read


PORTABLE, EMDMGMT, MOUNT_POINTS = "Microsoft\\Windows Portable Devices\\Devices", "Microsoft\\Windows NT\\CurrentVersion\\EMDMgmt", f"{_EXPLORER}\\MountPoints2"
LAUNCHES = "category string, value_name string, hex string, raw_last_executed long, registry_path string"


def user_assist(content: bytes, path: str = "") -> Iterator[dict]:
    """The values below UserAssist with the raw time of the last launch; sources.text.launch_records reads the rest."""
    root = Hive(content).root.at(f"{_EXPLORER}\\UserAssist")
    for category in root.subkeys if root else ():
        for name, (_, data) in category.sub("Count").named_values() if category.sub("Count") else ():
            raw = struct.unpack_from("<Q", data, 60)[0] if len(data) >= 72 else None
            yield {"category": category.name, "value_name": name, "hex": data.hex(), "raw_last_executed": raw, "registry_path": f"{_EXPLORER}\\UserAssist\\{category.name}\\Count"}


BAG = "hive string, path_text string, path_has_gap boolean, name string, kind string, drive_letter string, depth int, node_slot long, mru_position int, raw_modified long, modified_local string, created_local string, accessed_local string, mft_entry long, mft_sequence long, registry_path string, raw_key_last_write long, raw string, warnings string"


def _order(key: Key) -> dict[str, int]:
    raw = key.raw("MRUListEx")
    numbers = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    return {str(n): k for k, n in reversed(list(enumerate(numbers))) if n != 0xFFFFFFFF}


def shell_bags(content: bytes, path: str = "") -> Iterator[dict]:
    """A row for each bag: its item's name appended to its parent's path; a bag without a name leaves a gap."""
    hive = Hive(content)
    for kind, roots in BAGS.items():
        for where in roots:
            waiting = [(hive.root.at(where), where, "", "", 0)]
            while waiting:
                key, at, above, letter, depth = waiting.pop()
                if key is None:
                    continue
                if depth > DEEPEST:
                    yield {"hive": kind, "path_text": above, "depth": depth, "mru_position": -1, "registry_path": at, "warnings": f"the bag tree is deeper than {DEEPEST} levels and was not followed further"}
                    continue
                order = _order(key)
                for bag in key.subkeys:
                    if not bag.name.isdecimal():
                        continue
                    raw = key.raw(bag.name)
                    found = item(raw[2 : struct.unpack_from("<H", raw)[0]]) if len(raw) >= 3 else {"name": "", "warnings": ["no shell item is stored for this bag, so its own name is not known"]}
                    name = found["name"].removesuffix("\\")
                    here = "\\".join(p for p in (above, name) if p)
                    own = found.get("drive_letter") or letter
                    yield {
                        **{k: v for k, v in found.items() if k not in ("guid", "warnings")}, "hive": kind, "path_text": here, "path_has_gap": not name, "drive_letter": own, "depth": depth, "node_slot": bag.number("NodeSlot"), "mru_position": order.get(bag.name, -1), "registry_path": f"{at}\\{bag.name}",
                        "raw_key_last_write": bag.written, "raw": raw.hex(), "warnings": "; ".join(found["warnings"]),
                    }
                    waiting.append((bag, f"{at}\\{bag.name}", here, own, depth + 1))


MRU = "source_list string, kind string, name string, path_text string, path_has_gap boolean, drive_letter string, letter_from_name boolean, volume_label string, position int, value_name string, raw_modified long, modified_local string, registry_path string, raw_key_last_write long, raw string, warnings string"


def _listed(kind: str, data: bytes) -> dict:
    name, rest = "", data
    if kind != "open_save":
        end = next((k for k in range(0, len(data) - 1, 2) if data[k : k + 2] == b"\0\0"), len(data))
        name, rest = data[:end].decode("utf-16-le", "replace"), data[end + 2 :]
    found, warnings = items(rest)
    path, gap = path_of(found)
    last = found[-1] if found else {}
    letter = next((i["drive_letter"] for i in found if i["drive_letter"]), "")
    out = {"name": name or path.rsplit("\\", 1)[-1], "path_text": path if kind != "recent_doc" else "", "path_has_gap": gap, "drive_letter": letter, "letter_from_name": False, "volume_label": "", "raw_modified": last.get("raw_modified"), "modified_local": last.get("modified_local", ""), "warnings": "; ".join([*warnings, *last.get("warnings", ())])}
    if kind == "recent_doc" and not letter and (caption := re.fullmatch(r"(.*?) ?\(([A-Za-z]):\)", name)):
        label = caption[1].strip()
        out |= {"drive_letter": caption[2].upper(), "letter_from_name": True, "volume_label": "" if label.lower() in CAPTIONS else label}
    return out


def mru_lists(content: bytes, path: str = "") -> Iterator[dict]:
    """Recent documents and the file dialogues' lists, each with its place in the list (-1: not listed)."""
    root = Hive(content).root
    dialogues = f"{_EXPLORER}\\ComDlg32"
    for where, kind in ((f"{_EXPLORER}\\RecentDocs", "recent_doc"), (f"{dialogues}\\OpenSavePidlMRU", "open_save"), (f"{dialogues}\\LastVisitedPidlMRU", "last_visited"), (f"{dialogues}\\LastVisitedPidlMRULegacy", "last_visited")):
        top = root.at(where)
        for key, at in [(top, where), *((k, f"{where}\\{k.name}") for k in top.subkeys)] if top else ():
            order = _order(key)
            for name, (_, data) in key.named_values():
                if name.lower() != "mrulistex" and data:
                    yield {"source_list": at.rsplit("\\", 1)[-1], "kind": kind, **_listed(kind, data), "position": order.get(name, -1), "value_name": name, "registry_path": at, "raw_key_last_write": key.written, "raw": data.hex()}


def texts(key: Key) -> dict[str, str]:
    """All texts of a key by name."""
    return {name: shown(kind, data) for name, (kind, data) in key.named_values()}
