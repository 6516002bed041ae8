"""Shell items: what a shell folder's binary names say."""

from __future__ import annotations

import struct

from vestige.sources.binary import guid

# Folders by class id.
FOLDERS = {
    "{20d04fe0-3aea-1069-a2d8-08002b30309d}": "This PC", "{208d2c60-3aea-1069-a2d7-08002b30309d}": "Network", "{21ec2020-3aea-1069-a2dd-08002b30309d}": "Control Panel", "{450d8fba-ad25-11d0-98a8-0800361b1103}": "My Documents",
    "{645ff040-5081-101b-9f08-00aa002f954e}": "Recycle Bin", "{59031a47-3f72-44a7-89c5-5595fe6b30ee}": "Users Files", "{031e4825-7b94-4dc3-b131-e946b44c8dd5}": "Libraries", "{b4bfcc3a-db2c-424c-b029-7fe99a87c641}": "Desktop",
    "{f02c1a0d-be21-4350-88b0-7367fc96ef3c}": "Network Places", "{679f85cb-0220-4080-b29b-5540cc05aab6}": "Quick Access", "{d3162b92-9365-467a-956b-92703aca08af}": "Documents", "{088e3905-0323-4b02-9826-5d99428e115f}": "Downloads",
    "{24ad3ad4-a569-4530-98e1-ab02f9417aa8}": "Pictures", "{f86fa3ab-70d2-4fc7-9c99-fcbf05467f3a}": "Videos", "{3dfdf296-dbec-4fb4-81d1-6a3438bcf4de}": "Music", "{5e6c858f-0e22-4760-9afe-ea3317b67173}": "User Profile",
}
_EXTENSION = 0xBEEF0004


def dos_local(raw: int) -> str:
    """A DOS date and time as `YYYY-MM-DD HH:MM:SS`, empty where it is none."""
    from datetime import datetime

    day, clock = raw & 0xFFFF, raw >> 16
    try:
        return datetime(1980 + (day >> 9), day >> 5 & 15, day & 31, clock >> 11, clock >> 5 & 63, (clock & 31) * 2).isoformat(" ")
    except ValueError:
        return ""


def _zero_ended(b: bytes, at: int) -> tuple[str, int]:
    end = b.find(b"\0", at)
    end = len(b) if end < 0 else end
    return b[at:end].decode("latin-1"), end + 1


def _wide(b: bytes, at: int) -> tuple[str, int]:
    end = at
    while end + 1 < len(b) and b[end : end + 2] != b"\0\0":
        end += 2
    return b[at:end].decode("utf-16-le", "replace"), end + 2


def item(body: bytes) -> dict:
    """One item without its size: kind, name, drive_letter, guid, local times, file reference, warnings."""
    out: dict = {"kind": "unknown", "name": "", "drive_letter": "", "guid": "", "modified_local": "", "created_local": "", "accessed_local": "", "raw_modified": None, "mft_entry": None, "mft_sequence": None, "warnings": []}
    kind = body[0] if body else 0

    def folder(at: int) -> None:
        out["guid"] = guid(body[at : at + 16])
        out["name"] = FOLDERS.get(out["guid"], out["guid"])

    if kind == 0x1F:
        out["kind"] = "root_folder"
        folder(2) if len(body) >= 18 else out["warnings"].append("root folder item is too short to hold a class identifier")
    elif kind == 0x2F:
        out["kind"], out["name"] = "volume", _zero_ended(body, 1)[0]
        if out["name"][1:2] == ":":
            out["drive_letter"] = out["name"][0].upper()
    elif kind & 0xF0 == 0x20:
        out["kind"] = "volume"
        if len(body) >= 17:
            folder(1)
    elif kind & 0x70 == 0x30:
        out["kind"] = "file_entry"
        _file(body, kind, out)
    elif kind & 0xF0 == 0x40:
        out["kind"] = "network"
        if len(body) < 6:
            out["warnings"].append("network item is too short to hold a location")
        else:
            out["name"] = _zero_ended(body, 5)[0]
    elif kind & 0xF0 in (0x60, 0x70):
        out["kind"] = "uri" if kind & 0xF0 == 0x60 else "control_panel"
    return out


def _file(body: bytes, kind: int, out: dict) -> None:
    if len(body) < 13:
        out["warnings"].append("file entry is too short to hold its fixed fields")
        return
    out["raw_modified"] = struct.unpack_from("<I", body, 6)[0]
    out["modified_local"] = dos_local(out["raw_modified"])
    out["name"], end = _wide(body, 12) if kind & 4 else _zero_ended(body, 12)
    # The last two bytes say where the extension lies; else it follows the name, evenly aligned.
    for at in (struct.unpack_from("<H", body, len(body) - 2)[0] - 2, end + end % 2):
        if 0 <= at and at + 8 <= len(body) and struct.unpack_from("<I", body, at + 4)[0] == _EXTENSION:
            break
    else:
        return
    block = body[at:]
    version = struct.unpack_from("<H", block, 2)[0]
    name_at = (36 if version >= 7 else 18) + (2 if version >= 3 else 0)
    if len(block) < min(name_at, 36 if version >= 7 else 18):
        out["warnings"].append("extension block is too short to hold its fixed fields")
        return
    out["created_local"], out["accessed_local"] = (dos_local(x) for x in struct.unpack_from("<II", block, 8))
    if version >= 7:
        reference = struct.unpack_from("<Q", block, 20)[0]
        out["mft_entry"], out["mft_sequence"] = reference & (1 << 48) - 1, reference >> 48
    if long := _wide(block, name_at)[0]:
        out["name"] = long


def items(b: bytes) -> tuple[list[dict], list[str]]:
    """The items of a list up to its end, and what is wrong with it."""
    out, at = [], 0
    while at + 2 <= len(b):
        size = struct.unpack_from("<H", b, at)[0]
        if size == 0:
            break
        if size < 3 or at + size > len(b):
            return out, [f"item {len(out)} declares {size} bytes with {len(b) - at} left in the list"]
        out.append(item(b[at + 2 : at + size]))
        at += size
    return out, []


def path_of(found: list[dict]) -> tuple[str, bool]:
    """The path, and whether an item on it has no name."""
    return "\\".join(i["name"].removesuffix("\\") for i in found if i["name"]), any(not i["name"] for i in found)
