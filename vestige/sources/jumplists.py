"""Jump lists: the links in a compound file with the list that orders them, or one after another."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from vestige.sources.binary import LINK, link

ENTRY = "origin string, app_id string, stream_name string, destlist_present boolean, entry_number long, mru_position int, access_count long, destlist_ranking_value double, pinned boolean, recorded_path string, raw_last_access long, " + LINK
_FREE = 0xFFFFFFFA
#: Bytes of a stream at most.
MOST = 64 << 20
_LINK_HEAD = bytes.fromhex("4c0000000114020000000000c000000000000046")
# An entry of the list by its form: bytes before the path, after it, and where its fields lie.
_FORMS = {"modern": (0x80, 4, 0x60, 0x64, 0x6C, 0x74), "legacy": (0x70, 0, 0x5C, 0x60, 0x68, None)}


def streams(b: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of a compound file's streams."""
    if b[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", b, 30)
    size, small = 1 << shift, 1 << small_shift
    directory, _, cutoff, first_small, small_count, first_more, more = struct.unpack_from("<IIIIIII", b, 48)
    sector = lambda k: b[(k + 1) * size : (k + 2) * size]
    tables = [k for k in struct.unpack_from("<109I", b, 76) if k < _FREE]
    for _ in range(more):
        part = struct.unpack_from(f"<{size // 4}I", sector(first_more))
        tables += [k for k in part[:-1] if k < _FREE]
        first_more = part[-1]
    following = [k for t in tables for k in struct.unpack(f"<{size // 4}I", sector(t).ljust(size, b"\xff"))]

    def chain(at: int, links: list[int]) -> list[int]:
        out: list[int] = []
        while at < len(links) and len(out) <= len(links):
            out.append(at)
            at = links[at]
        return out

    whole = lambda at: b"".join(sector(k) for k in chain(at, following))
    small_links = [x for x in struct.unpack(f"<{len(t) // 4}I", t)] if (t := whole(first_small) if small_count else b"") else []
    entries = whole(directory)
    container = b""
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        start, total = struct.unpack_from("<IQ", entries, at + 116)
        if kind == 5:
            container = whole(start)
        elif kind == 2 and total <= MOST:
            name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
            data = whole(start) if total >= cutoff else b"".join(container[k * small : (k + 1) * small] for k in chain(start, small_links))
            yield name, data[:total]


def dest_list(b: bytes) -> tuple[dict[int, dict], list[str]]:
    """The list's entries by number. Which form they have is seen from what reads as a path and a time."""
    version, declared = struct.unpack_from("<II", b)
    out, at, form_of, warnings = {}, 32, "", []
    while at < len(b):
        for form, (fixed, after, ranking, time, pin, count) in _FORMS.items():
            if at + fixed + 2 > len(b):
                continue
            chars = struct.unpack_from("<H", b, at + fixed)[0]
            end = at + fixed + 2 + 2 * chars
            path = b[at + fixed + 2 : end].decode("utf-16-le", "replace")
            moment = struct.unpack_from("<Q", b, at + time)[0]
            if 0 < chars <= 4096 and end <= len(b) and path.strip() and path.isprintable() and "\ufffd" not in path and 0 < moment < 1 << 62:
                break
        else:
            warnings.append(f"an entry of the list can't be read; {len(out)} of {declared} were")
            break
        number = struct.unpack_from("<I", b, at + 0x58)[0]
        out[number] = {
            "entry_number": number, "mru_position": len(out) + 1, "machine_id": b[at + 0x48 : at + 0x58].split(b"\0")[0].decode("ascii", "replace"), "destlist_ranking_value": struct.unpack_from("<f", b, at + ranking)[0], "raw_last_access": moment,
            "pinned": struct.unpack_from("<i", b, at + pin)[0] >= 0, "access_count": struct.unpack_from("<I", b, at + count)[0] if count else None, "recorded_path": path, "destlist_present": True,
        }
        form_of = form_of or form
        at = end + after
    told = "legacy" if version == 1 else "modern" if version >= 3 else form_of
    if out and told != form_of:
        warnings.append(f"version {version} has entries of the {told} form, but the {form_of} one reads; counts and pins are left out")
        for entry in out.values():
            entry |= {"access_count": None, "pinned": None}
    return out, warnings


def entries(content: bytes, path: str = "") -> Iterator[dict]:
    """A row for each link of an automatic or custom jump list."""
    app = path.rsplit("/", 1)[-1].split(".")[0].lower()
    base = {"origin": "jump_list", "app_id": app, "destlist_present": False}
    if path.lower().endswith(".customdestinations-ms"):
        at, k = content.find(_LINK_HEAD), 0
        while at >= 0:
            following = content.find(_LINK_HEAD, at + 1)
            yield base | {"stream_name": f"link_{k}"} | link(content[at : following if following >= 0 else len(content)])
            at, k = following, k + 1
        return
    found = list(streams(content))
    known, warnings = next((dest_list(data) for name, data in found if name.lower() == "destlist" and len(data) >= 32), ({}, []))
    rows = []
    for name, data in found:
        try:
            number = int(name.strip(), 16)
        except ValueError:
            continue
        row = base | {"stream_name": name} | link(data)
        listed = known.get(number, {})
        rows.append(row | {k: v for k, v in listed.items() if k != "machine_id" or not row.get("machine_id")} | {"warnings": "; ".join(w for w in (row.get("warnings"), *warnings) if w)})
    yield from sorted(rows, key=lambda r: r.get("mru_position") or 0)
