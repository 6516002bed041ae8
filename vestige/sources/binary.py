"""Binary artefacts: files are read with binaryFile and decoded in Arrow batches on the executors.

A decoder never fails on a file: what it can't read is a warning in the row."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DRIVE_TYPES = ("unknown", "no root directory", "removable", "fixed", "remote", "cd-rom", "ram disk")
_LINK_ID = bytes.fromhex("0114020000000000c000000000000046")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content, size_bytes, modified_at and sha256 of the files below path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return f.select("path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"))


def verified(before: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """before (path, sha256) with whether a second reading has the same digest."""
    after = files(spark, path).select("path", F.col("sha256").alias("again"))
    return before.join(after, "path", "left").select(*before.columns, F.coalesce(F.col("sha256") == F.col("again"), F.lit(False)).alias("verified"))


def decoded(df: DataFrame, decode: Callable[[bytes], dict], schema: str) -> DataFrame:
    """path and the decoder's fields for each file; schema: the fields' DDL, `warnings string` among them."""
    names = StructType.fromDDL(schema).fieldNames()

    def each(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    got = decode(bytes(content))
                except (struct.error, IndexError, ValueError, UnicodeError) as e:
                    got = {"warnings": f"not decoded: {e}"}
                rows.append((path, *(got.get(n) for n in names)))
            yield pd.DataFrame(rows, columns=["path", *names]).astype(object)

    return df.select("path", "content").mapInPandas(each, f"path string, {schema}")


def guid(b: bytes) -> str:
    """Sixteen bytes as text; all zeros give ''."""
    if not any(b):
        return ""
    a, c, d = struct.unpack_from("<IHH", b)
    return f"{{{a:08x}-{c:04x}-{d:04x}-{b[8:10].hex()}-{b[10:16].hex()}}}"


LINK = "target_path string, drive_type string, removable boolean, volume_serial_hex string, volume_label string, target_size_bytes long, raw_created long, raw_accessed long, raw_written long, relative_path string, working_dir string, arguments string, icon_location string, machine_id string, target_item_path string, target_item_modified_local string, mft_entry long, mft_sequence long, network_path string, warnings string"


def link(b: bytes) -> dict:
    """A shell link: header, target's items, link information with its volume or network share, string data, tracker
    block."""
    from vestige.sources.shellitems import items, path_of

    if len(b) < 76 or struct.unpack_from("<I", b)[0] != 76 or b[4:20] != _LINK_ID:
        return {"warnings": "not a shell link"}
    flags, _, created, accessed, written, size = struct.unpack_from("<IIQQQI", b, 20)
    signed = lambda v: v if v < 1 << 63 else None
    out: dict = {"raw_created": signed(created), "raw_accessed": signed(accessed), "raw_written": signed(written), "target_size_bytes": size, "removable": False}
    warnings, at = [], 76
    if flags & 1:
        size = struct.unpack_from("<H", b, at)[0]
        found, wrong = items(b[at + 2 : at + 2 + size])
        warnings += wrong
        out["target_item_path"] = path_of(found)[0]
        if found:
            out |= {"target_item_modified_local": found[-1]["modified_local"], "mft_entry": found[-1]["mft_entry"], "mft_sequence": found[-1]["mft_sequence"]}
        at += 2 + size
    if flags & 2:
        info = b[at : at + struct.unpack_from("<I", b, at)[0]]
        _, head, has, volume, base, share, suffix = struct.unpack_from("<7I", info)
        wide = struct.unpack_from("<2I", info, 28) if head >= 36 else (0, 0)
        text = lambda o: info[o : info.index(b"\0", o)].decode("cp1252", "replace") if 0 < o < len(info) and b"\0" in info[o:] else ""
        if has & 1:
            if volume + 16 > len(info):
                warnings.append("volume identity lies outside of the link information")
            else:
                _, kind, serial, label = struct.unpack_from("<4I", info, volume)
                out |= {"drive_type": _DRIVE_TYPES[kind] if kind < len(_DRIVE_TYPES) else str(kind), "removable": kind == 2, "volume_serial_hex": f"{serial >> 16:04X}-{serial & 0xFFFF:04X}", "volume_label": text(volume + label)}
        full = lambda o: "".join(c for c in info[o : o + (len(info) - o & ~1)].decode("utf-16-le", "replace").split("\0")[:1]) if 0 < o < len(info) else ""
        if has & 2 and 0 < share < len(info) - 20:
            out["network_path"] = text(share + struct.unpack_from("<I", info, share + 8)[0])
        front, back = full(wide[0]) or text(base) or out.get("network_path", ""), full(wide[1]) or text(suffix)
        out["target_path"] = front + ("\\" if back and front and not front.endswith("\\") else "") + back
        at += len(info)
    for bit, name in ((4, "description"), (8, "relative_path"), (16, "working_dir"), (32, "arguments"), (64, "icon_location")):
        if flags & bit:
            if at + 2 > len(b):
                warnings.append(f"{name} is cut off")
                break
            n = struct.unpack_from("<H", b, at)[0] * (2 if flags & 128 else 1)
            out[name] = b[at + 2 : at + 2 + n].decode("utf-16-le" if flags & 128 else "cp1252", "replace")
            at += 2 + n
    while at + 8 <= len(b):
        n, signature = struct.unpack_from("<II", b, at)
        if n < 8:
            break
        if signature == 0xA0000003 and at + 32 <= len(b):
            out["machine_id"] = b[at + 16 : at + 32].split(b"\0")[0].decode("ascii", "replace")
        at += n
    return out | {"warnings": "; ".join(warnings)}


LAYOUT = "style string, disk_guid string, disk_signature long, partition_count int, partitions array<struct<number:int,starting_offset:long,length_bytes:long,type:string,guid:string,name:string>>, warnings string"


def layout(b: bytes) -> dict:
    """A drive layout: a 48-byte header and entries of 144 bytes; empty slots are left out."""
    if len(b) < 48:
        return {"warnings": "shorter than its header", "partitions": []}
    style, count = struct.unpack_from("<II", b)
    out: dict = {"style": ("MBR", "GPT", "RAW")[style] if style < 3 else str(style), "partition_count": count, "disk_guid": guid(b[8:24]) if style == 1 else "", "disk_signature": struct.unpack_from("<I", b, 8)[0] if style == 0 else None}
    found, warning = [], ""
    for k in range(count):
        at = 48 + 144 * k
        if at + 144 > len(b):
            warning = f"{count - k} entries are cut off"
            break
        start, length, number = struct.unpack_from("<qqI", b, at + 8)
        if style == 1:
            kind, own, name = guid(b[at + 32 : at + 48]), guid(b[at + 48 : at + 64]), b[at + 72 : at + 144].decode("utf-16-le", "replace").split("\0")[0]
        else:
            kind, own, name = f"{b[at + 32]:02x}", "", ""
        if length and kind not in ("", "00"):
            found.append({"number": number, "starting_offset": start, "length_bytes": length, "type": kind, "guid": own, "name": name})
    return out | {"partitions": found, "warnings": warning}


def mbr_signature(b: bytes) -> int | None:
    """The disk signature of a boot sector, if it is one."""
    return struct.unpack_from("<I", b, 440)[0] if len(b) >= 512 and b[510:512] == b"\x55\xaa" else None


def links(spark: SparkSession, path: str) -> DataFrame:
    return decoded(files(spark, path, "*.lnk"), link, LINK)


def layouts(df: DataFrame) -> DataFrame:
    """df: path and content, the raw layouts."""
    return decoded(df, layout, LAYOUT)
