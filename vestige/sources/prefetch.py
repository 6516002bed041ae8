"""Prefetch files: the programme, when it ran, the files and volumes that it loaded from; compressed ones too."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

RUN = (
    "executable string, executable_path string, path_hash string, format_version string, run_count long, times_recorded int, volume_count int, file_count int, raw_run_times array<long>, files array<string>, "
    "volumes array<struct<device_path:string,volume_serial_hex:string,raw_serial:long,raw_created:long>>, parse_warnings string"
)
#: Bytes that a compressed file may unfold to; volumes that one may name.
MOST, MOST_VOLUMES = 256 << 20, 16
#: By format: size of a volume's entry, where the run times lie, their number, where the count of runs lies.
_FORMATS = {17: (40, 120, 1, 144), 23: (104, 128, 1, 152), 26: (104, 128, 8, 208), 30: (96, 128, 8, 208), 31: (96, 128, 8, 208)}


def xpress_huffman(data: bytes, size: int) -> bytes:
    """LZ77 with Huffman codes, in blocks of 64 KiB of output with a table of code lengths each."""
    out, at = bytearray(), 0
    while len(out) < size:
        table = np.frombuffer(data, np.uint8, 256, at)
        lengths = np.empty(512, np.int64)
        lengths[0::2], lengths[1::2] = table & 15, table >> 4
        # Codes are dealt by length, then symbol: each takes a run of the 15-bit prefixes.
        symbols = np.lexsort((np.arange(512), lengths))
        symbols = symbols[lengths[symbols] > 0]
        spans = 1 << (15 - lengths[symbols])
        if spans.sum() > 1 << 15 or not len(symbols):
            raise ValueError("the code lengths are no prefix code")
        decode = np.repeat(symbols, spans).tolist()
        length_of = lengths.tolist()
        at += 256
        bits, spare = int.from_bytes(data[at : at + 2], "little") << 16 | int.from_bytes(data[at + 2 : at + 4], "little"), 16
        at += 4
        stop = min(size, len(out) + 65536)
        while len(out) < stop:
            if (prefix := bits >> 17) >= len(decode):
                raise ValueError("a code that the table lacks")
            symbol = decode[prefix]
            taken, match = length_of[symbol], symbol - 256
            for _ in range(2):  # the code, then a match's offset
                bits = bits << taken & 0xFFFFFFFF
                spare -= taken
                if spare < 0:
                    bits |= int.from_bytes(data[at : at + 2], "little") << -spare
                    at, spare = at + 2, spare + 16
                if match < 0:
                    out.append(symbol)
                    break
                if _ == 0:
                    run, taken = match & 15, match >> 4
                    if run == 15:
                        run, at = data[at] + 15, at + 1
                        if run == 270:
                            run, at = int.from_bytes(data[at : at + 2], "little"), at + 2
                            if run == 0:
                                run, at = int.from_bytes(data[at : at + 4], "little"), at + 4
                    back = (1 << taken) + (bits >> 32 - taken if taken else 0)
            else:
                run += 3
                if back > len(out):
                    raise ValueError("a match before the beginning")
                if back >= run:
                    out += out[len(out) - back : len(out) - back + run]
                else:
                    piece = bytes(out[-back:])
                    out += (piece * (run // back + 1))[:run]
    return bytes(out[:size])


def unfolded(b: bytes) -> bytes:
    if b[:3] != b"MAM":
        return b
    size = struct.unpack_from("<I", b, 4)[0]
    if not 0 < size <= MOST:
        raise ValueError(f"declares {size} bytes when unfolded")
    return xpress_huffman(b[8:], size)


def run(content: bytes, path: str = "") -> Iterator[dict]:
    """The one row of a file. A device path of a form that the kernel doesn't use means a wrong place, and is left
    out."""
    b = unfolded(content)
    if len(b) < 84 or b[4:8] != b"SCCA":
        raise ValueError("not a prefetch file")
    version = struct.unpack_from("<I", b)[0]
    executable = b[16:76].decode("utf-16-le", "replace").split("\0")[0]
    out: dict = {"executable": executable, "path_hash": f"{struct.unpack_from('<I', b, 76)[0]:08X}", "format_version": str(version), "files": [], "volumes": [], "raw_run_times": []}
    if version not in _FORMATS:
        yield out | {"executable_path": "", "times_recorded": 0, "volume_count": 0, "file_count": 0, "parse_warnings": f"format {version} has no known layout"}
        return
    entry, times_at, slots, count_at = _FORMATS[version]
    metrics, _, _, _, names_at, names_size, volumes_at, volumes, volumes_size = struct.unpack_from("<9I", b, 84)
    if version >= 30 and metrics == 296:  # the shorter header
        count_at -= 8
    times = struct.unpack_from(f"<{slots}Q", b, times_at)
    warnings = []
    out["raw_run_times"] = [t for t in times if 0 < t < 1 << 63]
    out["run_count"] = struct.unpack_from("<I", b, count_at)[0]
    out["files"] = [n for n in b[names_at : names_at + names_size].decode("utf-16-le", "replace").split("\0") if n]
    if volumes > MOST_VOLUMES or volumes * entry > volumes_size or volumes_at + volumes_size > len(b):
        warnings.append(f"declares {volumes} volumes in {volumes_size} bytes, which can't be; none was read")
        volumes = 0
    block = b[volumes_at : volumes_at + volumes_size]
    for k in range(volumes):
        at, chars, created, serial = struct.unpack_from("<IIQI", block, k * entry)
        device = block[at : at + 2 * chars].decode("utf-16-le", "replace").split("\0")[0] if 0 < at and at + 2 * chars <= len(block) else ""
        if not device.upper().startswith(("\\DEVICE\\", "\\VOLUME{")):
            warnings.append(f"volume {k + 1} has no device path where it should lie")
            continue
        out["volumes"].append({"device_path": device, "volume_serial_hex": f"{serial >> 16:04X}-{serial & 0xFFFF:04X}" if serial else "", "raw_serial": serial, "raw_created": created if created < 1 << 63 else None})
    own = [f for f in out["files"] if f.rsplit("\\", 1)[-1].upper().startswith(executable.upper())] if executable else []
    yield out | {"executable_path": own[0] if len(own) == 1 else "", "times_recorded": len(out["raw_run_times"]), "volume_count": len(out["volumes"]), "file_count": len(out["files"]), "parse_warnings": "; ".join(warnings)}
