"""Event logs: chunks of records whose bodies are binary XML with templates.

A log is cut into chunks, which are decoded apart, so that one large log is the work of many tasks; a bad chunk or
record is counted and the rest is kept."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

CHUNK, HEAD = 65536, 4096
Field = tuple[str, str]  # path of the element, its text


class _Chunk:
    def __init__(self, b: bytes):
        self.b = b
        self.templates: dict[int, list] = {}

    # --------------------------------------------------------------- values

    def value(self, kind: int, raw: bytes) -> str | list[str] | tuple:
        if kind & 0x80:
            base = kind & 0x7F
            if base == 1:
                return [x for x in raw.decode("utf-16-le", "replace").split("\0") if x]
            size = {3: 1, 4: 1, 5: 2, 6: 2, 7: 4, 8: 4, 9: 8, 10: 8, 11: 4, 12: 8, 13: 4, 15: 16, 17: 8, 18: 16, 20: 4, 21: 8}.get(base, 0)
            return [str(self.value(base, raw[k : k + size])) for k in range(0, len(raw), size)] if size else raw.hex()
        if kind == 0:
            return ""
        if kind == 1:
            return raw.decode("utf-16-le", "replace").rstrip("\0")
        if kind == 2:
            return raw.decode("cp1252", "replace").rstrip("\0")
        if kind in (3, 5, 7, 9):
            return str(int.from_bytes(raw, "little", signed=True))
        if kind in (4, 6, 8, 10, 16):
            return str(int.from_bytes(raw, "little"))
        if kind in (11, 12):
            number = struct.unpack("<f" if kind == 11 else "<d", raw)[0]
            return str(int(number)) if number == number and abs(number) < 1e15 and number == int(number) else str(number)
        if kind == 13:
            return "true" if any(raw) else "false"
        if kind == 15:
            a, b, c = struct.unpack_from("<IHH", raw)
            return f"{{{a:08x}-{b:04x}-{c:04x}-{raw[8:10].hex()}-{raw[10:16].hex()}}}"
        if kind == 17:
            return _time(int.from_bytes(raw, "little")) or ""
        if kind == 18:
            y, mo, _, d, h, mi, s, ms = struct.unpack("<8H", raw)
            return f"{y:04d}-{mo:02d}-{d:02d} {h:02d}:{mi:02d}:{s:02d}.{ms:03d}"
        if kind == 19:
            count = raw[1]
            return "-".join(["S", str(raw[0]), str(int.from_bytes(raw[2:8], "big")), *map(str, struct.unpack_from(f"<{count}I", raw, 8))])
        if kind in (20, 21):
            return hex(int.from_bytes(raw, "little"))
        return raw.hex()

    def name(self, at: int) -> tuple[str, int]:
        """A name and where it ends."""
        count = struct.unpack_from("<H", self.b, at + 6)[0]
        return self.b[at + 8 : at + 8 + 2 * count].decode("utf-16-le", "replace"), at + 10 + 2 * count

    # ---------------------------------------------------------------- nodes

    def nodes(self, at: int, end: int, in_template: bool) -> tuple[list, int]:
        """Content up to the element's end: texts, ("sub", id, optional), ("element", name, attributes, content)."""
        out: list = []
        b = self.b
        while at < end:
            token = b[at] & 0x0F if b[at] & 0x40 else b[at]
            if token == 0x00:
                return out, at + 1
            if token == 0x0F:
                at += 4
            elif token == 0x01:
                node, at = self.element(at, end, in_template)
                out.append(node)
            elif token == 0x04:
                return out, at + 1
            elif token == 0x05:
                if b[at + 1] != 1:
                    raise ValueError(f"a text of type {b[at + 1]}")
                count = struct.unpack_from("<H", b, at + 2)[0]
                out.append(b[at + 4 : at + 4 + 2 * count].decode("utf-16-le", "replace"))
                at += 4 + 2 * count
            elif token == 0x07:
                count = struct.unpack_from("<H", b, at + 1)[0]
                out.append(b[at + 3 : at + 3 + 2 * count].decode("utf-16-le", "replace"))
                at += 3 + 2 * count
            elif token == 0x08:
                count = struct.unpack_from("<H", b, at + 1)[0]
                out.append(chr(count))
                at += 3
            elif token == 0x09:
                where = struct.unpack_from("<I", b, at + 1)[0]
                text, after = self.name(where)
                out.append({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(text, ""))
                at = after if where == at + 5 else at + 5
            elif token in (0x0D, 0x0E):
                out.append(("sub", struct.unpack_from("<H", b, at + 1)[0], token == 0x0E))
                at += 4
            elif token == 0x0C:
                node, at = self.instance(at)
                out += node
            else:
                raise ValueError(f"an unknown token {b[at]:#x}")
        return out, at

    def element(self, at: int, end: int, in_template: bool) -> tuple[tuple, int]:
        b, has = self.b, self.b[at] & 0x40
        at += 3 if in_template else 1
        at += 4  # its size
        where = struct.unpack_from("<I", b, at)[0]
        name, after = self.name(where)
        at = after if where == at + 4 else at + 4
        attributes: dict[str, list] = {}
        if has:
            stop = at + 4 + struct.unpack_from("<I", b, at)[0]
            at += 4
            while at < stop:
                where = struct.unpack_from("<I", b, at + 1)[0]
                key, after = self.name(where)
                at = after if where == at + 5 else at + 5
                if b[at] & 0x0F == 0x05:
                    count = struct.unpack_from("<H", b, at + 2)[0]
                    attributes[key] = [b[at + 4 : at + 4 + 2 * count].decode("utf-16-le", "replace")]
                    at += 4 + 2 * count
                elif b[at] & 0x0F in (0x0D, 0x0E):
                    attributes[key] = [("sub", struct.unpack_from("<H", b, at + 1)[0], True)]
                    at += 4
                else:
                    raise ValueError("an attribute without a value")
        if b[at] == 0x03:
            return ("element", name, attributes, []), at + 1
        if b[at] != 0x02:
            raise ValueError("a start tag without an end")
        content, at = self.nodes(at + 1, end, in_template)
        return ("element", name, attributes, content), at

    def instance(self, at: int) -> tuple[list, int]:
        """A template's content with its values put in."""
        b = self.b
        where = struct.unpack_from("<I", b, at + 6)[0]
        size = struct.unpack_from("<I", b, where + 20)[0]
        if where not in self.templates:
            self.templates[where] = self.nodes(where + 24, where + 24 + size, True)[0]
        at = where + 24 + size if where == at + 10 else at + 10
        count = struct.unpack_from("<I", b, at)[0]
        kinds = [struct.unpack_from("<HB", b, at + 4 + 4 * k) for k in range(count)]
        at += 4 + 4 * count
        values: list = []
        for length, kind in kinds:
            values.append(("xml", self.nodes(at, at + length, False)[0]) if kind == 0x21 and length else self.value(kind, b[at : at + length]))
            at += length
        return [_filled(n, values) for n in self.templates[where]], at


def _filled(node, values: list):
    if isinstance(node, tuple) and node[0] == "sub":
        return values[node[1]] if node[1] < len(values) else ""
    if isinstance(node, tuple) and node[0] == "element":
        return "element", node[1], {k: [_filled(x, values) for x in v] for k, v in node[2].items()}, [_filled(x, values) for x in node[3]]
    return node


def _text(content: list) -> str:
    return "".join("" if isinstance(x, tuple) else ", ".join(x) if isinstance(x, list) else x for x in content)


def _fields(content: list, path: str) -> Iterator[Field]:
    """The texts of elements by path; a Data element goes by its name; attributes after `@`."""
    for node in content:
        if isinstance(node, tuple) and node[0] == "xml":
            yield from _fields(node[1], path)
        elif isinstance(node, tuple):
            _, name, attributes, inside = node
            named = _text(attributes.get("Name", []))
            here = f"{path}.{named if name == 'Data' and named else name}" if path else name
            for key, value in attributes.items():
                if not (name == "Data" and key == "Name"):
                    yield f"{here}@{key}", _text(value)
            if text := _text(inside).strip("\0"):
                yield here, text
            yield from _fields(inside, here)


def _time(raw: int) -> str | None:
    if not 0 < raw < 1 << 62:
        return None
    return (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=raw // 10)).replace(tzinfo=None).isoformat(" ", "microseconds")


def records(chunk: bytes) -> Iterator[tuple[int, int, list[Field] | None]]:
    """(record id, raw time, fields) of a chunk's records; fields None where a body can't be read."""
    end = min(struct.unpack_from("<I", chunk, 48)[0], len(chunk))
    at, decoder = 512, _Chunk(chunk)
    while at + 24 <= end and chunk[at : at + 4] == b"**\0\0":
        size, number, raw = struct.unpack_from("<IQQ", chunk, at + 4)
        if size < 28 or at + size > len(chunk):
            return
        try:
            content, _ = decoder.nodes(at + 24, at + size - 4, False)
            yield number, raw, list(_fields(content, ""))
        except (ValueError, IndexError, struct.error, RecursionError):
            yield number, raw, None
        at += size
