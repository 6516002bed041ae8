"""Where a collection's artefacts lie, and that nothing outside of it is read nor anything within written."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Hives of the machine, folders of recent items, accessors of collections.
_HIVES = {"SYSTEM": "SYSTEM", "SOFTWARE": "SOFTWARE"}
_RECENT = {"recent": "AppData/Roaming/Microsoft/Windows/Recent", "office_recent": "AppData/Roaming/Microsoft/Office/Recent", "quick_launch": "AppData/Roaming/Microsoft/Internet Explorer/Quick Launch", "desktop": "Desktop"}
_ACCESSORS = ("auto", "ntfs", "lazy_ntfs", "file")


class Boundary:
    def __init__(self, root: str):
        self.root = os.path.realpath(root)
        if not os.path.isdir(self.root):
            raise ValueError(f"no folder: {root}")

    def contains(self, path: str) -> bool:
        """Whether the path, links followed, lies within the root. A path that isn't there doesn't."""
        real = os.path.realpath(path)
        return os.path.lexists(real) and (real == self.root or real.startswith(self.root.rstrip(os.sep) + os.sep))

    def refuse_write(self, path: str) -> None:
        real = os.path.realpath(path)
        if real == self.root or real.startswith(self.root.rstrip(os.sep) + os.sep):
            raise ValueError(f"{path} lies within the evidence")


@dataclass
class Found:
    """artefacts: (kind, path, volume, drive_letter, profile, context, logs). What isn't there, what can't be told
    apart by its name, and what was refused or unreadable are listed too: nothing is passed over in silence."""

    artefacts: list[tuple] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    collisions: list[str] = field(default_factory=list)
    failures: list[tuple[str, str, str]] = field(default_factory=list)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The artefacts, and the problems as rows of severity, artefact, path and message."""
        problems = [("absent", "", m, "not there") for m in self.missing] + [("partial", "", c, "several files of one name") for c in self.collisions] + [("failed", k, p, why) for k, p, why in self.failures]
        return (
            spark.createDataFrame(self.artefacts, "kind string, path string, volume string, drive_letter string, profile string, context string, logs array<string>"),
            spark.createDataFrame(problems, "severity string, artefact string, path string, message string"),
        )


def letter_of(folder: str) -> str:
    """The drive letter in a volume folder's name, such as `C`, `C:` or `%5C%5C.%5CC%3A`."""
    name = folder.replace("%3A", ":").replace("%5C", "\\").replace("%5c", "\\").replace("%3a", ":").rstrip("\\")
    name = name.rsplit("\\", 1)[-1].removesuffix(":")
    return name.upper() if len(name) == 1 and name.isalpha() and name.isascii() else ""


class _Walk:
    def __init__(self, root: str):
        self.bounds, self.out = Boundary(root), Found()

    def admitted(self, kind: str, path: str) -> bool:
        if self.bounds.contains(path):
            return True
        self.out.failures.append((kind, path, "outside of the evidence"))
        return False

    def listing(self, kind: str, folder: str, needed: bool = True) -> list[str]:
        if not os.path.lexists(folder):
            if needed:
                self.out.missing.append(f"{kind} ({folder})")
            return []
        if not self.admitted(kind, folder):
            return []
        try:
            return sorted(os.listdir(folder))
        except OSError as e:
            self.out.failures.append((kind, folder, f"unreadable: {e.strerror}"))
            return []

    def named(self, kind: str, folder: str, name: str, needed: bool = True) -> str | None:
        """The file of this name whatever its case; several of them are a collision and none is taken."""
        fits = [n for n in self.listing(kind, folder, False) if n.lower() == name.lower()]
        if len(fits) > 1:
            self.out.collisions.append(os.path.join(folder, name))
        elif not fits and needed:
            self.out.missing.append(f"{kind} ({os.path.join(folder, name)})")
        path = os.path.join(folder, fits[0]) if len(fits) == 1 else None
        return path if path and self.admitted(kind, path) else None

    def volumes(self) -> Iterator[tuple[str, str]]:
        root = self.bounds.root
        is_volume = lambda p: os.path.isdir(os.path.join(p, "Windows"))
        if is_volume(root):
            yield root, ""
            return
        uploads = [os.path.join(root, "uploads", a, n) for a in _ACCESSORS for n in self.listing("VOLUME", os.path.join(root, "uploads", a), False)]
        nested = [v for v in uploads if is_volume(v)] or [v for n in self.listing("VOLUME", root) if is_volume(v := os.path.join(root, n))]
        for v in nested:
            if self.admitted("VOLUME", v):
                yield v, letter_of(os.path.basename(v))

    def add(self, kind: str, path: str | None, at: tuple[str, str], profile: str = "", context: str = "", logs: bool = False) -> None:
        if path:
            folder, name = os.path.split(path)
            found = [p for s in (".LOG1", ".LOG2") if (p := self.named(kind, folder, name + s, False))] if logs else []
            self.out.artefacts.append((kind, path, *at, profile, context, found))

    def volume(self, at: tuple[str, str]) -> None:
        v = at[0]
        for kind, name in _HIVES.items():
            self.add(kind, self.named(kind, os.path.join(v, "Windows/System32/config"), name), at, logs=True)
        for profile in self.listing("NTUSER", os.path.join(v, "Users")):
            home = os.path.join(v, "Users", profile)
            if not os.path.isdir(home):
                continue
            self.add("NTUSER", self.named("NTUSER", home, "NTUSER.DAT", False), at, profile, logs=True)
            self.add("USRCLASS", self.named("USRCLASS", os.path.join(home, "AppData/Local/Microsoft/Windows"), "UsrClass.dat", False), at, profile, logs=True)
            for context, folder in _RECENT.items():
                self._links(os.path.join(home, folder), at, profile, context)
        for kind, folder, fits in (("EVTX", "Windows/System32/winevt/Logs", lambda n: n.endswith(".evtx")), ("PREFETCH", "Windows/Prefetch", lambda n: n.endswith(".pf"))):
            for name in self.listing(kind, os.path.join(v, folder)):
                if fits(name.lower()) and self.admitted(kind, path := os.path.join(v, folder, name)):
                    self.add(kind, path, at)
        inf = os.path.join(v, "Windows/INF")
        self.add("SETUPAPI", self.named("SETUPAPI", inf, "setupapi.dev.log"), at)
        for name in self.listing("SETUPAPI_ROTATED", inf, False):
            if name.lower().startswith("setupapi.dev.") and name.lower().endswith(".log") and name.lower() != "setupapi.dev.log" and self.admitted("SETUPAPI_ROTATED", path := os.path.join(inf, name)):
                self.add("SETUPAPI_ROTATED", path, at)

    def _links(self, folder: str, at: tuple[str, str], profile: str, context: str) -> None:
        for name in self.listing("LNK", folder, False):
            path, low = os.path.join(folder, name), name.lower()
            if os.path.isdir(path) and not os.path.islink(path):
                self._links(path, at, profile, context)
            elif low.endswith((".lnk", ".automaticdestinations-ms", ".customdestinations-ms")) and self.admitted("LNK", path):
                self.add("LNK" if low.endswith(".lnk") else "JUMPLIST", path, at, profile, context)


def locate(root: str) -> Found:
    """The artefacts of a plain volume, of `uploads/<accessor>/<volume>`, or of `<root>/<volume>`."""
    walk = _Walk(root)
    volumes = list(walk.volumes())
    if not volumes:
        raise ValueError(f"no Windows volume beneath {root}")
    for at in volumes:
        walk.volume(at)
    walk.out.missing.sort()
    walk.out.collisions.sort()
    return walk.out
