"""Discovery on any file system that Arrow opens, folder by folder on all tasks.

Folders that can lead to artefacts are listed level by level: each level is one job over its folders, so a wide tree is
the work of many tasks. What is an artefact is told by patterns on the listed paths; several files of one name, and
what a volume lacks, come out of groupings and joins."""

from __future__ import annotations

import os

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.operators.staging import dropped, table_in_shared_folder
from vestige.sources.evidence import _ACCESSORS, _RECENT, Found, letter_of
from vestige.sources.ranged import where

_RECENT_FOLDERS = {context: folder.lower() for context, folder in _RECENT.items()}
# Kind, pattern of the path below a volume in lower case (its first group is the profile), whether the
# name must be the only one of its kind, whether a volume is expected to have it.
PATTERNS = [
    ("SYSTEM", r"windows/system32/config/system()", True, True), ("SOFTWARE", r"windows/system32/config/software()", True, True), ("NTUSER", r"users/([^/]+)/ntuser\.dat", True, False), ("USRCLASS", r"users/([^/]+)/appdata/local/microsoft/windows/usrclass\.dat", True, False),
    ("EVTX", r"windows/system32/winevt/logs/[^/]+\.evtx()", False, True), ("PREFETCH", r"windows/prefetch/[^/]+\.pf()", False, True), ("SETUPAPI", r"windows/inf/setupapi\.dev\.log()", True, True), ("SETUPAPI_ROTATED", r"windows/inf/setupapi\.dev\..+\.log()", False, False),
    *[(kind, rf"users/([^/]+)/{folder}/(?:.*/)?[^/]+\.{end}", False, False) for folder in _RECENT_FOLDERS.values() for kind, end in (("LNK", "lnk"), ("JUMPLIST", "(?:automatic|custom)destinations-ms"))],
]
_FOLDERS = ("windows/system32/config", "windows/system32/winevt/logs", "windows/prefetch", "windows/inf", "users/*/appdata/local/microsoft/windows", *[f"users/*/{f}" for f in _RECENT_FOLDERS.values()])
#: What a volume lies below, as far as the root.
_ABOVE = rf"(?:uploads/(?:{'|'.join(_ACCESSORS)})/[^/]+/|[^/]+/|)"


def _leading() -> str:
    """A pattern of the folders, below the root and in lower case, that are artefacts' folders or lead to one."""
    chains = set()
    for folder in _FOLDERS:
        parts = folder.split("/")
        chains |= {"/".join("[^/]+" if p == "*" else p for p in parts[:k]) for k in range(1, len(parts) + 1)}
    deep = [f"users/[^/]+/{f}/.*" for f in _RECENT_FOLDERS.values()]
    above = rf"uploads|uploads/(?:{'|'.join(_ACCESSORS)})|uploads/(?:{'|'.join(_ACCESSORS)})/[^/]+|[^/]+"
    return rf"(?:{above}|{_ABOVE}(?:{'|'.join(sorted(chains) + deep)}))"


LEADING = _leading()


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, below, folder, problem) of what lies in the folders below root that can lead to artefacts; below: the path
    from the root. On a local file system what resolves outside of the root is a problem and isn't followed."""
    root = root.rstrip("/")
    system, top = where(root)
    if system.get_file_info(top).type != fs.FileType.Directory:
        raise ValueError(f"no folder: {root}")
    local = isinstance(system, fs.LocalFileSystem)
    real = os.path.realpath(top) if local else ""

    def inside(path: str) -> bool:
        at = os.path.realpath(path)
        return os.path.lexists(at) and (at == real or at.startswith(real.rstrip(os.sep) + os.sep))

    def children(below: str) -> list[tuple]:
        here = f"{top}/{below}".rstrip("/")
        try:
            if local:  # names that aren't text for Arrow, and links, are the local listing's business
                found = [(e.name, e.is_dir()) for e in os.scandir(here)]
            else:
                found = [(i.base_name, i.type == fs.FileType.Directory) for i in system_of().get_file_info(fs.FileSelector(here))]
        except OSError as e:
            return [(f"{root}/{below}".rstrip("/"), below, True, f"unreadable: {e}")]
        out = []
        for name, folder in sorted(found):
            path = f"{below}/{name}".lstrip("/")
            out.append((f"{root}/{path}", path, folder, None if not local or inside(f"{top}/{path}") else "outside of the evidence"))
        return out

    def system_of():
        return where(root)[0]

    def each(batches):
        for b in batches:
            yield pd.DataFrame([row for below in b["below"] for row in children(below)], columns=["path", "below", "folder", "problem"]).astype(object)

    schema, levels, written = "path string, below string, folder boolean, problem string", [], []
    frontier = spark.createDataFrame([("",)], "below string")
    while True:
        level = table_in_shared_folder(frontier.mapInPandas(each, schema), written)
        levels.append(level)
        frontier = level.where(F.col("folder") & F.col("problem").isNull() & F.lower("below").rlike(f"^{LEADING}$")).select("below").repartition("below")
        if not frontier.limit(1).count():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    whole = table_in_shared_folder(out)
    for path in written:
        dropped(spark, path)
    return whole


def located(spark: SparkSession, root: str) -> Found:
    """The artefacts of a plain volume, of `uploads/<accessor>/<volume>`, or of `<root>/<volume>`, like evidence.locate;
    for roots on other file systems than this machine's."""
    root = root.rstrip("/")
    rows = listed(spark, root)
    low = F.lower("below")
    windows = rows.where(F.col("folder") & low.rlike(rf"^{_ABOVE}windows$") & F.col("problem").isNull()).select(F.regexp_replace("below", "(?i)/?windows$", "").alias("volume"))
    rank = F.when(F.col("volume") == "", 0).when(F.lower("volume").startswith("uploads/"), 1).otherwise(2)
    best = windows.agg(F.min(rank)).first()[0]
    if best is None:
        raise ValueError(f"no Windows volume beneath {root}")
    volumes = F.broadcast(windows.where(rank == best).distinct())
    inside = F.when(F.col("volume") == "", F.col("below")).otherwise(F.expr("substring(below, length(volume) + 2)"))
    files = rows.join(volumes, (F.col("volume") == "") | F.startswith("below", F.concat("volume", F.lit("/")))).withColumn("inside", inside)
    kind, profile = F.lit(None).cast("string"), F.lit("")
    for name, pattern, _, _ in reversed(PATTERNS):
        hit = F.lower("inside").rlike(f"^{pattern}$")
        kind, profile = F.when(hit, name).otherwise(kind), F.when(hit, F.regexp_extract("inside", f"(?i)^{pattern}$", 1)).otherwise(profile)
    context = F.lit("")
    for name, folder in _RECENT_FOLDERS.items():
        context = F.when(F.lower("inside").rlike(rf"^users/[^/]+/{folder}/"), name).otherwise(context)
    found = files.where("not folder").withColumns({"kind": kind, "profile": profile, "context": context}).where("kind is not null")
    single = [k for k, _, alone, _ in PATTERNS if alone]
    alike = found.where(F.col("kind").isin(*single)).groupBy("kind", F.lower("path").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")).where("n > 1")
    sound = found.where("problem is null").withColumn("low", F.lower("path")).join(alike.select("kind", "low"), ["kind", "low"], "left_anti")
    logs = files.where("not folder and problem is null").select(F.col("path").alias("log"), F.regexp_extract(F.lower("path"), r"^(.*)\.log[12]$", 1).alias("low")).where("low <> ''")
    beside = sound.where(F.col("kind").isin("SYSTEM", "SOFTWARE", "NTUSER", "USRCLASS")).join(logs, "low").groupBy("path").agg(F.array_sort(F.collect_list("log")).alias("logs"))
    out = Found()
    artefacts = sound.join(beside, "path", "left").select("kind", "path", "volume", "profile", F.when(F.col("kind").isin("LNK", "JUMPLIST"), F.col("context")).otherwise("").alias("context"), F.coalesce("logs", F.array().cast("array<string>")).alias("logs"))
    for r in artefacts.orderBy("path").collect():
        out.artefacts.append((r.kind, r.path, f"{root}/{r.volume}".rstrip("/"), letter_of(r.volume.rsplit("/", 1)[-1]) if r.volume else "", r.profile, r.context, list(r.logs)))
    expected = spark.createDataFrame([(k,) for k, _, _, e in PATTERNS if e], "kind string")
    there = found.select("volume", "kind").distinct()
    lacking = windows.where(rank == best).distinct().join(F.broadcast(expected), F.lit(True)).join(there, ["volume", "kind"], "left_anti")
    out.missing = sorted(f"{r.kind} ({f'{root}/{r.volume}'.rstrip('/')})" for r in lacking.collect())
    out.collisions = sorted(r.first for r in alike.collect())
    refused = files.where("problem is not null").withColumns({"kind": kind}).select(F.coalesce("kind", F.lit("FOLDER")).alias("kind"), "path", "problem")
    out.failures = [(r.kind, r.path, r.problem) for r in refused.orderBy("path").collect()]
    return out
