"""Exports: each a view in its stated total order as CSV or JSON lines, the case as Parquet, a manifest with digests,
a report and the run's folder."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vestige.operators.full import Case
from vestige.operators.rules import RuleSet


@dataclass(frozen=True)
class Export:
    name: str
    order: tuple[str, ...]
    form: str = "csv"


def clean_text(df: DataFrame) -> DataFrame:
    """Binary columns as text: `<non-utf8:hex>` where they aren't UTF-8."""
    binary = {f.name for f in df.schema if f.dataType.simpleString() == "binary"}
    return df.select(*[F.when(F.is_valid_utf8(c), F.decode(c, "UTF-8")).otherwise(F.concat(F.lit("<non-utf8:"), F.lower(F.hex(c)), F.lit(">"))).alias(c) if c in binary else F.col(c) for c in df.columns])


def export(df: DataFrame, spec: Export, folder: str) -> dict:
    """Write df in its order; the name, rows, bytes and SHA-256 of what was written. Rows are range-partitioned by
    the order, so a large view is many part files whose names ascend with it, and counted while they are written."""
    if missing := set(spec.order) - set(df.columns):
        raise ValueError(f"{spec.name} is ordered by columns that it lacks: {sorted(missing)}")
    path = f"{folder}/{spec.name}"
    rest = [c for c in df.columns if c not in spec.order]  # ties are broken by all other columns
    seen = Observation()
    w = df.orderBy(*[F.col(c).asc_nulls_last() for c in (*spec.order, *rest)]).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    if spec.form == "csv":
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option("emptyValue", "").csv(path)
    elif spec.form == "jsonl":
        w.option("ignoreNullFields", False).json(path)
    else:
        w.parquet(path)
    spark = df.sparkSession
    part = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    parts = sorted((re.sub(r"-[0-9a-f-]{36}", "", r.path.rsplit("/", 1)[1]), r.length, r.sha256) for r in part.collect())
    return {"name": spec.name, "rows": seen.get["rows"], "bytes": sum(p[1] for p in parts), "files": [{"name": n, "bytes": b, "sha256": s} for n, b, s in parts]}


def manifest(spark: SparkSession, outputs: list[dict], about: dict, folder: str) -> None:
    """manifest.json beside the exports, written by Spark so that any of its file systems will do."""
    text = json.dumps({"about": about, "outputs": sorted(outputs, key=lambda o: o["name"])}, indent=1, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest.json")


# The exports of a case, each a copy of a view.
EXPORTS = {
    "data/devices": ("device_classified", ("tier", "score", "physical_device_id")),
    "data/device-identities": ("device_identity", ("physical_device_id", "identity_preference", "device_key")),
    "data/device-links": ("device_link", ("precedence", "device_key", "other_device_key", "method", "reason")),
    "data/device-facts": ("device_fact", ("physical_device_id", "fact")),
    "data/device-rule-matches": ("device_rule_match", ("physical_device_id", "priority", "rule_id")),
    "classification/rules": ("rule", ("priority", "rule_id")),
    "classification/weights": ("rule_indicator", ("indicator_group", "fact")),
    "data/devnodes": ("devnode", ("device_key", "control_set", "registry_key", "source_id")),
    "data/events": ("event", ("time_utc", "source_file", "record_id", "rule_id", "device_key")),
    "data/file-activity": ("file_target", ("drive_letter", "path", "origin", "source_file")),
    "data/volumes": ("removable_volume", ("drive_letter", "volume_serial_hex", "volume_label")),
    "data/connections": ("connection", ("device_key", "started_utc", "ended_utc")),
    "data/device-lifecycle": ("device_lifecycle", ("device_key", "control_set", "source_id")),
    "data/device-volume-links": ("device_volume_link", ("device_key", "volume_kind", "volume_id", "drive_letter")),
    "data/disks": ("disk", ("disk_number", "time_utc", "record_id", "source_id")),
    "data/disk-departure-candidates": ("disk_departure_candidate", ("time_utc", "device_key", "record_id", "source_id")),
    "data/shellbags": ("shell_bag", ("hive", "profile", "path", "registry_path", "node_slot")),
    "data/mru": ("mru_entry", ("kind", "source_list", "position", "value_name")),
    "data/user-assist": ("user_assist", ("last_executed_utc", "name", "profile", "category")),
    "data/letter-activity": ("letter_activity", ("drive_letter", "artefact", "path", "recorded_utc")),
    "data/prefetch-runs": ("prefetch_run", ("ran_from_removable", "last_run_utc", "executable", "source_file")),
    "data/prefetch-executions": ("prefetch_execution", ("time_utc", "executable", "slot", "source_file")),
    "data/prefetch-volumes": ("prefetch_volume", ("matches_removable_volume", "executables", "device_path")),
    "data/prefetch-run-volume-candidates": ("prefetch_run_volume_candidate", ("source_file", "device_path")),
    "data/prefetch-files-removable": ("prefetch_file_on_removable", ("source_file", "path")),
    "data/file-attribution": ("file_attribution", ("activity_id", "route", "device_key")),
    "data/file-attribution-summary": ("file_attribution_summary", ("candidate_devices", "drive_letter", "path", "activity_id")),
    "data/timeline": ("timeline", ("entry_id",)),
    "data/timeline-significant": ("timeline_significant", ("entry_id",)),
    "data/timeline-moments": ("timeline_moment", ("moment_id",)),
    "data/timeline-moment-support": ("timeline_moment_support", ("moment_id", "category", "event")),
    "data/timeline-moment-members": ("timeline_moment_member", ("moment_id", "entry_id")),
    "provenance/parse-warnings": ("parse_warning", ("records", "artefact", "reason")),
    "provenance/host-time-zone": ("host_time_zone", ("control_set", "key_name", "source_id")),
    "provenance/sources": ("source", ("read_order",)),
    "provenance/observations": ("observation", ("observation_id",)),
}


def export_case(case: Case, folder: str, names: Iterable[str] = tuple(EXPORTS)) -> list[dict]:
    """The exports beneath folder, and what was written."""
    return [export(clean_text(getattr(case, view)()), Export(name, order, "jsonl" if name.endswith("observations") else "csv"), folder) | {"view": view} for name, (view, order) in ((n, EXPORTS[n]) for n in names)]


#: The tables that later readings start from, beside the evidence tables.
CONSOLIDATED = ("device_group", "device_fact", "file_attribution", "timeline_moment_member")


def save_case(case: Case, tables: Iterable[str], folder: str) -> list[dict]:
    """The evidence tables and the consolidated ones as Parquet beneath folder, with rows and digests."""
    out = []
    for name in (*tables, *CONSOLIDATED):
        df = getattr(case, name)() if name in CONSOLIDATED else case.table(name)
        out.append(export(df, Export(name, (), "parquet"), folder))
    return out


def read_case(spark: SparkSession, folder: str) -> Case:
    """A case over what save_case wrote."""
    return Case(lambda name: spark.read.parquet(f"{folder}/{name}"))


def claimed(spark: SparkSession, root: str, run_id: str | None = None, now: datetime | None = None) -> str:
    """A new folder beneath root for a run: its id or the UTC time, with a number after it where that is taken. The
    file system decides who gets a name: creating the claim fails if it is there."""
    if run_id is not None and not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", run_id):
        raise ValueError(f"not a run id: {run_id}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stamp = run_id or (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    for attempt in range(1, 10_000):
        name = stamp if attempt == 1 else f"{stamp}-{attempt}"
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}/.claim")
        files = path.getFileSystem(conf)
        if not files.exists(path.getParent()):
            try:
                files.create(path, False).close()
                return f"{root.rstrip('/')}/{name}"
            except Exception as e:  # another run was faster
                if not files.exists(path):
                    raise RuntimeError(f"can't write beneath {root}") from e
        if run_id is not None:
            raise FileExistsError(f"{root}/{name} is there already")
    raise FileExistsError(f"no free name for {stamp} beneath {root}")


#: Rows of a section of the report; each section says how many there are.
SHOWN = 750


def _table(df: DataFrame, columns: list[str], order: list, shown: int) -> str:
    cell = lambda v: html.escape("" if v is None else v.isoformat(" ", "seconds") if isinstance(v, datetime) else str(v))
    total = df.count()
    rows = df.orderBy(*order).limit(shown).select(*columns).collect()
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    told = f"<p>{len(rows)} of {total} rows</p>"
    return f"{told}<table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>{body}</table>"


def report(case: Case, title: str, shown: int = SHOWN) -> str:
    """A page without scripts: the summary, findings, devices by tier, the newest entries, files, gaps, coverage."""
    summary = case.report_summary().first().asDict()
    newest = [F.desc_nulls_last("sort_utc"), F.desc("entry_id")]
    sections = {
        "Summary": "<table>" + "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v))}</td></tr>" for k, v in summary.items()) + "</table>",
        "Findings": _table(case.report_finding(), ["headline", "basis"], ["finding_id"], shown),
        "Devices": _table(case.report_device().where("tier <= 2"), ["tier", "category", "device_label", "serial", "score", "first_seen_utc", "last_seen_utc", "linked_drive_letters", "connection_windows", "file_records"], ["tier", F.desc("score"), "physical_device_id"], shown),
        "Other devices": _table(case.report_device().where("tier > 2"), ["category", "device_label", "review_required", "event_count"], ["category", "physical_device_id"], shown),
        "Timeline": _table(case.report_timeline(), ["sort_utc", "category", "event", "device_label", "path", "confidence", "supporting"], newest, shown),
        "Files": _table(case.report_file_activity(), ["device_label", "confidence", "route", "path", "recorded_utc", "candidate_devices"], ["tier", F.desc("score"), "physical_device_id", "confidence_rank", F.asc_nulls_last("recorded_utc"), "activity_id"], shown),
        "Files without a device": _table(case.report_file_unattributed(), ["path", "drive_letter", "recorded_utc", "reason"], ["drive_letter", F.asc_nulls_last("path"), "activity_id"], shown),
        "Programmes": _table(case.report_prefetch(), ["device_label", "executable", "ran_from", "run_count", "last_run_utc", "drive_letter", "files_loaded"], ["tier", "physical_device_id", F.desc("ran_from"), "executable", "source_file"], shown),
        "Coverage": _table(case.report_coverage(), ["artefact", "sources", "bytes", "replayed", "not_replayed", "failed", "malformed"], ["artefact"], shown),
        "Limitations": _table(case.report_limitation(), ["severity", "artefact", "path", "message"], ["severity", "artefact", "path", "message"], shown),
    }
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left;white-space:pre-wrap}"
    body = "".join(f"<section><h2>{name}</h2>{content}</section>" for name, content in sections.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def rule_lines(rules: RuleSet | None = None, profile: str = "general") -> list[str]:
    """The rules and weights as text for a console."""
    r = rules or RuleSet()
    weights = r.rows(profile)["rule_indicator"][1]
    out = [f"{x['priority']:4d}  {x['id']}: {x['category']} if " + " and ".join(("not " if c.get("negate") else "") + c["fact"] for c in x["conditions"]) for x in sorted(r.data["rules"], key=lambda x: (-x["priority"], x["id"]))]
    return out + [f"{w:+7.1f}  {fact}" for fact, w, *_ in sorted(weights, key=lambda w: (-abs(w[1]), w[0]))]


def run_case(spark: SparkSession, case: Case, tables: Iterable[str], root: str, title: str, run_id: str | None = None, names: Iterable[str] = tuple(EXPORTS), about: Callable[[], dict] | None = None) -> str:
    """A whole run: a folder of its own, exports, the case, the report, and the manifest that lists them all with how
    long each step took. about: what the manifest says of the evidence; it is asked last, when all has been read."""
    folder, timings, began = claimed(spark, root, run_id), {}, datetime.now(UTC)

    def timed(step: str, f: Callable):
        since = datetime.now(UTC)
        out = f()
        timings[step] = (datetime.now(UTC) - since).total_seconds()
        return out

    outputs = timed("exports", lambda: export_case(case, folder, names))
    outputs += [o | {"name": f"case/{o['name']}"} for o in timed("case", lambda: save_case(case, tables, f"{folder}/case"))]
    timed("report", lambda: spark.createDataFrame([(report(case, title),)], "value string").coalesce(1).write.text(f"{folder}/report.html"))
    counts = case.report_summary().first().asDict()
    said = {"title": title, "run": folder.rsplit("/", 1)[1], "began": began.isoformat(), "counts": {k: str(v) for k, v in counts.items()}}
    if about is not None:
        said |= {"evidence": timed("verification", about)}
    manifest(spark, outputs, said | {"seconds": (datetime.now(UTC) - began).total_seconds(), "timings": timings}, folder)
    return folder
