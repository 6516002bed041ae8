"""The registered queries, a view each, and their SQL."""

from __future__ import annotations

import atexit
import re
from collections import OrderedDict
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.functions import macros as m
from vestige.operators import timeline
from vestige.operators.full import Case
from vestige.operators.rules import RuleSet
from vestige.operators.staging import table_in_shared_folder
from vestige.plans import case_sql, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Cases whose consolidated tables are kept; the oldest is closed beyond that.
KEPT = 4
_cases: OrderedDict[tuple, Case] = OrderedDict()
_PARTS = {name: re.sub(r"@(\w+)@", r"\1", sql) for name, sql in model.TABLES.items()} | case_sql.PARTS


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells whether the tables have changed: each one's length and time of change."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in model.BASE:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(conf)
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files.listStatus(path)]
    return tuple(out)


def _close_all() -> None:
    for case in _cases.values():
        case.close()
    _cases.clear()


def case_of(spark: SparkSession, sf_dir: str) -> Case:
    """The case over sf_dir. Its consolidated tables serve all queries of the application for as long as the tables
    there stay as they are."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _cases:
        if not _cases:
            atexit.register(_close_all)  # after the session's own, so that it runs before
        rules = RuleSet().tables(spark)
        # Evidence tables are files; these are made of others, so they are written when they are first asked for.
        write = lambda name, shared=None: table_in_shared_folder(model.table(spark, sf_dir, name, shared), made._written)
        shared = cache(lambda: write(model.SHARED))
        _cases[key] = made = Case(lambda name: rules[name] if name in rules else write(name, shared() if model.SHARED in model.needed({name}, model.TABLES) else None))
        while len(_cases) > KEPT:
            _, old = _cases.popitem(last=False)
            old.close()
    _cases.move_to_end(key)
    return _cases[key]


def sql_of(query: str) -> str:
    return model.with_parts(query, _PARTS, recursive=True)


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql_of(sql)
        return f

    return add


def _register(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(case_of(spark, sf_dir), name)()

    run.__name__, run.__doc__ = name, getattr(Case, name).__doc__
    query(f"SELECT * FROM v_{name}")(run)


for _view in [name[2:] for name in case_sql.PARTS if name.startswith("v_")]:
    _register(_view)


_ITEMS = """SELECT 'offensive' AS kind, physical_device_id AS k, ifnull(nullif(friendly_name, ''), physical_device_id) || ' — ' || classification_reason AS item FROM v_device_classified WHERE category = 'PotentialOffensiveDevice'
    UNION ALL SELECT 'storage', physical_device_id, coalesce(nullif(friendly_name, ''), nullif(device_desc, ''), physical_device_id) || if(serial = '', ' (no serial recorded)', ' (serial ' || serial || ')') FROM v_device_classified WHERE category = 'Storage' AND tier = 1
    UNION ALL SELECT 'mobile', physical_device_id, coalesce(nullif(friendly_name, ''), nullif(device_desc, ''), physical_device_id) FROM v_device_classified WHERE category = 'MobileDevice'
    UNION ALL SELECT 'review', physical_device_id, coalesce(nullif(friendly_name, ''), nullif(device_desc, ''), physical_device_id) || ' — ' || review_reason FROM v_device_classified WHERE review_required
    UNION ALL SELECT 'identity', physical_device_id, coalesce(nullif(friendly_name, ''), nullif(device_desc, ''), physical_device_id) FROM v_device_classified WHERE identity_not_unique AND tier <= 2
    UNION ALL SELECT DISTINCT if(ran_from, 'execution', 'execution_read'), executable || ' (' || drive_letter || ':)', executable || ' (' || drive_letter || ':)' FROM v_prefetch_device_link
    UNION ALL SELECT 'user_launched', drive_letter || ':' || name, drive_letter || ':  ' || name FROM user_assist WHERE NOT bookkeeping AND drive_letter <> ''"""


@query(f"SELECT kind, n AS place, item, items, greatest(items - 200, 0) AS left_out FROM (SELECT kind, item, row_number() OVER (PARTITION BY kind ORDER BY k, item) AS n, count(*) OVER (PARTITION BY kind) AS items FROM ({_ITEMS})) WHERE n <= 200")
def finding_items(spark, sf_dir):
    """What the findings list, the first 200 each, which is the report's limit."""
    return case_of(spark, sf_dir).finding_items()


_AFTER = {
    "v_fact_after": "FROM v_device_fact UNION ALL SELECT physical_device_id, 'file_activity', string_agg(e, '; ' ORDER BY e), count(*) FROM (SELECT DISTINCT physical_device_id, 'file records attributed at ' || confidence AS e FROM v_file_attribution JOIN v_device_group USING (device_key)) GROUP BY 1",
    **{f"{name}_after": _PARTS[name].replace("v_device_fact", "v_fact_after").replace("v_device_rule_match", "v_device_rule_match_after") for name in ("v_device_rule_match", "v_device_classification")},
}


def second_pass_of(spark: SparkSession, sf_dir: str) -> Case:
    """The second pass of the case over sf_dir, which serves its queries for as long."""
    case = case_of(spark, sf_dir)
    if "second pass" not in case._made:
        case._made["second pass"] = case.second_pass()
        case._written += case._made["second pass"]._written
    return case._made["second pass"]


def second_pass_fact(spark, sf_dir):
    """Facts once attribution is one."""
    return second_pass_of(spark, sf_dir).device_fact()


def second_pass_classification(spark, sf_dir):
    """Classification and scores once attribution is a fact."""
    return second_pass_of(spark, sf_dir).device_classification()


for _f, _v in ((second_pass_fact, "v_fact_after"), (second_pass_classification, "v_device_classification_after")):
    QUERIES[_f.__name__], ORACLE_SQL[_f.__name__] = _f, model.with_parts(f"SELECT * FROM {_v}", _PARTS | _AFTER, recursive=True)


@query("SELECT entry_id, category, event, sort_utc FROM v_timeline_significant ORDER BY sort_utc DESC NULLS LAST, entry_id DESC LIMIT 750")
def significant_newest(spark, sf_dir):
    """The report's section of the newest entries, which has a limit."""
    t = case_of(spark, sf_dir).timeline_significant()
    return t.orderBy(F.desc_nulls_last("sort_utc"), F.desc("entry_id")).limit(750).select("entry_id", "category", "event", "sort_utc")


@query("SELECT enumerator, count(*) AS identities, count(*) FILTER (WHERE serial_is_generated) AS generated FROM v_device GROUP BY 1")
def count_by_enumerator(spark, sf_dir):
    return case_of(spark, sf_dir).device().groupBy("enumerator").agg(F.count(F.lit(1)).alias("identities"), F.count_if("serial_is_generated").alias("generated"))


@query("SELECT min(sort_utc) AS first_utc, max(sort_utc) AS last_utc, count(*) AS entries FROM v_timeline WHERE epoch_default = ''")
def timeline_span(spark, sf_dir):
    return case_of(spark, sf_dir).timeline().where("epoch_default = ''").agg(F.min("sort_utc").alias("first_utc"), F.max("sort_utc").alias("last_utc"), F.count(F.lit(1)).alias("entries"))


@query("SELECT epoch_default, time_basis, category, count(*) AS entries, min(sort_utc) AS first_utc, max(sort_utc) AS last_utc FROM v_timeline GROUP BY ALL")
def epoch_defaults(spark, sf_dir):
    return case_of(spark, sf_dir).timeline().groupBy("epoch_default", "time_basis", "category").agg(F.count(F.lit(1)).alias("entries"), F.min("sort_utc").alias("first_utc"), F.max("sort_utc").alias("last_utc"))


@query(
    """SELECT d.physical_device_id, ifnull(m.c, 'Unknown') AS category, ifnull(m.t, 3) AS tier, ifnull(least(greatest(round(raw), 0), 100), 0) AS score, ifnull(round(raw, 1), 0) AS raw_score FROM v_physical_device d
    LEFT JOIN (SELECT physical_device_id, arg_min(category, (-priority, rule_id)) AS c, arg_min(tier, (-priority, rule_id)) AS t FROM v_device_rule_match GROUP BY 1) m USING (physical_device_id)
    LEFT JOIN (SELECT physical_device_id, sum(base_weight * CASE WHEN fact IN ('storage_identity', 'mtp_interface', 'optical_identity') THEN 1.5 WHEN fact IN ('mounted_volume', 'file_activity', 'executable_run_from_removable') THEN 2 ELSE 1 END) AS raw FROM v_device_fact JOIN rule_indicator USING (fact) GROUP BY 1) s USING (physical_device_id)"""
)
def exfiltration_profile(spark, sf_dir):
    """Classification with another profile's weights: scores change, categories don't."""
    return case_of(spark, sf_dir).with_rules(RuleSet().tables(spark, "exfiltration"))._classes().select("physical_device_id", "category", "tier", "score", "raw_score")


@query(
    """SELECT k, len(string_split(k, '\\')) > 2 AS has_instance_id, {tail} AS identity_tail, {generated} AS is_generated_serial, upper(split_part(k, '\\', 1)) AS identity_enumerator, upper(split_part(k, '\\', 1)) IN ('USBSTOR', 'STORAGE', 'SWD', 'SCSI', 'WPDBUSENUM') AS appends_instance_index, {recorded} AS device_serial_recorded, {serial} AS device_serial,
    CASE WHEN ({recorded}) = '' THEN '' WHEN ({recorded}) = ({serial}) THEN 'as recorded' ELSE 'the trailing instance index this enumerator appends was removed' END AS device_serial_rule, contains(k, '\\') OR k SIMILAR TO '[A-Za-z]:.*' AS is_location, upper(regexp_extract(k, 'VID_[0-9A-Fa-f]{{4}}&PID_[0-9A-Fa-f]{{4}}')) AS device_vid_pid,
    ifnull(list_position(['USBSTOR', 'SCSI', 'USB', 'HID', '-', 'SWD'], upper(split_part(k, '\\', 1))), 5) AS identity_rank, contains(upper(i), 'USB\\CLASS_0E') AS has_usb_class, contains(lower(i), 'subclass') AS has_text, regexp_matches(trim(f), '^[A-Za-z]:\\\\?$') AS is_drive_path, c <> '' AND replace(replace(c, '0', ''), '-', '') <> '{{}}' AS is_real_container,
    trim(replace(regexp_extract(d, 'Ven_([^&]*)&Prod_([^&]*)', 1) || ' ' || regexp_extract(d, 'Ven_([^&]*)&Prod_([^&]*)', 2), '_', ' ')) AS device_id_product
    FROM (SELECT DISTINCT normalised_instance_id AS k, compatible_ids AS i, friendly_name AS f, container_id AS c, device_id AS d FROM devnode)""".format(tail=case_sql._tail("k"), generated=case_sql._generated("k"), recorded=case_sql._recorded("k"), serial=case_sql._serial("k"))
)
def macro_suite(spark, sf_dir):
    """Every scalar function over identities."""
    d = case_of(spark, sf_dir).table("devnode").select(F.col("normalised_instance_id").alias("k"), F.col("compatible_ids").alias("i"), F.col("friendly_name").alias("f"), F.col("container_id").alias("c"), F.col("device_id").alias("d")).distinct()
    of_key = (m.has_instance_id, m.identity_tail, m.is_generated_serial, m.identity_enumerator, m.appends_instance_index, m.device_serial_recorded, m.device_serial, m.device_serial_rule, m.is_location, m.device_vid_pid)
    return d.select(
        "k", *[f(F.col("k")).alias(f.__name__) for f in of_key], m.identity_rank(m.identity_enumerator(F.col("k"))).alias("identity_rank"), m.has_usb_class(F.col("i"), "0e").alias("has_usb_class"), m.has_text(F.col("i"), "subclass").alias("has_text"), m.is_drive_path(F.col("f")).alias("is_drive_path"),
        m.is_real_container(F.col("c")).alias("is_real_container"), m.device_id_product(F.col("d")).alias("device_id_product"),
    )


@query("SELECT o_orderkey AS id, date_trunc('day', o_orderdate) + INTERVAL 300 MINUTE AS standard_utc, date_trunc('day', o_orderdate) + INTERVAL 240 MINUTE AS daylight_utc FROM orders")
def seasonal_candidates(spark, sf_dir):
    """Both UTC readings of wall-clock times."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy/MM/dd 00:00:00").alias("local_text"))
    return timeline.seasonal_candidates(o, 300, -60)
