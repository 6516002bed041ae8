"""Scalar functions over columns: device identities, time zones, clock defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEXED_ENUMERATORS = ("USBSTOR", "STORAGE", "SWD", "SCSI", "WPDBUSENUM")
IDENTITY_RANKS = {"USBSTOR": 1, "SCSI": 2, "USB": 3, "HID": 4, "SWD": 6}
PLACEHOLDER_CONTAINERS = ("{00000000-0000-0000-0000-000000000000}", "{00000000-0000-0000-ffff-ffffffffffff}")
#: Name of each clock default by its day.
EPOCHS = {"1601-01-01": "FILETIME zero, 1601-01-01", "1970-01-01": "the Unix epoch, 1970-01-01", "1980-01-01": "the FAT epoch, 1980-01-01", "2000-01-01": "an unset device clock at 2000-01-01"}
RUNNING_ON = "an unset device clock running on from 2000-01-01"


def has_instance_id(key: Column) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit("\\"))) >= 2


def identity_tail(key: Column) -> Column:
    return F.when(has_instance_id(key), F.substring_index(key, "\\", -1)).otherwise("")


def is_generated_serial(key: Column) -> Column:
    tail = identity_tail(key)
    return (F.length(tail) > 1) & (F.substring(tail, 2, 1) == "&")


def identity_enumerator(key: Column) -> Column:
    return F.upper(F.substring_index(key, "\\", 1))


def appends_instance_index(key: Column) -> Column:
    return identity_enumerator(key).isin(*INDEXED_ENUMERATORS)


def device_serial_recorded(key: Column) -> Column:
    tail = identity_tail(key)
    return F.when(is_generated_serial(key) | tail.startswith("{"), "").otherwise(tail)


def device_serial(key: Column) -> Column:
    recorded = device_serial_recorded(key)
    return F.when(appends_instance_index(key), F.regexp_replace(recorded, "&[0-9]+$", "")).otherwise(recorded)


def device_serial_rule(key: Column) -> Column:
    recorded = device_serial_recorded(key)
    return F.when(recorded == "", "").when(recorded != device_serial(key), "the trailing instance index this enumerator appends was removed").otherwise("as recorded")


def is_location(value: Column) -> Column:
    return F.coalesce((value != "") & (value.contains("\\") | value.rlike("^[A-Za-z]:")), F.lit(False))


def device_vid_pid(key: Column) -> Column:
    return F.upper(F.regexp_extract(key, "VID_[0-9A-Fa-f]{4}&PID_[0-9A-Fa-f]{4}", 0))


def is_real_container(container: Column) -> Column:
    return (container != "") & ~F.lower(container).isin(*PLACEHOLDER_CONTAINERS)


def identity_rank(enumerator: Column) -> Column:
    return reduce(lambda out, kv: F.when(F.upper(enumerator) == kv[0], kv[1]).otherwise(out), IDENTITY_RANKS.items(), F.lit(5))


def has_usb_class(ids: Column, code: str) -> Column:
    return F.upper(F.coalesce(ids, F.lit(""))).contains("USB\\CLASS_" + code.upper())


def has_text(value: Column, part: str) -> Column:
    return F.upper(F.coalesce(value, F.lit(""))).contains(part.upper())


def is_drive_path(name: Column) -> Column:
    return F.trim(name).rlike(r"^[A-Za-z]:\\?$")


def device_id_product(key: Column) -> Column:
    """`Ven_x&Prod_y` as "x y"; empty without both."""
    pattern = "Ven_([^&]*)&Prod_([^&]*)"
    both = F.concat(F.regexp_extract(key, pattern, 1), F.lit(" "), F.regexp_extract(key, pattern, 2))
    return F.trim(F.regexp_replace(F.replace(both, F.lit("_"), F.lit(" ")), " +", " "))


def local_timestamp(text: Column) -> Column:
    """A zone-less wall-clock text, dashed or slashed, as TIMESTAMP_NTZ of microseconds; null where it isn't one."""
    shaped = F.regexp_replace(F.when(text.rlike(r"^\s*\d{4,}[-/]\d{1,2}[-/]\d{1,2}([ T]|\s*$)"), text), r"^(\s*\d+)/(\d+)/(\d+)", "$1-$2-$3")
    return F.regexp_replace(shaped, r"(\.\d{6})\d+", "$1").try_cast("timestamp_ntz")


def epoch_default_local(ts: Column) -> Column:
    """The clock default that a local time shows, or ''."""
    out = F.when((ts >= F.lit("2000-01-01").cast("timestamp_ntz")) & (ts < F.lit("2000-02-01").cast("timestamp_ntz")), RUNNING_ON).otherwise("")
    for day, name in EPOCHS.items():
        out = F.when(ts.cast("date") == F.lit(day).cast("date"), name).otherwise(out)
    return F.when(ts.isNull(), "").otherwise(out)


def epoch_default_name(ts: Column) -> Column:
    """The same for a UTC time, with 14 hours of zones on either side of a default."""
    out = F.when((ts >= F.lit("2000-01-01").cast("timestamp_ntz")) & (ts < F.lit("2000-02-01").cast("timestamp_ntz")), RUNNING_ON).otherwise("")
    for day, name in EPOCHS.items():
        middle = F.lit(day).cast("timestamp_ntz")
        out = F.when(ts.between(middle - F.expr("INTERVAL 14 HOURS"), middle + F.expr("INTERVAL 14 HOURS")), name).otherwise(out)
    return F.when(ts.isNull(), "").otherwise(out)


def millis(ts: Column) -> Column:
    """Milliseconds since 1970; differences count boundaries."""
    return F.unix_millis(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def device_key(raw: Column) -> Column:
    """A device path or instance id as an upper-case identity key: no NULs, prefix or interface GUID."""
    bare = F.trim(F.regexp_replace(raw, "\x00", ""))
    bare = F.regexp_replace(bare, r"^.*(_\?\?_|\\\?\?\\)", "")
    parts = F.split(bare, "#")
    parts = F.when((F.size(parts) > 1) & F.element_at(parts, -1).rlike(r"^\{[0-9A-Fa-f-]+\}$"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    return F.upper(F.array_join(parts, "\\"))


def rot13(text: Column) -> Column:
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, lower + upper, lower[13:] + lower[:13] + upper[13:] + upper[:13])


def filetime(raw: Column) -> Column:
    """A FILETIME as TIMESTAMP_NTZ; zero, the largest value and the FAT epoch are null."""
    value = raw.cast("decimal(20,0)")
    micros = F.floor((value - F.lit(116444736000000000).cast("decimal(20,0)")) / 10).cast("long")
    sound = (value > 0) & (value < F.lit(9223372036854775807).cast("decimal(20,0)")) & (value != F.lit(119600064000000000).cast("decimal(20,0)"))
    return F.when(sound, F.timestamp_micros(micros).cast("timestamp_ntz"))
