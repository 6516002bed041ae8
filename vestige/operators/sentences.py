"""What the views say in words. Fixed values; a name in braces is a value that is put in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a record's time stands for.
OPENED = "the recorded time the target was last opened"
REWRITTEN = "the time the shortcut itself was last written, which in the {context} folder is when this target was most recently opened"
WRITTEN = "the time the shortcut itself was last written. This shortcut is from {context}, where the shell does not rewrite it on each open, so that time may be when it was created, edited, pinned or copied rather than when the target was opened"
UNRECORDED = "an unrecorded location"
TARGET = "the time the target file was last written, which describes the file and not any opening of it: this record carries no time for when it was opened"
FAT = "no time: the record stores the FAT epoch, 1980-01-01 00:00:00, which is what a zeroed DOS date becomes. The target — usually a drive root — carried no timestamp of its own"
NO_TIME = "no time is recorded on this record"
BAG = "the time the bag key was last written, which is when Explorer last updated the view and not necessarily when the folder was opened"
LISTED_FIRST = "the time the MRU key was last written, which dates the most recent entry in the list, and this is that entry"
LISTED = "the time the MRU key was last written, which dates the most recent entry in the list and not this one: this entry is at position {position}, so it is older than this and by an unrecorded amount"
LAUNCHED = "the last time the shell recorded this being launched"
NOT_LAUNCHED = "no launch time is recorded on this entry"
EXECUTED = "the most recent execution of this programme that Windows still records; earlier ones are overwritten after eight"
NOT_EXECUTED = "no execution time survives on this record"
# What a route rests on.
SERIAL = "EMDMgmt records this volume serial against this device in one key name"
LABEL_BOUND = "the label is unique to this device on this host; the record carries no moment of its own to check a connection window against, only a time it must be older than"
LABEL_TARGET = "the label is unique to this device on this host; the only time this record carries is its target file's own write time, which may have been set on another computer before the file was copied here, so no connection window on this host is checked against it"
LABEL_COVERED = "the label is unique to this device and a connection window independently places it on the machine at this time"
LABEL = "the label is unique to this device on this host; nothing places the device on the machine at this time"
LETTER_AGAINST = "the letter maps to this device now, and the record's own volume label names a different device: the mount table holds the mapping as it stood when the hive was read and is dated by nothing, while the label is what the volume called itself when the record was made. The row is kept and capped rather than dropped, because the mapping is real evidence"
LETTER_BOUND = "the letter maps to this device now; the record carries no moment of its own to check a connection window against, only a time it must be older than"
LETTER_TARGET = "the letter maps to this device now; the only time this record carries is its target file's own write time, which describes the file rather than any use of it and may predate the volume reaching this host, so no connection window is checked against it"
LETTER_COVERED = "the letter maps to this device and a connection window covers the time of this record"
LETTER = "the letter maps to this device now; nothing places the device on the machine when this record was made"
PREFETCH = "the prefetch file records this volume serial, a shell link records the same serial for a removable volume on {letter}, and that letter links to this device ({route})"
PREFETCH_AGAINST = ". That last hop is contradicted: the shell link labels this volume {label}, which the portable device list gives to a different device, so the letter mapping is out of date and names the wrong one"
PREFETCH_COVERED = "; a connection window covers the execution"
PREFETCH_ALONE = "; nothing places the device on the machine at that time"
PREFETCH_SEVERAL = ". This serial was recorded against more than one drive letter in this case, so the match to a volume is not the single answer an exact serial reads as"
SOLE = "this record is on removable media and exactly one removable device was connected when it was made: this one, which arrived at {arrived} UTC, {seconds} seconds before the record. No drive letter or label was needed to reach it, and none was used"
# What an entry of the timeline means.
NO_CAPACITY = "the partition driver described this disk with no capacity, which is what a removal looks like from this channel. It is not treated as one: an empty slot in a card reader reports the same thing while the reader stays in the port"
RECORDED = "the time this record was written to {channel}"
CONNECTED = "the earliest record placing this device on the machine"
REMOVED = "the record of this device being removed"
SECTION = "the moment this install section opened in setupapi.dev.log"
FIRST_INSTALL = "the registry records this as when this device was first installed on the host"
DRIVER_INSTALL = "the registry records this as when the current driver for this device was installed"
ARRIVAL = "the registry records this as the most recent time this device was connected; it is one stored state and not a connection history"
REMOVAL = "the registry records this as the most recent time this device was removed; it is one stored state and not a connection history"
KEY_WRITTEN = "when this device key was last written, which is the last time Windows changed something about the device and not necessarily when it was used"
RUN_LATEST = "the most recent execution of this programme Windows recorded"
RUN_EARLIER = "an earlier execution of this programme Windows still records"
ITEM = "the modified time the shell item stored, recorded as local wall clock with no zone"
LINK_ITEM = "the modified time the link's own shell item stored, recorded as local wall clock with no zone"
MOUNT_POINT = "when the mount point key was last written, which dates the most recent change to this mapping and not any use of the volume"
LAYOUT = "when the collector read this disk layout, which dates the collection and not the device"
# How a window ended.
OPENED_BY = "opened by {opened_by}; {records} record(s) support this window; "
SUPERSEDED = "no removal was recorded after it, and the device arrived again at {at}, so it left at some unrecorded point before that"
SHUT_DOWN = "no removal was recorded after it, and the host went off at {at}, which is why: a shutdown with the device still attached records no departure. Nothing places the device on the machine after that"
BROKE_OFF = "no removal was recorded after it, and the host stopped without shutting down cleanly: the last record before the outage is {after} and the boot that reported the unclean stop is {before}. The stop is somewhere between the two and no record dates it, so nothing places the device on the machine after the earlier of them"
UNDATED = "no removal was recorded after it, and the host is recorded as having stopped without shutting down cleanly — but the boot that reported that stop is not in the evidence, so nothing dates it and it bounds nothing. The window is open because no record closes it, not because the device is known to have stayed"
OPEN = "no removal was recorded after it, and the host was not recorded going off either, so the evidence simply ends with the device attached"
ENDED = "the next removal recorded came {seconds} seconds later"
# What a moment of the report is.
MOMENT_ARRIVAL = "this device was connected to the machine"
MOMENT_REMOVAL = "this device was removed from the machine"
MOMENT = ", and {records} records evidence it"
MOMENT_ACROSS = ", across {identities} of the identities this device enumerates under"

# What a finding adds to its headline.
RAN = "prefetch records that a programme ran, not that a person ran it, and Windows keeps only the last eight executions of each."
BY_USER = "UserAssist is per user and records what the shell started, so unlike prefetch it evidences a person rather than a process. It records no volume serial and no label, so the drive letter is the only route it offers to a device."
READ = "these ran from elsewhere; the prefetch record says the loader touched a file on this volume, not that the programme was on it."
STRONGEST = "strongest route reached: {best}. A drive letter is reused, so a letter-based link says which device holds the letter now and not which held it when the file was opened."
NO_DEVICE = "no USB device is linked to the drive letter these records name, so what they sat on is not established by this evidence"
CONTESTED = "two routes disagree about which device held the volume. That is a question the evidence has not settled rather than an answer to pick between."
REVIEW = "review is not a tier: a low-value device with a duplicated serial or a class nothing identified still needs looking at"
NO_WINDOW = "no arrival or removal record was selected from the event logs, so how long a device was attached is not established. What is known about when each device was present is in its install and lifecycle dates."
ALIKE = "no identity in the group reported a serial, or Windows generated one. Two visits by two identical devices and two visits by one are the same shape in this evidence."


def column(template: str, **values: Column) -> Column:
    parts = [values[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{(\w+)\}", template)) if p]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def sql(template: str, **values: str) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return " || ".join(f"CAST({values[p]} AS VARCHAR)" if k % 2 else quoted(p) for k, p in enumerate(re.split(r"\{(\w+)\}", template)) if p)
