"""What is read from event logs: a rule for each kind of record, with its meaning and the places of its fields.

A rule's fields are candidate paths below the element that `within` names; `*` stands for any one element, and the
first match counts. A field is called by its last name, or by what follows `>`; its role is that of its name, or what
follows `=`. The values are fixed: what the records mean and where their fields lie.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

# Roles of fields by name.
ROLES = {
    "DeviceInstanceId": "device_instance_id", "DeviceInstanceID": "device_instance_id", "InstanceId": "device_instance_id", "ParentId": "device_instance_id", "DiskInstancePath": "device_instance_id", "DeviceId": "device_instance_id", "Prop_DevnodeId": "device_instance_id", "Prop_DeviceId": "device_instance_id",
    "Prop_DeviceInstanceId": "device_instance_id", "ParentDeviceInstanceId": "parent_instance_id", "VolumeId": "volume_guid", "VolumeCorrelationId": "volume_guid", "VolumeLabel": "volume_label", "DeviceName": "device_name", "BusType": "bus_type", "VendorId": "vendor", "Manufacturer": "vendor",
    "ProductId": "product", "Model": "product", "DriverDescription": "product", "ProductRevision": "revision", "Revision": "revision", "DeviceSerialNumber": "serial", "SerialNumber": "serial", "DiskNumber": "disk_number", "VolumeNumber": "volume_number", "PartitionOffset": "partition_offset", "Capacity": "capacity",
    "Size": "capacity", "Mbr": "boot_record", "PartitionTable": "disk_layout", "ClassGuid": "class_guid", "DriverName": "driver_name", "DriverFileName": "driver_name", "FailureName": "driver_name", "MiniportName": "driver_name", "DriverVersion": "driver_version", "FrameworkVersion": "driver_version",
    "DriverDate": "driver_date", "ServiceName": "service_name", "Problem": "problem_code", "Status": "status", "InstallStatus": "status", "AddServiceStatus": "status", "NtStatus": "status", "HRESULT": "status", "ProcessName": "process_name", "DismountReason": "reason", "Reason": "reason", "TargetUserName": "account",
    "LogonType": "logon_type", "FileSystem": "file_system",
}
# Roles of the names in records of names and values, whatever their case.
NAMED_ROLES = {"deviceinstanceid": "device_instance_id", "deviceid": "device_instance_id", "prop_devnodeid": "device_instance_id", "prop_deviceid": "device_instance_id", "prop_deviceinstanceid": "device_instance_id", "drivername": "driver_name", "classguid": "class_guid", "servicename": "service_name", "status": "status", "problem": "problem_code"}


@dataclass(frozen=True)
class Rule:
    """gate: what must be true of a record to be kept. Without a provider the rule is for any."""

    channel: str
    provider: str
    event: int
    kind: str
    gate: str
    meaning: str
    within: str = "EventData"
    fields: str = ""

    @property
    def id(self) -> str:
        return ":".join(p for p in (self.channel, self.provider, str(self.event)) if p)

    @cached_property
    def places(self) -> tuple[tuple[tuple[str, ...], str, str], ...]:
        """(path, name, role) of each field."""
        out = []
        for told in self.fields.split():
            told, _, role = told.partition("=")
            path, _, name = told.partition(">")
            last = path.rsplit(".", 1)[-1]
            out.append(((*self.within.split("."), *path.split(".")), name or last, role or ROLES.get(last, "detail")))
        return tuple(out)


_PNP, _DF, _DSM, _NTFS = "Microsoft-Windows-Kernel-PnP/Configuration", "Microsoft-Windows-DriverFrameworks-UserMode/Operational", "Microsoft-Windows-DeviceSetupManager/Admin", "Microsoft-Windows-Ntfs/Operational"
_VOLUME, _POWER = "Microsoft-Windows-StorageVolume/Operational", "Microsoft-Windows-Kernel-Power"
_IDENTITY = "VolumeId VolumeCorrelationId VolumeLabel DeviceName BusType VendorId ProductId ProductRevision DeviceSerialNumber"
#: The place of a record's names and values.
PAIRS = "EventData.Data"
# The rules.
RULES = (
    Rule(_PNP, "", 400, "install", "usb", "device configured: a driver was selected and installed for the device", fields="DeviceInstanceId ParentDeviceInstanceId ClassGuid DriverName DriverVersion DriverDate DriverProvider MatchingDeviceId Status"),
    Rule(_PNP, "", 410, "install", "usb", "device started: the driver stack for the device was brought up", fields="DeviceInstanceId ClassGuid ServiceName DriverName LowerFilters UpperFilters Problem Status"),
    Rule(_PNP, "", 420, "disconnect", "usb", "device node removed or reported a problem", fields="DeviceInstanceId ClassGuid Problem Status"),
    Rule(_PNP, "", 430, "other", "usb", "device installation activity, reported in the Data name/value form", PAIRS),
    Rule("System", "Microsoft-Windows-Kernel-PnP", 219, "fault", "usb", "a driver failed to load for the device", fields="DriverName=device_instance_id FailureName Status"),
    Rule("System", "Microsoft-Windows-UserPnp", 20001, "install", "usb", "driver installation completed for the device", "UserData.*", "DeviceInstanceID DriverName DriverFileName DriverDescription DriverVersion DriverProvider InstallStatus"),
    Rule("System", "Microsoft-Windows-UserPnp", 20003, "install", "usb", "a service was associated with the device during installation", "UserData.*", "DeviceInstanceID ServiceName DriverFileName AddServiceStatus"),
    Rule("System", "Microsoft-Windows-DriverFrameworks-UserMode", 10000, "install", "usb", "user-mode driver framework began installing the device", "UserData.*", "DeviceId FrameworkVersion"),
    Rule(_DF, "", 2003, "other", "usb", "the user-mode driver host was asked to load drivers for this device; the drivers loading is not the same as the device arriving, because this also happens at boot and when a driver restarts", "UserData.*", "InstanceId DeviceInstanceId LifetimeId"),
    Rule(_DF, "", 2100, "other", "usb", "the user-mode driver host received a PnP or power operation for this device; which operation is carried in the request codes and not in the event ID, so this is not by itself a removal", "UserData.*", "InstanceId DeviceInstanceId LifetimeId MajorFunction MinorFunction Operation"),
    Rule(_DF, "", 2102, "other", "usb", "the user-mode driver host forwarded a finished PnP or power operation to the lower driver for this device; which operation is carried in the request codes and not in the event ID, so this is not by itself a removal", "UserData.*", "InstanceId DeviceInstanceId LifetimeId MajorFunction MinorFunction Operation NtStatus Status"),
    Rule(_VOLUME, "", 1001, "connect", "usb", "a volume on the disk became available", fields="DiskInstancePath DiskNumber VolumeNumber PartitionOffset"),
    Rule(_VOLUME, "", 1002, "disconnect", "usb", "a volume on the disk went away", fields="DiskInstancePath DiskNumber VolumeNumber PartitionOffset Deleted"),
    Rule("Microsoft-Windows-Storsvc/Diagnostic", "", 1001, "inventory", "usb", "disk described by the storage service: model, serial, bus and parent device", fields="ParentId DiskNumber VendorId ProductId ProductRevision SerialNumber BusType FileSystem Size PartitionStyle VolumeCount"),
    Rule("Microsoft-Windows-Partition/Diagnostic", "", 1006, "inventory", "usb", "disk described by the partition driver: model, serial, capacity and geometry", fields="ParentId RegistryId DiskNumber Manufacturer Model Revision SerialNumber Capacity BusType PartitionStyle PartitionCount DiskId UserRemovalPolicy Mbr PartitionTable"),
    Rule("Microsoft-Windows-Storage-Storport/Operational", "", 551, "inventory", "miniport", "storage port driver described an attached device", fields="MiniportName VendorId ProductId SerialNumber AdapterSerialNumber ClassDeviceGuid Removable"),
    Rule(_NTFS, "", 4, "connect", "usb", "an NTFS volume was mounted", fields=f"{_IDENTITY} IsBootVolume AdapterSerialNumber"),
    Rule(_NTFS, "", 9, "other", "usb", "NTFS reported on a volume, naming the device behind it", fields=f"{_IDENTITY} Reason Flags"),
    Rule(_NTFS, "", 300, "disconnect", "usb", "an NTFS volume was dismounted", fields=f"{_IDENTITY} DismountReason ProcessName ProcessId"),
    Rule(_NTFS, "", 303, "disconnect", "usb", "an NTFS volume dismount completed", fields=f"{_IDENTITY} DismountReason ProcessName ProcessId"),
    Rule(_DSM, "", 121, "fault", "usb", "device setup failed for the device", fields="Prop_DevnodeId HRESULT"),
    Rule(_DSM, "", 123, "other", "usb", "device setup reported elapsed time for the device", fields="Prop_DeviceId Prop_Seconds"),
    Rule(_DSM, "", 126, "install", "usb", "a driver package was applied to the device", fields="Prop_DeviceInstanceId Prop_PackageId"),
    Rule(_DSM, "", 127, "other", "usb", "device setup activity, reported in the Data name/value form", PAIRS),
    Rule(_DSM, "", 234, "other", "usb", "device setup reported elapsed time for the device", fields="Prop_DevnodeId Prop_MilliSeconds"),
    Rule("System", "EventLog", 6005, "session", "any", "the event log service started, which dates the host starting up"),
    Rule("System", "EventLog", 6006, "session", "any", "the event log service stopped, which dates a clean shutdown"),
    Rule("System", "EventLog", 6008, "session", "any", "a later start reported that the previous shutdown was unexpected: the host lost power or stopped without closing its logs, at a moment this record does not date"),
    Rule("System", "EventLog", 6013, "session", "any", "the running system reported its uptime, which it does once a day and which places the host as switched on at this moment"),
    Rule("System", "Microsoft-Windows-Kernel-General", 12, "session", "any", "the operating system started"),
    Rule("System", "Microsoft-Windows-Kernel-General", 13, "session", "any", "the operating system is shutting down"),
    Rule("System", "User32", 1074, "session", "any", "a shutdown or restart was requested, naming the process that asked for it and the user in whose name it was asked", fields="param1>Process=process_name param3>Reason=reason param5>ShutdownType param7>User"),
    Rule("System", _POWER, 42, "session", "any", "the host entered sleep"),
    Rule("System", _POWER, 107, "session", "any", "the host resumed from sleep"),
    Rule("System", _POWER, 41, "session", "any", "the host restarted, having found that it did not shut down cleanly beforehand"),
    Rule("Security", "", 4624, "logon", "any", "an account logged on, with the type saying whether that was at the console, over the network or as a service", fields="TargetUserName TargetDomainName LogonType WorkstationName IpAddress ProcessName"),
    Rule("Security", "", 4634, "logon", "any", "an account logged off", fields="TargetUserName TargetDomainName LogonType"),
    Rule("Security", "", 4647, "logon", "any", "a user initiated a log off, which is the person acting rather than the session ending", fields="TargetUserName TargetDomainName"),
    Rule("Security", "", 4800, "logon", "any", "the workstation was locked", fields="TargetUserName TargetDomainName"),
    Rule("Security", "", 4801, "logon", "any", "the workstation was unlocked", fields="TargetUserName TargetDomainName"),
)


def found(fields: list[tuple[str, str]], path: tuple[str, ...]) -> tuple[str, str] | None:
    """(path, text) of the first field of a record whose path matches, `*` standing for any one element."""
    for at, value in fields:
        parts = at.split(".")
        if len(parts) == len(path) and all(p in ("*", q) for p, q in zip(path, parts, strict=True)):
            return at, value
    return None


def extracted(rule: Rule, fields: list[tuple[str, str]]) -> list[dict]:
    """The rule's fields in a record's (path, text), attributes left out; paths are without the outermost element."""
    below = [(p.removeprefix("Event."), v) for p, v in fields if "@" not in p]
    if rule.within == PAIRS:
        named, out = None, []
        for at, value in below:
            if not at.startswith("EventData."):
                continue
            last = at.rsplit(".", 1)[-1]
            if last == "Name":
                named = value
            elif last == "Value" and named:
                out.append({"name": named, "role": NAMED_ROLES.get(named.lower(), "detail"), "value": value, "path": f"{PAIRS}.{named}"})
                named = None
        return out
    out = []
    for path, name, role in rule.places:
        if (hit := found(below, path)) and hit[1]:
            out.append({"name": name, "role": role, "value": hit[1], "path": hit[0]})
    return out
