"""The rule set that comes with the engine, in the JSON shape that rule files have, with the notes that reasons quote."""

# Rules, weights and notes.
RULE_SET = {
    "setup_classes": [
        {"guid": "{4d36e967-e325-11ce-bfc1-08002be10318}", "name": "DiskDrive"},
        {"guid": "{4d36e965-e325-11ce-bfc1-08002be10318}", "name": "CDROM"},
        {"guid": "{4d36e97b-e325-11ce-bfc1-08002be10318}", "name": "SCSIAdapter"},
        {"guid": "{71a27cdd-812a-11d0-bec7-08002be2092f}", "name": "Volume"},
        {"guid": "{533c5b84-ec70-11d2-9505-00c04f79deaf}", "name": "VolumeSnapshot"},
        {"guid": "{4d36e972-e325-11ce-bfc1-08002be10318}", "name": "Net"},
        {"guid": "{4d36e96d-e325-11ce-bfc1-08002be10318}", "name": "Modem"},
        {"guid": "{4d36e978-e325-11ce-bfc1-08002be10318}", "name": "Ports"},
        {"guid": "{4d36e979-e325-11ce-bfc1-08002be10318}", "name": "Printer"},
        {"guid": "{1ed2bbf9-11f0-4084-b21f-ad83a8e6dcdc}", "name": "PrintQueue"},
        {"guid": "{6bdd1fc6-810f-11d0-bec7-08002be2092f}", "name": "Image"},
        {"guid": "{745a17a0-74d3-11d0-b6fe-00a0c90f57da}", "name": "HIDClass"},
        {"guid": "{4d36e96b-e325-11ce-bfc1-08002be10318}", "name": "Keyboard"},
        {"guid": "{4d36e96f-e325-11ce-bfc1-08002be10318}", "name": "Mouse"},
        {"guid": "{4d36e96c-e325-11ce-bfc1-08002be10318}", "name": "Media"},
        {"guid": "{4d36e968-e325-11ce-bfc1-08002be10318}", "name": "Display"},
        {"guid": "{4d36e96e-e325-11ce-bfc1-08002be10318}", "name": "Monitor"},
        {"guid": "{50dd5230-ba8a-11d1-bf5d-0000f805f530}", "name": "SmartCardReader"},
        {"guid": "{53d29ef7-377c-4d14-864b-eb3a85769359}", "name": "Biometric"},
        {"guid": "{eec5ad98-8080-425f-922a-dabf3de3f69a}", "name": "WPD"},
        {"guid": "{36fc9e60-c465-11cf-8056-444553540000}", "name": "USB"},
        {"guid": "{e0cbf06c-cd8b-4647-bb8a-263b43f0f974}", "name": "Bluetooth"},
        {"guid": "{4d36e97d-e325-11ce-bfc1-08002be10318}", "name": "System"},
        {"guid": "{4d36e966-e325-11ce-bfc1-08002be10318}", "name": "Computer"},
        {"guid": "{62f9c741-b25a-46ce-b54c-9bccce08b6f2}", "name": "SoftwareDevice"},
        {"guid": "{f2e7dd72-6468-4e36-b6f1-6488f42c1b52}", "name": "SoftwareComponent"},
    ],
    "categories": [
        {"category": "Storage", "tier": 1, "relevance": "high", "note": "Mass storage: flash drives, external disks, card readers, enclosures."},
        {"category": "MobileDevice", "tier": 1, "relevance": "high", "note": "Phones, tablets, cameras and media players, usually over MTP or PTP."},
        {"category": "Network", "tier": 1, "relevance": "high", "note": "Ethernet, Wi-Fi, broadband and tethering interfaces — a path around the monitored network."},
        {"category": "DockHubComposite", "tier": 1, "relevance": "high", "note": "Docks and port replicators exposing several child functions. A bare hub is tier 2."},
        {"category": "OpticalMedia", "tier": 1, "relevance": "high", "note": "External optical drives and writers."},
        {"category": "PotentialOffensiveDevice", "tier": 1, "relevance": "high", "note": "Interfaces that do not align with the device's apparent purpose: HID beside storage or networking."},
        {"category": "PrinterScanner", "tier": 2, "relevance": "medium", "note": "Printers, scanners and multifunction devices."},
        {"category": "AuthenticationToken", "tier": 2, "relevance": "medium", "note": "Smart card readers, biometric readers and hardware tokens."},
        {"category": "SerialIndustrial", "tier": 2, "relevance": "medium", "note": "Serial and specialist communications adapters."},
        {"category": "AudioVideoCapture", "tier": 2, "relevance": "medium", "note": "Cameras and capture devices."},
        {"category": "DeveloperEmbedded", "tier": 2, "relevance": "medium", "note": "Development boards and programmable devices. No rule assigns this without a vendor reference list."},
        {"category": "StandardHID", "tier": 3, "relevance": "low", "note": "Conventional keyboards, mice and controllers."},
        {"category": "AudioOutput", "tier": 3, "relevance": "low", "note": "Speakers and headsets."},
        {"category": "DisplayDevice", "tier": 3, "relevance": "low", "note": "Monitors and display adapters."},
        {"category": "BluetoothAdapter", "tier": 3, "relevance": "low", "note": "Routine Bluetooth radios."},
        {"category": "PowerOnly", "tier": 3, "relevance": "low", "note": "Charging-only devices. No rule assigns this: a power-only device does not enumerate."},
        {"category": "OtherPeripheral", "tier": 3, "relevance": "low", "note": "Enumerated and recognised, but none of the above."},
        {"category": "Unknown", "tier": 3, "relevance": "review", "note": "Nothing in the evidence said what this is."},
    ],
    "rules": [
        {"id": "offensive.hid_with_storage", "category": "PotentialOffensiveDevice", "tier": 1, "priority": 100, "conditions": [{"fact": "hid_interface"}, {"fact": "storage_identity"}, {"fact": "hub_interface", "negate": True}], "note": "A device presenting as a keyboard or mouse that also carries storage is the shape of a keystroke-injection tool. The hub condition is what separates one device doing both from a dock with a keyboard and a memory stick plugged into it: see offensive.hid_with_network."},
        {"id": "offensive.hid_with_network", "category": "PotentialOffensiveDevice", "tier": 1, "priority": 99, "conditions": [{"fact": "hid_interface"}, {"fact": "network_interface"}, {"fact": "hub_interface", "negate": True}], "note": "HID beside a network interface is the shape of a device that types and then exfiltrates. Not where the device is a hub: a dock is a hub with a keyboard, an ethernet port and a monitor hanging off it, and reading that shape as a keystroke injector flagged every dock on the reference host. A keystroke injector is a composite device presenting its own interfaces, not a hub other devices attach through. Where a hub does carry both, the pairing is still recorded as mixed_interfaces_behind_hub and the device is still tier 1, as a dock."},
        {"id": "software.enumerated", "category": "OtherPeripheral", "tier": 3, "priority": 95, "conditions": [{"fact": "software_device"}], "note": "Every identity is a software-enumerated node. Windows creates these; nobody plugged one in. Without this rule the WAN miniports sit in tier 1 above the memory sticks, on the strength of a network class GUID."},
        {"id": "optical.class", "category": "OpticalMedia", "tier": 1, "priority": 92, "conditions": [{"fact": "optical_identity"}, {"fact": "usb_attached"}], "note": "A CD-ROM class device attached over USB. Stated as the attachment rather than as the absence of an internal bus: the note has always said 'over USB', and read the other way an optical device whose bus this collection never reached would be promoted to tier 1 on a silence. A virtual CD-ROM on a storage device is caught by the emulated rule."},
        {"id": "storage.emulated", "category": "PotentialOffensiveDevice", "tier": 1, "priority": 94, "conditions": [{"fact": "optical_identity"}, {"fact": "storage_identity"}, {"fact": "usb_attached"}], "note": "Storage and an emulated optical volume on one USB device is how installer payloads are delivered. The USB condition is not tidying: without it the virtual machine's own SATA CD-ROM is reported as a potentially offensive device."},
        {"id": "storage.internal", "category": "Storage", "tier": 3, "priority": 91, "conditions": [{"fact": "storage_identity"}, {"fact": "internal_bus"}], "note": "Storage enumerated on a fixed bus and on no USB bus: the machine's own disk. Reported because it explains the file records that reach no removable device, and kept out of tier 1 because it is not one."},
        {"id": "storage.bus_not_observed", "category": "Storage", "tier": 3, "priority": 91, "conditions": [{"fact": "storage_identity"}, {"fact": "usb_attachment_not_observed"}], "note": "Storage this collection never saw on any bus. Ordinarily the machine's own disk, but the evidence does not say so, and an incomplete collection produces the same silence — so it is tiered like an internal disk and described as the open question it is."},
        {"id": "storage.identity", "category": "Storage", "tier": 1, "priority": 90, "conditions": [{"fact": "storage_identity"}], "note": "A USBSTOR or SCSI disk identity, or USB base class 08."},
        {"id": "mobile.mtp_without_storage", "category": "MobileDevice", "tier": 1, "priority": 88, "conditions": [{"fact": "mtp_interface"}, {"fact": "storage_identity", "negate": True}], "note": "A portable device must not be missed because it never appeared under USBSTOR."},
        {"id": "mobile.apple", "category": "MobileDevice", "tier": 1, "priority": 89, "conditions": [{"fact": "apple_mobile_service"}], "note": "The Apple mobile device service names the device whatever else it exposes."},
        {"id": "network.interface", "category": "Network", "tier": 1, "priority": 86, "conditions": [{"fact": "network_interface"}], "note": "A USB network adapter is a route around the monitored network path."},
        {"id": "dock.hub_with_functions", "category": "DockHubComposite", "tier": 1, "priority": 84, "conditions": [{"fact": "hub_interface"}, {"fact": "multiple_interfaces"}, {"fact": "internal_hub", "negate": True}], "note": "A dock is inferred from its child functions, not from a class of its own. The machine's own root hub is excluded: everything on the machine hangs off it, and reading that as a dock puts the motherboard in tier 1."},
        {"id": "printer.interface", "category": "PrinterScanner", "tier": 2, "priority": 80, "conditions": [{"fact": "printer_interface"}], "note": "USB base class 07, the printer setup class, or a print queue."},
        {"id": "scanner.imaging", "category": "PrinterScanner", "tier": 2, "priority": 78, "conditions": [{"fact": "imaging_interface"}, {"fact": "mtp_interface", "negate": True}], "note": "The still image class covers scanners and stills cameras alike and cannot be split by class alone, so both land here rather than one of them being asserted wrongly."},
        {"id": "auth.smartcard", "category": "AuthenticationToken", "tier": 2, "priority": 76, "conditions": [{"fact": "smartcard_interface"}]},
        {"id": "auth.biometric", "category": "AuthenticationToken", "tier": 2, "priority": 75, "conditions": [{"fact": "biometric_interface"}]},
        {"id": "serial.interface", "category": "SerialIndustrial", "tier": 2, "priority": 70, "conditions": [{"fact": "serial_interface"}], "note": "A COM port over USB carries anything the far end sends."},
        {"id": "capture.video", "category": "AudioVideoCapture", "tier": 2, "priority": 68, "conditions": [{"fact": "video_interface"}]},
        {"id": "hub.internal", "category": "OtherPeripheral", "tier": 3, "priority": 41, "conditions": [{"fact": "hub_interface"}, {"fact": "internal_hub"}], "note": "The machine's own USB root hub. It is part of the motherboard rather than something anyone plugged in, and what passed through it is reported in its own right. Still listed, because a root hub install dates when the machine's USB stack was built."},
        {"id": "dock.hub_alone", "category": "DockHubComposite", "tier": 2, "priority": 40, "conditions": [{"fact": "hub_interface"}, {"fact": "internal_hub", "negate": True}], "note": "A hub with no child functions recorded. Tier 2, because what passed through it was not seen."},
        {"id": "hid.standard", "category": "StandardHID", "tier": 3, "priority": 30, "conditions": [{"fact": "hid_interface"}], "note": "Reached only when no storage or network interface sits alongside."},
        {"id": "audio.output", "category": "AudioOutput", "tier": 3, "priority": 28, "conditions": [{"fact": "audio_interface"}]},
        {"id": "display.class", "category": "DisplayDevice", "tier": 3, "priority": 26, "conditions": [{"fact": "display_interface"}]},
        {"id": "bluetooth.radio", "category": "BluetoothAdapter", "tier": 3, "priority": 24, "conditions": [{"fact": "wireless_interface"}]},
        {"id": "other.enumerated", "category": "OtherPeripheral", "tier": 3, "priority": 10, "conditions": [{"fact": "known_class"}], "note": "The class was recognised and none of the rules above applied."},
    ],
    "indicators": [
        {"fact": "storage_identity", "weight": 20, "group": "high_value", "note": "Storage is the capability most investigations turn on."},
        {"fact": "mounted_volume", "weight": 15, "group": "high_value", "note": "The device was given a volume, so the system was prepared to read and write it."},
        {"fact": "file_activity", "weight": 20, "group": "high_value", "note": "File records were attributed to this device. Not that files moved — that records name it."},
        {"fact": "executable_run_from_removable", "weight": 22, "group": "high_value", "note": "A programme was executed from a volume this device carried. Weighted above file activity: opening a file from a device is ordinary use, and running code off one is the shape of both exfiltration tooling and malware carried on removable media. It says a programme ran, not that anyone intended it to."},
        {"fact": "mtp_interface", "weight": 15, "group": "high_value"},
        {"fact": "network_interface", "weight": 18, "group": "high_value"},
        {"fact": "printer_interface", "weight": 12, "group": "high_value"},
        {"fact": "imaging_interface", "weight": 8, "group": "high_value"},
        {"fact": "serial_interface", "weight": 8, "group": "high_value"},
        {"fact": "optical_identity", "weight": 10, "group": "high_value"},
        {"fact": "multiple_interfaces", "weight": 8, "group": "high_value", "note": "A device exposing several classes can do several things."},
        {"fact": "smartcard_interface", "weight": 6, "group": "high_value"},
        {"fact": "biometric_interface", "weight": 6, "group": "high_value"},
        {"fact": "video_interface", "weight": 6, "group": "high_value"},
        {"fact": "apple_mobile_service", "weight": 12, "group": "high_value"},
        {"fact": "wireless_interface", "weight": 3, "group": "high_value", "note": "A radio is a communications path, whatever else the device is."},
        {"fact": "hub_interface", "weight": 2, "group": "high_value", "note": "A hub is what other devices attach through, so what passed through it was not necessarily seen."},
        {"fact": "hid_with_storage_or_network", "weight": 25, "group": "suspicion", "note": "The class the device reports does not match what it can do."},
        {"fact": "mixed_interfaces_behind_hub", "weight": 4, "group": "suspicion", "note": "The same pairing with a hub between the two interfaces, which is what a dock looks like. Weighted low and not a review flag: on the reference host this was every dock and every hub-and-ethernet adapter, and flagging them buried the real cases. Recorded so an analyst who wants to look can."},
        {"fact": "no_serial", "weight": 6, "group": "suspicion", "note": "Nothing separates this device from another of the same model."},
        {"fact": "duplicate_serial", "weight": 8, "group": "suspicion"},
        {"fact": "no_vid_pid", "weight": 4, "group": "suspicion"},
        {"fact": "unknown_class", "weight": 5, "group": "suspicion"},
        {"fact": "vendor_specific_interface", "weight": 4, "group": "suspicion", "note": "A vendor-specific interface is undocumented by definition."},
        {"fact": "short_lived_connection", "weight": 6, "group": "suspicion", "note": "A connection too short for ordinary use."},
        {"fact": "repeated_connection", "weight": 5, "group": "suspicion"},
        {"fact": "partial_artefacts", "weight": 4, "group": "suspicion", "note": "No registry key in this collection: deleted, not collected, or never written."},
        {"fact": "hid_only", "weight": -8, "group": "lower_value", "note": "A keyboard or mouse and nothing else. Reduces priority; never suppresses the device."},
        {"fact": "audio_only", "weight": -6, "group": "lower_value"},
        {"fact": "display_interface", "weight": -4, "group": "lower_value"},
        {"fact": "internal_hub", "weight": -8, "group": "lower_value"},
        {"fact": "internal_bus", "weight": -20, "group": "lower_value", "note": "The machine's own disk rather than something attached to it."},
        {"fact": "usb_attachment_not_observed", "weight": -20, "group": "lower_value", "note": "Storage this collection never saw on a bus. The same weight as an internal disk, because the two are indistinguishable from here and ranking an unknown above a memory stick would be a claim."},
        {"fact": "software_device", "weight": -10, "group": "lower_value", "note": "A software-enumerated node, not a thing anyone plugged in."},
    ],
    "review_facts": [
        {"fact": "unknown_class", "note": "The device class is unknown."},
        {"fact": "no_serial", "unless": ["hid_interface", "hub_interface", "wireless_interface", "smartcard_interface"], "note": "No serial number is present, or Windows generated it.", "unless_note": "A keyboard, a hub, a Bluetooth radio and a smartcard reader do not carry serials, so the absence of one says nothing about them. Flagged on every such device it swamped the real cases: eight of the thirteen flags on the reference host were device classes behaving normally. A duplicate serial on one of them is still flagged, because that is a finding at any class."},
        {"fact": "duplicate_serial", "note": "The serial is shared with another physical device."},
        {"fact": "no_vid_pid", "unless": ["internal_hub"], "note": "No vendor or product identifier was recorded.", "unless_note": "The machine's own root hub has no vendor or product id. That is what a root hub is, not something to look into."},
        {"fact": "hid_with_storage_or_network", "note": "The reported class conflicts with the apparent purpose."},
        {"fact": "multiple_interfaces", "note": "The device exposes multiple interfaces."},
        {"fact": "partial_artefacts", "note": "The device appears only in partial artefacts."},
        {"fact": "unresolved_identity_link", "note": "An identity link was reported and not acted on, so this may be part of another device."},
    ],
    "profiles": {
        "general": {},
        "exfiltration": {"storage_identity": 1.5, "mounted_volume": 2, "file_activity": 2, "mtp_interface": 1.5, "optical_identity": 1.5, "executable_run_from_removable": 2},
        "printing": {"printer_interface": 3, "imaging_interface": 2, "storage_identity": 0.75, "mounted_volume": 0.75},
        "network-bypass": {"network_interface": 3, "wireless_interface": 2, "serial_interface": 1.5, "storage_identity": 0.75},
        "identity": {"smartcard_interface": 3, "biometric_interface": 3, "hid_with_storage_or_network": 2, "hid_only": 0.5},
        "ot": {"serial_interface": 3, "vendor_specific_interface": 2.5, "network_interface": 1.5, "storage_identity": 0.75},
    },
}
