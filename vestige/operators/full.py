"""All views of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.operators.case import listed
from vestige.operators.chronicle import Chronicle
from vestige.operators.staging import table_in_shared_folder

#: What facts don't change: a second pass shares it with the first.
_SHARED = ("device", "device_group", "physical_device", "connection", "device_volume_link", "file_activity", "file_attribution", "device_label", "_fact_rows", "_shared_serials", "_peers")


class Case(Chronicle):
    """Evidence tables by name, and the views over them."""

    def with_rules(self, rules: dict[str, DataFrame]) -> Case:
        """The same case under other rule tables (another profile, say); facts and devices are shared."""
        other = type(self)(lambda name: rules[name] if name in rules else self.table(name))
        other._made = {name: getattr(self, name)() for name in ("physical_device", "_shared_serials", "_fact_rows", "_peers", "_own_facts")}
        return other

    def second_pass(self) -> Case:
        """The case once facts know of attribution: devices that file records reach get the fact `file_activity`, and
        all that rests on facts is decided anew. No other fact depends on attribution, so only those devices' rows
        are added; what facts don't change is shared with this case, which must stay open as long."""
        group = self.device_group().select("device_key", "physical_device_id")
        reached = self.file_attribution().join(group, "device_key").select("physical_device_id", F.concat(F.lit("file records attributed at "), "confidence").alias("evidence")).distinct()
        added = reached.groupBy("physical_device_id").agg(listed("evidence", "; ").alias("evidence"), F.count(F.lit(1)).alias("evidence_count"))
        first = self._own_facts()
        other = type(self)(self.table)
        other._made = {name: getattr(self, name)() for name in _SHARED}
        other._made["_own_facts"] = table_in_shared_folder(first.where("fact <> 'file_activity'").unionByName(added.withColumn("fact", F.lit("file_activity"))), other._written)
        return other
