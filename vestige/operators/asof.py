"""Look-ups along time without pairs: the last or next fact of a key at a time, and a row's neighbours.

Rows are dealt by key and day. What a day hasn't is carried over from the nearest day that has it, over one row a key
and day, so no task orders all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _day(time: str) -> Column:
    return F.col(time).cast("date")


def as_of(asked: DataFrame, at: str, facts: DataFrame, when: str, value: Column, keys: list[str], ahead: bool = False, strict: bool = False) -> DataFrame:
    """(keys, at, found): for each asked time the value of the last fact up to it, or with ahead of the next from it
    on; strict: not at that very time. Of facts of one time the greatest value counts, with ahead the least."""
    asked = asked.select(*keys, at).where(F.col(at).isNotNull()).distinct()
    facts = facts.select(*keys, F.col(when).alias("__t"), value.alias("__v")).where("__t is not null")
    best = F.min if ahead else F.max
    daily = facts.groupBy(*keys, _day("__t").alias("__day")).agg(best(F.struct("__t", "__v")).alias("__of_day"))
    days = daily.join(asked.select(*keys, _day(at).alias("__day")).distinct(), [*keys, "__day"], "full")
    by_day = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("__day") if ahead else F.asc("__day")).rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*keys, "__day", F.last("__of_day.__v", ignorenulls=True).over(by_day).alias("__carried"))
    # Facts of a time come before the question that they answer, after it where they mustn't.
    rows = facts.groupBy(*keys, "__t").agg(best("__v").alias("__v")).withColumn("__asks", F.lit(False))
    rows = rows.unionByName(asked.select(*keys, F.col(at).alias("__t"), F.lit(True).alias("__asks")), allowMissingColumns=True)
    order = [F.desc("__t") if ahead else F.asc("__t"), F.desc("__asks") if strict else F.asc("__asks")]
    within = Window.partitionBy(*keys, _day("__t")).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = rows.withColumn("__same", F.last("__v", ignorenulls=True).over(within)).where("__asks").select(*keys, F.col("__t").alias(at), _day("__t").alias("__day"), "__same")
    return same.join(carried, [*keys, "__day"], "left").select(*keys, at, F.coalesce("__same", "__carried").alias("found"))


def beside(df: DataFrame, keys: list[str], time: str, ties: list[str], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """df with the value of the row before (with ahead: after) by time and ties among those of the same keys."""
    df = df.withColumn("__day", _day(time)).withColumn("__value", value)
    order = [time, *ties]
    within = Window.partitionBy(*keys, "__day").orderBy(*order)
    pick = F.min_by if ahead else F.max_by
    edge = df.groupBy(*keys, "__day").agg(pick("__value", F.struct(*order)).alias("__edge"))
    days = Window.partitionBy(*keys).orderBy("__day")
    step = F.lead if ahead else F.lag
    edge = edge.select(*keys, "__day", step("__edge").over(days).alias("__other_day"))
    out = df.withColumn("__near", step("__value").over(within)).join(edge, [*keys, "__day"], "left")
    return out.withColumn(name, F.coalesce("__near", "__other_day")).drop("__day", "__value", "__near", "__other_day")
