"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.operators.staging import dropped, table_in_shared_folder


def connected_components(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(device_key, component): each key's smallest reachable one. Least neighbouring labels with pointer jumping, a
    table in the shared folder per round; rounds grow with the logarithm of the longest path."""
    spark, old = keys.sparkSession, []
    both = table_in_shared_folder(edges.select("left_key", "right_key").union(edges.select("right_key", "left_key")).toDF("k", "n").distinct(), old)
    labels = keys.select(F.col("device_key").alias("k")).distinct().select("k", F.col("k").alias("label"))
    while True:
        near = both.join(labels.select(F.col("k").alias("n"), F.col("label").alias("near")), "n").groupBy("k").agg(F.min("near").alias("near"))
        lower = labels.join(near, "k", "left").select("k", F.least("label", "near").alias("to"), (F.col("near") < F.col("label")).alias("moved"))
        jumped = lower.join(lower.select(F.col("k").alias("to"), F.col("to").alias("next")), "to").select("k", F.col("next").alias("label"), "moved")
        labels = table_in_shared_folder(jumped, old)
        if not labels.where("moved").limit(1).count():
            for path in old[:-1]:
                dropped(spark, path)
            return labels.select(F.col("k").alias("device_key"), F.col("label").alias("component"))
        labels = labels.select("k", "label")
