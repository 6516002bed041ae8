"""Tables in the shared folder, which end a plan's lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. On one machine, where that is unset, a temporary one; a cluster's machines
    couldn't see that, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vestige-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before the interpreter: nothing can be deleted through it
        pass


#: Spark's setting that a write's shuffle files go when it ends, instead of when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What Parquet's writers need for rows with texts of megabytes: a look at how much they hold after 10 rows at most, which
#: by default is after up to 10,000, and no least and greatest text kept for each row group until the file ends.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "10", **{f"parquet.column.statistics.enabled#{c}": "false" for c in ("evidence", "fact_evidence")}}


def long_rows(spark: SparkSession) -> None:
    """Set the session's Parquet writers up for such rows. It holds from here on, as whoever asked for the rows writes
    them later; what the session has set itself stays."""
    for key, value in LONG_ROWS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table_in_shared_folder(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read back. Its path is added to paths, whose owner deletes it; without
    those it goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    if paths is None:
        atexit.register(dropped, spark, path)
    else:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
