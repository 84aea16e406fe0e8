"""Tables that outlive a stage, kept where every executor can read them.

Cutting lineage goes through Parquet in the folder the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read and no recomputation.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from foliant.session import ship

_LOCAL_BASE: list[str] = []
#: The paths that this process has made, in order.
_MADE: list[str] = []
#: Seconds that Spark's cleaner has to drop shuffles before the next query writes its own.
SETTLE = 0.4


def shared_base(spark: SparkSession) -> str:
    """The shared folder of the session; a local temporary one only in local mode with none set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL_BASE:
        _LOCAL_BASE.append("file://" + tempfile.mkdtemp(prefix="foliant-"))
    return _LOCAL_BASE[0]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_base(spark)}/foliant-{uuid.uuid4().hex}/{label}"
    _MADE.append(path)
    return path


def keep(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and return a DataFrame that reads it back."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def keep_while(make, label: str, by: str | None = None) -> DataFrame:
    """As ``keep`` of what ``make`` returns, alone or before tables that it kept for it; those, and the shuffles, go once it is written."""
    made = make()
    df, *used = made if isinstance(made, tuple) else (made,)
    spark, out = df.sparkSession, keep(df, label, by)
    for table in used:
        drop_table(table)
    del made, df, used
    forget(spark)
    return out


def settled(make, label: str) -> DataFrame:
    """As ``keep`` of what ``make`` returns; every table that was kept for it meanwhile goes, and the shuffles.  For callers of one thread."""
    mark = len(_MADE)
    made = make()
    spark, out = made.sparkSession, keep(made, label)
    for path in _MADE[mark:-1]:
        drop_path(spark, path.rsplit("/", 1)[0])
    del _MADE[mark:], made
    forget(spark)
    return out


def forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffles of queries that nothing refers to any more.

    The listener bus refers to the last query until it hears of another one, hence the small query.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(SETTLE)


def drop_table(table: DataFrame, part: str = "") -> None:
    """Delete what ``keep`` wrote for a table, or for those that it is a union of; of other tables nothing.  ``part``, as in
    ``column=value``, names the one folder of each that goes."""
    base = shared_base(table.sparkSession).split(":", 1)[-1].replace("//", "/")
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/foliant-" in path and base.rstrip("/") in path.replace("//", "/") and path.endswith(part):
            drop_path(table.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path with the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
