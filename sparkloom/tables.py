"""Written tables that cut lineage, and ranks that no single task computes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is
    unset, a temporary one will do for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-scratch")
    return found.rstrip("/")


#: What this driver has written, in order; see forget().
_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def written() -> int:
    """How many tables have been written so far: a mark for forget()."""
    return len(_written)


def forget(spark: SparkSession, mark: int = 0, keep: int = 0) -> None:
    """Delete the tables written since ``mark``, but for the last ``keep``.  Results that
    are not written or collected yet still read theirs, so this is for their caller."""
    for path in _written[mark : len(_written) - keep]:
        delete(spark, path)
    del _written[mark : len(_written) - keep]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and
    a lost executor costs a read, not a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``name`` = 1, 2, ... in the given order: rows are dealt out by range, numbered in
    each partition, and shifted by what earlier partitions hold (a row for each)."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    low = (1 << 33) - 1
    rows = stored(dealt.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"_part": F.shiftright("_m", 33), "_m": F.col("_m").bitwiseAND(F.lit(low))})
    held = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = held.select("_part", F.coalesce(before, F.lit(0)).alias("_shift"))
    # one row for each partition, so it may be sent to all
    return rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_m") + F.col("_shift") + 1).drop("_m", "_part", "_shift")
