"""Shared helpers: row identity and ranks that need no single task."""

from __future__ import annotations

import functools

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import delete, partitions, scratch, stored  # noqa: F401
from .bytesops import tidied

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of every contract: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


#: Rows in an Arrow batch that carries whole texts.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small enough for rows of whole texts:
    Spark counts rows, not bytes, and both sides hold a batch at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def ascii_lower(c):
    """A-Z to a-z and nothing else (``lower`` would change other letters too)."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def with_row_key(df: DataFrame, *cols: str) -> DataFrame:
    """Two 64-bit keys of the named columns, the same for repeated rows only.  They
    stand for the row in joins, so that a null or repeated ``doc_id`` is no problem."""
    return df.withColumns({"_k1": F.xxhash64(F.lit(11), *cols), "_k2": F.xxhash64(F.lit(23), *cols)})


KEY = ["_k1", "_k2"]


@tidied
def _numbered(rows, column):
    import pyarrow as pa

    pid, at = TaskContext.get().partitionId(), 0
    for batch in rows:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, "_pid", "_at"])
        at += n


def ranked(df: DataFrame, group: str, order: list[str], rank: str = "rank") -> DataFrame:
    """``rank`` = 0, 1, ... within ``group`` in the given order, with no task that holds
    a whole group: rows are dealt out by range, numbered in each partition, and the
    numbers are shifted by what earlier partitions hold of the group (one row for
    each partition and group in it)."""
    n = partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_at", T.LongType())])
    rows = stored(dealt.mapInArrow(lambda it: _numbered(it, group), schema), "ranked")
    held = rows.groupBy(F.col(group).alias("_g"), F.col("_pid").alias("_p")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("_g", "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    out = rows.join(shift, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_pid") == F.col("_p")))
    return out.withColumn(rank, F.col("_at") + F.col("_shift")).drop("_pid", "_at", "_g", "_p", "_shift")


def apart(*results: str, uses: tuple[str, ...] = ("doc_id", "text")):
    """For operators that return the columns of the table they take, and ``results``.

    Columns that the operator does not use go through it under names that nothing else has
    and get their own back, so that they may have any names, those of the operator's own
    working columns and names that differ in case only included.  Columns that have the name
    of a result, in any case, are replaced by it."""
    taken = {r.lower() for r in results}

    def wrap(operator):
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **more) -> DataFrame:
            have = docs.columns
            place = {}
            for use in uses:
                same = [i for i, c in enumerate(have) if c == use] or [i for i, c in enumerate(have) if c.lower() == use]
                place |= {same[0]: use} if same else {}
            safe = [place.get(i, f"_x{i}") for i in range(len(have))]
            gone = [n for i, n in enumerate(safe) if i not in place and have[i].lower() in taken]
            out = operator(docs.toDF(*safe).drop(*gone), *args, **more)
            back = dict(zip(safe, have))
            return out.toDF(*[back.get(c, c) for c in out.columns])

        return run

    return wrap


def arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
