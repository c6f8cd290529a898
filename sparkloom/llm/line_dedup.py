"""Operator 1: lines that many documents share, by levelled sorted runs of line hashes.

A run is a table (two 64-bit hashes of a line key, number of documents), sorted by
hash in each file.  A new batch counts its own keys, merge-anti-joins the keys that
the runs have already settled (enough documents: more counts change nothing) and is
added as a run of level 0.  When a level holds ``fanout`` runs they are merged into
one run of the next level.  The sum over all runs says which keys are common.

Cases: a null text counts as empty; an empty text is one empty line, whose key is
too short to be dropped; every row is a document, repeated rows too; ties do not
arise; texts of any length are split whole; empty tables give empty results; columns named ``n_lines`` or ``n_dropped``
in any case are replaced, other extra columns are kept whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .bytesops import tidied

HASH = ["_h1", "_h2"]


def line_key(line):
    return C.ascii_lower(F.btrim(line, F.lit(C.SPACES)))


def _hashes(key):
    return F.xxhash64(F.lit(3), key).alias("_h1"), F.xxhash64(F.lit(5), key).alias("_h2")


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs of one corpus, kept in ``path``."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int, min_chars: int = 1, fanout: int = 3):
        self.spark, self.path, self.min_docs, self.min_chars, self.fanout = spark, path, min_docs, min_chars, fanout
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _read(self, runs: list[str]) -> DataFrame:
        schema = "_h1 long, _h2 long, _n long"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*runs)

    def _write(self, counts: DataFrame, level: int) -> None:
        run = f"{self.path}/run-{self.written}-level-{level}"
        self.written += 1
        counts.sortWithinPartitions(*HASH).write.parquet(run)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(run)

    def totals(self) -> DataFrame:
        return self._read([r for level in self.levels for r in level]).groupBy(*HASH).agg(F.sum("_n").alias("_n"))

    def common(self) -> DataFrame:
        return self.totals().filter(F.col("_n") >= self.min_docs).select(*HASH)

    def keys(self, docs: DataFrame) -> DataFrame:
        """The hashes of each document's different line keys, one row for each."""
        keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
        keys = docs.select(*[c for c in docs.columns if c != "text"], F.explode(keys).alias("_key")).filter(F.length("_key") >= self.min_chars)
        return keys.select(*[c for c in docs.columns if c != "text"], *_hashes(F.col("_key")))

    def add(self, docs: DataFrame) -> None:
        self.add_counts(self.keys(docs.select("text")).groupBy(*HASH).agg(F.count(F.lit(1)).alias("_n")))

    def add_counts(self, counts: DataFrame) -> None:
        """A new batch: its keys and in how many of its documents each is."""
        if self.written:
            counts = counts.join(self.common(), HASH, "left_anti")
        self._write(counts, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._read(old).groupBy(*HASH).agg(F.sum("_n").alias("_n")), level + 1)
            for run in old:
                C.delete(self.spark, run)
            level += 1


@tidied
def _keep(batches, at):
    import pyarrow as pa

    for batch in batches:
        kept, lines, dropped = [], [], []
        for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            parts = (text or "").split("\n")
            if drop:
                out = set(drop)
                kept.append("\n".join([x for i, x in enumerate(parts) if i not in out]))
            else:
                kept.append(text or "")
            lines.append(len(parts))
            dropped.append(len(drop or ()))
        own = [pa.array(kept, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays([*own, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*batch.schema.names[:-1], "n_lines", "n_dropped"])


@C.apart("n_lines", "n_dropped")
def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with the lines dropped whose key is in ``min_docs`` documents or more,
    and ``n_lines`` (before), ``n_dropped``."""
    spark = docs.sparkSession
    C.text_batches(docs.sparkSession)
    runs = LineRuns(spark, C.scratch(spark, "line-runs"), min_docs, min_chars, fanout)
    # one pass over the texts deals their keys to the batches
    dealt = runs.keys(docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("_batch"), "text"))
    dealt = C.stored(dealt.groupBy("_batch", *HASH).agg(F.count(F.lit(1)).alias("_n")), "line-keys")
    for b in range(batches):
        runs.add_counts(dealt.filter(F.col("_batch") == b).drop("_batch"))
    keyed = C.with_row_key(docs, "doc_id", "text")
    each = keyed.select(*C.KEY, F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line"))
    each = each.select(*C.KEY, "_pos", line_key(F.col("_line")).alias("_key")).filter(F.length("_key") >= min_chars)
    # written first, so that both sides of the join are plain exchanges and a hot line's
    # partition can be split
    common = C.stored(runs.common(), "common-lines")
    hits = each.select(*C.KEY, "_pos", *_hashes(F.col("_key"))).join(common, HASH, "left_semi")
    drops = hits.groupBy(*C.KEY).agg(F.collect_set("_pos").alias("_drop"))
    joined = keyed.join(drops, C.KEY, "left").select(*docs.columns, "_drop")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = docs.columns.index("text")
    return joined.mapInArrow(lambda it: _keep(it, at), schema)
