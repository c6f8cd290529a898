"""Upkeep of what is derived from sources (chunks, vectors, postings) as an idempotent stream.

A change says what a writer has seen and what it makes of it: ``source``, ``seq`` (its place
among the changes of the source), ``expected`` (the content hash it has read; null: no such
source), ``hash`` (the new one; null: the source is deleted) and any further columns, which
are kept with the source.  A change whose expectation no longer holds when its turn comes
loses and has no effect.

A batch of changes is one epoch.  Its tables go to ``heads/epoch=n`` (source and hash of what
has changed), ``rows/epoch=n`` (what is kept) and ``lost/epoch=n``, and a row in ``done``
comes last.  Only epochs with that row count, so one that failed leaves no trace and is
written over by the next attempt, and a batch that is delivered again changes nothing.  A
reader pins the last epoch and sees that state whatever is committed later.

Which changes hold is a chain: from the hash that is held to the first change that expects
it, from that one's hash to the next later change that expects it, and so on.  Links are
found by windows over blocks of rows and the chain by doubling, so no task holds a source's
changes, however many there are.

Cases: repeated changes are one; of equal ``seq`` the one of lesser hashes comes first, and
of those that differ only in what is kept, any; null sources are sources of their own kind
(one); empty batches count as epochs.  One driver commits to a folder at a time; writers are
streams or batches that it runs, in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from . import queues

#: So many numbers of changes make a block of the windows that find links.
BLOCK = 4096
OWN = ["source", "seq", "expected", "hash"]


def _token(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def _links(nodes: DataFrame) -> DataFrame:
    """(n, next) of nodes n, source, wants (null: a start), gives: the first later node of the
    source that wants what n gives."""
    give = nodes.select("source", F.col("gives").alias("token"), "n", F.lit(1).alias("gives"))
    want = nodes.filter("wants IS NOT NULL").select("source", F.col("wants").alias("token"), "n", F.lit(0).alias("gives"))
    rows = give.unionByName(want).withColumn("block", F.floor(F.col("n") / BLOCK))
    key = ["source", "token", "block"]
    wanted = F.min(F.when(F.col("gives") == 0, F.col("n")))
    later = Window.partitionBy(*key).orderBy("n", "gives").rowsBetween(1, Window.unboundedFollowing)
    near = rows.withColumn("next", wanted.over(later)).filter("gives = 1").select(*key, "n", "next")
    beyond = Window.partitionBy("source", "token").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = rows.groupBy(*key).agg(wanted.alias("_first")).withColumn("_far", F.min("_first").over(beyond)).filter("_far IS NOT NULL")
    blocks = blocks.select(*[F.col(c).alias(f"_{c}") for c in key], "_far")
    j = near.join(blocks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("token") == F.col("_token")) & (F.col("block") == F.col("_block")), "left")
    return j.select("n", F.coalesce("next", "_far").alias("next")).filter("next IS NOT NULL")


def _reached(starts: DataFrame, links: DataFrame) -> DataFrame:
    """All nodes (n) on the chains that begin at ``starts``, in as many rounds as the
    longest chain's length has binary digits."""
    jump, reached = tables.stored(links, "upkeep-jump"), starts.select("n")
    while True:
        # what is reached so far are each chain's first 1, 2, 4, ... nodes: these are as many after them
        front = tables.stored(jump.join(reached, "n").select(F.col("next").alias("n")), "upkeep-reached")
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
        above = jump.select(F.col("n").alias("next"), F.col("next").alias("_after"))
        jump = tables.stored(jump.join(above, "next").select("n", F.col("_after").alias("next")), "upkeep-jump")


def decided(changes: DataFrame, held: DataFrame) -> DataFrame:
    """``changes`` with ``n`` (their order) and ``won``; ``held``: source, held (its hash)."""
    marked = changes.dropDuplicates(OWN).withColumns({"_wants": _token("expected"), "_gives": _token("hash"), "_start": F.lit(1)})
    sources = changes.select("source").distinct()
    known = held.select(F.col("source").alias("_s"), "held")
    starts = sources.join(known, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", _token("held").alias("_gives"), F.lit(0).alias("_start"))
    every = marked.unionByName(starts, allowMissingColumns=True)
    every = tables.numbered(every, ["source", "_start", "seq", "_wants", "_gives"], "n")
    nodes = every.select("n", "source", F.col("_wants").alias("wants"), F.col("_gives").alias("gives"))
    chain = _reached(every.filter("_start = 0"), _links(nodes)).withColumn("_on", F.lit(True))
    out = every.filter("_start = 1").join(chain, "n", "left")
    return out.withColumn("won", F.col("_on").isNotNull()).drop("_wants", "_gives", "_start", "_on")


def rebased(lost: DataFrame) -> DataFrame:
    """Losers as changes of what is held now (column ``held``): the default retry."""
    return lost.withColumn("expected", F.col("held")).drop("held")


class Upkeep:
    """A folder of epochs; ``kept`` is the schema of what is kept with a source."""

    def __init__(self, spark: SparkSession, root: str, kept: str):
        self.spark, self.root = spark, root.rstrip("/")
        extra = T.StructType.fromDDL(kept).fields if kept else []
        key = T.StructType.fromDDL("source string, hash string, seq long").fields
        number = [T.StructField("epoch", T.LongType())]
        change = T.StructType.fromDDL("source string, seq long, expected string, hash string").fields
        self.kept = [f.name for f in extra]
        self.schemas = {
            "heads": T.StructType([*key, *number]),
            "rows": T.StructType([T.StructField("source", T.StringType()), *extra, *number]),
            "lost": T.StructType([*change, *extra, T.StructField("held", T.StringType()), *number]),
            "done": T.StructType.fromDDL("writer string, batch long, won long, lost long, epoch long"),
        }
        if not self._exists("done"):
            for name in self.schemas:
                self._write(spark.createDataFrame([], T.StructType(self.schemas[name].fields[:-1])), name, -1)

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _write(self, df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/epoch={epoch}")

    def _read(self, name: str, at: int, since: int = -1) -> DataFrame:
        d = self.spark.read.schema(self.schemas[name]).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        return d.filter(F.col("epoch").between(since, at))

    def pinned(self) -> int:
        """The last epoch that is complete (-1: none): what a reader holds on to."""
        found = self._read("done", 1 << 62).agg(F.max("epoch")).first()[0]
        return -1 if found is None else found

    def history(self) -> DataFrame:
        """epoch, writer, batch, won and lost of each complete epoch."""
        return self._read("done", 1 << 62).select("epoch", "writer", "batch", "won", "lost")

    def heads(self, at: int | None = None) -> DataFrame:
        """source, hash, seq, epoch as of an epoch; a deleted source has a null hash."""
        rows = self._read("heads", self.pinned() if at is None else at)
        pick = F.max_by(F.struct("hash", "seq", "epoch"), "epoch").alias("_h")
        return rows.groupBy("source").agg(pick).select("source", "_h.*")

    def current(self, at: int | None = None) -> DataFrame:
        """source, hash, seq and what is kept, of all sources as of an epoch."""
        at = self.pinned() if at is None else at
        live = self.heads(at).filter("hash IS NOT NULL").select(F.col("source").alias("_s"), "hash", "seq", F.col("epoch").alias("_e"))
        j = self._read("rows", at).join(live, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")))
        return j.select("source", "hash", "seq", *self.kept)

    def lost(self, at: int | None = None) -> DataFrame:
        """Changes that never held, with the hash that was held instead, and their epoch."""
        return self._read("lost", self.pinned() if at is None else at)

    def changes(self, sources: DataFrame, seq: int = 0) -> DataFrame:
        """The changes that make the state that of ``sources`` (source, hash, what is kept):
        new and changed ones, and deletes of those that are not there any more."""
        then = self.heads().filter("hash IS NOT NULL").select(F.col("source").alias("_s"), F.col("hash").alias("expected"))
        now = sources.select("source", "hash", *self.kept, F.lit(True).alias("_there"))
        j = now.join(then, F.col("source").eqNullSafe(F.col("_s")), "full").filter("NOT hash <=> expected")
        return j.select(F.when(F.col("_there"), F.col("source")).otherwise(F.col("_s")).alias("source"), F.lit(seq).cast("long").alias("seq"), "expected", "hash", *self.kept)

    def commit(self, changes: DataFrame, batch: int, writer: str = "", tries: int = 0, redo: Callable[[DataFrame], DataFrame] = rebased) -> bool:
        """Apply a batch, once; False if it has been applied before.  Losers go through
        ``redo``, which gets them with ``held`` and returns changes (with the same columns;
        none for those it gives up), and are tried again up to ``tries`` times."""
        done = self._read("done", 1 << 62)
        if not done.filter((F.col("writer") == writer) & (F.col("batch") == batch)).isEmpty():
            return False
        mark, epoch = tables.written(), self.pinned() + 1
        columns = [*OWN, *self.kept]
        typed = changes.select(F.col("source").cast("string"), F.col("seq").cast("long"), F.col("expected").cast("string"), F.col("hash").cast("string"), *self.kept)
        # a stream's own session plans without adaptive execution, so this one reads the batch
        path = tables.scratch(self.spark, "upkeep-changes")
        typed.write.parquet(path)
        todo = self.spark.read.schema(typed.schema).parquet(path)
        heads = self.heads(epoch - 1)
        some = todo.select(F.col("source").alias("_s")).distinct()
        held = heads.join(some, F.col("source").eqNullSafe(F.col("_s")), "left_semi").select("source", F.col("hash").alias("held"))
        held, won, left = tables.stored(held, "upkeep-held"), None, None
        for turn in range(tries + 1):
            sorted_ = tables.stored(decided(todo, held), "upkeep-decided")
            good = sorted_.filter("won").select(*columns, F.struct(F.lit(turn).alias("turn"), "n").alias("_at"))
            won = good if won is None else won.unionByName(good)
            last = won.groupBy("source").agg(F.max_by("hash", "_at").alias("_h"), F.max("_at").alias("_last"))
            last = tables.stored(last.select(F.col("source").alias("_s"), "_h", "_last"), "upkeep-last")
            same = F.col("source").eqNullSafe(F.col("_s"))
            losers = sorted_.filter("NOT won").select(*columns)
            if turn:
                losers = losers.unionByName(given_up)
            present = held.join(last, same, "full").select(F.when(F.col("_last").isNotNull(), F.col("_s")).otherwise(F.col("source")).alias("_p"), F.when(F.col("_last").isNotNull(), F.col("_h")).otherwise(F.col("held")).alias("held"))
            left = tables.stored(losers.join(present, F.col("source").eqNullSafe(F.col("_p")), "left").drop("_p"), "upkeep-lost")
            if turn == tries or left.isEmpty():
                break
            todo = tables.stored(redo(left).select(*columns), "upkeep-again")
            again = todo.select(F.col("source").alias("_s"), F.col("seq").alias("_n"), F.col("hash").alias("_g"))
            given_up = left.join(again, same & F.col("seq").eqNullSafe(F.col("_n")) & F.col("hash").eqNullSafe(F.col("_g")), "left_anti").select(*columns)
            held = tables.stored(present.withColumnRenamed("_p", "source"), "upkeep-held")
        final = won.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_at") == F.col("_last")))
        final = tables.stored(final.select(*columns), "upkeep-final")
        self._write(final.select("source", "hash", "seq"), "heads", epoch)
        self._write(final.filter("hash IS NOT NULL").select("source", *self.kept), "rows", epoch)
        self._write(left.select(*columns, "held"), "lost", epoch)
        count = won.agg(F.count(F.lit(1)).alias("won")).crossJoin(left.agg(F.count(F.lit(1)).alias("lost")))  # one row each
        self._write(count.select(F.lit(writer).alias("writer"), F.lit(batch).cast("long").alias("batch"), "won", "lost"), "done", epoch)
        tables.forget(self.spark, mark)
        return True

    def run(self, stream: DataFrame, checkpoint: str, writer: str = "stream", **more) -> None:
        """Commit a stream of changes to its end, each micro-batch as one epoch."""
        queues.each_batch(stream, lambda df, batch: self.commit(df, batch, writer, **more), checkpoint, "append")
