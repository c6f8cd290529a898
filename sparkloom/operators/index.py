"""Index upkeep: content hashes, what has changed, replacing parts of a chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*cols: str) -> Column:
    """SHA-256 of the fields as lines; null counts as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def delta(current: DataFrame, stored: DataFrame) -> DataFrame:
    """id and state: new, changed, same or deleted.  Both have id and hash."""
    c, s = current.select("id", F.col("hash").alias("now")), stored.select("id", F.col("hash").alias("then"))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "changed").otherwise("same")
    return c.join(s, "id", "full").select("id", state.alias("state"))


def needs_rebuild(metadata: dict, model: str, dimensions: int, version: int) -> bool:
    return (metadata.get("model"), metadata.get("dimensions"), metadata.get("version")) != (model, dimensions, version)


def replaced(chunks: DataFrame, sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """All chunks of ``sources`` (column source) give way to ``fresh`` ones."""
    return chunks.join(sources.select("source").distinct(), "source", "left_anti").unionByName(fresh)


def added(chunks: DataFrame, fresh: DataFrame, dimensions: int, may_lack: tuple[str, ...] = ("code",)) -> DataFrame:
    """Chunks and the fresh ones of right dimension whose id is new, one for each id."""
    fits = (F.size("embedding") == dimensions) | (F.col("type").isin(*may_lack) & (F.coalesce(F.size("embedding"), F.lit(0)) <= 0))
    new = fresh.filter(fits).join(chunks.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return chunks.unionByName(new)


def without_prefix(chunks: DataFrame, prefix: str) -> DataFrame:
    return chunks.filter(~F.col("id").startswith(prefix))


def compare_and_set(hashes: DataFrame, updates: DataFrame) -> DataFrame:
    """Hash rows after updates (id, expected, hash): one whose expectation fails leaves
    the row as it is; a null expectation is for a new row only."""
    j = hashes.withColumnRenamed("hash", "held").join(updates, "id", "full")
    ok = F.col("hash").isNotNull() & F.col("held").eqNullSafe(F.col("expected"))
    return j.select("id", F.when(ok, F.col("hash")).otherwise(F.col("held")).alias("hash")).filter("hash IS NOT NULL")


def statistics(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("type").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("sources"), F.count_if(F.size("embedding") > 0).alias("embedded"))


def latest(rows: DataFrame, key: str, updated: str, tie: str) -> DataFrame:
    """Of rows with the same key the newest."""
    pick = F.max_by(F.struct(*rows.columns), F.struct(F.col(updated), F.col(tie)))
    return rows.groupBy(F.col(key).alias("_k")).agg(pick.alias("r")).select("r.*")
