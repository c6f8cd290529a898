"""Vector retrieval: exact cosine top-k, header boosts and the roll-up to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, TOP = 0.3, 20


def dot(a, b) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Zero where lengths differ or a norm is zero; sums in double precision."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0) | size.isNull(), 0.0).otherwise(dot(a, b) / size)


def normalised(a) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def rounded(x: Column, places: int = 6) -> Column:
    """Halves away from zero in binary, as SQL engines round; what is too small and negative is
    -0.0, where Spark's own round goes through decimals and loses the sign."""
    scaled = F.abs(x * 10.0**places)
    down = F.floor(scaled).cast("double")
    near = F.signum(x) * (down + F.when(scaled - down >= 0.5, 1.0).otherwise(0.0)) / 10.0**places
    return F.when(scaled < 2.0**52, near).otherwise(x)


def top_k(chunks: DataFrame, query: list[float], k: int | None = TOP, threshold: float = THRESHOLD, kind: str | None = None) -> DataFrame:
    """The k chunks most like ``query``, or all over the threshold (k None).  The vector
    is a literal, so this is a scan, a filter and a top-k; no join."""
    rows = chunks.filter(F.col("type") == kind) if kind else chunks
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = rows.withColumn("score", F.round(cosine(F.col("embedding"), q), 6))
    rows = rows.filter(F.col("score") >= threshold)
    return rows if k is None else rows.orderBy(F.desc("score"), "vec_id").limit(k)


def query_of(chunks: DataFrame, vec_id: int) -> list[float]:
    """The vector of one chunk, as a query."""
    row = chunks.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def header_boost(query: str) -> Column:
    """Doc chunks gain up to 0.15 by the share of query words in their header path."""
    words = query.lower().split()
    path = F.lower(F.coalesce(F.col("header_path"), F.lit("")))
    hits = sum((F.when(path.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return F.when((F.col("type") == "doc") & (path != "") & F.lit(bool(words)), hits / float(max(1, len(words))) * 0.15).otherwise(0.0)


def roll_up(scored: DataFrame) -> DataFrame:
    """Chunks to sources: the best chunk's score and a tenth of the next two."""
    w = Window.partitionBy("type", "source").orderBy(F.desc("score"), "vec_id")
    best = scored.withColumn("n", F.row_number().over(w)).filter("n <= 3")
    return best.groupBy("type", "source").agg(
        F.round(F.sum(F.when(F.col("n") == 1, F.col("score")).otherwise(F.col("score") * 0.1)), 7).alias("score"),
        F.max(F.when(F.col("n") == 1, F.col("vec_id"))).alias("best_chunk"),
    )


def merge_stores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Results of two stores by type, source and, where results name their ``store``, that; the
    higher score stays.  Memories of one id in two stores are two results."""
    keys = [c for c in ("type", "source", "store") if c in a.columns and c in b.columns]
    return a.unionByName(b).groupBy(*keys).agg(F.max("score").alias("score"), F.max_by("best_chunk", "score").alias("best_chunk"))


def hashed_embedding(c, size: int = 64) -> Column:
    """A vector of a text without any model: signed counts of its tokens by hash."""
    from ..functions.text import tokens

    at = F.transform(tokens(c), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(at, lambda x: x["i"] == i), F.lit(0.0), lambda s, x: s + x["s"]).cast("float"))
