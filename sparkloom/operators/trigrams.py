"""Substring search over code symbols from a stored index of parts of words.

``symbols`` has the symbols with a number ``d`` in its order; ``parts/bucket=...`` has a row
for each part of a word of one to three characters and block of 256 numbers, with the places
in the block of the symbols that have it.  A term's parts of three characters are intersected
block by block; symbols that have them all are compared with the term itself.  A term of up to
three characters is a part, so what it finds needs no comparison.  A search reads the buckets of
its parts, and of these the row groups that hold them.

Scores are those of ``codesearch.code_search``, as whatever scores contains a term.

Cases: null fields are empty; repeated symbols are symbols each; a query without a word finds
nothing; an empty table gives an index that finds nothing.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X
from . import codesearch as Q

BLOCK, BUCKETS, LONGEST = 256, 32, 3


def _parts(words: Column, k: int) -> Column:
    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(w) - (k - 1)), lambda i: F.substr(w, i, F.lit(k)))
        return F.when(F.length(w) >= k, each).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(words, of))


def _needed(term: str) -> list[str]:
    return sorted({term[i : i + LONGEST] for i in range(max(len(term) - LONGEST + 1, 1))})


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, symbols: DataFrame) -> Index:
        numbered = T.numbered(symbols, ["path", "name"], "d")
        numbered.write.mode("overwrite").parquet(f"{self.root}/symbols")
        words = F.array_distinct(X.tokens(Q.everything()))
        rows = self.symbols().select("d", F.explode(F.array_distinct(F.concat(*[_parts(words, k) for k in range(1, LONGEST + 1)]))).alias("part"))
        block = F.floor(F.col("d") / BLOCK).alias("block")
        blocks = rows.groupBy("part", block).agg(F.sort_array(F.collect_list((F.col("d") % BLOCK).cast("short"))).alias("places"))
        blocks = blocks.withColumn("bucket", (F.crc32("part") % BUCKETS).cast("int"))
        blocks = blocks.repartitionByRange(T.partitions(self.spark), "bucket", "part", "block").sortWithinPartitions("bucket", "part", "block")
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/parts")
        return self

    def symbols(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/symbols")

    def parts(self) -> DataFrame:
        return self.spark.read.schema("part string, block long, places array<short>, bucket int").parquet(f"{self.root}/parts")

    def candidates(self, terms: list[str]) -> DataFrame:
        """(term, d): the symbols that have all parts of a term."""
        need = [(t, p, len(_needed(t))) for t in dict.fromkeys(terms) for p in _needed(t)]
        parts = sorted({p for _, p, _ in need})
        buckets = sorted({zlib.crc32(p.encode()) % BUCKETS for p in parts})
        read = self.parts().filter(F.col("bucket").isin(buckets) & F.col("part").isin(parts))
        asked = self.spark.createDataFrame(need, "term string, part string, needed long")
        # as many rows as the query has parts
        j = read.join(F.broadcast(asked), "part").groupBy("term", "block", "needed").agg(F.collect_list("places").alias("_all"))
        met = F.aggregate("_all", F.element_at("_all", 1), F.array_intersect)
        return j.filter(F.size("_all") == F.col("needed")).select("term", F.explode(F.transform(met, lambda at: F.col("block") * BLOCK + at)).alias("d"))

    def found(self, terms: list[str]) -> DataFrame:
        """The symbols that contain a term, with ``terms``: those that they contain."""
        has = self.candidates(terms).groupBy("d").agg(F.collect_set("term").alias("_terms"))
        s = self.symbols().join(has, "d")
        text = Q.everything()
        true = F.filter("_terms", lambda t: (F.length(t) <= LONGEST) | text.contains(t))
        return s.withColumn("_terms", F.array_sort(true)).filter("size(_terms) > 0").withColumnRenamed("_terms", "terms")

    def frequencies(self, terms: list[str]) -> DataFrame:
        """(term, symbols) of the terms that a symbol contains."""
        return self.found(terms).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("symbols"))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        terms = X.query_tokens(query)
        if not terms:
            return self.symbols().drop("d").withColumn("score", F.lit(0.0)).limit(0)
        found = T.stored(self.found(terms), "found-symbols")
        everyone = self.symbols().agg(F.count(F.lit(1)).alias("n"))
        df = found.agg(*[F.count_if(F.array_contains("terms", t)).alias(f"df{i}") for i, t in enumerate(dict.fromkeys(terms))])
        stats = everyone.crossJoin(df)  # one row each
        return Q.scored(found.drop("d", "terms"), terms, stats, limit)
