"""Operator 2: token counts through a digest cache.

The cache is a table (digest of the normalised content, tokens), one folder for each
tokenizer version, a digest of the vocabulary file and the library version.
Documents are joined to it by digest; only distinct contents that it lacks are
encoded, whole, and appended.  Ids are those of the ``tokenizers`` library; for a vocabulary of
lower-case words each string between white space goes to its model once a worker (see ``encoding``).

The normal form puts one space for each run of ASCII white space and none at the ends,
which no vocabulary that drops white space can tell apart; ``spaces=False`` leaves texts
as they are, for any other vocabulary.

Cases: a null text is an empty one (0 tokens); repeated rows and copies are encoded
once and each get their count; ties do not arise; texts of any length are encoded whole;
empty tables give empty results; columns with the names of the results, in any case, are
replaced, other extra columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .bytesops import pieces, tidied
from .encoding import encoder_of


def tokenizer_version(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()[:32]


@tidied
def _count(batches, path):
    import pyarrow as pa

    encoder = encoder_of(path)
    for batch in batches:
        for first, n, _, _ in pieces(batch, "_norm", 1 << 20):
            texts = batch.column(1).slice(first, n).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array([len(x) for x in encoder.encode(texts)], pa.int64())], ["_digest", "n_tokens"])


@tidied
def _digested(batches, at, spaces, keep):
    """Each text's digest and, by ``keep``, its normal form alone or all columns and the
    bytes of the text.  Normal forms go out once for each task, so that a content with
    very many copies is shuffled once for each; a task keeps 32 bytes for each content."""
    import pyarrow as pa

    seen = set()
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column(at).to_pylist()]
        norm = [b" ".join(r.split()) for r in raw] if spaces else raw
        digests = [hashlib.sha256(n).digest() for n in norm]
        if keep == "norm":
            fresh = {d: n for d, n in zip(digests, norm) if d not in seen}
            seen.update(fresh)
            digests, norm = list(fresh), list(fresh.values())
        digest = pa.array(digests, pa.binary())
        if keep == "norm":
            yield pa.RecordBatch.from_arrays([digest, pa.array(norm, pa.binary()).cast(pa.string())], ["_digest", "_norm"])
        else:
            own = batch.columns if keep == "all" else batch.columns[:at] + batch.columns[at + 1 :]
            names = batch.schema.names if keep == "all" else batch.schema.names[:at] + batch.schema.names[at + 1 :]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(r) for r in raw], pa.int64()), digest], [*names, "n_bytes", "_digest"])


def cached_counts(spark, cache: str, version: str) -> DataFrame:
    """What the cache holds for one tokenizer version; one row for each digest even
    where two writers have appended the same one."""
    schema = "_digest binary, n_tokens long"
    where = f"{cache}/{version}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(where).groupBy("_digest").agg(F.max("n_tokens").alias("n_tokens"))


@C.apart("n_bytes", "n_tokens", "over_limit")
def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048, spaces: bool = True, texts: bool = True) -> DataFrame:
    """``docs`` (without the text unless ``texts``) with ``n_bytes``, ``n_tokens`` and
    ``over_limit``; fills ``cache``."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    C.text_batches(spark)
    contents = docs.select("text").mapInArrow(lambda it: _digested(it, 0, spaces, "norm"), "_digest binary, _norm string")
    known = cached_counts(spark, cache, version)
    misses = contents.join(known, "_digest", "left_anti").dropDuplicates(["_digest"])
    misses.mapInArrow(lambda it: _count(it, tokenizer), "_digest binary, n_tokens long").write.mode("append").parquet(f"{cache}/{version}")
    at, fields = docs.columns.index("text"), [f for f in docs.schema.fields if texts or f.name != "text"]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("_digest", T.BinaryType())])
    sized = docs.mapInArrow(lambda it: _digested(it, at, spaces, "all" if texts else "rest"), schema)
    # written first, so that both sides of the join are plain exchanges and the partition
    # of a content with very many copies can be split
    counts = C.stored(cached_counts(spark, cache, version), "token-counts")
    out = sized.join(counts, "_digest").drop("_digest")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
