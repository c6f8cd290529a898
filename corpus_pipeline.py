"""A training corpus from ``documents``: the stages in order, each written as Parquet
and read back as the next one's input.

1. quality rules: documents that the rules reject go, and those without a word.  The
   rules' own base limits on length are off here: a short clean document stays.
2. line dedup: lines that ten documents or more share go; ``n_chars`` follows.
3. SimHash near-dedup: five-word shingles and a similarity of 0.8 or more; the document
   of smallest id of each component stays.
4. benchmark decontamination: documents with a benchmark window go.
5. best-fit packing: the pieces of the documents that are left, in sequences.

Every stage but the last returns the columns of ``documents``.  Null texts count as
empty, as in the operators; a document that loses all its lines stays, empty, until the
near-duplicate stage, where all empty ones are one group.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import tables
from sparkloom.llm import common as C
from sparkloom.llm.decontam import decontaminate
from sparkloom.llm.encoding import tokenizer_path
from sparkloom.llm.line_dedup import drop_common_lines
from sparkloom.llm.packing import pack
from sparkloom.llm.quality import judge
from sparkloom.llm.queries import BYTE_VOCABULARY
from sparkloom.llm.simhash import similar_documents


def keeping_columns(stage):
    """The stage on tables with any extra columns: it sees them under names of their own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return C.apart(uses=("doc_id", "text", "n_chars"))(lambda own: stage(spark, own, sf_dir))(docs)

    return run


@keeping_columns
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge(docs, min_words=1, max_repeat_percent=100).filter("kept").select(*docs.columns)


@keeping_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_common_lines(docs, min_docs=10, min_chars=1).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


@keeping_columns
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of smallest doc_id stays (null ids last, equal ids by
    row key); repeated rows are one."""
    keyed = C.with_row_key(docs, "doc_id", "text")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *C.KEY)
    groups = similar_documents(keyed.select(row.alias("doc_id"), "text"), shingle=5, similarity=0.8)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id._k1", "doc_id._k2").distinct()
    return keyed.join(first, C.KEY, "left_semi").dropDuplicates(C.KEY).select(*docs.columns)


@keeping_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path(BYTE_VOCABULARY), capacity=2048, end=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Expectation-maximisation, byte-pair encoding and packing are not SQL; the tests
#: compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; of what they write only the last result stays."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables.written()
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        tables.forget(spark, mark, keep=1)
    return docs
