"""Extra columns whose names are those of working columns, or of results in another case."""

import pytest

import corpus_pipeline
from sparkloom.llm import decontam, gru_lm, histogram_packing, line_dedup, merkle, packing, quality, sharding, simhash, suffix_dedup, tandem, token_counts, token_store
from sparkloom.llm import common as C
from sparkloom.llm.encoding import tokenizer_path

from . import helpers as H

EXTRA = ["_k1", "_K2", "_drop", "_spans", "_digest", "_code", "_n_words", "_x0", "_x3", "_key", "_pos", "_batch", "rank", "_pid", "_norm", "ids", "gram", "none", "_segment", "at", "node", "_h1"]
RESULTS = ["N_LINES", "n_Dropped", "N_Bytes", "N_TOKENS", "Over_Limit", "N_removed", "Spans", "KEPT", "Quality", "Base_Failed", "N_WORDS", "fingerprint", "Component_ID", "shard", "Offset"]
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def frame(spark, texts=None):
    texts = [t for t in (H.odd_texts() if texts is None else texts)]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c} of {i}" for c in EXTRA + RESULTS]) for i, t in enumerate(texts)]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *EXTRA, *RESULTS]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in columns)).repartition(3)


def held(out, results):
    """Extra columns have their values, results are there once, and replace their namesakes."""
    names = [c.lower() for c in out.columns]
    assert len(set(names)) == len(names) and set(results) <= set(out.columns)
    rows = out.collect()
    for r in rows:
        for c in EXTRA:
            assert r[c] == f"{c} of {r['doc_id']}"
        for c in RESULTS:
            assert c in results or c.lower() in {x.lower() for x in results} or r[c] == f"{c} of {r['doc_id']}"
    return rows


OPERATORS = {
    1: (lambda s, d: line_dedup.drop_common_lines(d), ["n_lines", "n_dropped"]),
    2: (lambda s, d: token_counts.count_tokens(d, WORD, C.scratch(s, "clash")), ["n_bytes", "n_tokens", "over_limit"]),
    3: (lambda s, d: suffix_dedup.remove_repeats(d, length=128), ["n_bytes", "n_removed", "n_spans", "spans", "kept"]),
    5: (lambda s, d: decontam.decontaminate(d, s.createDataFrame([("a", "nothing like it at all")], "item_id string, text string")), []),
    8: (lambda s, d: quality.judge(d), [*quality.RESULTS, "base_failed", "quality", "kept"]),
}


@pytest.mark.parametrize("n", OPERATORS)
def test_extra_columns_come_back_unchanged(spark, n):
    run, results = OPERATORS[n]
    docs = frame(spark)
    assert len(held(run(spark, docs), results)) == docs.count()


def test_other_operators_take_any_extra_columns(spark):
    docs, plain = frame(spark), H.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.createDataFrame([("a", "nothing like it at all")], "item_id string, text string")

    def store(d):
        path = C.scratch(spark, "clash-store")
        token_store.write_store(d, path, BYTE, end=2)
        return token_store.read_documents(spark, path)

    for run in (
        sharding.shard_by_bytes,
        lambda d: decontam.benchmark_hits(d, bench).select("doc_id", "n_words", "spans", "items"),
        simhash.near_duplicates,
        store,
        lambda d: packing.pack(d, BYTE).select("doc_id", "piece", "start", "length", "ids_crc32"),
        lambda d: tandem.periodic_runs(d, planted=True),
        merkle.manifest,
        lambda d: histogram_packing.pack(d, WORD).select("doc_id", "doc_tokens").distinct(),
    ):
        assert sorted(map(repr, run(docs).collect())) == sorted(map(repr, run(plain.withColumn("source", C.F.lit("s"))).collect()))
    assert gru_lm.score_documents(docs).count() == docs.count()


def test_stages_keep_extra_columns(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, H.DATA)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c} of {r['doc_id']}" for c in EXTRA + RESULTS)
