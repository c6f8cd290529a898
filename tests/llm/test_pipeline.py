import collections
import zlib

import corpus_pipeline
from sparkloom.llm import common as C
from sparkloom.llm import quality as Q

from . import helpers as H
from .test_lines_and_counts import plain_line_dedup
from .test_repeats_and_near_copies import plain_groups, plain_wide
from .test_shards_and_files import library_ids
from .test_text_models import plain_hits


def test_pipeline_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in H.documents(spark).collect()}
    kept = {r.doc_id for r in Q.judge(H.documents(spark), min_words=1, max_repeat_percent=100).filter("kept").collect()}
    assert 0 < len(kept) < len(docs)
    docs = {d: t for d, t in docs.items() if d in kept}
    docs = {d: x[2] for d, x in zip(docs, plain_line_dedup(list(docs.values()), 10))}
    part = plain_groups({d: plain_wide(t) for d, t in docs.items()}, 38)
    docs = {d: t for d, t in docs.items() if part[d] == d}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{H.DATA}/benchmark.parquet").collect()]
    docs = {d: t for (d, t), hit in zip(docs.items(), plain_hits(list(docs.values()), bench)) if not hit[1]}
    want = collections.Counter()
    for d, ids in zip(docs, library_ids(list(docs.values()), 0)):
        first = len(ids) % 2048 or 2048
        edges = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want[d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = corpus_pipeline.run(spark, H.DATA).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want


def test_stages_keep_columns_and_take_odd_rows(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    odd = H.frame(spark, None, [(None, "null id", "en", "s", 7, "", "", "")] * 2).selectExpr("doc_id + 100000 AS doc_id", *columns[1:])
    docs = H.documents(spark).unionByName(odd)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = C.stored(stage(spark, docs, H.DATA), f"test-{name}")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    rows = docs.collect()
    assert len(rows) and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    empty = H.empty(spark).select(*columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, H.DATA).collect() == []


def test_near_duplicate_stage_keeps_one_of_each(spark):
    texts = ["one two three four", "one two three four", None, "", " ", "five six seven"]
    extra = [(None, "one two three four", "", "", 1, "", "", ""), (None, "eight nine ten", "", "", 1, "", "", ""), (5, "again five other words", "", "", 1, "", "", "")]
    docs = H.frame(spark, texts, extra).select("doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.simhash_dedup(spark, docs, H.DATA).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got) == [(-1, "eight nine ten"), (0, "one two three four"), (2, ""), (5, "again five other words"), (5, "five six seven")]
