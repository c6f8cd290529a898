import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import encoding as E
from sparkloom.llm import histogram_packing as P

from . import helpers as H

FILE = E.tokenizer_path("word_bpe_49k.json")
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def one_by_one(counts, capacity):
    """Totals of shortest-pack-first, piece by piece."""
    totals = []
    for size in range(capacity, 0, -1):
        for _ in range(counts.get(size, 0)):
            at = min(range(len(totals)), key=totals.__getitem__, default=None)
            if at is None or totals[at] + size > capacity:
                totals.append(size)
            else:
                totals[at] += size
    return sorted(totals)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=10))
def test_patterns_equal_one_by_one(counts):
    array = np.zeros(41, np.int64)
    for size, n in counts.items():
        array[size] = n
    patterns, packs = P.plan_patterns(array, 40)
    assert sorted(t for t, _, n in packs.tolist() for _ in range(n)) == one_by_one(counts, 40)
    held, ranks = {}, {}
    for size, first, n, each, pack, offset in patterns.tolist():
        for nth in range(n):
            ranks.setdefault(size, []).append(first + nth)
            held.setdefault(pack + nth // each, []).append((offset + nth % each * size, size))
    assert all(sorted(r) == list(range(counts[s])) for s, r in ranks.items()) and set(ranks) == set(counts)
    for total, first, n in packs.tolist():
        for pack in range(first, first + n):
            at = 0
            for offset, size in sorted(held[pack]):
                assert offset == at
                at += size
            assert at == total


def check(rows, docs, capacity):
    """``rows`` hold every id of (doc_id, text) once, gapless, without padding."""
    library = E.held(E.LibraryEncoder, FILE)
    want = {d: np.array([*library.encode([t or ""])[0], 2], "<u4") for d, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for doc, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[doc])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(want[doc][r["start"] : at])
        assert at == len(want[doc])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return by_sequence


@pytest.mark.parametrize("capacity", [4096, 64, 7])
def test_packing_matches_the_library_and_leaves_no_padding(spark, capacity):
    texts = H.odd_texts()
    rows = P.pack(H.frame(spark, texts), FILE, capacity=capacity).collect()
    sequences = check(rows, list(enumerate(texts)), capacity)
    total = sum(r["length"] for r in rows)
    assert len(sequences) == total // capacity + (total % capacity).bit_count()


def test_packing_of_documents(spark):
    docs = H.documents(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(P.pack(docs, FILE).collect(), pairs, 4096)


def test_nulls_repeats_long_texts_and_empty(spark):
    rows = [(None, "a b", "en", "s", 1, "c", "c", "c")] * 3 + [(4, None, "en", "s", 1, "c", "c", "c")] * 2 + [(5, "word, " * 300_000, "en", "s", 1, "c", "c", "c")]
    out = P.pack(spark.createDataFrame(rows, H.SCHEMA), FILE).collect()
    assert sum(r["length"] for r in out) == 3 * 3 + 2 + 600_001
    assert sum(r["length"] for r in out if r["doc_id"] is None) == 9
    long = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == 5)
    assert all(a + n == b for (a, n), (b, _) in zip(long, long[1:])) and long[-1][0] + long[-1][1] == 600_001
    ids_as_text = spark.createDataFrame([("x", "one two"), ("y", None)], "doc_id string, text string")
    assert {r["doc_id"] for r in P.pack(ids_as_text, FILE).collect()} == {"x", "y"}
    assert P.pack(H.empty(spark), FILE).columns == NAMES and P.pack(H.empty(spark), FILE).isEmpty()


def test_word_encoder_equals_the_library():
    encoder = E.held(E.WordEncoder, FILE)
    chars = [chr(i) for i in range(1, 0xD800) if not E._CASED.search(chr(i))]
    texts = [t for c in chars for t in (c, f"a{c}b", f"1{c}2", f"!{c}.")]
    rng = random.Random(3)
    pool = chars[:200] * 3 + rng.sample(chars, 400) + list("   '''\n\tabcdeAB12,.\x1c\u0085̇ΣİΑα") * 20
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["x" * 300_000, " " * 1_000_000, "<|endoftext|> It's <|startoftext|>"]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        assert [x.tolist() for x in encoder.encode(part)] == encoder.library.encode(part)
