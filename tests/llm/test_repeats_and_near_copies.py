import collections
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bytesops as B
from sparkloom.llm import simhash as S
from sparkloom.llm import suffix_dedup as R
from sparkloom.llm.components import connected_components

from . import helpers as H


def plain_repeats(texts, length, keep):
    where = collections.defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            where[t[i : i + length]].append((d, i))
    cut = [bytearray(len(t)) for t in texts]
    for found in where.values():
        for d, i in (found if keep == "none" else found[1:]) if len(found) > 1 else ():
            cut[d][i : i + length] = b"\1" * length
    return [bytes(b for b, x in zip(t, c) if not x) for t, c in zip(texts, cut)]


def planted(length):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [some(rng.randint(length, 3 * length)) for _ in range(5)]
    texts = ["", "a" * (3 * length), "ab" * (2 * length), passages[0], passages[0]]
    for _ in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 40) :] if rng.random() < 0.6 else some(rng.randint(0, 2 * length)) for _ in range(rng.randint(1, 4))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [512, 2])
def test_repeats_match_brute_force(spark, keep, crowd):
    texts = planted(150)
    got = R.remove_repeats(H.frame(spark, texts), 150, keep, crowd).orderBy("doc_id").collect()
    want = plain_repeats([t.encode() for t in texts], 150, keep)
    assert [bytes(r.kept) for r in got] == want
    for r, t in zip(got, texts):
        assert r.n_bytes == len(t.encode()) and r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_spans == len(r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_repeats_edge_rows(spark):
    odd = R.remove_repeats(H.frame(spark), 128).orderBy("doc_id").collect()
    want = plain_repeats([(t or "").encode() for t in H.odd_texts()], 128, "none")
    assert [bytes(r.kept) for r in odd] == want and odd[0].size == "clash"
    row = (None, "z" * 10 + "".join(map(str, range(200))), "", "", 1, "", "", "")
    assert all(r.n_removed == r.n_bytes for r in R.remove_repeats(H.frame(spark, [], [row, row]), 128).collect())
    assert R.remove_repeats(H.empty(spark), 128).collect() == []


def test_long_texts_are_cut_in_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 1000)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef") for _ in range(700))
    text = "".join(rng.choice("ghij") for _ in range(3000)) + passage + "".join(rng.choice("klm") for _ in range(2100)) + passage
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"text": text}])
    starts = [a for *_, a in R._slices(batch, 150)]
    assert starts == list(range(0, len(text) - 149, 1000))
    windows = []
    for _, _, buf, off, a in R._slices(batch, 150):
        lo, hi, _, _ = R.anchors(buf, off, 150)
        windows += [a + i for x, y in zip(lo, hi) for i in range(x, y + 1)]
    assert windows == list(range(len(text) - 149))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5))
def test_factor_arrays_match_brute_force(texts):
    length = 16
    for keep in ("none", "first"):
        got = R.repeated_windows(texts, length, keep)
        where = collections.defaultdict(list)
        for d, t in enumerate(texts):
            for i in range(len(t) - length + 1):
                where[t[i : i + length]].append((d, i))
        want = {p for found in where.values() if len(found) > 1 for p in (found if keep == "none" else found[1:])}
        assert {(d, int(i)) for d, hits in enumerate(got) for i in hits} == want


def plain_fingerprint(text):
    w = H.words((text or "").translate(H.TO_LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints):
    ids, parent = list(prints), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    docs = H.documents(spark).select("doc_id", "text").unionByName(H.frame(spark).selectExpr("doc_id + 100000 AS doc_id", "text"))
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    want = plain_components(prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert len(set(want.values())) < len(want)


def test_simhash_null_ids_and_empty(spark):
    row = (None, "a b c d", "", "", 1, "", "", "")
    got = S.near_duplicates(H.frame(spark, [], [row, row, (5, "a b c d", "", "", 1, "", "", "")])).collect()
    assert [r.component_id for r in got] == [5, 5, 5]
    assert S.near_duplicates(H.empty(spark)).collect() == []


def flipped(rng, x, k):
    for b in rng.sample(range(64), k):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("crowd", [4096, 3])
def test_links_connect_all_pairs_within_three_bits(spark, crowd):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    prints |= {flipped(rng, centre, rng.randint(0, 2)) for _ in range(40)}
    for x in list(prints):
        prints.add(flipped(rng, x, rng.randint(1, 4)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = [(r.u, r.v) for r in S.link_fingerprints(table, crowd=crowd).collect()]
    for u, v in links:
        assert bin((u ^ v) & (1 << 64) - 1).count("1") <= 64
    parent = {signed(x): signed(x) for x in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[root(u)] = root(v)
    want = plain_components({signed(x): x for x in prints})
    assert len({(root(x), want[x]) for x in parent}) == len(set(want.values())) == len({root(x) for x in parent})


def test_golay_code_is_perfect():
    low, high, near = S.golay_tables()
    assert (near[:, 0] >= 0).all() and int((near >= 0).sum()) == 1 + 23 + 253 + 1771 + 8855
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 200)
    codes = S.codewords(words)
    flips = words ^ (1 << rng.integers(0, 23, 200))
    other = S.codewords(flips)
    assert all(set([a[0]]) <= set(b) for a, b in zip(codes.tolist(), other.tolist()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            x, y = root(u), root(v)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(parent)}


def test_crowd_links_are_exact(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(63)
    prints = sorted({flipped(rng, centre, rng.randint(0, 3)) & (1 << 63) - 1 for _ in range(25)})
    links = S.crowd_links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()
    assert all(bin(r.u ^ r.v).count("1") <= 3 for r in links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([(r.u, r.v) for r in links], "u long, v long")).collect()}
    want = plain_components({x: x for x in prints})
    assert {x: got.get(x, x) for x in prints} == want


def plain_wide(text):
    """A wide fingerprint by one bit after another."""
    w = H.words((text or "").translate(H.TO_LOWER))
    shingles = [" ".join(w[i : i + 5]).encode() for i in range(max(1, len(w) - 4))] if w else []
    counts = np.zeros(256, int)
    for s in shingles:
        h = B.span_hash(B.prefix(np.frombuffer(s, np.uint8)), np.array([0]), np.array([len(s)]))
        for k in range(4):
            x = int(B.mix(h + np.array([k * int(B.BASE) % (1 << 64)], np.uint64))[0])
            counts[64 * k : 64 * k + 64] += [x >> b & 1 for b in range(64)]
    return sum(1 << b for b in range(256) if 2 * counts[b] > len(shingles))


def plain_groups(prints, limit):
    """Smallest id of each component of all pairs within ``limit`` bits."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= limit:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_wide_fingerprints_match_plain_ones():
    import pyarrow as pa

    rng = random.Random(5)
    texts = H.odd_texts() + [" ".join(rng.choice("abcdefgh") for _ in range(1500))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = next(S._wide_fingerprints(iter([batch]), 5))
    for i, t in enumerate(texts):
        assert sum((got.column(2 + k)[i].as_py() & (1 << 64) - 1) << 64 * k for k in range(4)) == plain_wide(t)


@pytest.mark.parametrize("crowd", [4096, 5])
def test_similar_documents(spark, crowd):
    """Near copies of all kinds of similarity, a crowd of one text among them, against
    all pairs by brute force."""
    rng = random.Random(12)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 200, 600]))] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [edited(rng, rng.choice(base), rng.randint(1, 4)) for _ in range(50)] + [edited(rng, base[0], 1) for _ in range(60)]
    docs = H.frame(spark, texts + H.odd_texts())
    prints = {i: plain_wide(t) for i, t in enumerate(texts + H.odd_texts())}
    want, sure = plain_groups(prints, S.bits_apart(0.8)), plain_groups(prints, 26)
    got = {r.doc_id: r.component_id for r in S.similar_documents(docs, crowd=crowd).collect()}
    # no link is made that brute force does not make; those within 26 bits, which is a
    # similarity of 0.9, are all found, and of the others nearly all
    assert got.keys() == want.keys() and all(want[i] == want[c] for i, c in got.items())
    assert all(got[i] == got[c] for i, c in sure.items())
    assert len(set(want.values())) < len(want) - 60 and len(set(got.values())) <= len(set(want.values())) + 2


def test_similar_documents_null_ids_and_empty(spark):
    row = (None, "a b c d e f", "", "", 1, "", "", "")
    got = S.similar_documents(H.frame(spark, [], [row, row, (5, "a b c d e f", "", "", 1, "", "", "")])).collect()
    assert [r.component_id for r in got] == [5, 5, 5]
    assert S.similar_documents(H.empty(spark)).collect() == []


def test_runs_settle_whatever_their_length():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 30, 400))
    fp = rng.integers(0, 1 << 63, (400, 4), dtype=np.uint64)
    for i in range(0, 400, 2):
        fp[i] = fp[rng.integers(0, 20)] ^ (np.uint64(1) << np.uint64(rng.integers(0, 64)))
    links = {tuple(sorted(x)) for x in S._settled(key, fp, 10).tolist()}
    names = S._node(fp).tolist()
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    for i in range(400):
        for j in range(i):
            if key[i] == key[j] and S._differ(fp[i], fp[j]) <= 10:
                assert root(names[i]) == root(names[j])
    near = {tuple(sorted((names[i], names[j]))) for i in range(400) for j in range(i) if S._differ(fp[i], fp[j]) <= 20}
    assert links <= near


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 23, 300)
    for bits in (1, 2):
        other = words.copy()
        for i in range(len(other)):
            for b in rng.choice(23, bits, replace=False):
                other[i] ^= 1 << int(b)
        assert all({*a[a >= 0]} & {*b[b >= 0]} for a, b in zip(S.codewords(words), S.codewords(other)))


def test_repeats_on_documents_match_brute_force(spark):
    """All of the sf0.01 documents: places of every 400-byte string by its hash."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen = collections.Counter()
    for t in texts.values():
        seen.update(hash(t[i : i + 400]) for i in range(len(t) - 399))
    want = {}
    for d, t in texts.items():
        cut = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                cut[i : i + 400] = b"\1" * 400
        want[d] = bytes(b for b, x in zip(t, cut) if not x)
    got = R.remove_repeats(docs, 400, "none").select("doc_id", "n_removed", "kept").collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == want and sum(r.n_removed for r in got) > 0
