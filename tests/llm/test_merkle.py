import hashlib
import random
import zlib

import pytest

from sparkloom.llm import merkle as M

from . import helpers as H

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, arity):
    """All levels, from the leaves to the node above all."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, at, arity):
    out = []
    for nodes in levels[:-1]:
        low = at // arity * arity
        out.append((nodes[low:at], nodes[at + 1 : low + arity]))
        at //= arity
    return out


def brute(rows, arity=16):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], arity) for s in order}
    top = tree([trees[s][-1][0] for s in order], arity)
    out = []
    for n, s in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            doc, _, lang, n_chars, text = row
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and text is not None:
                text = text.translate(H.TO_LOWER)
            path = siblings(trees[s], at, arity) + siblings(top, n, arity)
            folded = leaf_of((doc, s, lang, n_chars, text))
            for left, right in path:
                folded = sha(*left, folded, *right)
            proof = sha(*[x for left, right in path for x in left + right])
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rows string, `at` long, node string, L0 string, _pid int, Path string, block int"


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1, "x", "x", 1, "x", 1) for r in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in M.manifest(docs, M.lowered_fifth(), **more).select(*COLUMNS).collect()]


def corpus(n, sources, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "One Two", "é" * 10, "Ünï A|b:3", "x" * 5000]
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (2, [None]), (17, ["a"]), (300, ["a", "é", None, "", "b"]), (900, ["hot"] * 40 + ["z", "Z", None])])
def test_manifest_matches_brute_force(spark, n, sources):
    rows = corpus(n, sources)
    assert sorted(run(spark, rows), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("arity, height, top", [(2, 2, 5), (3, 1, 2)])
def test_distributed_rounds_match_brute_force(spark, arity, height, top):
    for rows in (corpus(60, ["a", "b", None]), corpus(40, [f"s{i}" for i in range(25)])):
        assert sorted(run(spark, rows, arity=arity, height=height, top=top), key=repr) == sorted(brute(rows, arity), key=repr)


def test_nulls_ties_and_empty(spark):
    rows = [(None, None, None, None, None)] * 3 + [(7, "a", "en", 1, "T")] * 20 + [(7, "a", "en", 2, "T"), (10, "a", "en", 1, "long " * 400_000)]
    assert sorted(run(spark, rows), key=repr) == sorted(brute(rows), key=repr)
    assert run(spark, []) == []


def test_without_tampering_all_rows_verify(spark):
    docs = H.documents(spark)
    out = M.manifest(docs)
    assert out.filter("NOT verified").isEmpty() and out.count() == docs.count()
