import collections
import math
import re
import zlib

import numpy as np
import pytest

from sparkloom.llm import decontam as D
from sparkloom.llm import gru_lm as G
from sparkloom.llm import quality as Q

from . import helpers as H

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(texts, items, window=10):
    queries = collections.defaultdict(set)
    for name, text in items:
        w = WORD.findall((text or "").translate(H.TO_LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            queries[tuple(w[i : i + window])].add(str(name))
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(H.TO_LOWER))
        hit, found = set(), set()
        for n in {len(q) for q in queries}:
            for i in range(len(w) - n + 1):
                if (q := tuple(w[i : i + n])) in queries:
                    hit |= set(range(i, i + n))
                    found |= queries[q]
        out.append((len(w), hit, sorted(found)))
    return out


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away"), (22, "short item here"), (3, None), (4, ""), (3, "!!!"), (5, "x"), (6, "Shared, line of MANY documents")]


def test_hits_match_brute_force(spark):
    texts = H.odd_texts() + ["so the QUICK brown-fox jumps over the lazy dog and runs", "quick brown fox", "a short item, here short item here", "the quick brown fox jumps over the lazy dog and runs away " * 3]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain_hits(texts, ITEMS)
    for block in (2_000_000, 8):
        got = D.benchmark_hits(H.frame(spark, texts), bench, block_words=block).orderBy("doc_id").collect()
        assert [(r.n_words, {i for s in r.spans for i in range(s.start, s.end)}, list(r["items"])) for r in got] == want
    clean = D.decontaminate(H.frame(spark, texts), bench).select("doc_id", "size").collect()
    assert {r.doc_id for r in clean} == {i for i, w in enumerate(want) if not w[1]} and clean[0].size == "clash"


def test_hits_on_documents(spark):
    docs = H.documents(spark).orderBy("doc_id").collect()
    bench = spark.read.parquet(f"{H.DATA}/benchmark.parquet")
    want = plain_hits([r.text for r in docs], [(r.item_id, r.text) for r in bench.collect()])
    got = D.benchmark_hits(H.documents(spark), bench).orderBy("doc_id").collect()
    assert [(r.n_words, {i for s in r.spans for i in range(s.start, s.end)}, list(r["items"])) for r in got] == want
    assert any(w[1] for w in want)


def test_hits_empty_repeated_and_null(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.benchmark_hits(H.empty(spark), bench).collect() == []
    none = D.benchmark_hits(H.frame(spark, ["a b"]), bench.limit(0)).collect()
    assert [(r.n_words, r.spans, r["items"]) for r in none] == [(2, [], [])]
    row = (None, "short item here", "", "", 1, "", "", "")
    for block in (2_000_000, 8):
        assert [list(r["items"]) for r in D.benchmark_hits(H.frame(spark, [], [row, row]), bench, block_words=block).collect()] == [["22"], ["22"]]


def test_items_without_an_id_count_as_hits_only(spark):
    bench = spark.createDataFrame([(None, "short item here"), ("None", "other words")], "item_id string, text string")
    got = D.benchmark_hits(H.frame(spark, ["a short item here", "other words", "a b"]), bench).orderBy("doc_id").collect()
    assert [(sum(s.end - s.start for s in r.spans), list(r["items"])) for r in got] == [(3, []), (2, ["None"]), (0, [])]


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    texts = ["blue then green and red", "red a b c d e f g h green blue", "red green blue", "red green", "blue red"]
    got = D.benchmark_hits(H.frame(spark, texts), bench, slop=2).orderBy("doc_id").collect()
    assert [bool(r.near_items) for r in got] == [True, False, True, False, False]
    assert [bool(r["items"]) for r in got] == [False, False, True, False, False]


def plain_features(text):
    w, t = H.words(text), text or ""
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    earlier, copies = set(), 0
    for line in t.split("\n"):
        if H.words(line):
            copies += line in earlier
            earlier.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), copies, len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_quality_features_match_brute_force(spark):
    texts = H.odd_texts()
    got = Q.judge(H.frame(spark)).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in NAMES) for r in got] == [plain_features(t) for t in texts]
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    assert Q.judge(H.empty(spark)).collect() == []


def test_quality_expression_equals_the_model(spark):
    docs = H.documents(spark)
    votes = Q.rules()
    rows = Q.measured(docs.select("doc_id", "text"), False).select("doc_id", *[v.cast("int").alias(k) for k, v in votes.items()]).toPandas()
    seen = rows.groupby(list(votes)).size().reset_index(name="n")
    shares, table = Q.fit(seen[list(votes)].to_numpy(int), seen["n"].to_numpy(float), list(votes))
    assert abs(shares.sum() - 1) < 1e-9
    want = dict(zip(rows["doc_id"], Q.probability_of_good(rows[list(votes)].to_numpy(int), shares, table)))
    got = {r.doc_id: r.quality for r in Q.judge(docs, texts=False).collect()}
    assert all(abs(got[d] - want[d]) < 1e-4 for d in want)


def test_quality_against_an_independent_model(spark):
    """The verdict on every document from votes and a fit in plain Python."""
    texts = [r.text for r in H.documents(spark).orderBy("doc_id").collect()]
    votes = [plain_votes(t) for t in texts]
    names = [n for family in Q.FAMILIES for n in family]
    start = [{n: 0.1 for n in names}] + [{n: 0.6 if n in family else 0.1 for n in names} for family in Q.FAMILIES]
    shares, table = [0.85, 0.05, 0.05, 0.05], [dict(t) for t in start]
    first = list(shares)

    def classes(v):
        p = [s * math.prod(t[n] if x < 0 else 1 - t[n] for n, x in v.items() if x) for s, t in zip(shares, table)]
        return [x / sum(p) for x in p]

    for _ in range(500):
        p, n = [classes(v) for v in votes], len(votes)
        old = table
        shares = [(sum(x[k] for x in p) / n + 1e-3 * first[k]) / 1.001 for k in range(4)]
        hold = [1e-3 * f for f in first]
        table = [{r: (sum(x[k] for x, v in zip(p, votes) if v[r] < 0) / n + hold[k] * start[k][r]) / (sum(x[k] for x, v in zip(p, votes) if v[r]) / n + hold[k]) for r in names} for k in range(4)]
        if max(abs(table[k][r] - old[k][r]) for k in range(4) for r in names) < 1e-9:
            break
    good = [k for k in range(4) if sum(table[k].values()) <= sum(table[0].values())]
    want = [sum(classes(v)[k] for k in good) for v in votes]
    got = Q.judge(H.documents(spark), min_words=1, max_repeat_percent=100).orderBy("doc_id").collect()
    assert all(abs(r.quality - q) < 1e-4 and r.kept == (q >= 0.5 and bool(H.words(r.text))) for r, q in zip(got, want, strict=True))


def plain_votes(text):
    w = H.words(text)
    raw, n = (text or "").encode(), len(w)
    chars, letter = sum(map(len, w)), lambda b: 65 <= b < 91 or 97 <= b < 123 or b >= 128
    letters = sum(map(letter, raw))
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    repeat = len({j for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
    lines = [x for x in (text or "").split("\n") if H.words(x)]
    per = lambda a, b: a / max(b, 1)

    def vote(x, good, bad, when):
        s = 1 if good < bad else -1
        return 0 if not when else -1 if s * x >= s * bad else 1 if s * x <= s * good else 0

    size = per(chars, n)
    return {
        "symbols": vote(per(len(re.findall(r"[#*$%&|<>]", text or "")), n), 0.02, 0.15, n >= 5),
        "letters": vote(per(letters, chars), 0.93, 0.85, n >= 5),
        "odd_words": vote(per(sum(not any(map(letter, x.encode())) for x in w), n), 0.1, 0.3, n >= 5),
        "word_length": 0 if n < 5 else 1 if 4 <= size <= 6 else 0 if 3.5 <= size <= 7 else -1,
        "repeats": vote(per(repeat, n), 0.1, 0.3, n >= 20),
        "lines": vote(per(len(lines) - len(set(lines)), len(lines)), 0.05, 0.25, len(lines) >= 3),
        "variety": vote(per(len(set(w)), n), 0.5, 0.35, 20 <= n <= 2000),
        "capitals": vote(per(sum(65 <= b < 91 for b in raw), letters), 0.08, 0.3, letters >= 20),
        "sentences": vote(per(sum(b in b".!?" for b in raw), n), 0.15, 0.3, n >= 20),
    }


def test_quality_agrees_with_labels(spark):
    """Labels have no part in the fit."""
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").withColumnRenamed("quality", "label")
    got = Q.judge(spark.read.parquet(f"{data}/documents.parquet"), min_words=1, texts=False).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.label == 1) for r in got) >= 0.98 * len(got)


FAMILIES = [["a", "b", "c"], ["d", "e"], ["f", "g"]]


def simulated(n=100_000, seed=0):
    """Votes of seven rules of known accuracy on documents of known classes."""
    rng = np.random.default_rng(seed)
    table = np.array([[0.02, 0.01, 0.15, 0.01, 0.03, 0.01, 0.02], [0.9, 0.7, 0.6, 0.05, 0.05, 0.02, 0.05], [0.05, 0.02, 0.2, 0.95, 0.8, 0.1, 0.02], [0.02, 0.1, 0.15, 0.02, 0.1, 0.85, 0.9]])
    kind = rng.choice(4, n, p=[0.85, 0.06, 0.05, 0.04])
    votes = np.where(rng.random((n, 7)) < table[kind], -1, 1)
    votes[rng.random((n, 7)) < 0.1] = 0
    return kind, votes, table


def fitted(votes):
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    return Q.fit(patterns, counts.astype(float), list("abcdefg"), FAMILIES)


def test_em_recovers_the_accuracies_of_rules():
    kind, votes, want = simulated()
    shares, table = fitted(votes)
    assert np.abs(shares - [0.85, 0.06, 0.05, 0.04]).max() < 0.01
    assert np.abs(table[0] - want[0]).max() < 0.01 and np.abs(table - want).max() < 0.1
    kept = Q.probability_of_good(votes, shares, table) >= 0.5
    assert (kept == (kind == 0)).mean() > (((votes != -1).all(axis=1)) == (kind == 0)).mean() + 0.1


def test_one_weak_vote_against_is_outvoted():
    _, votes, _ = simulated()
    model = fitted(votes)
    weak, strong, borne_out, unheard = (np.array([v]) for v in ([1, 1, -1, 1, 1, 1, 1], [-1, 0, 0, 1, 1, 1, 1], [-1, 1, -1, 1, 1, 1, 1], [0] * 7))
    assert Q.probability_of_good(weak, *model)[0] > 0.9 and Q.probability_of_good(unheard, *model)[0] > 0.8
    assert Q.probability_of_good(strong, *model)[0] < 0.5 and Q.probability_of_good(borne_out, *model)[0] < 0.5


def test_verdicts_differ_from_all_must_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    against = sum((v == -1).cast("int") for v in Q.rules().values())
    judged = Q.judge(docs, min_words=1, texts=False).select("doc_id", "kept")
    rows = Q.measured(docs.select("doc_id", "text"), False).select("doc_id", against.alias("against")).join(judged, "doc_id").collect()
    assert any(r.kept for r in rows if r.against) and any(not r.kept for r in rows if r.against)


def plain_base(rows):
    tokens = {i: H.words((t or "").translate(H.TO_LOWER)) + [None] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (out[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def test_language_model_base_and_held_out(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = plain_base([(r.doc_id, r.text) for r in docs.collect()])
    got = G.score_documents(docs, block_tokens=50_000).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_language_model_odd_rows(spark):
    texts = H.odd_texts()
    got = G.score_documents(H.frame(spark), head=20, width=4).orderBy("doc_id").collect()
    want = plain_base(list(enumerate(texts)))
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [want[i][:4] for i in range(len(texts))]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert G.score_documents(H.empty(spark)).collect() == []
    assert len(G.score_documents(H.frame(spark, [], [(None, "a", "", "", 1, "", "", "")] * 2)).collect()) == 2


def small_model():
    head = [(int(h), 50 - i) for i, h in enumerate(np.random.default_rng(1).integers(-(2**62), 2**62, 10))]
    model = G.Model(head, np.arange(G.TAILS, dtype=float), hidden=5, width=4)
    rng = np.random.default_rng(2)
    for k in ("class_w", "word_w", "table", "u"):
        model.p[k] = rng.normal(0, 0.5, model.p[k].shape).astype(np.float32)
    return model


def test_probabilities_sum_to_one():
    model = small_model()
    ids = np.arange(10 + G.TAILS)
    h = np.tile(np.random.default_rng(5).normal(size=5).astype(np.float32), (len(ids), 1))
    assert np.exp(model.output(h, ids)[0]).sum() == pytest.approx(1, abs=1e-5)


def test_scores_do_not_depend_on_windows_or_company():
    model, rng = small_model(), np.random.default_rng(3)
    docs = [rng.integers(0, 10 + G.TAILS, n) for n in (1, 7, 200, 33)]
    lens = np.array([len(d) for d in docs])
    together = G.score(model, np.concatenate(docs), lens, span=16, most=50)
    alone = np.concatenate([G.score(model, d, np.array([len(d)]), span=1000) for d in docs])
    assert np.allclose(together, alone, atol=1e-4)


def test_gradients_match_differences():
    """The step that training takes first goes down the loss, as the output layer's
    gradient by finite differences says."""
    model, rng = small_model(), np.random.default_rng(4)
    h, ids = rng.normal(size=(30, 5)).astype(np.float32), rng.integers(0, 10 + G.TAILS, 30)
    grads = {k: np.zeros_like(v) for k, v in model.p.items()}
    model.output(h, ids, grads)
    for name, at in (("class_w", (2, 1)), ("word_w", (1, 3, 2)), ("word_b", (0, 1)), ("class_b", (0,))):
        loss = []
        for step in (1e-2, -1e-2):
            model.p[name][at] += step
            loss.append(-model.output(h, ids)[0].mean())
            model.p[name][at] -= step
        assert grads[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-2, abs=2e-3)


def test_training_learns_a_sequence():
    model = small_model()
    docs = [np.array([0, 1, 2, 3] * 30) for _ in range(20)]
    assert G.score(model, docs[0], np.array([120])).mean() < -2
    for _ in range(60):
        G.train(model, docs)
    assert G.score(model, docs[0], np.array([120])).mean() > -0.2


def training_batch(model, docs):
    """One block of ``docs`` (word numbers), none held out, as the training tasks read it."""
    import pyarrow as pa

    words = model.words
    local = np.searchsorted(words, words[np.concatenate(docs)]).astype(np.uint32)
    cells = [G._squeeze(x) for x in (local, words, np.zeros(len(words), np.uint8))]
    return pa.RecordBatch.from_pylist([{"held": [False] * len(docs), "lots": list(range(len(docs))), "lens": [len(d) for d in docs], "tokens": cells[0], "words": cells[1], "tails": cells[2]}])


def test_tasks_of_one_worker_start_from_the_same_weights():
    """A reused worker hands the same broadcast value to each of its tasks."""
    model = small_model()
    shared, start = type("Shared", (), {"value": model}), model.flat()
    tasks = [training_batch(model, [np.arange(10)] * n) for n in (5, 9)]
    one_worker = [next(G._train_task(iter([t]), shared, 0, 1)).column(1)[0].as_py() for t in tasks]
    two_workers = [next(G._train_task(iter([t]), type("Shared", (), {"value": small_model()}), 0, 1)).column(1)[0].as_py() for t in tasks]
    assert one_worker == two_workers and (model.flat() == start).all()


def test_every_training_document_moves_the_weights(spark, monkeypatch):
    trained = []
    monkeypatch.setattr(G, "_averaged", lambda local, tasks: trained.append(local.agg({"tokens": "sum"}).first()[0] or 0))
    got = G.score_documents(H.documents(spark), block_tokens=20_000).collect()
    assert sum(trained) == sum(r.n_tokens for r in got if not r.held_out)


def test_stretches_go_on_from_the_text_before_them():
    """With stretches of one token only the carried state tells what comes next."""
    model, docs = small_model(), [np.array([0, 1, 2, 3] * 30) for _ in range(20)]
    for _ in range(60):
        G.train(model, docs, stretch=1)
    assert G.score(model, docs[0], np.array([120])).mean() > -0.7
    texts = [np.arange(n) % 10 for n in (0, 30, 64, 7)]
    states = G._entry_states(model, texts)
    for text, state in zip(texts, states):
        h = np.zeros((1, model.hidden), np.float32)
        for i in text:
            h = model.step(model.p["table"][[i]], h)[0]
        assert np.allclose(h[0], state, atol=1e-5)


def test_gradients_through_time_match_differences():
    model, rng = small_model(), np.random.default_rng(6)
    grid, h = rng.integers(0, 10 + G.TAILS, (5, 3)), rng.normal(size=(3, 5)).astype(np.float32)
    real = np.array([[True] * 3] * 4 + [[True, True, False]])

    def loss():
        state, out = h, []
        for t in range(5):
            out.append(model.output(state[real[t]], grid[t][real[t]])[0])
            state = model.step(model.p["table"][grid[t]], state)[0]
        return -np.concatenate(out).mean()

    for memory in (1, 0):
        model.memory = np.float32(memory)
        _, grads = G._window(model, grid, real, h)
        for name in ("u", "table", "class_w"):
            for at in zip(*np.unravel_index(np.argsort(-np.abs(grads[name]).reshape(-1))[:3], grads[name].shape)):
                ends = []
                for step in (1e-2, -1e-2):
                    model.p[name][at] += step
                    ends.append(loss())
                    model.p[name][at] -= step
                assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-3)


def test_recurrence_helps_on_held_out_documents(spark):
    """Base, a network without memory and the model, on documents it has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r: G.score_documents(docs, recurrent=r).filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first() for r in (True, False)}
    per = lambda r, c: rows[r][f"sum({c})"] / rows[r]["sum(n_tokens)"]
    assert per(True, "base_score") + 0.1 < per(False, "score") < per(True, "score") - 0.005


def test_head_grows_with_the_vocabulary():
    assert G.head_size(50) == 1024 < G.head_size(10**7) < G.head_size(10**9) < 10**5


def rare_fault():
    """Votes of clean documents, of 0.1% with one fault that its whole family sees, and of
    common faulty ones; and how common each is."""
    names = [n for family in Q.FAMILIES for n in family]
    against = lambda *rules: [-1 if n in rules else 1 for n in names]
    patterns = np.array([against(), against("symbols", "letters", "odd_words"), against("repeats", "variety"), against("capitals", "sentences"), against("lines"), against("repeats", "variety", "lines")])
    return names, patterns, np.array([0.909, 0.001, 0.03, 0.02, 0.03, 0.01])


def test_quality_does_not_depend_on_the_size_of_the_corpus():
    names, patterns, shares = rare_fault()
    small, large = (Q.probability_of_good(patterns, *Q.fit(patterns, shares * n, names)) for n in (10_000, 1_000_000))
    assert np.allclose(small, large, atol=1e-9)


def test_quality_rejects_a_rare_fault():
    names, patterns, shares = rare_fault()
    p = Q.probability_of_good(patterns, *Q.fit(patterns, shares * 10_000, names))
    assert p[0] > 0.9 and p[4] > 0.5 and (p[[1, 2, 3, 5]] < 0.5).all()


def test_a_corpus_without_faults_is_kept():
    names = [n for family in Q.FAMILIES for n in family]
    votes = np.where(np.random.default_rng(1).random((5000, len(names))) < 0.01, -1, 1)
    p = Q.probability_of_good(votes, *Q.fit(votes, np.ones(5000), names))
    assert (p >= 0.5).mean() > 0.97
