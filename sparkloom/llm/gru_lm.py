"""Operator 7: a gated recurrent language model in numpy, trained and applied by Spark.

Counts.  Whole texts become blocks of about a million tokens: each block holds its
documents' tokens as numbers of the block's own sorted word list (64-bit hashes).
Only (word, block) pairs are shuffled: training counts are summed by word over all
blocks, and the totals are joined back to the blocks' words.

Model.  The output softmax is factored: first a class, then the word within it.  The
most frequent words (more of them the larger the vocabulary, see ``head_size``) form
classes of equal size, each with a softmax of its own; all other words belong to tail classes (by their last byte) and share their class's
probability by add-one counts, with one place left for words never seen.  Its biases
start at the logarithms of the corpus counts, so the start is the unigram model.  Cells
are gated recurrent units.

Training is data-parallel: in each round every task runs truncated backpropagation
through windows of its documents (state carried from window to window) from the
common weights, and the tasks' weights are averaged by their tokens.  Every round takes
its own share of the training documents (1 in ``rounds``), by a hash of the row, from
all blocks alike, so that over all rounds each document trains once.  A long document
trains as stretches side by side; each starts from the state that the 64 tokens before
it leave under the weights of the moment.  Scoring carries the state through each whole document.

Cases: a null text is an empty one (its end token only); a null doc_id counts as the
empty string and trains; repeated rows train and are scored as often as they come;
documents of any length are scored whole; ties in frequency follow the word hash; an
empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import copy
import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from . import common as C

U = np.uint64
END = U(0x5EED5EED5EED5EED)
TAILS = 32
#: Rows at a time of the class softmax, so that they stay in a core's cache.
ROWS = 1024
BLOCK = "block long, doc_id array<{id}>, held array<boolean>, lots array<long>, lens array<long>, tokens binary, words binary, tails binary, counts binary"


def _squeeze(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _loose(x: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


@B.tidied
def _make_blocks(batches, most):
    import pyarrow as pa

    pid, seq, held_now, parts = TaskContext.get().partitionId(), 0, 0, []

    def close():
        word, tail, lens, held = (np.concatenate(x) for x in list(zip(*parts))[:4])
        order = np.argsort(word)
        ranked = word[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        words, first = ranked[new], order[new]
        local = np.empty(len(word), np.uint32)
        local[order] = np.cumsum(new) - 1
        del order, ranked, new
        train = np.repeat(~held, lens)
        counts = np.bincount(local[train], minlength=len(words)).astype(np.int64)
        ids = pa.concat_arrays([p[4] for p in parts])
        lots = np.concatenate([p[5] for p in parts])
        cols = [pa.array([(pid << 32) + seq]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), B.list_column(held, [len(held)], pa.bool_()), B.list_column(lots, [len(lots)], pa.int64()), B.list_column(lens, [len(lens)], pa.int64())]
        cols += [pa.array([_squeeze(x)], pa.binary()) for x in (local, words, tail[first], counts)]
        return pa.RecordBatch.from_arrays(cols, ["block", "doc_id", "held", "lots", "lens", "tokens", "words", "tails", "counts"])

    for batch in batches:
        for row, n, buf, off in B.pieces(batch):
            buf = B.TO_LOWER[buf]
            starts, ends = B.spans(B.NOT_SPACE[buf], off)
            first = np.searchsorted(starts, off)
            lens = np.diff(first) + 1
            at = np.arange(len(starts)) + np.repeat(np.arange(n), lens - 1)
            word, tail = np.full(lens.sum(), END, U), np.zeros(lens.sum(), np.uint8)
            word[at] = B.span_hash(B.prefix(buf), starts, ends)
            tail[at] = buf[ends - 1] % TAILS if len(ends) else 0
            held = batch.column(1).slice(row, n).to_numpy(zero_copy_only=False).astype(bool)
            parts.append((word, tail, lens, held, batch.column(0).slice(row, n), batch.column(2).slice(row, n).to_numpy()))
            held_now += len(word)
            if held_now >= most:
                done = close()
                parts, held_now, seq = [], 0, seq + 1
                B.give_back()
                yield done
    if parts:
        yield close()


@B.tidied
def _word_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for r in batch.to_pylist():
            words, tails, counts = _loose(r["words"], np.int64), _loose(r["tails"], np.uint8), _loose(r["counts"], np.int64)
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.full(n, r["block"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(counts), pa.array(tails.astype(np.int32))], ["word", "block", "i", "n", "tail"])


def _softmax(h: np.ndarray, own: np.ndarray, w: np.ndarray, b: np.ndarray, share: int | None):
    """log P of each row's own column and, if ``share`` is given, the gradient of the
    logits of a mean over that many rows."""
    a, rows = h @ w, np.arange(len(own))
    a += b
    a -= a.max()
    mine = a[rows, own]
    e = np.exp(a)
    s = e @ np.ones(e.shape[1], np.float32)
    if s.min() < 1e-20:
        # a row lies far below the largest: each by its own
        shift = a.max(axis=1)
        mine -= shift
        e = np.exp(a - shift[:, None])
        s = e.sum(axis=1)
    out = mine - np.log(s)
    if share is None:
        return out, None
    e *= 1 / (s[:, None] * share)
    e[rows, own] -= 1 / share
    return out, e


class Model:
    """Weights by name; ``words`` are the sorted hashes of the head words."""

    def __init__(self, head: list[tuple[int, int]], tails: np.ndarray, hidden: int, width: int, recurrent: bool = True, seed: int = 7):
        # head: (hash, count) by falling count; tails: tokens of each tail class; without
        # recurrence only the last token tells what comes next
        self.memory = np.float32(recurrent)
        rng, n = np.random.default_rng(seed), len(head)
        self.hidden, self.width, self.heads = hidden, width, -(-n // width)
        hashes, counts = np.array([h for h, _ in head], np.int64).view(U), np.array([c for _, c in head], float)
        order = np.argsort(hashes)
        self.words, self.rank = hashes[order], order
        inner = np.full((self.heads, width), -30.0)
        inner.reshape(-1)[:n] = np.log(counts + 1)
        mass = np.append(np.exp(inner).sum(axis=1), tails + 1.0)
        self.p = {
            "table": rng.normal(0, 0.1, (n + TAILS, 3 * hidden)),
            "u": rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)),
            "class_w": np.zeros((hidden, self.heads + TAILS)),
            "class_b": np.log(mass / mass.sum()),
            "word_w": np.zeros((self.heads, hidden, width)),
            "word_b": inner,
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def ids(self, words: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Head words by rank, all others by tail class after them."""
        i = np.searchsorted(self.words, words)
        i[i == len(self.words)] = 0
        known = self.words[i] == words if len(self.words) else np.zeros(len(words), bool)
        out = len(self.words) + tails.astype(np.int64)
        out[known] = self.rank[i[known]]
        return out

    def step(self, x: np.ndarray, h: np.ndarray):
        k = self.hidden
        h = h * self.memory
        hu = h @ self.p["u"]
        gates = 1 / (1 + np.exp(-(x[:, : 2 * k] + hu[:, : 2 * k])))
        z, r = gates[:, :k], gates[:, k:]
        new = np.tanh(x[:, 2 * k :] + r * hu[:, 2 * k :])
        return new + z * (h - new), z, r, new, hu[:, 2 * k :]

    def output(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None):
        """log P(id | h) without the tails' inner part; with grads, also adds those of
        the mean loss and returns d loss / d h."""
        n, heads = len(self.words), self.heads
        cls = np.where(ids < n, ids // self.width, heads + ids - n)
        out, dh = np.empty(len(ids)), None if grads is None else np.empty_like(h)
        for i in range(0, len(ids), ROWS):
            hi, own = h[i : i + ROWS], cls[i : i + ROWS]
            out[i : i + ROWS], d = _softmax(hi, own, self.p["class_w"], self.p["class_b"], len(ids) if grads else None)
            if grads is not None:
                grads["class_w"] += hi.T @ d
                grads["class_b"] += d.sum(axis=0)
                np.matmul(d, self.p["class_w"].T, out=dh[i : i + ROWS])
        # words within their classes: the tokens of a class stand together
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cut = np.searchsorted(cls[order], np.arange(heads + 1))
        order = order[: cut[-1]]
        hs, inner, back = h[order], np.empty(len(order)), np.empty((len(order), h.shape[1]), np.float32)
        word = (ids[order] - cls[order] * self.width).astype(np.int64)
        for c in np.flatnonzero(np.diff(cut)):
            at = slice(cut[c], cut[c + 1])
            inner[at], d = _softmax(hs[at], word[at], self.p["word_w"][c], self.p["word_b"][c], len(ids) if grads else None)
            if grads is not None:
                grads["word_w"][c] += hs[at].T @ d
                grads["word_b"][c] += d.sum(axis=0)
                np.matmul(d, self.p["word_w"][c].T, out=back[at])
        out[order] += inner
        if grads is not None:
            dh[order] += back
        return out, dh

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


def _grid(ids: np.ndarray, first: np.ndarray, live: np.ndarray, a: int, b: int, lens: np.ndarray):
    """Tokens a..b of the live documents as [time][document], and which are real."""
    t = np.arange(a, b)[:, None]
    real = t < lens[live][None, :]
    return ids[np.where(real, first[live][None, :] + t, 0)], real


def _entry_states(model: Model, before: list[np.ndarray]) -> np.ndarray:
    """The state that each of some short texts leaves, under the present weights."""
    order = np.argsort([-len(x) for x in before], kind="stable")
    lens = np.array([len(before[i]) for i in order])
    grid = np.zeros((lens[0], len(before)), np.int64)
    for k, i in enumerate(order):
        grid[lens[0] - lens[k] :, k] = before[i]
    h = np.zeros((len(before), model.hidden), np.float32)
    for t in range(lens[0]):
        m = int(np.searchsorted(-lens, t - lens[0], "right"))
        h[:m] = model.step(model.p["table"][grid[t, :m]], h[:m])[0]
    out = np.empty_like(h)
    out[order] = h
    return out


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[rows] += values, where rows may repeat."""
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    out[ranked[first]] += np.add.reduceat(values[order], first)


class Adam:
    """Step sizes of the weights; lasts as long as a task."""

    def __init__(self, model: Model, rate: float = 0.01):
        self.rate, self.steps = rate, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))

    def move(self, model: Model, grads: dict) -> None:
        self.steps += 1
        norm = math.sqrt(sum(float(np.vdot(v, v)) for v in grads.values()))
        for k, v in grads.items():
            v *= min(1.0, 1.0 / (norm + 1e-9))
            mean, square = self.mean[k], self.square[k]
            mean += 0.1 * (v - mean)
            v *= v
            square += 0.01 * (v - square)
            model.p[k] -= (self.rate / (1 - 0.9**self.steps)) * mean / (np.sqrt(square / (1 - 0.99**self.steps)) + 1e-6)


def _window(model: Model, grid: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict]:
    """The state after a window, and the gradients of its mean loss."""
    k, steps, lanes = model.hidden, *grid.shape
    grads = {n: np.zeros_like(v) for n, v in model.p.items()}
    x = model.p["table"][grid]
    past, z, r, new, hu = (np.empty((steps, lanes, k), np.float32) for _ in range(5))
    for t in range(steps):
        past[t] = h
        h, z[t], r[t], new[t], hu[t] = model.step(x[t], h)
    back = np.zeros_like(past)
    back[real] = model.output(past[real], grid[real], grads)[1]
    # of the state after each step: d new, d z and d r before their bends
    to_new, to_z, to_r = (1 - z) * (1 - new * new), (past * model.memory - new) * z * (1 - z), hu * r * (1 - r)
    dx, du = np.empty_like(x), np.empty_like(x)
    carry, turned = np.zeros_like(h), model.p["u"].T
    for t in range(steps - 1, -1, -1):
        dn = dx[t, :, 2 * k :]
        np.multiply(carry, to_new[t], out=dn)
        np.multiply(carry, to_z[t], out=dx[t, :, :k])
        np.multiply(dn, to_r[t], out=dx[t, :, k : 2 * k])
        du[t, :, : 2 * k] = dx[t, :, : 2 * k]
        np.multiply(dn, r[t], out=du[t, :, 2 * k :])
        carry = model.memory * (carry * z[t] + du[t] @ turned) + back[t]
    grads["u"] += model.memory * (past.reshape(-1, k).T @ du.reshape(-1, 3 * k))
    _add_rows(grads["table"], grid[real], dx[real])
    return h, grads


def train(model: Model, docs: list[np.ndarray], adam: Adam | None = None, span: int = 32, lanes: int = 256, stretch: int = 512, warm: int = 64) -> int:
    """Truncated backpropagation over documents side by side, in stretches of equal
    length so that a long one does not run alone.  The state goes on from window to
    window; a stretch starts from what the ``warm`` tokens before it leave."""
    adam, seen = adam or Adam(model), 0
    # few texts go side by side in smaller numbers, so that they make steps enough
    items = sorted([(d[a : a + stretch], d[max(0, a - warm) : a]) for d in docs for a in range(0, len(d), stretch)], key=lambda x: len(x[0]), reverse=True)
    lanes = min(lanes, max(16, len(items) // 3))
    for g in range(0, len(items), lanes):
        group, before = zip(*items[g : g + lanes])
        lens = np.array([len(d) for d in group])
        ids, first = np.concatenate(group), np.cumsum(lens) - lens
        h = _entry_states(model, before)
        for a in range(0, lens[0], span):
            live = np.arange(int(np.searchsorted(-lens, -a, "left")))
            grid, real = _grid(ids, first, live, a, min(a + span, lens[0]), lens)
            h, grads = _window(model, grid, real, h[: len(live)])
            adam.move(model, grads)
            seen += int(real.sum())
    return seen


def score(model: Model, ids: np.ndarray, lens: np.ndarray, span: int = 64, most: int = 16_384) -> np.ndarray:
    """Natural-log P of each token less the tails' inner part, state carried from
    window to window through each whole document."""
    out = np.zeros(len(ids))
    start = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    lens, first = lens[order], start[order]
    h = np.zeros((len(lens), model.hidden), np.float32)
    for a in range(0, int(lens[0]) if len(lens) else 0, span):
        live = np.arange(int(np.searchsorted(-lens, -a, "left")))
        h = h[: len(live)]
        states, places = [], []
        for t in range(a, min(a + span, int(lens[0]))):
            m = int(np.searchsorted(-lens, -t, "left"))
            h = h[:m]
            at = first[:m] + t
            states.append(h)
            places.append(at)
            h = model.step(model.p["table"][ids[at]], h)[0]
        past, at = np.concatenate(states), np.concatenate(places)
        for i in range(0, len(at), most):
            out[at[i : i + most]] = model.output(past[i : i + most], ids[at[i : i + most]])[0]
    return out


@B.tidied
def _train_task(batches, shared, which, parts):
    import pyarrow as pa

    # a broadcast value stays in a reused worker: training it in place would reach later tasks
    model, tokens = copy.deepcopy(shared.value), 0
    adam = Adam(model)
    for batch in batches:
        for r in batch.to_pylist():
            lens = np.array(r["lens"])
            pick = ~np.array(r["held"]) & (np.array(r["lots"]) % parts == which)
            if pick.any():
                ids = model.ids(_loose(r["words"], U), _loose(r["tails"], np.uint8))[_loose(r["tokens"], np.uint32)]
                cut = np.append(0, np.cumsum(lens))
                tokens += train(model, [ids[cut[d] : cut[d + 1]] for d in np.flatnonzero(pick)], adam)
            B.give_back()
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([model.flat().astype(np.float32).tobytes()], pa.binary())], ["tokens", "weights"])


@B.tidied
def _average(batches):
    """One row for a partition: the mean of its weights by tokens."""
    import pyarrow as pa

    tokens, total = 0, None
    for batch in batches:
        for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = np.frombuffer(w, np.float32).astype(np.float64) * n
            tokens, total = tokens + n, w if total is None else total + w
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["tokens", "weights"])


def _averaged(local: DataFrame, tasks: int, fan: int = 16) -> np.ndarray | None:
    """The mean of all tasks' weights, as a tree: no task reads more than about ``fan``
    of them, nor does the driver."""
    while tasks > fan:
        tasks = -(-tasks // fan)
        local = local.repartition(tasks).mapInArrow(_average, "tokens long, weights binary")
    rows = local.collect()
    if not rows:
        return None
    return sum(np.frombuffer(r.weights, np.float32).astype(np.float64) * r.tokens for r in rows) / sum(r.tokens for r in rows)


@B.tidied
def _gather_counts(batches):
    """Rows sorted by block and word number to one row for each block."""
    import pyarrow as pa

    out = lambda b, c: pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([_squeeze(np.concatenate(c))], pa.binary())], ["of", "totals"])
    now, parts = None, []
    for batch in batches:
        block, c = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else []
        for a, b in zip(edges[:-1], edges[1:]):
            if block[a] != now and parts:
                yield out(now, parts)
                parts = []
            now = int(block[a])
            parts.append(c[a:b])
    if parts:
        yield out(now, parts)


@B.tidied
def _score_task(batches, shared):
    import pyarrow as pa

    model, tail_tokens, tail_words, n_all, v_all = shared.value
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda c: batch.column(batch.schema.get_field_index(c))[i]  # noqa: E731,B023
            lens, held = cell("lens").values.to_numpy(), cell("held").values
            words, tails = _loose(cell("words").as_py(), U), _loose(cell("tails").as_py(), np.uint8)
            local, c = _loose(cell("tokens").as_py(), np.uint32), _loose(cell("totals").as_py(), np.int64)
            word_ids = model.ids(words, tails).astype(np.int32)
            logs = score(model, word_ids[local], lens)
            inner = np.where(word_ids >= len(model.words), np.log((c + 1) / (tail_tokens[tails] + tail_words[tails] + 1)), 0.0)
            logs += inner[local]
            base = np.log10((c + 1) / (n_all + v_all + 1))[local]
            cut = np.cumsum(lens) - lens
            add = lambda x: np.add.reduceat(x, cut)  # noqa: E731,B023
            out = pa.RecordBatch.from_arrays([cell("doc_id").values, held, pa.array(lens), pa.array(add((c > 0)[local].astype(np.int64))), pa.array(np.full(len(lens), n_all)), pa.array(add(base)), pa.array(add(logs) / np.log(10))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            del logs, base, local, c
            B.give_back()
            yield out


def head_size(vocabulary: int) -> int:
    """Words with an output of their own: all of a small vocabulary, then as its square
    root, so that the weights stay small enough to send."""
    return max(1024, math.isqrt(vocabulary))


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, hidden: int = 16, width: int | None = None, head: int | None = None, rounds: int = 3, recurrent: bool = True, block_tokens: int = 1_200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    C.text_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % modulus == held
    blocks = C.stored(docs.select("doc_id", out.alias("held"), F.xxhash64("doc_id", "text").alias("lot"), "text").mapInArrow(lambda it: _make_blocks(it, block_tokens), BLOCK.format(id=kind)), "lm-blocks")
    rows = blocks.select("block", "words", "tails", "counts").mapInArrow(lambda it: _word_rows(it), "word long, block long, i int, n long, tail int")
    # summed first and then joined: both sides of the join are plain exchanges, so the
    # partition of a word that every block has can be split
    seen = C.stored(rows.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c"), F.min("tail").alias("tail")), "lm-counts")
    known = rows.select("word", "block", "i").join(seen.select("word", "c"), "word", "left").select("block", "i", F.coalesce("c", F.lit(0)).alias("c"))
    n_all, v_all = (int(x or 0) for x in seen.agg(F.sum("c"), F.count(F.lit(1))).first())
    head = head or head_size(v_all)
    width = width or math.isqrt(head)
    top = [(r.word, r.c) for r in seen.orderBy(F.desc("c"), "word").limit(head).select("word", "c").collect()]
    tail_tokens, tail_words = np.zeros(TAILS), np.zeros(TAILS)
    names = spark.createDataFrame([(w,) for w, _ in top], "word long")
    for k, n, v in seen.join(F.broadcast(names), "word", "left_anti").groupBy("tail").agg(F.sum("c"), F.count(F.lit(1))).collect():
        tail_tokens[k], tail_words[k] = n, v

    model = Model(top, tail_tokens, hidden, width, recurrent)
    tasks = blocks.rdd.getNumPartitions()
    for which in range(rounds if top else 0):
        shared = spark.sparkContext.broadcast(model)
        local = blocks.select("held", "lots", "lens", "tokens", "words", "tails").mapInArrow(lambda it, s=shared, w=which: _train_task(it, s, w, rounds), "tokens long, weights binary")
        mean = _averaged(local, tasks)
        if mean is not None:
            model.load(mean)

    totals = known.repartition(C.partitions(spark), "block").sortWithinPartitions("block", "i").mapInArrow(lambda it: _gather_counts(it), "of long, totals binary")
    shared = spark.sparkContext.broadcast((model, tail_tokens, tail_words, n_all, v_all))
    joined = blocks.select("block", "doc_id", "held", "lens", "tokens", "words", "tails").join(totals, F.col("block") == F.col("of"))
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.mapInArrow(lambda it: _score_task(it, shared), schema)
