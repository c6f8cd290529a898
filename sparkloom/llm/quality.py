"""Operator 8: quality rules by weak supervision.

Each rule looks at one feature of a whole text and votes good (1), bad (-1) or
abstains (0).  Several rules look at each kind of fault (``FAMILIES``).  A document is
good or has one kind of fault, and each rule has an accuracy for each of these classes;
expectation-maximisation over the counts of vote patterns (at most 3 ** rules rows,
whatever the corpus) estimates the accuracies and how common the classes are.  Nothing
pins them: a family only says where its class starts.  A document is kept if the
posterior probability of good is at least ``keep``: one vote of a rule that others do
not bear out can be outvoted, and one of a rule that proves exact cannot.  No rule
decides alone, save the base limits that the caller may ask for.

Cases: a null text has no words; in a text without words, or with too few, rules
abstain, and what is left is how common good documents are; texts of any length are
measured whole; ties in the posterior (equal to ``keep``) are kept; repeated rows count
as often as they come; an empty table gives an empty result; columns with the names of
the results, in any case, are replaced, other extra columns are kept whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from . import common as C

U = np.uint64
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPERCASE, LETTER, DIGIT = (np.zeros(256, bool) for _ in range(3))
UPPERCASE[65:91] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "n_odd_words"]


def features(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The features of each text; all are counts."""
    mask = B.NOT_SPACE[buf]
    starts, ends = B.spans(mask, off)
    first = np.searchsorted(starts, off)
    pre = B.prefix(buf)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = B.per_doc(mask & ((buf & 0xC0) != 0x80), off)
    out["n_symbols"] = B.per_doc(SYMBOL[buf], off)
    for name, table in (("n_upper", UPPERCASE), ("n_letters", LETTER), ("n_digits", DIGIT), ("n_marks", STOP)):
        out[name] = B.per_doc(table[buf], off)
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(LETTER[buf], out=letters[1:])
    docs = len(off) - 1
    out["n_odd_words"] = np.bincount(B.owner(starts, off)[letters[ends] == letters[starts]], minlength=docs)
    own = np.repeat(np.arange(docs), out["n_words"])
    salt = B.mix(np.arange(docs, dtype=U) + U(1))
    word = B.span_hash(pre, starts, ends)
    out["n_distinct"] = np.zeros(docs, np.int64)
    if len(word):
        # how many different words a document has: by (document, word) pairs
        pair = np.argsort(word ^ salt[own])
        key = (word ^ salt[own])[pair]
        fresh = np.append(True, key[1:] != key[:-1])
        out["n_distinct"] = np.bincount(own[pair[fresh]], minlength=docs)

    # words in windows of three that occur twice or more
    out["n_repeat_words"] = np.zeros(docs, np.int64)
    if len(word) >= 3:
        window = B.mix(word[:-2] * U(3) + B.mix(word[1:-1] * U(5) + B.mix(word[2:])))
        whole = np.flatnonzero(own[:-2] == own[2:])
        window = window[whole] ^ salt[own[whole]]
        again = whole[_repeated(window)]
        covered = np.zeros(len(word), bool)
        for k in range(3):
            covered[again + k] = True
        out["n_repeat_words"] = np.bincount(own[covered], minlength=docs)

    # lines with a word that equal an earlier one of their document
    line = np.ones(len(buf), bool)
    breaks = np.flatnonzero(buf == 10)
    line[breaks] = False
    a, b = B.spans(line, off)
    words_to = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(mask, out=words_to[1:])
    some = words_to[b] > words_to[a]
    a, b = a[some], b[some]
    host = B.owner(a, off)
    key = B.span_hash(pre, a, b) ^ salt[host]
    order = np.argsort(key)
    later = np.zeros(len(key), bool)
    if len(key):
        later[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(host[later], minlength=docs)
    out["n_lines"] = np.bincount(host, minlength=docs)
    return out


def _repeated(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


@B.tidied
def _measure(batches, keep):
    import pyarrow as pa

    for batch in batches:
        parts = [features(buf, off) for _, _, buf, off in B.pieces(batch)]
        cols = [np.concatenate([p[f] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for f in FEATURES]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *map(pa.array, cols)], [*[batch.schema.names[i] for i in keep], *["_" + f for f in FEATURES]])


def measured(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``docs`` (without the text unless ``texts``) with each feature as ``_<feature>``."""
    keep = [i for i, c in enumerate(docs.columns) if texts or c != "text"]
    schema = T.StructType([*[docs.schema.fields[i] for i in keep], *[T.StructField("_" + f, T.LongType()) for f in FEATURES]])
    return docs.mapInArrow(lambda it: _measure(it, keep), schema)


def _ratio(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict:
    """Votes by name.  Limits are shares of what a text has, so they hold at any
    length; a rule abstains between its two limits and where a text is too short.  They
    are close on purpose: a rule may be wrong at times, and that is estimated."""
    few, long = F.col("_n_words") >= 5, F.col("_n_words") >= 20
    size = _ratio("_word_chars", "_n_words")

    def vote(value, good, bad, when):
        low = good < bad
        yes = value <= good if low else value >= good
        no = value >= bad if low else value <= bad
        return F.when(~when, 0).when(no, -1).when(yes, 1).otherwise(0)

    return {
        "symbols": vote(_ratio("_n_symbols", "_n_words"), 0.02, 0.15, few),
        "letters": vote(_ratio("_n_letters", "_word_chars"), 0.93, 0.85, few),
        "odd_words": vote(_ratio("_n_odd_words", "_n_words"), 0.1, 0.3, few),
        "word_length": F.when(~few, 0).when(size.between(4, 6), 1).when(size.between(3.5, 7), 0).otherwise(-1),
        "repeats": vote(_ratio("_n_repeat_words", "_n_words"), 0.1, 0.3, long),
        "lines": vote(_ratio("_n_dup_lines", "_n_lines"), 0.05, 0.25, F.col("_n_lines") >= 3),
        "variety": vote(_ratio("_n_distinct", "_n_words"), 0.5, 0.35, long & (F.col("_n_words") <= 2000)),
        "capitals": vote(_ratio("_n_upper", "_n_letters"), 0.08, 0.3, F.col("_n_letters") >= 20),
        "sentences": vote(_ratio("_n_marks", "_n_words"), 0.15, 0.3, long),
    }


#: Rules that look at the same kind of fault.
FAMILIES = [["symbols", "letters", "odd_words", "word_length"], ["repeats", "lines", "variety"], ["capitals", "sentences"]]


def fit(patterns: np.ndarray, counts: np.ndarray, names: list[str], families: list[list[str]] = FAMILIES, rounds: int = 500, prior: float = 0.85, steady: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes and P(vote against | class, not abstaining) as
    [class][rule], by expectation-maximisation; abstaining says nothing.  Class 0 is
    good, class k has the fault of family k - 1.

    At the start a rule is against 6 in 10 documents with its family's fault and 1 in 10
    others; what it is in truth is learnt.  Counts become shares of their sum, so the
    corpus's size has no say; the start, as a share of ``steady``, steadies classes that
    are hardly there."""
    table = np.full((len(families) + 1, patterns.shape[1]), 0.1)
    for k, family in enumerate(families):
        table[k + 1, [names.index(r) for r in family]] = 0.6
    shares = np.append(prior, np.full(len(families), (1 - prior) / len(families)))
    if not len(counts):
        return shares, table
    against, voted = (patterns == -1).astype(float), (patterns != 0).astype(float)
    counts, first, start = counts / counts.sum(), shares, table
    for _ in range(rounds):
        weight = posterior(patterns, shares, table) * counts
        old, hold = table, steady * first
        shares = (weight.sum(axis=1) + hold) / (1 + steady)
        table = (weight @ against + hold[:, None] * start) / (weight @ voted + hold[:, None])
        if np.abs(table - old).max() < 1e-9:
            break
    return shares, table


def posterior(patterns: np.ndarray, shares: np.ndarray, table: np.ndarray) -> np.ndarray:
    """P(class | votes), [class][pattern]."""
    logs = np.log(table) @ (patterns == -1).T + np.log(1 - table) @ (patterns == 1).T + np.log(shares)[:, None]
    p = np.exp(logs - logs.max(axis=0))
    return p / p.sum(axis=0)


def probability_of_good(patterns: np.ndarray, shares: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The posterior of good.  Against switched labels, a class that rules vote against
    no more than they do against class 0 is good too."""
    good = table.mean(axis=1) <= table[0].mean()
    return posterior(patterns, shares, table)[good].sum(axis=0)


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@C.apart(*RESULTS, "base_failed", "quality", "kept")
def judge(docs: DataFrame, keep: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, texts: bool = True) -> DataFrame:
    """``docs`` (without the text unless ``texts``) with the counts, ``base_failed``,
    ``quality`` (the posterior) and ``kept``."""
    C.text_batches(docs.sparkSession)
    spark, votes = docs.sparkSession, rules()
    # each text is measured once; the counts of patterns and the result read this table
    rows = C.stored(measured(docs, texts), "quality-features")
    own = [c for c in docs.columns if texts or c != "text"]
    seen = rows.groupBy(*[v.cast("int").alias(k) for k, v in votes.items()]).count().toPandas()
    patterns, counts = seen[list(votes)].to_numpy(int), seen["count"].to_numpy(float)
    order = np.lexsort(patterns.T)
    patterns, counts = patterns[order], counts[order]
    # the posterior of each pattern seen: at most 3 ** rules rows, so it is broadcast
    good = np.round(probability_of_good(patterns, *fit(patterns, counts, list(votes))), 9)
    digits = [3**i for i in range(len(votes))]
    known = spark.createDataFrame([(int(c), float(q)) for c, q in zip((patterns + 1) @ np.array(digits), good)], "_code int, quality double")
    code = sum(((v.cast("int") + 1) * d for v, d in zip(votes.values(), digits)), F.lit(0))
    rows = rows.withColumn("_code", code).join(F.broadcast(known), "_code")
    failed = (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > max_repeat_percent * F.col("_n_words"))
    return rows.select(*own, *[F.col("_" + f).alias(f) for f in RESULTS], failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= keep)).alias("kept"))
