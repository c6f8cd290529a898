"""Near-duplicate review of memories and decisions.

Scores: equal titles 0.98, equal contents 1.0, else the largest Jaccard similarity of
the token sets of title, content and everything; the same category adds 0.05.  A pair
with a Jaccard similarity of t shares a token among the rarest of each side, so
candidates come from a join on those (prefix filter): exact, and no pair of all rows
is formed.  Sets are joined, each once, and not the entries that have them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X
from . import refs as REFS

THRESHOLD, CATEGORY_BONUS = 0.72, 0.05
#: Rows of one token that meet all its others in one task, and ids of one title in a list.
BLOCK, UNIT = 4096, 64
KINDS = ["title", "content", "all"]
#: A word that is more than one in this many of all words is frequent, so fewer are: 4 MB at most.
FREQUENT = 1 << 18
#: Title words that say nothing of the topic.
TOPIC_STOP = ["and", "are", "but", "for", "from", "new", "old", "our", "the", "this", "that", "use", "uses", "using", "with"]


def _hashed(tokens):
    """64-bit hashes stand for the words of a set."""
    return F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))


def _cut(entries: DataFrame) -> DataFrame:
    """id, category, title, content and the token sets.  Each text is cut once: the tokens of everything are
    those of its parts (``s_more``: category and tags), as no token goes over a line break or blank."""
    more = F.concat_ws("\n", "category", F.array_join("tags", " "))
    return entries.select("id", F.lower("category").alias("category"), "title", "content", *[_hashed(X.letter_tokens(c)).alias(k) for k, c in (("s_title", "title"), ("s_content", "content"), ("s_more", more))])


def _all(sets: DataFrame) -> DataFrame:
    return sets.withColumn("s_all", F.array_distinct(F.concat("s_title", "s_more", "s_content")))


def prepared(entries: DataFrame) -> DataFrame:
    """id, category, normal forms and token sets."""
    return _all(_cut(entries)).withColumns({c: X.squeeze(c) for c in ("title", "content")})


def jaccard(a, b):
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _met(rows: DataFrame, near, *by: str) -> DataFrame:
    """``rows`` (``t`` and others) as a and b where they share the token ``t`` and are ``near``.  The
    rows of a frequent token are dealt to blocks by the columns ``by``, so none is one task."""
    often = rows.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")).filter("_blocks > 1")
    # at most one row for each BLOCK rows
    rows = rows.join(F.broadcast(often), "t", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    a = rows.withColumn("_block", F.pmod(F.xxhash64(*by), "_blocks").cast("int")).alias("a")
    b = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).alias("b")
    return a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a._block") == F.col("b._block")) & near)


def _ranked(sets: DataFrame) -> DataFrame:
    """``words`` of each row (``kind``, ``key``) as numbers in ascending order: the rarest word of all kinds has
    the smallest.  Words of different kinds are different.  m0 to m3: a bitmap of 256 bits, each set where
    the numbers that it stands for are odd in count."""
    rows = sets.select("kind", "key", F.explode("words").alias("t"))
    counts = rows.groupBy("kind", "t").agg(F.count(F.lit(1)).alias("_c"))
    numbers = T.numbered(counts, ["_c", "kind", "t"], "w").select("kind", "t", "w")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("w", 2).bitwiseAND(F.lit(63)).cast("int"))
    marks = [F.coalesce(F.bit_xor(F.when(F.col("w").bitwiseAND(F.lit(3)) == i, bit)), F.lit(0)).alias(f"m{i}") for i in range(4)]
    return rows.join(numbers, ["kind", "t"]).groupBy("kind", "key").agg(F.sort_array(F.collect_list("w")).alias("w"), *marks)


def _starts(batches, least, frequent):
    """Of each set its rarest words in ascending order of frequency, a row for each: place ``p``, the word
    with its kind as ``t``, the size n of the set and m0 to m3, a bitmap of 256 bits, each set where the
    words that it stands for are odd in count."""
    import pyarrow as pa

    common, rank = frequent.value
    for batch in batches:
        names = batch.schema.names
        lists = batch.column(names.index("words"))
        n = np.diff(lists.offsets.to_numpy())
        words, salt = lists.flatten().to_numpy(), batch.column(names.index("salt")).to_numpy()
        if not len(words):
            continue
        own = np.repeat(np.arange(len(n)), n)
        often = np.zeros(len(words), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, words), len(common) - 1)
            often = np.where(common[at] == words, rank[at], 0)
        order = np.lexsort((words, often, own))
        begin = np.cumsum(n) - n
        place = np.arange(len(words)) - np.repeat(begin, n)
        bit = np.left_shift(np.uint64(1), (words & 63).astype(np.uint64))
        part = words >> 6 & 3
        marks = [np.bitwise_xor.reduceat(np.where(part == i, bit, np.uint64(0)), begin).view(np.int64) for i in range(4)]
        some = place < np.repeat(n - np.ceil(n * least - 1e-9).astype(np.int64) + 1, n)
        of = own[some]
        t = words[order][some] ^ salt[of]
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index("key")).take(pa.array(of)), *map(pa.array, (t, place[some].astype(np.int32), n[of].astype(np.int32), *[m[of] for m in marks]))],
            ["key", "t", "p", "n", "m0", "m1", "m2", "m3"],
        )


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, j): pairs of keys a < b of ``sets`` (``kind, key, words``; each set once, none empty) of a kind
    with a Jaccard similarity j of ``least`` or more.  Words are their 64-bit hashes, or are hashed.

    Such sets share one of the size - ceil(least * size) + 1 first words of both, in any order that is the
    same for all; here frequent words come last, by how frequent they are, and the others before
    them by hash, so that the order takes no join.  Where the first
    shared one stands bounds what they can share in all, and so do bitmaps: where these differ, a word
    is in one set only.  The few pairs that pass are compared word by word."""
    spark = sets.sparkSession
    if dict(sets.dtypes)["words"] != "array<bigint>":
        sets = sets.withColumn("words", _hashed("words"))
    sets = T.stored(sets.select("kind", "key", "words").filter("size(words) > 0"), "review-sets")
    counts = sets.select(F.explode("words").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    total = sets.agg((F.sum(F.size("words")) / FREQUENT).alias("least"))
    often = counts.filter("c > 1").join(F.broadcast(total), F.col("c") > F.col("least")).select("t", "c").toArrow()
    t, c = often["t"].to_numpy(), often["c"].to_numpy()
    rank = np.empty(len(t), np.int64)
    rank[np.lexsort((t, c))] = np.arange(1, len(t) + 1)
    order = np.argsort(t)
    frequent = spark.sparkContext.broadcast((t[order], rank[order]))
    rows = sets.select("key", F.xxhash64("kind").alias("salt"), "words").mapInArrow(lambda it: _starts(it, least, frequent), f"key {dict(sets.dtypes)['key']}, t long, p int, n int, m0 long, m1 long, m2 long, m3 long")
    rows = T.stored(rows, "review-starts")
    both = F.col("a.n") + F.col("b.n")
    need = F.ceil(both * (least / (1 + least)) - 1e-9)
    apart = sum((F.bit_count(F.col(f"a.m{i}").bitwiseXOR(F.col(f"b.m{i}"))) for i in range(4)), F.lit(0))
    near = (F.col("a.key") < F.col("b.key")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least - 1e-9)
    near &= (F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) >= need) & (apart <= both - 2 * need)
    pairs = _met(rows, near, "key").select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    side = lambda x: sets.select(F.col("key").alias(x), F.col("words").alias(f"w_{x}"))
    both, all_ = F.size(F.array_intersect("w_a", "w_b")), F.size("w_a") + F.size("w_b")
    found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), all_.alias("all"))
    found = found.select("a", "b", (F.col("both") / (F.col("all") - F.col("both"))).alias("j"))
    # written, so that sets are compared once, however often and from whichever side the pairs are read
    return T.stored(found, "review-links").filter(F.col("j") >= least - 1e-9)


def _keyed(sets: DataFrame, *more: str) -> DataFrame:
    """Each entry with the key of all entries that have the same words in its title, content and everything
    (k_title, k_content, k_all) or, without words (``bare_`` is true), the same text; null where there is neither."""
    keys = []
    for kind, text in (("title", X.squeeze("title")), ("content", X.squeeze("content")), ("all", F.lit(""))):
        bare = F.size(f"s_{kind}") == 0
        said = [F.lit(kind), F.when(bare, text), F.sort_array(f"s_{kind}")]
        key = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), *said)), 16, "0") for i in (1, 2)])
        keys += [F.when(~bare | (text != ""), F.unhex(key)).alias(f"k_{kind}"), bare.alias(f"bare_{kind}")]
    return _all(sets).select("id", F.coalesce("category", F.lit("")).alias("category"), *more, "s_title", "s_content", "s_more", *keys)


def _by_kind(keyed: DataFrame, *more: str) -> DataFrame:
    """A row for each entry and kind that has a ``key``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("key"), F.col(f"bare_{k}").alias("bare")) for k in KINDS])).alias("s")
    return keyed.select("id", "category", *more, each).select("id", "category", *more, "s.*").filter("key IS NOT NULL")


def _sets_of(keyed: DataFrame) -> DataFrame:
    """``kind, key, words`` of all sets, each once and none empty."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("key"), F.col(f"s_{k}").alias("words")) for k in KINDS])).alias("s")
    return _all(keyed).select(each).select("s.*").filter("size(words) > 0").groupBy("key").agg(F.first("kind").alias("kind"), F.first("words").alias("words"))


def with_heads(sets: DataFrame) -> DataFrame:
    """``head``: the smallest id of the entries that say the same (in normal form)."""
    say = ["category", "title", "content", F.sort_array("s_all").alias("_words")]
    rows = sets.select("*", F.xxhash64(*say).alias("_k1"), F.xxhash64(F.lit(7), *say).alias("_k2"))
    heads = rows.groupBy("_k1", "_k2").agg(F.min("id").alias("head"))
    return rows.join(heads, ["_k1", "_k2"]).drop("_k1", "_k2")


def _scored(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, score, reasons of pairs at ``threshold`` or more."""
    side = lambda s: sets.drop("head").select([F.col(c).alias(f"{s}_{c}") if c != "id" else F.col("id").alias(s) for c in sets.columns if c != "head"])
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    title, content, all_ = (jaccard(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in ("s_title", "s_content", "s_all"))
    same_title = (F.col("a_title") != "") & (F.col("a_title") == F.col("b_title"))
    same_content = (F.col("a_content") != "") & (F.col("a_content") == F.col("b_content"))
    best = F.greatest(F.when(same_title, 0.98).otherwise(0.0), F.when(same_content, 1.0).otherwise(0.0), title, content, all_)
    same_kind = (F.col("a_category") != "") & (F.col("a_category") == F.col("b_category")) & (best > 0)
    score = F.when(same_kind, F.least(F.lit(1.0), best + CATEGORY_BONUS)).otherwise(best)
    reasons = F.array_compact(F.array(F.when(same_title, "title"), F.when(same_content, "content"), F.when(title >= threshold, "title_tokens"), F.when(content >= threshold, "content_tokens"), F.when(all_ >= threshold, "combined"), F.when(same_kind, "category")))
    return rows.select("a", "b", F.round(score, 6).alias("score"), F.array_join(reasons, ",").alias("reasons")).filter(F.col("score") >= threshold)


def review_pairs(entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, score, reasons of all pairs at ``threshold`` or more.  Entries that say the
    same are one class: pairs are between the heads of classes, and between a head and
    each other member, so copies are not expanded into all their pairs.

    What a pair scores is known from the kinds in which it was found: a similarity that is too low
    to be found is neither the score nor a reason."""
    sets = T.stored(with_heads(prepared(entries)), "review-sets")
    least = threshold - CATEGORY_BONUS - 1e-6
    texts = ["title_sum", "content_sum"]
    heads = sets.filter("id = head").withColumns({f"{c}_sum": F.when(F.col(c) != "", F.unhex(F.md5(c))) for c in ("title", "content")})
    classes = T.stored(_keyed(heads, *texts), "review-keyed")
    keyed = _by_kind(classes, *texts)
    side = lambda x: keyed.select(F.col("key").alias(x), F.struct("id", "category", *texts).alias(f"of_{x}"))
    links = similar_sets(_sets_of(classes), least)
    far = links.join(side("a"), "a").join(keyed.select(F.col("key").alias("b"), "kind", F.struct("id", "category", *texts).alias("of_b")), "b")
    own = keyed.select(F.col("key").alias("a"), "kind", F.when(F.col("bare"), 0.0).otherwise(1.0).alias("j"), F.struct("id", "category", *texts).alias("of_b"))
    own = own.join(side("a"), "a").filter("of_a.id < of_b.id")
    pairs = far.select("of_a", "of_b", "kind", "j").unionByName(own.select("of_a", "of_b", "kind", "j"))
    same = lambda c: F.coalesce(F.col(f"of_a.{c}") == F.col(f"of_b.{c}"), F.lit(False))
    ends = [f("of_a.id", "of_b.id").alias(x) for f, x in ((F.least, "a"), (F.greatest, "b"))]
    pairs = pairs.select(*ends, "kind", "j", same("title_sum").alias("st"), same("content_sum").alias("sc"), (same("category") & (F.col("of_a.category") != "")).alias("same"))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("j"))), F.lit(0.0)).alias(f"j_{kind}")
    pairs = pairs.groupBy("a", "b", "st", "sc", "same").agg(of("title"), of("content"), of("all"))
    full = lambda c: F.when(F.size(c) > 0, 1.0).otherwise(0.0)
    copies = sets.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"), (F.col("title") != "").alias("st"), (F.col("content") != "").alias("sc"), F.coalesce(F.col("category") != "", F.lit(False)).alias("same"), full("s_title").alias("j_title"), full("s_content").alias("j_content"), full("s_all").alias("j_all"))
    best = F.greatest(F.when(F.col("st"), 0.98).otherwise(0.0), F.when(F.col("sc"), 1.0).otherwise(0.0), "j_title", "j_content", "j_all")
    kind = F.col("same") & (best > 0)
    score = F.when(kind, F.least(F.lit(1.0), best + CATEGORY_BONUS)).otherwise(best)
    reasons = F.array_compact(F.array(F.when(F.col("st"), "title"), F.when(F.col("sc"), "content"), F.when(F.col("j_title") >= threshold, "title_tokens"), F.when(F.col("j_content") >= threshold, "content_tokens"), F.when(F.col("j_all") >= threshold, "combined"), F.when(kind, "category")))
    return pairs.unionByName(copies).select("a", "b", F.round(score, 6).alias("score"), F.array_join(reasons, ",").alias("reasons")).filter(F.col("score") >= threshold)


def _best(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("score"), "match")
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)


def _smallest(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The n smallest ids of each group, numbered by ``_n``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("_n") <= n)


def best_matches(entries: DataFrame, n: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """id, match, score, n: the n best matches of each entry among all others.

    No group of equals is paired out.  Entries with the same words (or, without words, the same text) in
    title, content or everything are a class there.  Seen from entries of one class and
    category, the members of a class score by it alike, but for the category, so of each class only
    the n + 1 smallest ids count, of all and of that category, and of what comes together
    only the n + 1 best.  A match among the n best of an entry is so in the kind that gives its score."""
    classes = T.stored(_keyed(_cut(entries)), "review-keyed")
    keyed = _by_kind(classes)
    links = similar_sets(_sets_of(classes), threshold - CATEGORY_BONUS - 1e-6)
    ways = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba")])
    links = links.select(F.explode(ways).alias("way"), "j").select("way.a", "way.b", "j")
    alike = F.when(F.col("bare") & (F.col("kind") == "title"), 0.98).otherwise(1.0)
    low = T.stored(_smallest(keyed.select("key", "category", "id", alike.alias("alike")), n + 1, "key", "category"), "review-low")
    seen = low.filter("_n = 1").select("key", "category", "alike")
    other = F.col("key").alias("other")
    met = seen.join(links, seen.key == links.a).select("key", "category", F.col("b").alias("other"), "j").unionByName(seen.select("key", "category", other, F.col("alike").alias("j")))
    met = T.stored(met, "review-met")
    bonus = F.when(F.col("category") != "", F.least(F.lit(1.0), F.col("j") + CATEGORY_BONUS)).otherwise(F.col("j"))
    same = met.join(low.select(other, "category", F.col("id").alias("match")), ["other", "category"]).select("key", "category", "match", bonus.alias("score"))
    rest = _smallest(low, n + 1, "key").select(other, F.col("category").alias("_other"), F.col("id").alias("match"))
    rest = met.join(rest, "other").filter("category != _other").select("key", "category", "match", F.col("j").alias("score"))
    found = same.unionByName(rest).withColumn("score", F.round("score", 6)).filter(F.col("score") >= threshold)
    best = Window.partitionBy("key", "category").orderBy(F.desc("score"), "match")
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= n + 1).drop("_n")
    found = keyed.select("key", "category", "id").join(found, ["key", "category"]).filter("id != match")
    return _best(found.groupBy("id", "match").agg(F.max("score").alias("score")), n)


def topic_conflicts(decisions: DataFrame) -> DataFrame:
    """Pairs of different titles that share two significant title tokens or more:
    0.82 and 0.03 for each more, 0.09 at most.  Two shared tokens are one besides the
    most frequent, so no join is made on a title's most frequent token.

    Titles are met, not decisions: each once, at the rarest token that two of them share, with the ids
    that have it in lists of some UNIT; what is shuffled grows as the decisions do, and only the result as
    their pairs."""
    stop = F.array(*map(F.lit, TOPIC_STOP))
    rows = decisions.select("id", X.squeeze("title").alias("key"), F.array_except(X.letter_tokens("title"), stop).alias("words")).filter("size(words) > 1")
    rows = T.stored(rows, "topic-titles")
    titles = rows.groupBy("key").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("_c"))
    ranked = _ranked(titles.withColumn("kind", F.lit("topic"))).select("key", "w")
    lists = rows.select("key", "id").join(titles.select("key", F.ceil(F.col("_c") / UNIT).alias("_lists")), "key")
    lists = lists.groupBy("key", F.pmod(F.xxhash64("id"), "_lists").alias("_list")).agg(F.collect_list("id").alias("ids"))
    rows = T.stored(lists.join(ranked, "key"), "topic-lists").withColumn("t", F.explode(F.slice("w", 1, F.size("w") - 1)))
    shared = F.array_intersect("a.w", "b.w")
    # the intersection keeps the order of the first, so its first is the rarest
    near = (F.col("a.key") < F.col("b.key")) & (F.size(shared) >= 2) & (F.get(shared, F.lit(0)) == F.col("a.t"))
    pairs = _met(rows, near, "key", "_list").select(F.col("a.ids").alias("_a"), F.col("b.ids").alias("_b"), F.size(shared).cast("long").alias("shared"))
    pairs = pairs.select(F.explode("_a").alias("_a"), "_b", "shared").select("_a", F.explode("_b").alias("_b"), "shared").filter("_a != _b")
    score = F.round(0.82 + F.least((F.col("shared") - 2) * 0.03, F.lit(0.09)), 6)
    return pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "shared", score.alias("score"))


def merge_matches(matches: DataFrame) -> DataFrame:
    """Of several results for an id the highest score and all reasons."""
    return matches.groupBy("id").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))


def cleanup_candidates(entries: DataFrame, as_of: str, days: int = 7, limit: int = 20) -> DataFrame:
    """The longest unchanged, oldest first."""
    hours = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp"))) / 3600
    aged = entries.withColumn("age_days", F.floor(hours / 24))
    return aged.filter(F.col("age_days") >= days).orderBy(F.desc("age_days"), "id").limit(limit)


def inbox(entries: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """(id, reason) of what wants a look: proposals, expired ones, lost sources."""
    expired = F.col("ttl_days").isNotNull() & (F.col("updated_at").cast("timestamp") + F.expr("make_interval(0, 0, 0, ttl_days)") < F.lit(as_of).cast("timestamp"))
    flags = F.array_compact(F.array(F.when(F.col("status") == "proposed", "proposed"), F.when(expired, "stale_ttl"), F.when(F.coalesce("source", F.lit("")) == "", "missing_source")))
    own = entries.select("id", F.explode(flags).alias("reason"))
    lost = entries.filter("source != ''").join(sources.select(F.col("id").alias("source")), "source", "left_anti").select("id", F.lit("source_missing").alias("reason"))
    return own.unionByName(lost)


def review_items(entries: DataFrame, known: DataFrame, decisions: DataFrame, matched: DataFrame, as_of: str) -> DataFrame:
    """id, reasons, issues, repairs of every entry that wants a look.

    ``entries``: id, status, updated_at, ttl_days, sources (references); ``known``: type and id of
    tasks, docs and memories; ``decisions``: id, status, superseded_by; ``matched``: ids of entries with
    a near duplicate.  Reasons come in the order proposed, duplicate_review (of proposals only),
    stale_ttl, then missing_source or what is wrong with the sources, by place: source_missing and
    source_decision_superseded.  A repair names the decision that replaces a superseded one.
    Sources that are no reference, or of another kind, are let be; null lists are empty."""
    refs = entries.select("id", F.posexplode("sources").alias("place", "source")).withColumn("r", REFS.parse(F.col("source")))
    refs = refs.filter(F.col("source").startswith("@") & F.col("r.valid")).select("id", "place", "source", F.col("r.type").alias("type"), F.col("r.target").alias("target"))
    # one row for each target that is there, so that no source is counted twice
    there = known.select("type", F.col("id").alias("target")).distinct().withColumn("_there", F.lit(True))
    made = decisions.groupBy(F.col("id").alias("target")).agg(F.first("status").alias("_status"), F.first("superseded_by").alias("_by")).withColumn("type", F.lit("decision"))
    refs = refs.filter(F.col("type").isin("task", "doc", "memory", "decision")).join(there, ["type", "target"], "left").join(made, ["type", "target"], "left")
    decision = F.col("type") == "decision"
    lost = F.when(decision, F.col("_status").isNull()).otherwise(F.col("_there").isNull())
    superseded = decision & ((F.col("_status") == "superseded") | (F.size("_by") > 0))
    code = F.when(lost, "source_missing").when(superseded, "source_decision_superseded")
    following = F.when(superseded, F.get("_by", F.lit(0)))
    issue = F.struct("place", code.alias("code"), "source", "target", following.alias("replacement"))
    found = refs.withColumn("issue", issue).filter("issue.code IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_list("issue")).alias("_issues"))
    rows = entries.join(found, "id", "left").join(matched.select("id").distinct().withColumn("_matched", F.lit(True)), "id", "left")
    issues = F.coalesce("_issues", F.array().cast("array<struct<place: int, code: string, source: string, target: string, replacement: string>>"))
    expired = F.col("ttl_days").isNotNull() & (F.col("updated_at").cast("timestamp") + F.expr("make_interval(0, 0, 0, ttl_days)") < F.lit(as_of).cast("timestamp"))
    proposed = F.col("status") == "proposed"
    own = F.array(
        F.when(proposed, "proposed"), F.when(proposed & F.col("_matched"), "duplicate_review"), F.when((F.col("status") == "stale") | expired, "stale_ttl"),
        F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "missing_source"),
    )
    reasons = F.array_distinct(F.concat(F.array_compact(own), F.transform(issues, lambda i: i["code"])))
    repairs = F.transform(F.filter(issues, lambda i: i["replacement"].isNotNull()), lambda i: F.struct(i["source"].alias("source"), F.concat(F.lit("@decision/"), i["replacement"]).alias("replacement")))
    return rows.select("id", reasons.alias("reasons"), issues.alias("issues"), repairs.alias("repairs")).filter(F.size("reasons") > 0)


def reason_counts(items: DataFrame) -> DataFrame:
    """How many entries have each reason."""
    return items.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def resolve(rows: DataFrame) -> DataFrame:
    """The state after a resolution: update, create, propose, reject or merge."""
    r = F.col("resolution")
    status = F.when(r == "propose", "proposed").when(r == "reject", "rejected").when(r == "merge", "merged").when(r.isin("update", "create"), "active").otherwise(F.col("status"))
    return rows.withColumns({"status": status, "merged_into": F.when(r == "merge", F.col("match"))})


def supersede(decisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of (new_id, old_id): links are added, the old one is superseded and a
    new draft accepted."""
    new = pairs.groupBy(F.col("new_id").alias("id")).agg(F.collect_set("old_id").alias("_olds"))
    old = pairs.groupBy(F.col("old_id").alias("id")).agg(F.collect_set("new_id").alias("_news"))
    d = decisions.join(new, "id", "left").join(old, "id", "left")
    none = F.array().cast("array<string>")
    status = F.when(F.col("_news").isNotNull(), "superseded").when(F.col("_olds").isNotNull() & (F.col("status") == "draft"), "accepted").otherwise(F.col("status"))
    return d.withColumns({"supersedes": F.array_union("supersedes", F.coalesce("_olds", none)), "superseded_by": F.array_union("superseded_by", F.coalesce("_news", none)), "status": status}).drop("_olds", "_news")
