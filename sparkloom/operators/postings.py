"""Keyword retrieval from a stored inverted index: posting blocks by term, upkeep by
deltas, and the best k of one query or of a table of queries at once.

An index is a folder of Parquet tables:

* ``docs``: one row a document: its number ``d``, what boosts read, and which fields it has;
* ``postings/bucket=...``: one row for each term, kind of entity and block of 256 numbers:
  ``p``, an array of (place in the block, field, count, length of the field), each packed in a
  number (see ``packed``), ``top``, the most counts and the least length in each field of the
  block, which bound what any of its documents can score, and ``docs``, how many have the term.  Rows are sorted by term, so that a reader takes the buckets of
  its terms and of these the row groups that hold them.  Parts of paths and categories of one
  to three characters are terms too (of no weight), as boosts look for substrings of these;
* ``terms/bucket=...``: changes to the document frequency of terms;
* ``gone``: numbers whose document was replaced or removed;
* ``updates``: one row for each update that is complete: changes to the number of documents and
  to the sums of field lengths, and the next free number.  It is written last, and rows of the
  other tables count only where theirs is there, so that an update that failed leaves no trace
  and can be tried again.

Blocks are ranges of numbers and not of places in a list, so blocks of several terms meet by
number: the sum of their bounds is what a document there can score at most.  A search scores
the most promising blocks of each query first; the k-th best score there is what others must
reach, and blocks that cannot are skipped.  Its results are those of ``lexical.keyword_search``.

Texts are dealt by block, and a block's postings are made in one piece, so what is shuffled is texts and
finished postings, not single counts.  A search likewise deals postings by block, each once however many
queries have its term; a block's documents are scored there, and only those go on that can be among the best.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X
from . import lexical as K

BLOCK = 256
BUCKETS = 32
#: Blocks that a query scores first, to learn what the others must reach.
FIRST = 8
#: With no more than so many times FIRST blocks a query, all are scored.
FEW = 8
#: So few live blocks are told to the scan by number.
NAMED = 256
#: The order of fields in postings.
FIELDS = list(dict.fromkeys(name for weights in K.WEIGHTS.values() for name in weights))
TITLE, TAGS, PATH = (FIELDS.index(n) for n in ("title", "tags", "path"))
#: Parts of paths and of categories stand where fields do.
PATH_PART, CATEGORY_PART = -1, -2

SCHEMAS = {
    "docs": "type string, id string, title string, path string, category string, tags array<string>, d long, block long, fields array<tinyint>",
    "postings": "term string, type string, block long, top array<long>, p array<long>, docs int, bucket int",
    "terms": "term string, df long, bucket int",
    "gone": "d long",
    "updates": "`update` int, since int, docs long, sums array<long>, have array<long>, next long",
}
MADE = "term string, type string, block long, top array<long>, p array<long>, docs int"
MADE_COLUMNS = ["term", "type", "block", "top", "p", "docs"]
#: Bits of a count and of a length in a packed posting.
BITS = 25


def packed(off: int, f: int, tf: int, length: int) -> int:
    """A posting as a number: place in the block, field, count, length of the field."""
    if length >> BITS:
        raise ValueError(f"a field of {length} tokens: postings hold less than {1 << BITS}")
    return ((off << 5 | f + 2) << BITS | tf) << BITS | length


def opened(x: Column) -> dict[str, Column]:
    """The parts of a packed posting."""
    low = F.lit((1 << BITS) - 1)
    return {
        "off": F.shiftright(x, 2 * BITS + 5).cast("int"), "f": F.shiftright(x, 2 * BITS).bitwiseAND(F.lit(31)).cast("int") - 2,
        "tf": F.shiftright(x, BITS).bitwiseAND(low).cast("int"), "len": x.bitwiseAND(low).cast("int"),
    }


def _made(names: list[str]):
    """What makes the postings of one block and kind from its lower-case texts."""
    fields = [(FIELDS.index(n), f"f_{n}") for n in names]
    tokens = re.compile("[a-z0-9]+").findall

    def make(rows: pa.Table) -> pa.Table:
        p: dict[str, list[int]] = {}
        offs = rows["off"].to_pylist()
        for f, name in fields:
            for off, text in zip(offs, rows[name].to_pylist()):
                if text:
                    words = tokens(text)
                    base = packed(off, f, 0, len(words))
                    for word, tf in Counter(words).items():
                        p.setdefault(word, []).append(base + (tf << BITS))
        for mark, f, name in (("\x01p", PATH_PART, "_path"), ("\x01c", CATEGORY_PART, "_category")):
            for off, text in zip(offs, rows[name].to_pylist()):
                for part in {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}:
                    p.setdefault(mark + part, []).append(packed(off, f, 1, 0))
        top, docs, low = [], [], (1 << BITS) - 1
        for each in p.values():
            most: dict[int, tuple[int, int]] = {}
            for x in each:
                f, tf, n = x >> 2 * BITS & 31, x >> BITS & low, x & low
                a, b = most.get(f, (tf, n))
                most[f] = max(a, tf), min(b, n)
            top.append([packed(0, f - 2, a, b) for f, (a, b) in most.items()])
            docs.append(len({x >> 2 * BITS + 5 for x in each if x >> 2 * BITS & 31 >= 2}))
        many = pa.list_(pa.int64())
        columns = [pa.array(list(p), pa.string()), pa.array([rows["type"][0].as_py()] * len(p), pa.string()), pa.array([rows["block"][0].as_py()] * len(p), pa.int64())]
        return pa.table([*columns, pa.array(top, many), pa.array([sorted(x) for x in p.values()], many), pa.array(docs, pa.int32())], ["term", "type", "block", "top", "p", "docs"])

    return make


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def _needed(text: Column, mark: str) -> Column:
    """The parts that a text with this substring has: its own of three characters, or itself."""
    n = F.length(text)
    three = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(3))))
    return F.array_distinct(three)


def _weights(kind: Column, f: Column) -> Column:
    """The weight of a field of an entity; parts have none."""
    by_kind = reduce(lambda a, k: a.when(kind == k, F.array(*[F.lit(float(K.WEIGHTS[k].get(n, 0.0))) for n in FIELDS])), list(K.WEIGHTS)[1:], F.when(kind == list(K.WEIGHTS)[0], F.array(*[F.lit(float(K.WEIGHTS[list(K.WEIGHTS)[0]].get(n, 0.0))) for n in FIELDS])))
    return F.when(f >= 0, F.coalesce(F.get(by_kind, f.cast("int")), F.lit(0.0))).otherwise(0.0)


def _type_boost(kind: Column) -> Column:
    return reduce(lambda a, k: a.when(kind == k, K.TYPE_BOOST[k]), list(K.TYPE_BOOST)[1:], F.when(kind == "doc", K.TYPE_BOOST["doc"])).otherwise(0.0)


def _phrase_pattern(q: Column) -> Column:
    """``functions.text.boundary_pattern`` of a column."""
    word = f"[{X.WORD_BYTES}]"
    left = F.when(F.substring(q, 1, 1).rlike(word), f"(?<!{word})").otherwise(f"(?<={word})")
    right = F.when(F.substring(q, -1, 1).rlike(word), f"(?!{word})").otherwise(f"(?={word})")
    return F.concat(F.lit("(?i)"), left, F.lit("\\Q"), F.replace(q, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), right)


def boosts(q: Column, every: Column, once: Column) -> Column:
    """``lexical.boosts`` for a column of trimmed lower-case queries and their tokens."""
    title, path, category = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "path", "category"))
    phrase = title.contains(q) & F.rlike(F.coalesce("title", F.lit("")), _phrase_pattern(q))
    out = F.when(title == q, 8.0).when(phrase, 4.0).otherwise(0.0)
    out += F.when(path == "", 0.0).when(path == q, 7.0).when(path.contains(q), 3.0).otherwise(0.0)
    out += F.when(category == q, 4.0).when((category != "") & category.contains(q), 2.0).otherwise(0.0)
    out += F.when(F.exists("tags", lambda t: F.lower(t) == q), 3.0).otherwise(0.0)
    words = F.transform(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(f"([{X.WORD_BYTES}]+)"), 1), F.lower)
    return out + F.when(F.size(every) > 1, F.size(F.array_intersect(once, words)) / F.size(once).cast("double") * 6.0).otherwise(0.0)


def query_table(queries: DataFrame) -> DataFrame:
    """``qid, q, every, once`` of the queries (``qid, query``) that have a token."""
    q = F.lower(F.regexp_replace(F.coalesce("query", F.lit("")), r"^\s+|\s+$", ""))
    every = X.tokens("query")
    return queries.select("qid", q.alias("q"), every.alias("every"), F.array_distinct(every).alias("once")).filter(F.size("every") > 0)


def _by_block(gone: DataFrame) -> DataFrame:
    """``block, dead``: places in each block whose document is gone."""
    return gone.groupBy(F.shiftright("d", 8).alias("block")).agg(F.collect_set(F.pmod("d", F.lit(BLOCK)).cast("int")).alias("dead"))


def _added(most: Column) -> Column:
    """What boosts can add at most, told from the terms of the query in each field: see ``boosts``."""
    out = F.when(most > 0, _type_boost(F.col("type"))).otherwise(0.0)
    out += F.when(F.col("title") == F.col("n"), 8.0).otherwise(0.0) + F.when(F.col("all") > 1, F.col("title") / F.col("n") * 6.0).otherwise(0.0)
    out += F.when(F.col("path_parts") < F.col("parts"), 0.0).when(F.col("path") == F.col("n"), 7.0).otherwise(3.0)
    return out + F.when(F.col("category_parts") < F.col("parts"), 0.0).otherwise(4.0) + F.when(F.col("tags") == F.col("n"), 3.0).otherwise(0.0)


class Index:
    """The inverted index of one corpus (see ``lexical.corpus``) in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _there(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/updates")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _complete(self) -> list:
        return sorted(self.spark.read.schema(SCHEMAS["updates"]).parquet(f"{self.path}/updates").collect(), key=lambda r: r["update"]) if self._there() else []

    def complete(self) -> bool:
        """Whether there has been an update."""
        return bool(self._complete())

    def _read(self, name: str, done: list) -> DataFrame:
        """A table's rows of complete updates."""
        rows = [f"{self.path}/{name}/update={r['update']}" for r in done if r["update"] >= done[-1]["since"]]
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*rows)

    def _write(self, df: DataFrame, name: str, update: int) -> None:
        """By bucket, sorted by term; several files for a bucket where there is much.  Terms are dealt by their hash,
        as dealing by range would make the rows twice, once to sample them."""
        files = -(-T.partitions(self.spark) // BUCKETS)
        slot = F.col("bucket") * files + F.pmod(F.xxhash64(F.lit(1), "term"), F.lit(files)).cast("int")
        by = [c for c in ("bucket", "term", "type", "block") if c in df.columns]
        dealt = df.repartition(BUCKETS * files, slot).sortWithinPartitions(*by)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/update={update}")

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Put in the rows of ``changed`` (a corpus), in place of those of the same type and id,
        and take out those of ``removed`` (``type, id``)."""
        done = self._complete()
        number, first = len(done), max((r["next"] for r in done), default=0)
        names = K._fields(changed)
        rows = T.numbered(changed, ["type", "id"], "_nth").withColumn("d", F.col("_nth") - 1 + first).drop("_nth").withColumn("block", F.shiftright("d", 8))
        has = F.array_compact(F.array(*[F.when(F.col(f"f_{n}").isNotNull(), F.lit(FIELDS.index(n))).cast("tinyint") for n in names]))
        docs = rows.select("type", "id", "title", "path", "category", "tags", "d", "block", has.alias("fields"))
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/update={number}")  # rows come by number

        low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        texts = rows.select("type", "block", F.pmod("d", F.lit(BLOCK)).cast("int").alias("off"), low("path").alias("_path"), low("category").alias("_category"), *[F.lower(f"f_{n}").alias(f"f_{n}") for n in names])
        blocks = texts.groupBy("block", "type").applyInArrow(_made(names), MADE)
        self._write(blocks.select(_bucket(F.col("term")), *MADE_COLUMNS), "postings", number)

        gone = self._lost(changed, removed, done) if done else self.spark.createDataFrame([], "d long, fields array<tinyint>")
        gone = T.stored(gone, "index-gone")
        gone.select("d").write.mode("overwrite").parquet(f"{self.path}/gone/update={number}")
        new = self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{self.path}/postings/update={number}").select("bucket", "term", "docs", "p", F.lit(1).alias("sign"))
        old = [T.stored(self._postings_of(gone, done).withColumn("sign", F.lit(-1)), "index-lost")] if done else []
        both = reduce(DataFrame.unionByName, old, new)
        change = both.filter("docs != 0").groupBy("bucket", "term").agg(F.sum(F.col("docs") * F.col("sign")).alias("df")).filter("df != 0")
        self._write(change, "terms", number)

        # a field's length is the sum of its counts
        x = opened(F.col("x"))
        sums = both.select("sign", F.explode("p").alias("x")).select(x["f"].alias("f"), (x["tf"] * F.col("sign")).alias("n")).filter("f >= 0").groupBy("f").agg(F.sum("n").alias("n"))
        held = docs.select(F.col("d"), "fields", F.lit(1).alias("sign")).unionByName(gone.select("d", "fields", F.lit(-1).alias("sign")))
        have = [F.coalesce(F.sum(F.when(F.array_contains("fields", F.lit(i).cast("tinyint")), F.col("sign"))), F.lit(0)).cast("long") for i in range(len(FIELDS))]
        sums = sums.agg(F.array(*[F.coalesce(F.sum(F.when(F.col("f") == i, F.col("n"))), F.lit(0)).cast("long") for i in range(len(FIELDS))]).alias("sums"))
        last = F.coalesce(F.max(F.when(F.col("sign") > 0, F.col("d"))) + 1, F.lit(first))
        # the next number starts a block of its own
        following = (F.ceil(last / BLOCK) * BLOCK).cast("long")
        note = held.agg(F.lit(number).alias("update"), F.lit(done[-1]["since"] if done else 0).alias("since"), F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("docs"), F.array(*have).alias("have"), following.alias("next"))
        note = note.crossJoin(F.broadcast(sums)).select("update", "since", "docs", "sums", "have", "next")  # one row each
        note.coalesce(1).write.mode("append").parquet(f"{self.path}/updates")

    def _postings_of(self, gone: DataFrame, done: list) -> DataFrame:
        """``bucket, term, docs, p``: what is posted of these documents."""
        dead = _by_block(gone)
        p = F.filter("p", lambda x: F.array_contains("dead", opened(x)["off"]) & (opened(x)["f"] >= 0))
        rows = self._read("postings", done).select("bucket", "term", "block", "p").join(dead, "block").select("bucket", "term", p.alias("p"))
        return rows.select("bucket", "term", F.size(F.array_distinct(F.transform("p", lambda x: opened(x)["off"]))).alias("docs"), "p").filter(F.size("p") > 0)

    def _lost(self, changed: DataFrame, removed: DataFrame | None, done: list) -> DataFrame:
        """``d, fields`` of documents that stand for the keys so far."""
        keys = changed.select("type", "id")
        keys = (keys if removed is None else keys.unionByName(removed.select("type", "id"))).distinct()
        return self._live(done).join(keys, ["type", "id"], "left_semi").select("d", "fields")

    def _live(self, done: list) -> DataFrame:
        return self._read("docs", done).join(self._read("gone", done), "d", "left_anti")

    def pinned(self) -> Reader:
        """The index as it is now, for searches that later updates do not touch."""
        return Reader(self, self._complete())

    def search(self, query: str, k: int = 20, kind: str = "all") -> DataFrame:
        """The best k of one query, in their order: as ``lexical.keyword_search``."""
        return self.pinned().search(query, k, kind)

    def search_many(self, queries: DataFrame, k: int | None = 20, kind: str = "all") -> DataFrame:
        """``qid, place, type, id, title, bm25, boost, score``: the best k (None: all, without a
        place) of each query of ``queries`` (``qid, query``), in one plan."""
        return self.pinned().search_many(queries, k, kind)

    def compact(self) -> None:
        """Rewrite all updates as one: postings of documents that are gone leave, numbers stay."""
        done = self._complete()
        number = len(done)
        gone = T.stored(self._read("gone", done), "index-gone")
        self._live(done).drop("update").write.mode("overwrite").parquet(f"{self.path}/docs/update={number}")
        rows = self._read("postings", done)
        left = F.filter("p", lambda x: ~F.array_contains("dead", opened(x)["off"]))
        kept = rows.join(_by_block(gone), "block", "left").withColumn("p", F.when(F.col("dead").isNull(), F.col("p")).otherwise(left)).filter(F.size("p") > 0)
        have = F.size(F.array_distinct(F.transform(F.filter("p", lambda x: opened(x)["f"] >= 0), lambda x: opened(x)["off"])))
        kept = kept.withColumn("docs", F.when(F.col("dead").isNull(), F.col("docs")).otherwise(have))
        self._write(kept.select("bucket", *MADE_COLUMNS), "postings", number)
        gone.limit(0).write.mode("overwrite").parquet(f"{self.path}/gone/update={number}")
        df = self._read("terms", done).groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df != 0")
        self._write(df, "terms", number)
        zeros = F.array(*[F.lit(0).cast("long")] * len(FIELDS))
        note = self.spark.range(1).select(F.lit(number).alias("update"), F.lit(number).alias("since"), F.lit(0).cast("long").alias("docs"), zeros.alias("sums"), zeros.alias("have"), F.lit(max(r["next"] for r in done)).cast("long").alias("next"))
        note.write.mode("append").parquet(f"{self.path}/updates")


class Reader:
    """An index as it was when it was pinned."""

    def __init__(self, index: Index, done: list):
        self.index, self.done, self.buckets, self.words, self.one, self.pruned = index, done, [], [], False, True

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written; what a single query consists of, in memory."""
        return self.index.spark.createDataFrame(df.collect(), df.schema) if self.one else T.stored(df, name)

    def statistics(self) -> tuple[int, list[float]]:
        """Documents, and the average length of each field (1 where it is 0 or unknown)."""
        docs = sum(r["docs"] for r in self.done)
        sums, have = ([sum(r[c][i] for r in self.done) for i in range(len(FIELDS))] for c in ("sums", "have"))
        return docs, [s / n if n and s else 1.0 for s, n in zip(sums, have)]

    def _read(self, name: str) -> DataFrame:
        """A table's rows; of those in buckets, the buckets of the terms of the search."""
        out = self.index._read(name, self.done)
        return out.filter(F.col("bucket").isin(self.buckets)) if "bucket" in out.columns else out

    def _terms(self, queries: DataFrame) -> DataFrame:
        """``qid, bucket, term, idf, need``: the terms of each query and, of no weight, the parts of
        it that a path or category with the query in it has."""
        docs, _ = self.statistics()
        kinds = F.array(*[F.struct(F.lit(f).alias("need"), terms.alias("terms")) for f, terms in ((0, F.col("once")), (PATH_PART, _needed(F.col("q"), "\x01p")), (CATEGORY_PART, _needed(F.col("q"), "\x01c")))])
        each = queries.select("qid", F.explode(kinds).alias("x")).select("qid", "x.need", F.explode("x.terms").alias("term")).select("qid", "need", "term", _bucket(F.col("term")))
        each = self._kept(each, "query-terms")
        # at most BUCKETS numbers, and the terms of a single query
        self.buckets = [r["bucket"] for r in each.select("bucket").distinct().collect()]
        self.words = [r["term"] for r in each.select("term").distinct().collect()] if self.one else []
        df = self._read("terms").join(each.filter("need = 0").select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.when(F.col("df") > 0, F.log1p((docs - F.col("df") + 0.5) / (F.col("df") + 0.5))).otherwise(0.0)
        return self._kept(each.join(df, "term", "left").select("qid", "need", "bucket", "term", idf.alias("idf")), "query-terms")

    def _asked(self, terms: DataFrame, *columns: str) -> DataFrame:
        """Postings of the terms, each once, dealt by block."""
        rows = self._read("postings").select("bucket", "term", "type", "block", *columns)
        if self.words:
            rows = rows.filter(F.col("term").isin(self.words))
        else:
            rows = rows.join(terms.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        return rows.repartition("block")

    def _with_terms(self, rows: DataFrame, terms: DataFrame) -> DataFrame:
        """Joined to the terms of queries; these are few beside the index, and where they are not small
        enough to be sent to all tasks, Spark joins by term."""
        return rows.join(F.broadcast(terms) if self.one else terms, ["bucket", "term"])

    def _impact(self, x: dict[str, Column], idf: Column, averages: list[float]) -> Column:
        length = K.K1 * (1 - K.B + K.B * x["len"] / F.get(F.array(*[F.lit(a) for a in averages]), x["f"].cast("int")))
        return F.when(x["f"] >= 0, _weights(F.col("type"), x["f"]) * idf * x["tf"] * (K.K1 + 1) / (x["tf"] + length)).otherwise(0.0)

    def bounds(self, queries: DataFrame, terms: DataFrame) -> DataFrame:
        """``qid, type, block, bound``: the most that a document of each block can score."""
        _, averages = self.statistics()
        met = self._with_terms(self._asked(terms, "top"), terms)
        most = F.aggregate("top", F.lit(0.0), lambda s, x: s + self._impact(opened(x), F.col("idf"), averages))
        within = lambda f: F.count_if((F.col("need") == 0) & F.exists("top", lambda x: opened(x)["f"] == f))
        block = met.groupBy("qid", "type", "block").agg(
            F.sum(most).alias("most"), F.count_if(F.col("need") == 0).alias("terms"),
            within(TITLE).alias("title"), within(TAGS).alias("tags"), within(PATH).alias("path"),
            F.count_if(F.col("need") == PATH_PART).alias("path_parts"), F.count_if(F.col("need") == CATEGORY_PART).alias("category_parts"),
        )
        block = block.join(self._sizes(queries), "qid")
        return block.select("qid", "type", "block", (F.col("most") + _added(F.col("most"))).alias("bound")).filter("bound > 0")

    def _sizes(self, queries: DataFrame) -> DataFrame:
        return queries.select("qid", F.size("once").alias("n"), F.size("every").alias("all"), F.size(_needed(F.col("q"), "")).alias("parts"))

    def _scored(self, queries: DataFrame, terms: DataFrame, live: DataFrame | None, kind: str, k: int | None, named: bool = False) -> DataFrame:
        """``qid, type, id, title, bm25, boost, score`` of the matches in ``live`` (``qid, type, block``) or all;
        with k, of those that can be among the k best."""
        _, averages = self.statistics()
        rows, docs = self._asked(terms, "p"), self._read("docs")
        rows = rows if kind == "all" else rows.filter(F.col("type") == kind)
        if named:
            blocks = [r["block"] for r in live.select("block").distinct().limit(NAMED + 1).collect()]
            if len(blocks) <= NAMED:
                # the row groups of these
                here = reduce(lambda a, b: a | b, [F.col("block") == b for b in blocks], F.lit(False))
                rows, docs = rows.filter(here), docs.filter(here)
        met = rows.join(_by_block(self._read("gone")), "block", "left")
        if live is not None:
            met = met.join(live.groupBy("block").agg(F.collect_set(F.struct("qid", "type")).alias("live")), "block")
        met = self._with_terms(met, terms)
        if live is not None:
            met = met.filter(F.array_contains("live", F.struct("qid", "type")))
        x = opened(F.col("x"))
        each = met.select("qid", "type", "block", "need", "idf", "dead", F.explode("p").alias("x")).select("*", *[c.alias(n) for n, c in x.items()])
        each = each.filter(F.col("dead").isNull() | ~F.array_contains("dead", F.col("off")))
        within = lambda f: F.count_if((F.col("need") == 0) & (F.col("f") == f))
        hits = each.groupBy("qid", "type", "block", "off").agg(
            F.sum(self._impact({n: F.col(n) for n in x}, F.col("idf"), averages)).alias("bm25"), F.count_if(F.col("need") == 0).alias("hit"),
            within(TITLE).alias("title"), within(TAGS).alias("tags"), within(PATH).alias("path"),
            F.count_if(F.col("need") == PATH_PART).alias("path_parts"), F.count_if(F.col("need") == CATEGORY_PART).alias("category_parts"),
        )
        hits = hits.join(self._sizes(queries), "qid").filter("hit > 0 OR path_parts = parts OR category_parts = parts")
        least = F.col("bm25") + F.when(F.col("bm25") > 0, _type_boost(F.col("type"))).otherwise(0.0)
        hits = hits.select("qid", "type", "block", (F.col("block") * BLOCK + F.col("off")).alias("d"), "bm25", least.alias("least"), (F.col("bm25") + _added(F.col("bm25"))).alias("most"))
        if k is not None:
            # boosts only add, so what k others have at least must be reached, up to rounding: in the block, then in all
            reach = F.col("most") + 2e-6 >= F.coalesce("kth", F.lit(0.0))
            kth = F.nth_value("least", k).over(Window.partitionBy("qid", "type", "block").orderBy(F.desc("least")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            hits = T.stored(hits.withColumn("kth", kth).filter(reach).drop("kth", "block"), "search-hits")
            best = hits.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("least")))).filter(F.col("n") <= k)
            hits = hits.join(best.filter(F.col("n") == k).select("qid", F.col("least").alias("kth")), "qid", "left").filter(reach)
        found = hits.select("qid", "d", "bm25").join(docs.select("d", "type", "id", "title", "path", "category", "tags"), "d").join(queries.select("qid", "q", "every", "once"), "qid")
        boost = boosts(F.col("q"), F.col("every"), F.col("once")) + F.when(F.col("bm25") > 0, _type_boost(F.col("type"))).otherwise(0.0)
        found = found.withColumn("boost", boost)
        found = found.withColumns({"score": F.round(F.col("bm25") + F.col("boost"), 6), "bm25": F.round("bm25", 6), "boost": F.round("boost", 6)})
        return found.filter("score > 0").select("qid", "type", "id", "title", "bm25", "boost", "score")

    def live_blocks(self, queries: DataFrame, terms: DataFrame, k: int, kind: str = "all") -> DataFrame:
        """``qid, type, block, bound, least``: ``least`` is the k-th best score in the blocks of
        the highest bounds; a block is live if its bound reaches it.  Where no query has
        many blocks it is 0, as looking for it would take longer than scoring them all."""
        blocks = self.bounds(queries, terms)
        blocks = T.stored(blocks if kind == "all" else blocks.filter(F.col("type") == kind), "block-bounds")
        self.pruned = not blocks.groupBy("qid").count().filter(F.col("count") > FIRST * FEW).isEmpty()
        if not self.pruned:
            return blocks.withColumn("least", F.lit(0.0))
        first = blocks.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "type", "block"))).filter(F.col("n") <= FIRST)
        scored = self._scored(queries, terms, first.select("qid", "type", "block"), kind, k)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
        least = scored.withColumn("n", place).filter(F.col("n") == k).select("qid", F.col("score").alias("least"))
        return blocks.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))

    def search_many(self, queries: DataFrame, k: int | None = 20, kind: str = "all") -> DataFrame:
        """``qid, place, type, id, title, bm25, boost, score``: the best k (None: all, without a
        place) of each query of ``queries`` (``qid, query``), in one plan."""
        asked = self._kept(query_table(queries), "queries")
        terms = self._terms(asked)
        if k is None:
            return self._scored(asked, terms, None, kind, None)
        # scores are rounded to six places
        live = self.live_blocks(asked, terms, k, kind).filter(F.col("bound") + 1e-6 >= F.col("least")).select("qid", "type", "block")
        live = T.stored(live, "live-blocks") if self.pruned else live
        scored = self._scored(asked, terms, live, kind, k, named=True)
        place = F.array_position(F.array(*map(F.lit, K.TYPE_ORDER)), F.col("type"))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), place, "title", "id")
        out = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
        return out.select("qid", "place", "type", "id", "title", "bm25", "boost", "score")

    def search(self, query: str, k: int = 20, kind: str = "all") -> DataFrame:
        """The best k of one query, in their order: as ``lexical.keyword_search``."""
        self.one = True
        one = self.index.spark.createDataFrame([(0, query)], "qid int, query string")
        return self.search_many(one, k, kind).orderBy("place").drop("qid", "place")
