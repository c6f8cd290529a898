"""Keyword retrieval: fielded BM25 with boosts, and the older additive scores.

A corpus is a table with ``type``, ``id``, ``title``, ``path``, ``category``, ``tags``
and the text of each weighted field in a column of its own (null: the entity has no
such field).  A query has few terms, so counts of terms are expressions on each row,
written once; statistics are one aggregation of them to one row, ranking one pass over
them and a top-k; nothing is exploded or shuffled by term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X

K1, B = 1.2, 0.75
#: Field weights by entity.
WEIGHTS = {
    "task": {"title": 4.0, "id": 5.0, "labels": 2.2, "description": 1.5, "plan": 1.0, "notes": 0.8, "acceptance": 0.8, "status_priority": 0.4},
    "doc": {"title": 4.0, "path": 3.2, "tags": 2.2, "description": 1.6, "content": 1.0},
    "memory": {"title": 4.0, "category": 2.8, "tags": 2.2, "content": 1.2, "layer": 0.4},
    "decision": {"title": 4.0, "id": 3.2, "status": 0.6, "tags": 2.2, "sources": 1.0, "related_docs": 1.0, "related_tasks": 1.0, "content": 1.2},
}
#: What a match adds by entity, and the order of entities in ties.
TYPE_BOOST = {"doc": 0.20, "task": 0.30, "memory": 0.05, "decision": 0.18}
TYPE_ORDER = ["doc", "decision", "task", "memory"]


def _text(c: Column, kind: str) -> Column:
    return F.array_join(c, " ") if kind.startswith("array") else c.cast("string")


def corpus(entities: DataFrame, kind: str) -> DataFrame:
    """An entity table in corpus form: fields become ``f_<name>`` text columns."""
    types = dict(entities.dtypes)
    have = lambda n, default: F.col(n) if n in types else F.lit(default)
    key = "path" if kind == "doc" else "id"
    fields = []
    for name in WEIGHTS[kind]:
        if name == "status_priority":
            fields.append(F.concat_ws(" ", *[n for n in ("status", "priority") if n in types]).alias("f_status_priority"))
        else:
            fields.append((F.coalesce(_text(F.col(name), types[name]), F.lit("")) if name in types else F.lit("")).alias(f"f_{name}"))
    tags = next((n for n in ("tags", "labels") if n in types), None)
    return entities.select(
        F.lit(kind).alias("type"), F.col(key).alias("id"), F.coalesce("title", F.lit("")).alias("title"), have("path", "").alias("path"), have("category", "").alias("category"),
        (F.col(tags) if tags and kind != "task" else F.array().cast("array<string>")).alias("tags"), *fields,
    )


def union_corpus(parts: list[DataFrame]) -> DataFrame:
    """Corpora of several kinds; a field that a kind does not have is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _fields(df: DataFrame) -> list[str]:
    """Names of the fields of a corpus, or of its counts."""
    return [c[2:] for c in df.columns if c.startswith("f_")] or [c[2:] for c in df.columns if c.startswith("n_")]


def _weight(name: str) -> Column:
    out = F.lit(0.0)
    for kind, weights in WEIGHTS.items():
        if name in weights:
            out = F.when(F.col("type") == kind, weights[name]).otherwise(out)
    return out


def counted(df: DataFrame, terms: list[str]) -> DataFrame:
    """Each field's length in tokens ``n_<field>`` and counts of the terms ``c_<field>``,
    in their order; a field that is null has length null."""
    names = _fields(df)
    df = df.withColumns({f"f_{n}": F.lower(f"f_{n}") for n in names})
    # cut at what is between tokens, which is faster than to look for each
    df = df.withColumns({f"k_{n}": F.array_remove(F.split(f"f_{n}", "[^a-z0-9]+"), "") for n in names})
    out = {f"n_{n}": F.when(F.col(f"k_{n}").isNotNull(), F.size(f"k_{n}")) for n in names}
    has = lambda n, t: F.when(F.contains(F.col(f"f_{n}"), F.lit(t)), F.size(f"k_{n}") - F.size(F.array_remove(f"k_{n}", t))).otherwise(0)
    out |= {f"c_{n}": F.array(*[has(n, t) for t in terms]) for n in names}
    return df.withColumns(out).drop(*[f"k_{n}" for n in names])


def statistics(rows: DataFrame, terms: list[str]) -> DataFrame:
    """One row: documents, the terms' inverse frequencies, average length of each field."""
    names = _fields(rows)
    df = [F.count_if(reduce(lambda a, b: a | b, [F.get(f"c_{n}", F.lit(i)) > 0 for n in names])).alias(f"df{i}") for i in range(len(terms))]
    counts = rows.agg(F.count(F.lit(1)).alias("docs"), *df, *[F.avg(f"n_{n}").alias(f"a_{n}") for n in names])
    idf = [F.when(F.col(f"df{i}") > 0, F.log1p((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))).otherwise(0.0) for i in range(len(terms))]
    return counts.select(F.array(*idf).alias("idf"), *[F.when(F.col(f"a_{n}") > 0, F.col(f"a_{n}")).otherwise(1.0).alias(f"a_{n}") for n in names])


def bm25(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Adds ``bm25``.  ``rows`` is counted(); what is left of filters is the corpus."""
    names = _fields(rows)
    joined = rows.crossJoin(F.broadcast(statistics(rows, terms)))  # one row

    def field(name: str) -> Column:
        length = K1 * (1 - B + B * F.col(f"n_{name}") / F.col(f"a_{name}"))
        part = lambda tf, idf: F.when(tf > 0, idf * tf * (K1 + 1) / (tf + length)).otherwise(0.0)
        return _weight(name) * F.aggregate(F.zip_with(f"c_{name}", "idf", part), F.lit(0.0), lambda a, x: a + x)

    score = sum((F.when(F.exists(f"c_{n}", lambda c: c > 0), field(n)).otherwise(0.0) for n in names), F.lit(0.0))
    return joined.withColumn("bm25", score).drop("idf", *[f"a_{n}" for n in names])


def boosts(query: str, terms: list[str]) -> Column:
    """What titles, paths, categories and tags add, whether or not a term matches."""
    q = query.strip().lower()
    title, path, category = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "path", "category"))
    out = F.when(title == q, 8.0).when(X.has_phrase("title", q), 4.0).otherwise(0.0)
    out += F.when(path == "", 0.0).when(path == q, 7.0).when(path.contains(q), 3.0).otherwise(0.0)
    out += F.when(category == q, 4.0).when((category != "") & category.contains(q), 2.0).otherwise(0.0)
    out += F.when(F.exists("tags", lambda t: F.lower(t) == q), 3.0).otherwise(0.0)
    if len(terms) > 1:
        once = list(dict.fromkeys(terms))
        hit = sum((F.when(X.boundary_count("title", t) > 0, 1).otherwise(0) for t in once), F.lit(0))
        out += hit / float(len(once)) * 6.0
    return out


def keyword_scores(rows: DataFrame, query: str) -> DataFrame:
    """type, id, title, bm25, boost, score of all matches.  Blank queries and queries
    without a token match nothing."""
    every = X.query_tokens(query)
    terms = list(dict.fromkeys(every))
    if not terms:
        return rows.select("type", "id", "title", *[F.lit(0.0).alias(c) for c in ("bm25", "boost", "score")]).limit(0)
    # each text is cut into tokens once: statistics and scores read the written counts
    counts = T.stored(counted(rows, terms).drop(*[f"f_{n}" for n in _fields(rows)]), "term-counts")
    scored = bm25(counts, terms)
    by_type = reduce(lambda a, k: a.when(F.col("type") == k, TYPE_BOOST[k]), list(TYPE_BOOST)[1:], F.when(F.col("type") == "doc", TYPE_BOOST["doc"])).otherwise(0.0)
    scored = scored.withColumn("boost", boosts(query, every) + F.when(F.col("bm25") > 0, by_type).otherwise(0.0))
    scored = scored.withColumns({"score": F.round(F.col("bm25") + F.col("boost"), 6), "bm25": F.round("bm25", 6), "boost": F.round("boost", 6)})
    return scored.filter("score > 0").select("type", "id", "title", "bm25", "boost", "score")


def keyword_search(rows: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The best of keyword_scores()."""
    place = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type"))
    return keyword_scores(rows, query).orderBy(F.desc("score"), place, "title", "id").limit(limit)


def heuristic_task_score(query: str) -> Column:
    """The older additive score of a task: points for phrases and parts of them."""
    q, words = query.lower(), query.lower().split()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    score = F.when(X.has_phrase("title", q), F.when(low("title") == q, 100.0).otherwise(60.0)).when(low("title").contains(q), 30.0).otherwise(0.0)
    score += F.when(low("id").contains(q), 30.0).otherwise(0.0)
    score += F.when(X.has_phrase("description", q), 25.0).when(low("description").contains(q), 15.0).otherwise(0.0)
    score += 10.0 * F.size(F.filter("labels", lambda x: F.lower(x).contains(q)))
    if len(words) > 1:
        part = F.lit(0.0)
        for w in words:
            for name, whole, piece in (("title", 2.0, 0.5), ("description", 1.0, 0.3)):
                part += F.when(X.boundary_count(name, w) > 0, whole).when(low(name).contains(w), piece).otherwise(0.0)
        score += part / float(len(words)) * 20.0
    return score


def heuristic_doc_score(query: str) -> Column:
    """The same for a doc: title, path, description, tags and content."""
    q, words = query.lower(), query.lower().split()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    score = F.when(X.has_phrase("title", q), F.when(low("title") == q, 100.0).otherwise(60.0)).when(low("title").contains(q), 30.0).otherwise(0.0)
    score += F.when(low("path").contains(q), 25.0).otherwise(0.0)
    score += F.when(X.has_phrase("description", q), 25.0).when(low("description").contains(q), 15.0).otherwise(0.0)
    score += F.when(X.has_phrase("content", q), 20.0).when(low("content").contains(q), 10.0).otherwise(0.0)
    score += 10.0 * F.size(F.filter("tags", lambda x: F.lower(x).contains(q)))
    if len(words) > 1:
        part = F.lit(0.0)
        for w in words:
            for name, whole, piece in (("title", 2.0, 0.5), ("content", 1.0, 0.3)):
                part += F.when(X.boundary_count(name, w) > 0, whole).when(low(name).contains(w), piece).otherwise(0.0)
        score += part / float(len(words)) * 20.0
    return score
