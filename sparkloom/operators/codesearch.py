"""Search over code symbols: comments before them, relations, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X

K1, B = 1.2, 0.75
#: Field weights, and words that count more in comments.
WEIGHTS = {"name": 5.0, "container": 3.0, "signature": 2.5, "comments": 2.0, "path": 1.5, "relationships": 1.2, "package": 1.0, "kind": 0.8}
COMMENT_WORDS = ["login", "auth", "authenticate", "token", "session", "credential"]


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def code_search(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Scores of symbols.  A token's weight rises with how few symbols contain it as a
    part of their text; lengths are held against the length of the query; a token that
    the query repeats counts again."""
    terms = X.query_tokens(query)
    once = list(dict.fromkeys(terms))
    if not terms:
        return symbols.withColumn("score", F.lit(0.0)).limit(0)
    stats = symbols.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(everything().contains(t)).alias(f"df{i}") for i, t in enumerate(once)])
    return scored(symbols, terms, stats, limit)


def everything() -> Column:
    """All that is searched of a symbol, as one text."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "kind", "container", "signature", "path", "package", "comments", "relationships")]))


def scored(symbols: DataFrame, terms: list[str], stats: DataFrame, limit: int) -> DataFrame:
    """The best symbols; ``stats`` is one row: n, the number of all, and for each different
    term in order df0, df1, ..., how many contain it."""
    once = list(dict.fromkeys(terms))
    s = symbols.crossJoin(F.broadcast(stats))  # one row
    for name in WEIGHTS:
        s = s.withColumn(f"k_{name}", X.tokens(name))
    score = F.lit(0.0)
    for t in terms:
        i = once.index(t)
        df = F.col(f"df{i}")
        idf = F.when(df > 0, 1.0 + (F.col("n") - df + 0.5) / (df + 0.5)).otherwise(0.0)
        for name, weight in WEIGHTS.items():
            tf = F.size(F.filter(f"k_{name}", _equals(t))).cast("double")
            denominator = tf + K1 * (1 - B + B * F.size(f"k_{name}") / float(len(terms)))
            score += F.when(tf > 0, weight * idf * tf * (K1 + 1) / denominator).otherwise(0.0)
    s = s.withColumn("score", F.round(score + boost(terms), 6))
    order = [F.desc("score"), "path", "name", *(["id"] if "id" in symbols.columns else [])]
    return s.filter("score > 0").orderBy(*order).limit(limit).drop("n", *[f"df{i}" for i in range(len(once))], *[f"k_{n}" for n in WEIGHTS])


def _equals(term: str):
    return lambda x: x == term


def boost(terms: list[str]) -> Column:
    q = " ".join(terms)
    out = F.when(_low("name") == q, 10.0).when(_low("name").startswith(q), 6.0).when(_low("name").contains(q), 4.0).otherwise(0.0)
    out += F.when(_low("container") == q, 5.0).otherwise(0.0)
    out += F.when(reduce(lambda a, b: a | b, [_low("path").contains(t) for t in terms]), 2.0).otherwise(0.0)
    asked = [w for w in COMMENT_WORDS if w in terms]
    if asked:
        out += F.when(reduce(lambda a, b: a | b, [_low("comments").contains(w) for w in asked]), 3.0).otherwise(0.0)
    return out


def preceding_comments(lines: DataFrame) -> DataFrame:
    """Comment lines right above a symbol, joined.  lines: path, number, text, symbol
    (null: no symbol starts there).  A run of comments belongs to the line after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("number")
    comment = F.trim("text").rlike(r"^(//|#|\*|/\*)")
    run = F.sum(F.when(comment, 0).otherwise(1)).over(w)
    rows = lines.withColumns({"_c": comment, "_run": run})
    plain = F.trim(F.regexp_replace("text", r"^\s*(//+|#+|/?\*+/?)\s?", ""))
    notes = rows.filter("_c").groupBy("path", (F.col("_run") + 1).alias("_run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", plain.alias("t")))), lambda x: x["t"]), " ").alias("comments"))
    return rows.filter("symbol IS NOT NULL AND NOT _c").join(notes, ["path", "_run"], "left").select("path", "number", "symbol", F.coalesce("comments", F.lit("")).alias("comments"))


def flattened(symbols: DataFrame) -> DataFrame:
    """A symbol table with ``parent`` ids to dotted containers, whatever the depth, by
    pointer doubling: each round joins a symbol's names so far to those above them.  A
    symbol whose parents go round in a circle gets those that the rounds had come to."""
    up = symbols.select(F.col("id").alias("_up"), F.col("name").alias("container"))
    s = symbols.select("id", "name", F.col("parent").alias("_up")).join(up, "_up", "left")
    s = T.stored(s.select("id", "name", F.when(F.col("container").isNotNull(), F.col("_up")).alias("_up"), F.coalesce("container", F.lit("")).alias("container")), "containers")
    open_ = None
    while (now := s.filter("_up IS NOT NULL").count()) not in (0, open_):
        above = s.select(F.col("id").alias("_up"), F.col("_up").alias("_next"), F.col("container").alias("_above"))
        j = s.join(above, "_up", "left")
        s = T.stored(j.select("id", "name", F.col("_next").alias("_up"), F.concat_ws(".", F.nullif("_above", F.lit("")), "container").alias("container")), "containers")
        open_ = now
    return s.drop("_up")
