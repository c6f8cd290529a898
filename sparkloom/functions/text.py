"""Column functions on text: tokens, word boundaries, snippets, slugs, cases, durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BYTES = "0-9A-Za-z_"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """Every maximal run of a-z and 0-9 of the lower-cased text; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def first_tokens(c, n: int) -> Column:
    """The first n of tokens(), of which no more are cut."""
    start = F.regexp_extract(F.lower(F.coalesce(col(c), F.lit(""))), f"^(?:[^a-z0-9]*+[a-z0-9]++){{1,{n}}}", 0)
    return tokens(start)


def query_tokens(query: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", query.lower())


def boundary_pattern(phrase: str) -> str:
    """``phrase`` between ASCII word borders, in a form that Java and RE2-like engines
    read alike: a border next to a word character is the absence of another."""
    word = lambda ch: re.match(f"[{WORD_BYTES}]", ch)
    left = f"(?<![{WORD_BYTES}])" if word(phrase[0]) else f"(?<=[{WORD_BYTES}])"
    right = f"(?![{WORD_BYTES}])" if word(phrase[-1]) else f"(?=[{WORD_BYTES}])"
    return f"(?i){left}{re.escape(phrase)}{right}"


def boundary_count(c, phrase: str) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(boundary_pattern(phrase)))


def has_phrase(c, phrase: str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(boundary_pattern(phrase))


def truncate(c, most: int) -> Column:
    """Unchanged up to ``most`` characters, else cut to that with dots at the end."""
    c = col(c)
    short = F.substring(c, 1, most) if most <= 3 else F.concat(F.substring(c, 1, most - 3), F.lit("..."))
    return F.when(F.length(c) <= most, c).otherwise(short)


def snippet(c, query: str, most: int = 150) -> Column:
    """Up to 40 characters before the first hit and the rest of ``most`` after it, with
    dots on the sides that are cut; empty if nothing is found."""
    c = F.coalesce(col(c), F.lit(""))
    at = F.instr(F.lower(c), query)
    start = F.greatest(F.lit(0), at - 1 - 40)
    end = F.least(F.length(c), at - 1 + len(query) + most - 40)
    body = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(c, start + 1, end - start), F.when(end < F.length(c), "...").otherwise(""))
    return F.when((F.lit(query) == "") | (at == 0), "").otherwise(body)


def squeeze(c) -> Column:
    """White space collapsed, ends trimmed, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+", " "))


def token_estimate(c) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.expr("(octet_length(coalesce({}, '')) + 3) div 4".format(c)) if isinstance(c, str) else F.floor((F.octet_length(c) + 3) / 4)


def slug(c) -> Column:
    """a-z and 0-9 stay; runs of hyphens, spaces and underscores are one hyphen."""
    kept = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\- _]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\- _]+", "-"), r"^-|-$", "")


def decision_slug(c) -> Column:
    """Anything else is one hyphen; empty becomes ``decision``."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", "decision").otherwise(s)


def sanitized_title(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"[^a-zA-Z0-9\s-]", ""), r"\s+", "-")


def name_words(c) -> Column:
    """The words of an identifier: split at spaces, hyphens, underscores and where the
    case says so."""
    s = F.regexp_replace(col(c), r"[_\-]", " ")
    s = F.regexp_replace(s, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def camel_case(c) -> Column:
    return F.array_join(F.transform(name_words(c), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_capital(w))), "")


def pascal_case(c) -> Column:
    return F.array_join(F.transform(name_words(c), _capital), "")


def start_case(c) -> Column:
    return F.array_join(F.transform(name_words(c), _capital), " ")


def kebab_case(c) -> Column:
    return F.array_join(F.transform(name_words(c), F.lower), "-")


def snake_case(c) -> Column:
    return F.array_join(F.transform(name_words(c), F.lower), "_")


def duration_seconds(c) -> Column:
    """``1h30m45s`` and parts of it as seconds; null for anything else."""
    c = F.trim(col(c))
    ok = c.rlike(r"^(?=.)(\d+h)?(\d+m)?(\d+s)?$")
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, rf"(\d+){unit}", 1), F.lit("")), F.lit("9999999999")), F.lit(0))
    total = (part("h") * 3600 + part("m") * 60 + part("s")).cast("long")
    return F.when(ok & ((total > 0) | c.isin("0s", "0m", "0h")), total)


def policy_seconds(c) -> Column:
    """A duration as above, or a number of days such as ``30d``."""
    days = F.regexp_extract(F.trim(col(c)), r"^(\d+)d$", 1)
    return F.when(days != "", F.nullif(days, F.lit("")).cast("long") * 86400).otherwise(duration_seconds(c))


def duration_text(c) -> Column:
    """Seconds as ``2h05m``, ``2h``, ``3m07s``, ``3m`` or ``9s``."""
    c = col(c)
    h, m, s = F.floor(c / 3600), F.floor(c % 3600 / 60), c % 60
    return (
        F.when((h > 0) & ((m > 0) | (s > 0)), F.format_string("%dh%02dm", h, m))
        .when(h > 0, F.format_string("%dh", h))
        .when((m > 0) & (s > 0), F.format_string("%dm%02ds", m, s))
        .when(m > 0, F.format_string("%dm", m))
        .otherwise(F.format_string("%ds", s))
    )


def timestamp_of(c) -> Column:
    """The first of four layouts that fits, as UTC; null if none does."""
    layouts = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(x)) for x in layouts])


def byte_limited(c, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    chars = F.split(col(c), "")
    grown = F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), lambda a, x: F.struct(
        F.when(a["n"] + F.octet_length(x) <= most, F.concat(a["t"], x)).otherwise(a["t"]).alias("t"),
        F.when(a["n"] + F.octet_length(x) <= most, a["n"] + F.octet_length(x)).otherwise(F.lit(most + 1)).alias("n")))
    return F.when(F.octet_length(col(c)) <= most, col(c)).otherwise(grown["t"])


def yaml_quoted(c) -> Column:
    """A scalar as YAML text: quoted where it could be read as something else."""
    c = col(c)
    risky = c.rlike(r"""^$|^[\s\-?:,\[\]{}#&*!|>'"%@`]|[:#]\s|:$|\s$|\n""") | F.lower(c).isin("true", "false", "null", "yes", "no", "~") | c.rlike(r"^[\d.+-]+$")
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\\\\\"), '"', r'\\\\"'), "\n", r"\\\\n")
    return F.when(risky, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(c)


def is_truthy(c) -> Column:
    """Template conditions: all but empty, ``false`` and ``0``."""
    return ~F.trim(F.coalesce(col(c), F.lit(""))).isin("", "false", "0")


def unique_tokens(c, least: int = 3) -> Column:
    """Distinct a-z0-9 tokens of ``least`` characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) >= least)))


def letter_tokens(c, least: int = 3) -> Column:
    """Distinct runs of Unicode letters and digits of ``least`` bytes or more."""
    runs = F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.filter(runs, lambda t: F.octet_length(t) >= least))
