"""Small corpora and plain Python versions of what the operators compute."""

import random
import re

DATA = "/root/testdata/sf0.001"
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string, _h1 string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_texts():
    """Null, empty, blank, repeated, long and unusual texts."""
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "ÉTÉ", "x", "1,000", "#tag", "a|b", "Ωmega", "日本", "end."]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = "Shared line of many documents"
    out = [None, "", " ", "\n", "\n\n\t\r\n", "one", "One two", "a b c", "x" * 3000, "a\x0bb\x0cc\rd e\u0085f"]
    out += [say(n) for n in (3, 10, 60, 300, 2500)]
    out += [f"{say(8)}\n  {shared.upper() if i % 2 else shared}\t\n{say(5)}" for i in range(14)]
    base = say(120)
    out += [base] * 5 + [base + " tail", base.replace("alpha", "alpha alpha", 1)]
    out += ["same line\nsame line\nother\nsame line", "repeat me now " * 40, "!!! ### $$$ " * 30, "<|endoftext|> and <|startoftext|>"]
    return out


def rows(texts, first=0):
    """Rows with extra columns whose names clash with those of operators' results."""
    return [(first + i, t, "en", "src0", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]


def frame(spark, texts=None, extra=()):
    return spark.createDataFrame([*rows(odd_texts() if texts is None else texts), *extra], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
