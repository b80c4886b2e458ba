"""Documents that every operator must take: nulls anywhere, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copy int, key string, n_tokens int"


def rows():
    rng = random.Random(5)
    words = ["the", "quick", "Brown", "fox", "é", "naïve", "汉字", "token", "x1", "jumps", "over", "lazy", "dogs,", "and", "then", "sleeps."]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    near = base.split(" ")
    near[60] = "CHANGED"
    texts = [base, base, " ".join(near), base.upper(), "", None, " \t\n", "one", "one two", text(30_000), "x" * 50_000, "a\n\nb   c ", text(80), text(80) + "<|endoftext|>"]
    made = [(k, t, rng.choice(["en", "fr"]), f"s{k % 3}", None if t is None else len(t), 1.0, 9, "k", 3) for k, t in enumerate(texts)]
    made.append(made[-1])  # a repeated row
    made.append((12, "another text under a known id", None, None, None, None, None, None, None))
    made.append((None, "a text without an id", None, None, None, None, None, None, None))
    return made


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
