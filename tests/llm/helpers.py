"""Small tables for the corpus operators."""

import random

DOCS = "doc_id long, text string, source string, lang string, n_chars long, size int, fp string, label int, h int, target double, text_ string"


def docs(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source); the other columns clash with names used inside operators."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "en", len(r[1] or ""), 1, "x", 2, 3, 0.5, "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()) + str(rng.randrange(40)) for _ in range(n))


LONG = " ".join(f"w{i}é" for i in range(40_000))
#: Null and empty texts, white space only, ties, repeated rows, a null id, one id with two texts, a very long text.
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id here"), (5, "a b c"), (5, "other text"), (6, LONG), (7, "ünï cödé 世界 🙂 text"), (8, "x" * 5000)]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
