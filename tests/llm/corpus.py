"""A small corpus with the cases that every operator must stand: nulls, empty and long texts, repeats, clashing columns."""

import random

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()),
    StructField("score", DoubleType()), StructField("n_words", IntegerType()), StructField("t", StringType()), StructField("bucket", IntegerType()),
])


def words(rng, n):
    return " ".join(rng.choice("the of and alpha beta gamma delta Straße naïve x1 fox dog tree river stone cloud".split()) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(n=40, seed=3):
    """(doc_id, text, lang, source, n_chars) and columns whose names clash with results."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "one two three", words(rng, 30_000)]
    texts += [words(rng, rng.randint(1, 200)).replace(". ", ".\n") for _ in range(n)]
    texts += texts[6:10] + [t + " tail" for t in texts[10:13]] + ["Same line here.\nSame line here.\nother"] * 3
    rows = [(i, t, "en", rng.choice(["a", "b", None, "c"]), len(t or ""), 0.5, 7, "x", 1) for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, "no id at all", "en", None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
