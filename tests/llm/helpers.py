"""Small tables and brute-force versions."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs_frame(spark, rows, extra=()):
    """rows: (doc_id, text[, source]); extra: names of further columns, filled with text."""
    data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    from pyspark.sql import functions as F
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def random_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def components(ids, links):
    p = {i: i for i in ids}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
