"""Small document tables for the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "river stone winter garden window letter market morning silver forest yellow copper village engine harbour summer bridge candle meadow island thunder pocket ladder marble ribbon saddle temple valley wagon basket".split()


def prose(seed, n, words=WORDS):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(n))


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


#: Names that operators might use themselves, and names that need quoting.
CLASHES = {"t": 1, "key": 2, "blob": "x", "n": 3, "root": 4, "bucket": 5, "a.b": 6, "spans": 7, "rejected_by": "y", "blank": True, "doc": 8, "path": "p", "pending": 9, "rank": 10}


def clashing(df):
    from pyspark.sql import functions as F

    for name, value in CLASHES.items():
        df = df.withColumn(name, F.lit(value))
    return df
