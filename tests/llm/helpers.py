"""Small documents with the awkward cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def prose(seed, n):
    rng = random.Random(seed)
    words = "the of and that oak river stone light winter market copper harbour signal garden bridge paper letter window silver mountain".split()
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def awkward():
    """Null, empty and long texts, a null id, ties, repeated rows and near copies."""
    base = prose(1, 120)
    return [
        doc(1, base),
        doc(2, base),
        doc(3, base + " coda"),
        doc(4, None),
        doc(5, ""),
        doc(6, " \n\t "),
        doc(7, prose(2, 6000)),
        doc(8, prose(3, 80)),
        doc(8, prose(3, 80)),
        doc(None, prose(4, 60)),
        doc(9, "één été – naïve ▁ 🙂\n\n日本語 " + prose(5, 30), None, None),
        doc(10, "short"),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def clashing(df):
    """The same rows with more columns, some named like those that operators make."""
    from pyspark.sql import functions as F

    for name in ("TEXT", "shard", "fp", "size", "g", "component_id", "kept", "own", "c", "host"):
        df = df.withColumn(name + "_", F.lit(1)).withColumnRenamed(name + "_", name) if name not in ("TEXT",) else df
    columns = df.columns
    return df.select("*", F.lit("other").alias("extra")).toDF(*columns, "TEXT")
