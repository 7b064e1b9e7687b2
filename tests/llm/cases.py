"""Small tables with the awkward rows every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns, named as operators name their own.
EXTRA = ("kept", "sha", "id", "salt", "cls", "size", "token", "ids", "start", "__xsha", "label", "part")


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward():
    base = words(1, 120)
    near = base.split()
    near[7] = "changed"
    return [
        (1, base, "en", "a", 1),
        (2, base.upper(), "en", "a", 1),
        (3, " ".join(near), "de", "b", None),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \n\t ", "fr", "", 0),
        (7, "one", "en", "b", 3),
        (8, "One", "en", "b", 3),
        (9, words(2, 6000), "es", "a", 1),
        (9, words(2, 6000), "es", "a", 1),
        (None, words(3, 80), "en", None, 1),
        (11, words(3, 80) + " more", None, "c", 1),
        (12, "é 中文   ﬁn İstanbul\x00 ퟿ end", "xx", "c", 1),
        (13, "same same same " * 60, "en", "c", 1),
        (14, "same same same " * 60, "en", "c", 1),
        (-5, "a b\n\na b\r\nc", "en", "é", 1),
    ]


def frame(spark, rows=None, extra=False):
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for i, name in enumerate(EXTRA):
            df = df.withColumn(name, F.lit(i))
    return df


def collected(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def tables(spark):
    """The awkward table, plain and with clashing columns, and an empty one, each with its rows."""
    return [(frame(spark), awkward()), (frame(spark, extra=True), awkward()), (frame(spark, []), [])]
