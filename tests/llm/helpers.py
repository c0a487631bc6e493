"""Small tables with the awkward cases every operator must take."""

from pyspark.sql import functions as F

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat".split()


def prose(n, seed=1):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


def awkward():
    """(doc_id, text): nulls, empty, white space only, long, ties, repeated rows, a repeated id, odd characters."""
    long = prose(30000, 7)
    return [(1, prose(60)), (2, prose(60)), (3, None), (4, ""), (5, " \t\n"), (6, long), (7, long.replace("lorem", "larem", 3)), (8, "word"), (9, "WORD"), (10, "a  b\tc"),
            (11, "a b c"), (12, prose(60) + " extra"), (12, prose(60) + " extra"), (None, "no id here"), (None, None), (13, "x" * 20000), (14, "naïve 漢字 😀 \u0000 end"), (15, prose(61, 3)),
            (16, " ".join([prose(60)] * 2)), (15, "same id, other text")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    if extra:
        for c in ("fp", "ids", "chunk", "h", "_text", "_row", "__row", "score", "start", "kept", "n_chars"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
