"""Small documents with the awkward cases every operator must survive."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def documents(spark, rows):
    """``rows``: (doc_id, text) or whole rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank at dawn"
    return documents(
        spark,
        [
            (1, base),
            (2, base + " "),
            (3, None),
            (4, ""),
            (5, " \t\n"),
            (6, base),
            (6, base),
            (7, LONG),
            (8, LONG + "x"),
            (9, "naïve café straße \U0001f600 token=abc123def"),
            (None, base.upper()),
            (None, None),
            (10, "one"),
            (11, "two words"),
            (12, base, None, None, None),
        ],
    )
