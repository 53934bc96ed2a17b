"""Small documents with nulls, empty, blank, very long, tied and repeated texts."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(6000))
DOCS = [
    (1, "one two three four five six seven", "en", "a"), (2, "one two three four five six seven", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", "en", "b"),
    (6, "ONE  two\nthree four FIVE six seven", "de", None), (7, "short text", "en", "c"), (8, "Short  TEXT", "en", "c"), (9, LONG, "fr", "a"), (10, LONG + " more", "fr", "b"), (9, LONG, "fr", "a"), (None, "no id here but some words", "en", "a"), (11, "é ü 日本 🎉 x", "xx", "z"),
]


def odd_documents(spark):
    """The documents above with columns whose names clash with those of operators."""
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit("x"), "part": F.lit("x"), "tie": F.lit(1), "name": F.lit("x"), "n": F.lit("x"), "group": F.lit(0), "piece": F.lit("p"), "w": F.lit("w"), "s": F.lit("s")})
