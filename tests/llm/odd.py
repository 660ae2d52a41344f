"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from pyspark.sql import functions as F

CLASHING = ["content", "digest", "sid", "n", "key", "salt", "hot", "row_id", "uid", "k", "blob", "path", "words", "token",
            "_id", "_label", "_text", "_key", "file", "leaf", "cid", "vec", "rep", "at", "group_size", "id", "spans"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def base_rows():
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    near = " ".join(f"word{i}" for i in range(200))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "ONE"), (6, "two words"), (7, line), (8, line.upper()),
        (9, line), (9, line), (10, near), (11, near.replace("word100", "other")), (12, near + " more words here"),
        (13, "É é ÉCOLE école ß 日本語 😀 ﬁ İstanbul ΟΔΟΣ"), (14, "x" * 120_000), (15, "ab " * 30_000), (None, "no id at all here"),
        (None, None), (16, "a\nb\nc\nd\ne"), (17, "q\na\nb\nc\n\nd\nr"), (18, "a\na\na\na\na\na\na\na"), (19, near), (20, "tab\tsep\x0bvt\x1cfs\x85nel\xa0nb"),
        (21, "<|endoftext|>'re x's 1234 don't  stop \n\n end "),
    ]
    return [(i, t, "en", None if i is None else f"src{i % 3}", None) for i, t in rows]


def documents(spark, rows=None, clashing=True):
    df = spark.createDataFrame(base_rows() if rows is None else rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if clashing else df
