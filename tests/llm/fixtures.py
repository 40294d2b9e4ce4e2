"""Small document tables with the hard cases."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        T.StructField("kept", T.StringType()),
        T.StructField("length", T.StringType()),
        T.StructField("print", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("of", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("line", T.StringType()),
    ]
)

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, the end."),
    (2, "The quick\tbrown \n fox jumps over the lazy dog, the end."),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "one"),
    (7, "One two"),
    (8, "été à l'école, c'était bien — naïve façade ½ ² ΑΣ Σ İstanbul"),
    (9, "漢字 🙂🙂 emoji nbsp line\x1cfile"),
    (10, "don't 'tis it's WE'LL they'd, 'the' o'clock's%%% 12.50 ,,, a1b2"),
    (11, "a  b   c\n\n\nd \n e\n f  "),
    (12, " leading and trailing "),
    (13, "<|endoftext|> and <|startoftext|>x"),
    (14, "word " * 5000),
    (15, "One two"),
    (15, "One two"),
    (15, "one TWO"),
    (None, "no id"),
    (None, "no id"),
    (16, "no id"),
    (17, "\x00 nul � ퟿"),
    (18, "x" * 3000),
    (19, "été déjà vu"),
]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", "k", "n", "o", "i", "l") for i, t in rows], DOCUMENTS)


def given(folder="/root/testdata/sf0.001"):
    """The rows (doc_id, text) of a given table."""
    import duckdb

    return duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet' order by doc_id").fetchall()
