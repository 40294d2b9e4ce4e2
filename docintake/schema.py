"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

from docintake.fixed_values import INFO_KEYS, RECORD_COLUMNS

INFO = T.StructType([T.StructField(k, T.StringType()) for k in INFO_KEYS])

RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in RECORD_COLUMNS])

MESSAGES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("internal_date", T.StringType()),
        T.StructField("header_date", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField(
            "parts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("part_no", T.LongType()),
                        T.StructField("filename", T.StringType()),
                        T.StructField("content", T.BinaryType()),
                    ]
                )
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)

CHAT_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("question_length", T.LongType()),
        T.StructField("answer_length", T.LongType()),
        T.StructField("question_type", T.StringType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
