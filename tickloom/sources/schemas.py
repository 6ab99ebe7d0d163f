"""Fixed schemas of the input and output tables."""

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("bar_ix", T.IntegerType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
    ]
)

# `pos` is the explicit input order of a headline inside its session.
HEADLINES = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("bar_ix", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("headline", T.StringType()),
    ]
)

TEXT_VECTORS = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("target_position", T.DoubleType()),
    ]
)

# Keys of a registry record.
REGISTRY = T.StructType(
    [
        T.StructField("submission_path", T.StringType()),
        T.StructField("created_at_utc", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("test_split", T.StringType()),
        T.StructField("feature_count", T.LongType()),
        T.StructField("mean_cv_sharpe", T.DoubleType()),
        T.StructField("include_headlines", T.BooleanType()),
        T.StructField("notes", T.StringType()),
        T.StructField("row_count", T.LongType()),
    ]
)
