"""The log envelope: one record, a batch of records sharing a context, and a topic message."""

from __future__ import annotations

from pyspark.sql import types as T

CONTEXT = T.StructType(
    [
        T.StructField("kafka_topic", T.StringType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_replication_factor", T.IntegerType()),
        T.StructField("es_index_prefix", T.StringType()),
        T.StructField("es_document_type", T.StringType()),
        T.StructField("app_max_tps", T.IntegerType()),
        T.StructField("app_secret", T.StringType()),
        T.StructField("disable_app_tps", T.BooleanType()),
        T.StructField("app_group_max_tps", T.IntegerType()),
    ]
)

ITEM = T.StructType(
    [T.StructField("timestamp", T.StringType()), T.StructField("content", T.StringType())]
)

RECORD = T.StructType(
    [
        T.StructField("context", CONTEXT),
        T.StructField("timestamp", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

COLLECTION = T.StructType(
    [T.StructField("context", CONTEXT), T.StructField("items", T.ArrayType(ITEM))]
)

HEADERS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
)

MESSAGE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("headers", HEADERS),
    ]
)

# Header key, collection marker and the error names a consumer of the
# output tables sees.
FORMAT_HEADER = "message_format"
COLLECTION_FORMAT = "TimberCollection"
PARSE_ERROR = "Protobuf Parse Error"
JSON_ERROR = "JSON Parse Error"
CONTENT_MISSING = "Timber Content Missing Error"
FIELDS_MISSING = "Timber Field Missing Error"
LIMIT_EXCEEDED = "Bandwidth Limit Exceeded"
APP_GROUP_KEY = "app_group"
