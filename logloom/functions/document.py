"""Columns derived from one log record: routing names, error classes, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.regex import replace_all, to_java_regex
from logloom.schema import APP_GROUP_KEY

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"
DEFAULT_SUFFIX = "_logs"

# Text in a write error -> error class, most specific first.
ERROR_CLASSES = {
    "the final mapping": "multiple_type",
    "to parse field": "mapping_failed",
    "mapping": "mapping_failed",
    "mapper": "mapping_failed",
    "Data too large": "data_too_large",
    "TransportService is closed": "request_error_transport_service_closed",
    "Node not connected": "node_not_connected",
    "primary shard is not active": "inactive_primary_shard",
    "no such shard": "no_such_shard",
    "index read-only": "index_read_only",
    "Limit of total fields": "limit_of_total_fields_excedeed",
    "maximum shards open": "maximum_shards_open",
}
UNDEFINED_ERROR = "undefined_error"


def topic_name(name: Column, prefix: str = "", suffix: str = DEFAULT_SUFFIX) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(name, F.lit("")), F.lit(suffix))


def ingest_stamp(clock: Column | None = None) -> Column:
    """RFC3339 UTC seconds; the wall clock unless a column is given as the clock."""
    return F.date_format(F.current_timestamp() if clock is None else clock, RFC3339)


def rate_key(context: Column, topic: Column, key_prefix: str = "") -> Column:
    """``struct(key, max_tps)``: the app group's bucket if the app has none of its own."""
    shared = F.coalesce(context.getField("disable_app_tps"), F.lit(False))
    key = F.when(shared, F.lit(APP_GROUP_KEY)).otherwise(topic)
    quota = F.when(shared, context.getField("app_group_max_tps")).otherwise(context.getField("app_max_tps"))
    prefix = key_prefix.strip()
    if prefix:
        key = F.concat_ws(":", F.lit(prefix), key)
    return F.struct(key.alias("key"), F.coalesce(quota, F.lit(0)).alias("max_tps"))


def topic_options(context: Column, ignore: bool = False) -> Column:
    """``struct(partitions, replication)`` for a topic to create; -1 leaves it to the broker."""
    if ignore:
        return F.struct(F.lit(-1).alias("partitions"), F.lit(-1).alias("replication"))
    return F.struct(
        context.getField("kafka_partition").alias("partitions"),
        context.getField("kafka_replication_factor").alias("replication"),
    )


def index_name(prefix: Column, clock: Column, data_stream: bool = False) -> Column:
    """``prefix-yyyy.MM.dd``, or the bare prefix for a data stream."""
    return prefix if data_stream else F.concat(prefix, F.lit("-"), F.date_format(clock, "yyyy.MM.dd"))


def app_name(topic: Column, suffix: str = DEFAULT_SUFFIX) -> Column:
    """The topic without its suffix; the suffix is a pattern, not plain text."""
    return replace_all(topic, to_java_regex(f"{suffix}$"), "") if suffix else topic


def index_base(index: Column) -> Column:
    """The index name without its date."""
    return replace_all(index, r"-\d{4}\.\d{2}\.\d{2}\z", "")


def error_class(reason: Column, caused_by: Column | None = None) -> Column:
    """Class of a write error; the cause is consulted only when the reason tells nothing."""

    def classify(text: Column, otherwise: Column) -> Column:
        chain = F
        for needle, name in ERROR_CLASSES.items():
            chain = chain.when(text.contains(needle), name)
        return chain.otherwise(otherwise)

    undefined = F.lit(UNDEFINED_ERROR)
    unknown = undefined if caused_by is None else classify(caused_by, undefined)
    return F.when(F.coalesce(reason, F.lit("")) == "", F.lit("")).otherwise(classify(reason, unknown))


def log_bytes(*fields: Column, names: tuple[str, ...] = ()) -> Column:
    """Size of the encoded record: UTF-8 length of its JSON form."""
    named = [f.alias(n) for f, n in zip(fields, names, strict=True)] if names else list(fields)
    return F.octet_length(F.to_json(F.struct(*named)))


def archive_path(path: str, topic: Column, clock: Column, compressor: str = "") -> Column:
    """Object name of one archive flush."""
    ending = {"": ".log", "gzip": ".log.gz", "zstd": ".log.zst"}
    if compressor not in ending:
        raise ValueError(f"compressor {compressor!r} is not supported")
    return F.concat(
        F.lit(f"{path}/"), topic, F.lit("/"), topic, F.lit("-"), F.date_format(clock, RFC3339), F.lit(ending[compressor])
    )
