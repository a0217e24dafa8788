"""Search documents and archive lines from log content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.schema import CONTENT_MISSING, FIELDS_MISSING, JSON_ERROR


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Spark moves a filter below a projection by copying the projected expression into it, which
    would parse the same JSON once per use. A one-row generator is a border it does not cross.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def search_documents(records: DataFrame, content: str = "content", timestamp: str = "timestamp") -> DataFrame:
    """Add ``document`` and ``error``: the content with ``@timestamp`` added where it is absent.

    A present ``@timestamp`` is kept even when its value is null.
    """
    parsed = once(records, _json=F.try_parse_json(content))
    written = once(parsed, _body=F.to_json("_json"))
    body = F.col("_body")
    error = (
        F.when(F.col(content).isNull(), CONTENT_MISSING)
        .when(body.isNull(), JSON_ERROR)
        .when(~body.startswith("{"), FIELDS_MISSING)
    )
    stamp = F.to_json(F.struct(F.coalesce(F.col(timestamp), F.lit("")).alias("@timestamp")))
    added = F.when(body == "{}", stamp).otherwise(
        F.concat(F.left(body, F.length(body) - 1), F.lit(","), F.right(stamp, F.length(stamp) - 1))
    )
    stamped = _at('$["@timestamp"]').isNotNull()
    return written.withColumns(
        {"document": F.when(error.isNull(), F.when(stamped, body).otherwise(added)), "error": error}
    ).drop("_json", "_body")


def archive_lines(records: DataFrame, content: str = "content", simple: bool = True) -> DataFrame:
    """Add ``line`` and ``error``: the short archive form, or the whole content when not ``simple``.

    The short form is ``{"message", "log_tag", "log_time"}``; a message that looks like JSON is
    embedded as JSON and must then be valid.
    """
    parsed = once(records, _json=F.try_parse_json(content))
    json = F.col("_json")
    unreadable = F.when(F.col(content).isNull(), CONTENT_MISSING).when(json.isNull(), JSON_ERROR)
    if not simple:
        return parsed.withColumns({"line": F.to_json(json), "error": unreadable}).drop("_json")
    picked = once(parsed, _message=_text_at('$["@message"]'), _container=_at("$.k8s_metadata.container_name"))
    message = F.col("_message")
    embedded = F.left(message, F.lit(1)).isin("{", "[")
    inner = once(picked, _inner=F.when(embedded, F.try_parse_json(message)))
    missing = F.col("_container").isNull() | (F.coalesce(message, F.lit("")) == "")
    error = unreadable.when(missing, FIELDS_MISSING).when(embedded & F.col("_inner").isNull(), JSON_ERROR)
    line = F.to_json(
        F.struct(
            F.coalesce(F.col("_inner"), message.cast(T.VariantType())).alias("message"),
            F.coalesce(_text_at("$.k8s_metadata.container_name"), F.lit("")).alias("log_tag"),
            F.coalesce(_text_at('$["@timestamp"]'), F.lit("")).alias("log_time"),
        )
    )
    return inner.withColumns({"line": F.when(error.isNull(), line), "error": error}).drop(
        "_json", "_message", "_container", "_inner"
    )


def _at(path: str) -> Column:
    """The value at a path; a JSON null is a value, a missing path is NULL."""
    return F.try_variant_get("_json", path, "variant")


def _text_at(path: str) -> Column:
    """The value at a path if it is a string."""
    return F.when(F.schema_of_variant(_at(path)) == "STRING", F.try_variant_get("_json", path, "string"))
