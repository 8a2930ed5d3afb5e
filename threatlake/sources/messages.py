"""Messages: base64 JSON bodies of collection requests and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions import fixed
from threatlake.functions.columns import is_json, word_list


def decoded(data: Column) -> Column:
    """Text of a base64 body; null when it is not base64 of valid UTF-8."""
    return F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string"))


def decode(messages: DataFrame, data_col: str = "data") -> DataFrame:
    """Add ``body``; messages that are not base64 JSON are dropped."""
    rows = messages.withColumn("body", decoded(F.col(data_col)))
    return rows.where(is_json(F.col("body")))


def requested_sources(body: Column) -> Column:
    """Sources a collection request names, or the default two."""
    named = F.from_json(body, "struct<sources:array<string>>")["sources"]
    return F.coalesce(named, word_list(fixed.DEFAULT_SOURCES))
