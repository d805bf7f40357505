"""Admission gates: which captures can hold operations at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions.columns import contains_any


def is_post() -> Column:
    return F.upper("method") == "POST"


def is_get() -> Column:
    return F.upper("method") == "GET"


def body_gate() -> Column:
    return contains_any(F.col("req_body"), V.BODY_MARKS)


def url_gate() -> Column:
    return contains_any(F.col("url"), V.URL_MARKS)


def script_type_gate() -> Column:
    return F.col("resp_content_type").rlike(V.SCRIPT_CONTENT_TYPE)


def script_text_gate() -> Column:
    return contains_any(F.col("resp_body"), V.SCRIPT_MARKS)


def socket_gate() -> Column:
    return (
        F.col("is_text")
        & (F.col("direction") == V.SOCKET_DIRECTION)
        & contains_any(F.col("payload"), V.SOCKET_MARKS)
    )


def is_operation(text: Column) -> Column:
    """Text that is an operation by itself."""
    return F.trim(text).rlike(V.IS_OPERATION)


def is_inline_fragment(text: Column) -> Column:
    return F.trim(text).rlike(V.IS_INLINE_FRAGMENT)


def script_captures(exchanges: DataFrame) -> DataFrame:
    """Script responses worth reading, as (capture_id, ts, host, url, endpoint, body)."""
    return exchanges.where(script_type_gate() & script_text_gate()).select(
        "capture_id",
        "ts",
        "host",
        "url",
        F.col("path").alias("endpoint"),
        F.col("resp_body").alias("body"),
    )


def traffic_profile(exchanges: DataFrame) -> DataFrame:
    """Captures per method and gate outcome."""
    return (
        exchanges.select(
            F.upper("method").alias("method"),
            F.coalesce(is_post() & body_gate(), F.lit(False)).alias("body_gate"),
            F.coalesce(is_get() & url_gate(), F.lit(False)).alias("url_gate"),
        )
        .groupBy("method", "body_gate", "url_gate")
        .agg(F.count("*").alias("n_captures"))
    )


def script_gate_profile(exchanges: DataFrame) -> DataFrame:
    """Script admission per content type."""
    is_script = script_type_gate()
    return (
        exchanges.where(F.col("resp_content_type").isNotNull())
        .groupBy("resp_content_type")
        .agg(
            F.count("*").alias("n_responses"),
            F.count_if(is_script).alias("n_scripts"),
            F.count_if(is_script & script_text_gate()).alias("n_admitted"),
        )
    )
