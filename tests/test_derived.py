"""Captures derived from tables: what filters on them read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opatlas.sources import derived


@pytest.mark.parametrize("kind", ["api", "scripts", "sockets"])
def test_a_time_range_derives_its_own_rows_only(spark, tmp_path, kind):
    events = "1L AS event_id, timestamp'2024-01-01' AS ts, 2L AS user_id, 'view' AS event_type, 1.0D AS value, '{}' AS props"
    spark.sql(f"SELECT {events}").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 1L AS page_id, 'u' AS url, 'h' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    conversations = "1L AS conv_id, 0L AS turn, 'user' AS role, 't' AS text"
    spark.sql(f"SELECT {conversations}").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = derived.captures(spark, str(tmp_path), kind)
    found = rows.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp"))
    assert found.count() == 1 and rows.where(F.col("ts") > F.lit("2024-01-02").cast("timestamp")).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Filter")  # children stand below
