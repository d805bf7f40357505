"""Capture tables: schemas and readers, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from opatlas.operators.findings import KEY

HTTP_EXCHANGES = (
    "capture_id BIGINT, ts TIMESTAMP, host STRING, path STRING, url STRING, method STRING, "
    "req_body STRING, resp_content_type STRING, resp_body STRING"
)
SOCKET_MESSAGES = (
    "capture_id BIGINT, ts TIMESTAMP, url STRING, path STRING, direction STRING, "
    "is_text BOOLEAN, payload STRING"
)


def read_http_exchanges(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Exchanges stored as Parquet.  ``path`` carries its query string, ids are unique."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(HTTP_EXCHANGES).parquet(path)


def read_socket_messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(SOCKET_MESSAGES).parquet(path)


_LAYOUT = "buckets int, columns string"


def _layout(path: str) -> str:
    return f"{path.rstrip('/')}.layout"


def write_findings(found: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store findings in buckets by key, sorted within them.

    A later join by key reads the stored side as it lies: only the findings that arrived are dealt out,
    into as many parts as there are buckets (by default the session's shuffle partitions; a bucket
    should fit into a task's memory).  Their number is kept in a small file beside the table.  A table is
    never overwritten while it is read: write a new path.
    """
    spark = found.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"opatlas_findings_{uuid.uuid4().hex}"
    dealt = found.repartition(buckets, *KEY)
    dealt.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry; files at a given path stay
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    spark.createDataFrame([(buckets, columns)], _LAYOUT).coalesce(1).write.json(_layout(path))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot of all stored findings; joins by key need no exchange of it.

    Joins merge it with the other side bucket by bucket, whatever the table's size.
    """
    buckets, columns = spark.read.schema(_LAYOUT).json(_layout(path)).first()
    key = ", ".join(KEY)
    name = f"opatlas_findings_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}')"
        f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS"
    )
    return spark.table(name).hint("merge")
