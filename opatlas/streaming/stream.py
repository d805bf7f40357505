"""Continuous runs: extraction, first sight of a key, and findings kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opatlas.functions.classify import classify
from opatlas.operators import findings, gates, scripts
from opatlas.session import materialize

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state on disk: the set of seen keys is never dropped and may outgrow memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_ops(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the operations of a stream of items to a Parquet table; stateless."""
    return (
        classify(items)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_sight(items: DataFrame) -> DataFrame:
    """Finding keys of a stream, each reported once, for ever.

    There is no watermark on purpose: a key that comes back after any time is not new.
    """
    return (
        classify(items)
        .select(
            "endpoint",
            "operation_name",
            "operation_type",
            F.coalesce("persisted_hash", F.lit("")).alias("persisted_hash"),
        )
        .dropDuplicates(findings.KEY)
    )


def write_first_sight(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    use_disk_state(items.sparkSession)
    return (
        first_sight(items)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_partials(
    captures: DataFrame,
    partials_of: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    name: str = "requests",
) -> StreamingQuery:
    """Write the partial findings of each micro-batch of captures.

    ``name`` tells streams apart that write to one path, such as requests and scripts.

    Keeping the longest body is an update, so every batch adds its own partials and readers
    merge them.  Each attempt at a batch writes a folder of its own; a record written after it
    publishes the attempt, and readers follow records only.  A batch that is run again publishes
    its new attempt in place of the old one, so nothing is counted twice, no folder that a reader
    may be on is touched, and an attempt that broke off is never read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        attempt = uuid.uuid4().hex
        findings.merge(partials_of(batch)).write.parquet(f"{path}/{_PARTIALS}/{attempt}")
        _publish(batch.sparkSession, path, {name: batch_id}, attempt)

    return _started(captures, write, checkpoint)


_PARTIALS, _COMMITS, _BUNDLES = "partials", "commits", "bundles"
_COMMIT = "name string, batch_id bigint, is_snapshot boolean, at timestamp, attempt string"


def _publish(spark: SparkSession, path: str, last: dict[str, int], attempt: str, is_snapshot: bool = False) -> None:
    """Publish a folder for a batch of each stream in ``last``.

    All records are in one file, which appears at once or not at all, so a snapshot of several streams
    is never seen in part.  ``is_snapshot``: the folder stands for all batches up to these.
    """
    rows = [(name, batch_id, is_snapshot, attempt) for name, batch_id in last.items()]
    records = spark.createDataFrame(rows, "name string, batch_id bigint, is_snapshot boolean, attempt string")
    records = records.withColumn("at", F.current_timestamp())
    records.coalesce(1).write.mode("append").parquet(f"{path}/{_COMMITS}")


def _published(spark: SparkSession, path: str) -> tuple[list[str], dict[str, int]]:
    """(folders to read, last batch of each stream): the latest snapshot and the batches after it.

    The snapshot is one folder with a record for each stream it covers; of the other records only
    those of later batches reach the driver.
    """
    commits = spark.read.schema(_COMMIT).parquet(f"{path}/{_COMMITS}")
    snapshots = commits.where("is_snapshot")
    latest = snapshots.orderBy(F.desc("at"), F.desc("attempt")).first()
    covered: dict[str, int] = {}
    if latest:
        covered = {r["name"]: r["batch_id"] for r in snapshots.where(F.col("attempt") == latest["attempt"]).collect()}
    later = F.lit(True)
    for name, batch_id in covered.items():
        later = later & ((F.col("name") != name) | (F.col("batch_id") > batch_id))
    batches = commits.where(~F.col("is_snapshot") & later).groupBy("name", "batch_id")
    chosen = batches.agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt")).collect()
    last = dict(covered)
    for r in chosen:
        last[r["name"]] = max(r["batch_id"], last.get(r["name"], -1))
    attempts = {r["attempt"] for r in chosen} | ({latest["attempt"]} if latest else set())
    return sorted(f"{path}/{_PARTIALS}/{a}" for a in attempts), last


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Findings of everything published by the streams below ``path`` so far."""
    folders, _ = _published(spark, path)
    return findings.merge(spark.read.parquet(*folders))


def compact(spark: SparkSession, path: str) -> DataFrame:
    """Publish the merged findings as a snapshot of all streams; later reads start from it.

    One record file switches all streams at once: before it readers take the old folders, after it the
    new one, and a compaction that breaks off anywhere leaves them with the old.
    """
    folders, last = _published(spark, path)
    attempt = uuid.uuid4().hex
    findings.merge(spark.read.parquet(*folders)).write.parquet(f"{path}/{_PARTIALS}/{attempt}")
    _publish(spark, path, last, attempt, is_snapshot=True)
    return merged(spark, path)


# --- scripts: every distinct text is read once, in whichever batch it comes first ------------------


def _operations_of(scripts_seen: DataFrame, path: str, attempt: str) -> DataFrame:
    """Operations of the scripts of a batch, by bundle.

    Texts whose hash some earlier batch has met are not read again: their operations come from the
    table below ``path``.  What this batch reads for the first time is added to it, with one row
    without an operation for each text, so that texts that hold none are known as well.  Should two
    attempts read one text, both rows say the same; readers drop repeats.
    """
    spark = scripts_seen.sparkSession
    bodies = scripts_seen.select(scripts.bundle_id(F.col("body")).alias("bundle_id"), "body")
    ids = bodies.select("bundle_id").distinct()
    store = f"{path}/{_BUNDLES}"
    known = spark.read.schema(_KNOWN).parquet(store) if _exists(spark, store) else spark.createDataFrame([], _KNOWN)
    unread = materialize(ids.join(known.select("bundle_id"), "bundle_id", "left_anti"))
    texts = bodies.join(unread, "bundle_id", "left_semi").groupBy("bundle_id").agg(F.first("body").alias("body"))
    found = scripts.bundle_ops(texts).select(*_OPERATION)
    read = found.unionByName(unread, allowMissingColumns=True)
    read.write.parquet(f"{store}/attempt={attempt}")
    every = spark.read.schema(_KNOWN).parquet(store).join(ids, "bundle_id", "left_semi")
    return every.where("operation_type is not null").select(*_OPERATION).dropDuplicates(["bundle_id", "ord"])


_KNOWN = (
    "bundle_id string, source string, ord bigint, operation_type string, operation_name string, "
    "persisted_hash string, operation_body string"
)
_OPERATION = [column.split(" ")[0] for column in _KNOWN.split(", ")]


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(_KNOWN).parquet(path)
    except AnalysisException:
        return False
    return True


def write_script_partials(captures: DataFrame, path: str, checkpoint: str, name: str = "scripts") -> StreamingQuery:
    """Like :func:`write_partials` for script responses: each distinct text is read once for all batches,
    and later copies only add when and where they were seen."""

    def write(batch: DataFrame, batch_id: int) -> None:
        attempt = uuid.uuid4().hex
        admitted = gates.script_captures(batch)
        ops = findings.once_per(_operations_of(admitted, path, attempt), ["bundle_id"])
        partials = findings.from_ops(scripts.at_sightings(ops, scripts.sightings(admitted)))
        findings.merge(partials).write.parquet(f"{path}/{_PARTIALS}/{attempt}")
        _publish(batch.sparkSession, path, {name: batch_id}, attempt)

    return _started(captures, write, checkpoint)


def write_script_ops(captures: DataFrame, path: str, checkpoint: str, name: str = "scripts") -> StreamingQuery:
    """Operations of script responses, a row for each response and operation; texts are read once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        attempt = uuid.uuid4().hex
        admitted = gates.script_captures(batch)
        ops = _operations_of(admitted, path, attempt)
        places = admitted.select(
            "capture_id", "ts", "url", "endpoint", F.lit("GET").alias("method"),
            scripts.bundle_id(F.col("body")).alias("bundle_id"),
        )
        places.join(ops, "bundle_id").drop("bundle_id").write.parquet(f"{path}/{_PARTIALS}/{attempt}")
        _publish(batch.sparkSession, path, {name: batch_id}, attempt)

    return _started(captures, write, checkpoint)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all published batches below ``path``."""
    folders, _ = _published(spark, path)
    return spark.read.parquet(*folders)


def _started(captures: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    stream = captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
