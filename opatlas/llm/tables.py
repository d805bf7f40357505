"""Reading the given tables, and small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opatlas.session import new_shared_path

# White space of the word rule: space and the characters 9 to 13.
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id's digits, modulo ``modulus``; a null id counts as an empty text."""
    digits = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(digits.cast("binary")), F.lit(modulus))


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the cluster's shared folder and read again.

    Cuts the lineage: an executor that is lost later costs a read, not a recomputation.
    """
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't hold yet (names compare without case)."""
    taken = {column.lower() for column in df.columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex}"


def sample_texts(docs: DataFrame, rows: int) -> list[str]:
    """Whole texts of at most ``rows`` ids, those with the smallest hash; null texts are left out.

    Only ids are compared; texts of the chosen ids alone reach the driver, one for each id.
    """
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.where("text is not null").join(F.broadcast(chosen), "doc_id", "left_semi")  # ``rows`` ids
    texts = found.groupBy("doc_id").agg(F.min("text").alias("text"))
    return [r["text"] for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


def most_frequent(counts: DataFrame, times: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the largest counts down to a bound that all above it pass.

    The bound comes from a histogram of the counts' magnitudes, a few hundred numbers, so no task
    sends more than its share of the result.
    """
    size = F.floor(F.log2(times) * 16)
    steps = counts.groupBy(size.alias("size")).agg(F.count("*").alias("rows"), F.min(times).alias("least"))
    total, bound = 0, None
    for row in sorted(steps.collect(), key=lambda r: -r["size"]):
        total += row["rows"]
        if total > most:
            break
        bound = row["least"]
    return counts.where(F.lit(False) if bound is None else F.col(times) >= bound)
