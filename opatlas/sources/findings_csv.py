"""Findings as CSV: export, import, and merge into stored findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.operators.findings import KEY, source_label, source_of_label
from opatlas.session import materialize
from opatlas.sources.lines import PLACE, text_lines, with_line_numbers

_MALFORMED = "_malformed"
_ROW = [*KEY, "url", "method", "source", "operation_body"]


def _one_line(text: Column) -> Column:
    """Newlines become spaces, carriage returns go; quotes are doubled by the writer."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.replace(text, F.lit("\r"), F.lit(""))


def csv_rows(found: DataFrame) -> DataFrame:
    columns = [
        "endpoint", "method", "source", "operation_type", "operation_name",
        "persisted_hash", "url", "operation_body",
    ]
    labelled = found.withColumn("source", source_label(F.col("source")))
    return labelled.select(
        *[_one_line(F.col(c)).alias(name) for c, name in zip(columns, V.CSV_COLUMNS, strict=True)]
    )


_FORMAT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_findings_csv(found: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One quoted CSV file per partition, each with the header line."""
    csv_rows(found).write.csv(path, mode=mode, header=True, quoteAll=True, emptyValue="", **_FORMAT)


def check_header(heads: DataFrame) -> None:
    """Reject files that are no findings export; the first line of every file is checked.

    Rows are read by position, so a header has to name the columns in their order; a shorter
    one may stop after the required columns.
    """
    # a header of all columns is read like any row; a shorter one is kept as it is
    cells = F.coalesce(F.split("raw", ","), F.array(*V.CSV_COLUMNS))
    names = F.transform(cells, lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    columns = F.array(*[F.lit(c) for c in V.CSV_COLUMNS])
    least = 1 + max(V.CSV_COLUMNS.index(c) for c in V.CSV_REQUIRED_COLUMNS)
    fits = (F.size(names) >= least) & (F.slice(columns, F.lit(1), F.size(names)) == names)
    line = F.left(F.array_join(cells, ","), F.lit(200)).alias("line")
    wrong = heads.where(~fits).select("file", line).orderBy("file").first()
    if wrong:
        wanted = ",".join(V.CSV_COLUMNS)
        raise ValueError(f"no findings export, {wrong['file']} begins with {wrong['line']!r}, not {wanted}")


def read_findings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export with ``is_valid``: a row with too few fields is not valid.

    Every line is parsed once and written down with its place, so rows, rejected rows and the check of
    the headers come from one pass over the files.  ``row_at`` is the row's place in the files, for
    rules that depend on file order; ``line_no`` its line in its file; ``raw`` the line, where it is
    not valid.
    """
    schema = ", ".join(f"{c} STRING" for c in [*V.CSV_COLUMNS, _MALFORMED])
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _FORMAT.items()}
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED, "maxCharsPerColumn": "-1"}
    # Blank lines count as lines, but hold no row.
    is_blank = ~F.col("value").rlike(r"[^\x00-\x20]")
    parsed = text_lines(spark, path).select("*", F.when(~is_blank, F.from_csv("value", schema, options)).alias("f"))
    valid = F.col(f"f.{_MALFORMED}").isNull() | F.col(f"f.{V.CSV_COLUMNS[-1]}").isNotNull()
    lines = materialize(
        parsed.select(
            *PLACE,
            *[F.coalesce(F.col(f"f.{c}"), F.lit("")).alias(c) for c in V.CSV_COLUMNS],
            F.col("f").isNotNull().alias("is_row"),
            valid.alias("is_valid"),
            F.when(~valid, F.col("value")).alias("raw"),
        )
    )
    numbered = with_line_numbers(lines)
    check_header(numbered.where("line_no = 1"))
    return numbered.where("line_no > 1 and is_row").select(
        F.col("Endpoint").alias("endpoint"),
        F.col("OperationName").alias("operation_name"),
        F.col("OperationType").alias("operation_type"),
        F.col("PersistedHash").alias("persisted_hash"),
        F.col("URL").alias("url"),
        F.col("Method").alias("method"),
        source_of_label(F.col("Source")).alias("source"),
        F.col("OperationSelectionBody").alias("operation_body"),
        "is_valid",
        F.struct(*PLACE).alias("row_at"),
        "line_no",
        F.when(~F.col("is_valid"), F.col("raw")).alias("raw"),
    )


def rejected_rows(rows: DataFrame) -> DataFrame:
    """Where and what the rows are that an import leaves out: (file, line_no, text)."""
    return rows.where("not is_valid").select(F.col("row_at.file").alias("file"), "line_no", F.col("raw").alias("text"))


def importable(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Valid rows whose key is not stored yet; of repeats in the files the first one."""
    first = (
        rows.where("is_valid")
        .groupBy(*KEY)
        .agg(F.min_by(F.struct("url", "method", "source", "operation_body"), "row_at").alias("row"))
        .select(*KEY, "row.*")
    )
    return first.join(stored.select(*KEY), KEY, "left_anti").select(*_ROW)
