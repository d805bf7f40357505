"""The registered queries: each takes (spark, sf_dir) and returns a flat DataFrame.

All of them read whole test tables through the derived captures of
``opatlas.sources.derived``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opatlas import fixed_values as V
from opatlas.functions import text as T
from opatlas.operators import (
    constants,
    findings,
    gates,
    reports,
    requests,
    schema,
    scripts,
    tokens,
    variables,
)
from opatlas.plans import catalogue as plans
from opatlas.session import materialize, new_shared_path
from opatlas.sources import capture_lines, captures, derived, findings_csv
from opatlas.streaming import stream

# Findings of captures before this moment count as stored by an earlier run.
STORED_UNTIL = "2024-01-16 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]


def _plain_time(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.captures(spark, sf_dir, "api")


def _sockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.captures(spark, sf_dir, "sockets")


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.distinct_bundles(gates.script_captures(derived.captures(spark, sf_dir, "scripts")))


def _catalogue(
    spark: SparkSession, sf_dir: str, include_assembled: bool = False
) -> DataFrame:
    return plans.catalogue(
        derived.http_exchanges(spark, sf_dir), _sockets(spark, sf_dir), include_assembled
    )


def _op_columns(ops: DataFrame) -> DataFrame:
    return ops.select(
        "capture_id", "url", "endpoint", "method", "source", "ord",
        "operation_type", "operation_name", _text("persisted_hash"), "operation_body",
    )


def _finding_columns(found: DataFrame) -> DataFrame:
    return found.select(
        *findings.KEY, "url", "method", "source", "operation_body",
        _plain_time("first_seen"), _plain_time("last_seen"), "n_seen",
    )


def _bundle_op_columns(ops: DataFrame) -> DataFrame:
    return ops.select(
        "bundle_id", "source", "ord", "operation_type", "operation_name",
        _text("persisted_hash"), "operation_body",
    )


# --- captures -----------------------------------------------------------------


def traffic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.traffic_profile(derived.http_exchanges(spark, sf_dir))


def http_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op_columns(requests.http_ops(_api(spark, sf_dir)))


def _http_ops_of(*types: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return http_ops(spark, sf_dir).where(F.col("operation_type").isin(*types))

    return query


def batched_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = _api(spark, sf_dir).where(gates.is_post() & F.col("req_body").rlike(V.BATCH_START))
    return _op_columns(requests.http_ops(batched))


def get_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op_columns(requests.http_ops(_api(spark, sf_dir).where(gates.is_get())))


def ws_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op_columns(requests.socket_ops(_sockets(spark, sf_dir)))


# --- scripts ------------------------------------------------------------------


def js_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.script_gate_profile(derived.captures(spark, sf_dir, "scripts"))


def js_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = gates.script_captures(derived.captures(spark, sf_dir, "scripts"))
    return scripts.bundle_inventory(admitted).select(
        "bundle_id", "url", _plain_time("first_seen"), "n_served", "n_chars"
    )


def _js(*extractors: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _bundle_op_columns(scripts.bundle_ops(_bundles(spark, sf_dir), list(extractors)))

    return query


def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the text cleaning, on the text of all script responses."""
    bodies = derived.captures(spark, sf_dir, "scripts").select(F.col("resp_body").alias("raw")).distinct()
    raw = F.col("raw")
    return bodies.select(
        F.sha2(raw, 256).alias("text_id"),
        T.unescape_json(raw).alias("unescaped"),
        T.unescape_script(raw).alias("unescaped_script"),
        T.collapse_spaces(raw).alias("collapsed"),
        T.flatten_concat(raw).alias("flattened"),
        T.drop_script_syntax(raw).alias("without_syntax"),
        T.keep_operation_tokens(raw).alias("sanitized"),
        T.trim_after_last_block(raw).alias("trimmed"),
        T.clean_script_text(raw).alias("cleaned"),
        T.capitalize(raw).alias("capitalized"),
    )


def js_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = constants.constants(_bundles(spark, sf_dir))
    value = T.collapse_spaces(F.col("value"))
    return table.select(
        "bundle_id",
        "name",
        "value",
        gates.is_operation(value).alias("is_operation"),
        gates.is_inline_fragment(value).alias("is_inline_fragment"),
    )


def js_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The bundles feed both the constants and the chains.
    ops = constants.assembled_ops(materialize(_bundles(spark, sf_dir)))
    return _bundle_op_columns(ops).drop("ord")


# --- findings -----------------------------------------------------------------


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding_columns(_catalogue(spark, sf_dir))


def findings_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the operations assembled from string constants among them."""
    return _finding_columns(_catalogue(spark, sf_dir, include_assembled=True))


def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.sorted_by(findings.findings_table(_catalogue(spark, sf_dir)), "operation_name")


def _stored_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings before the cut, written and read back as a table, and findings from then on."""
    exchanges, messages = derived.http_exchanges(spark, sf_dir), _sockets(spark, sf_dir)
    cut = F.col("ts") < F.lit(STORED_UNTIL).cast("timestamp")
    path = new_shared_path(spark, "findings")
    captures.write_findings(plans.catalogue(exchanges.where(cut), messages.where(cut)), path)
    arrived = plans.catalogue(exchanges.where(~cut), messages.where(~cut))
    return captures.read_findings(spark, path), arrived


def findings_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, arrived = _stored_and_new(spark, sf_dir)
    return _finding_columns(findings.new_keys(arrived, stored))


def filter_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = findings.filter_findings(
        _catalogue(spark, sf_dir), label=V.SOURCE_LABELS["HTTP_POST"], operation_type="query"
    )
    return _finding_columns(chosen)


def counts_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_cube(_catalogue(spark, sf_dir))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    exchanges = derived.http_exchanges(spark, sf_dir)
    found = reports.endpoint_inventory(exchanges)
    return found.select("host", "path", _plain_time("first_seen"), "n_calls", "n_operations")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "csv")
    findings_csv.write_findings_csv(_catalogue(spark, sf_dir), path)
    return findings_csv.read_findings_csv(spark, path).where("is_valid").drop("is_valid", "row_at", "line_no", "raw")


def _csv_of_arrived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored findings, and the arrived ones as rows of CSV files; fragments come twice, and ids once
    more in rows that stop short of the last fields."""
    stored, arrived = _stored_and_new(spark, sf_dir)
    arrived = materialize(arrived)
    path = new_shared_path(spark, "csv")
    findings_csv.write_findings_csv(arrived, path)
    findings_csv.write_findings_csv(arrived.where("operation_type = 'fragment'"), path, mode="append")
    short = findings_csv.csv_rows(arrived.where("operation_type = 'doc_id'")).select(V.CSV_COLUMNS[:6])
    short.write.csv(path, mode="append", header=True, quoteAll=True, emptyValue="", quote='"', escape='"')
    return stored, findings_csv.read_findings_csv(spark, path)


def csv_import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, rows = _csv_of_arrived(spark, sf_dir)
    return reports.import_tallies(rows, stored)


def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, rows = _csv_of_arrived(spark, sf_dir)
    return findings_csv.importable(rows, stored)


def csv_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an import leaves out; their files' names differ from run to run."""
    _, rows = _csv_of_arrived(spark, sf_dir)
    return findings_csv.rejected_rows(rows).groupBy("text").agg(F.count("*").alias("n_rows"))


def _captured_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = new_shared_path(spark, "lines")
    bodies = _api(spark, sf_dir).where(gates.is_post()).select("req_body")
    bodies.write.text(path)
    return capture_lines.ingested(spark, path)


def jsonl_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = _captured_lines(spark, sf_dir)
    return capture_lines.capture_line_ops(lines)


def jsonl_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = _captured_lines(spark, sf_dir)
    return rejected.groupBy("text").agg(F.count("*").alias("n_rows"))


# --- structure ----------------------------------------------------------------


def op_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.structure_report(_catalogue(spark, sf_dir))


def variable_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variables.variables(_catalogue(spark, sf_dir))


def variables_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variables.variables_template(_catalogue(spark, sf_dir))


def _selections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bodies = materialize(tokens.distinct_bodies(_catalogue(spark, sf_dir)))
    return bodies, schema.typed_selections(bodies)


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _selections(spark, sf_dir)
    return schema.schema_fields(rows).select("type_name", "field", "return_type")


def schema_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _selections(spark, sf_dir)
    rows = materialize(rows)
    return schema.schema_root(rows, schema.schema_types(rows)).select("root", "field", "return_type")


def schema_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies, rows = _selections(spark, sf_dir)
    args = schema.schema_args(rows, variables.declarations(bodies))
    return args.select("type_name", "field", "argument", "argument_type")


def schema_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies, rows = _selections(spark, sf_dir)
    return schema.schema_inputs(bodies, schema.schema_types(rows)).select("input_type")


def schema_sdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.schema_lines(_catalogue(spark, sf_dir))


# --- streams ------------------------------------------------------------------


def _stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts_of = gates.script_captures(derived.captures(spark, sf_dir, "scripts", stream=True))
    items = requests.exploded(_stream_exchanges(spark, sf_dir)).drop("host")
    return items.unionByName(scripts.capture_items(scripts_of))


def _stream_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.http_exchange_items(derived.captures(spark, sf_dir, "api", stream=True)).unionByName(
        requests.socket_message_items(derived.captures(spark, sf_dir, "sockets", stream=True))
    )


def _drained(query: object) -> None:
    query.awaitTermination()


def _arriving(spark: SparkSession, sf_dir: str, kind: str, n_batches: int = 2) -> DataFrame:
    """Captures of one kind as a stream of stored files, in ``n_batches`` micro-batches.

    Each micro-batch holds as many files as all tasks write, so no single task has to write or read a
    share of the table that grows with it.
    """
    rows = derived.captures(spark, sf_dir, kind)
    path = new_shared_path(spark, f"arriving-{kind}")
    n_files = max(n_batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(n_files, "capture_id").write.parquet(path)
    written = len(spark.read.parquet(path).inputFiles())  # parts without rows write no file
    per_batch = max(1, -(-written // n_batches))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def stream_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "stream-ops")
    items = requests.exploded(_stream_exchanges(spark, sf_dir)).drop("host")
    _drained(stream.write_ops(items, f"{path}/table", f"{path}/checkpoint"))
    responses = _arriving(spark, sf_dir, "scripts")
    _drained(stream.write_script_ops(responses, f"{path}/scripts", f"{path}/scripts-checkpoint"))
    ops = spark.read.parquet(f"{path}/table").unionByName(stream.published(spark, f"{path}/scripts"))
    return _op_columns(ops)


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "stream-keys")
    _drained(stream.write_first_sight(_stream_items(spark, sf_dir), f"{path}/table", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/table")


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three streams of several micro-batches each, with a compaction in between."""
    path = new_shared_path(spark, "stream-findings")
    table = f"{path}/table"

    def merge_of(kind: str, items_of: Callable[[DataFrame], DataFrame]) -> None:
        items = items_of(_arriving(spark, sf_dir, kind))
        _drained(stream.write_partials(items, findings.findings_of_exchanges, table, f"{path}/{kind}", name=kind))

    merge_of("api", requests.http_exchange_items)
    merge_of("sockets", requests.socket_message_items)
    stream.compact(spark, table)
    _drained(stream.write_script_partials(_arriving(spark, sf_dir, "scripts"), table, f"{path}/scripts"))
    return _finding_columns(stream.merged(spark, table))


QUERIES: dict[str, Query] = {
    "gql_traffic_profile": traffic_profile,
    "gql_http_ops": http_ops,
    "gql_persisted_ops": _http_ops_of("persisted"),
    "gql_doc_ids": _http_ops_of("doc_id"),
    "gql_fragments": _http_ops_of("fragment"),
    "gql_batched_ops": batched_ops,
    "gql_get_ops": get_ops,
    "gql_ws_ops": ws_ops,
    "gql_js_gate": js_gate,
    "gql_js_bundles": js_bundles,
    "gql_js_tagged": _js("tagged"),
    "gql_js_raw": _js("raw"),
    "gql_js_minified": _js("property", "quoted", "compact", "query_field", "body_field", "text_field"),
    "gql_js_hashes": _js("hash", "hex_id"),
    "gql_js_doc_ids": _js("node_name_first", "node_id_first", "query_id", "doc_id"),
    "gql_text_clean": text_clean,
    "gql_js_constants": js_constants,
    "gql_js_concat": js_concat,
    "gql_findings": all_findings,
    "gql_findings_assembled": findings_assembled,
    "gql_findings_table": findings_table,
    "gql_findings_new": findings_new,
    "gql_filter_source_type": filter_source_type,
    "gql_counts_cube": counts_cube,
    "gql_endpoints": endpoints,
    "gql_csv_roundtrip": csv_roundtrip,
    "gql_csv_import": csv_import,
    "gql_csv_import_merge": csv_import_merge,
    "gql_csv_rejected": csv_rejected,
    "gql_jsonl_ingest": jsonl_ingest,
    "gql_jsonl_rejected": jsonl_rejected,
    "gql_op_depth": op_depth,
    "gql_variables": variable_catalogue,
    "gql_variables_template": variables_template,
    "gql_schema_fields": schema_fields,
    "gql_schema_root": schema_root,
    "gql_schema_args": schema_args,
    "gql_schema_inputs": schema_inputs,
    "gql_schema_sdl": schema_sdl,
    "gql_stream_ops": stream_ops,
    "gql_stream_first_seen": stream_first_seen,
    "gql_stream_merge": stream_merge,
}
